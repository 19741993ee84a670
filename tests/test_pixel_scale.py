"""Pixel queries: what keeps their seconds and their tasks from growing faster than the input."""

import re

import __spark_entry__ as entry
from quern.operators import raster, validation

from .compare import DATA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_methods_that_are_not_compiled_are_not_made(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    for name in ("rah_iterative", "cwsi_lst", "global_validation"):
        entry.queries()[name](spark, DATA)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_samples_are_taken_before_pixels_are_joined(spark):
    px = spark.createDataFrame([("a", y, x, 100.0, 10.0, 20.0, 60.0 + y) for y in range(8) for x in range(4)] + [("b", 0, 0, 1.0, 1.0, 0.0, 0.0)], "scene_id string, y bigint, x int, rn double, g double, h double, le double")
    asked = []

    def terms(s):
        asked.append(sorted((r.scene_id, r.y, r.x) for r in s.collect()))
        return s

    got = {r.scene_id: r for r in validation.sampled_closure(px, terms=terms).collect()}
    # Scene b is one pixel: all three places are its only one, whose free energy is 0.
    assert asked == [[("a", 2, 1), ("a", 4, 2), ("a", 6, 3), ("b", 0, 0)]]
    assert got["a"].samples == 3 and abs(got["a"].mean_residual - 6.0) < 1e-9 and got["b"].samples == 1
    # A join by scene would bring a quarter of all pixels of four scenes to one task.
    joins = re.findall(r"Join LeftSemi, \(*\(?\w+", plan(validation.sampled_closure(px)))
    assert len(joins) == 2


def test_moments_need_no_quantiles(spark, monkeypatch):
    monkeypatch.setattr(raster, "quantiles", None)
    px = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None)], "scene_id string, u double, v double")
    got = {r.band: tuple(r)[2:] for r in raster.moments(px, ["scene_id"], ["u", "v"]).collect()}
    assert got == {"u": (2, 1.0, 3.0, 2.0, 1.0), "v": (0, 0.0, 0.0, 0.0, 0.0)}
    assert entry.queries()["product_statistics"](spark, DATA).count() == 16
