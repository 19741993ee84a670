"""Readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import products, readers, writers


def test_files_notebooks_and_units(spark, tmp_path):
    (tmp_path / "a.py").write_text('class A:\n    """Doc."""\n    def f(self, x, *, y=1, **z):\n        return x\n')
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "1+1"}], "metadata": {}}))
    (tmp_path / "s.js").write_text("var a = 1;\nfunction f() {}\nconst g = () => 2;")
    f = readers.files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.mime for r in f.collect()}["s.js"] == "text/javascript"
    units = {(r.kind, r.name): r for r in readers.python_units(f.where("path like '%.py'")).collect()}
    assert units["function", "f"].signature == "f(self, x, *, y, **z)" and units["class", "A"].docstring == "Doc." and len(units) == 2
    nb = readers.notebooks(f.where("path like '%.ipynb'")).first()
    assert nb.text == "<!-- cell 0 [markdown] -->\n# T\nx\n\n<!-- cell 1 [code] -->\n1+1" and (nb.cell_count, nb.language) == (2, "python")
    assert [(r.name, r.line) for r in readers.js_units(f.where("path like '%.js'")).orderBy("line").collect()] == [("a", 1), ("g", 3)]
    odd = spark.createDataFrame([("a", 'x = "#no"  # yes\n# all\ny = 1\n'), ("b", "def ("), ("c", None)], "path string, text string")
    assert [r.text for r in readers.without_comments(odd).orderBy("path").collect()] == ['x = "#no"       \n     \ny = 1\n', "def (", None]
    assert readers.indentation(f.where("path like '%a.py'")).first().width == 4


def test_geojson(spark, tmp_path):
    g = {"type": "FeatureCollection", "features": [{"id": "p", "type": "Feature", "properties": {"crop": "rice"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": {"id": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    got = {r.id: len(r.rings) for r in readers.features(spark, str(tmp_path / "g.json")).collect()}
    assert got == {"p": 1, "m": 2}


def test_weather_and_benchmark(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,temperature_2m,relative_humidity_2m,wind_speed_10m,surface_pressure,shortwave_radiation,et0_fao_evapotranspiration\n2024-01-01T10:00:00,1,2,3,4,5,6\n")
    assert readers.weather(spark, str(tmp_path / "w.csv")).first().surface_pressure == 4
    (tmp_path / "short.csv").write_text("time,temperature_2m\n2024-01-01T10:00:00,1\n")
    with pytest.raises(Exception):
        readers.weather(spark, str(tmp_path / "short.csv")).collect()
    (tmp_path / "b.jsonl").write_text('{"query": "q", "gold_ids": ["1"]}\n\n')
    assert readers.benchmark(spark, str(tmp_path / "b.jsonl")).count() == 1
    (tmp_path / "x.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        readers.benchmark(spark, str(tmp_path / "x.jsonl")).collect()


def test_writers(spark, tmp_path):
    ex = spark.createDataFrame([({"question": "q", "answer": "a"},)], "payload map<string,string>")
    writers.dataset(ex, "qa_eval", str(tmp_path))
    assert json.loads(spark.read.text(str(tmp_path / "qa_eval")).first()[0]) == {"question": "q", "reference_answer": "a", "expected_documents": []}
    assert spark.read.json(str(tmp_path / "qa_eval_card")).first()["count"] == 1
    with pytest.raises(ValueError):
        writers.dataset(ex.limit(0), "sft", str(tmp_path))
    with pytest.raises(ValueError):
        writers.dataset(ex, "other", str(tmp_path))
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, writers.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    v = spark.createDataFrame([("s", "a", [1.0, 2.0]), ("t", "b", [1.0])], "space_id string, id string, embedding array<double>")
    writers.vectors(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("space_id = 's'").count() == 1
    assert {r.space_id: r.dimension for r in writers.manifest(v, "m").collect()} == {"s": 2, "t": 1}


def test_products(spark):
    names = ["NDVI_L8_OLI_2023-06-06_x.tif", "CWSI_LST_L8_oli_1_2023-06-06_a.tif", "RGB.tif", "x.tif"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(products.product_of(F.col("n")), products.date_of(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("NDVI", "2023-06-06"), ("CWSI_LST", "2023-06-06"), ("RGB", None), (None, None)]
