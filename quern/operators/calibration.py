"""Anchor pixels and the calibration of the temperature difference, by scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.energy import LATENT
from quern.functions.expr import clip
from quern.operators.quantiles import quantiles
from quern.operators.raster import beside
from quern.session import checkpoint

#: Relaxation levels, in steps of a quarter; each moves a percentile by ten times its size.
LEVELS = [i / 4 for i in range(13)]
CLUSTER, ENOUGH = 20, 5


def _ranks(start: int, sign: int) -> list[float]:
    return [(start + sign * 10 * level) / 100 for level in LEVELS]


def anchors(px: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """(scene_id, level, kind, n, ts, ndvi, rn, g): the cold and the hot cluster of each scene, medians of their pixels.

    Candidates are cut by percentiles of lst and ndvi (at level 0 of albedo and lai, too). All levels' percentiles are found
    at once, all levels' counts are another aggregation; the first level with enough of both kinds holds, else the last. A
    cluster is the coldest or hottest so many candidates, as many of either kind.
    """
    px = checkpoint(px.where("lst is not null and ndvi is not null").select("scene_id", "y", "x", "lst", "ndvi", "albedo", "lai", "rn", "g"))
    q = quantiles(px, ["scene_id"], {"lst": _ranks(15, 1) + _ranks(90, -1), "ndvi": _ranks(90, -1) + _ranks(10, 1), "albedo": [0.3, 0.7], "lai": [0.8, 0.2]})
    n = len(LEVELS)
    cuts = q.select("scene_id", F.slice("lst", 1, n).alias("_tc"), F.slice("lst", n + 1, n).alias("_th"), F.slice("ndvi", 1, n).alias("_nc"), F.slice("ndvi", n + 1, n).alias("_nh"), F.col("albedo").alias("_a"), F.col("lai").alias("_l"))
    r = lambda c: F.round(c, 6)  # noqa: E731  percentiles carry noise in their last digits
    cuts = cuts.select("scene_id", *[F.transform(c, r).alias(c) for c in cuts.columns[1:]])
    # Bounds widen with the level, so a pixel is a candidate from some level on: the first at which both of its values pass.
    d = beside(px, cuts, "scene_id").withColumns({"_t": r("lst"), "_v": r("ndvi")})
    fails = lambda bounds, bad: F.size(F.filter(bounds, bad))
    cold = F.greatest(fails("_tc", lambda x: x < F.col("_t")), fails("_nc", lambda x: x > F.col("_v")))
    hot = F.greatest(fails("_th", lambda x: x > F.col("_t")), fails("_nh", lambda x: x < F.col("_v")))
    cold = F.when((cold == 0) & ~F.coalesce((r("albedo") <= F.col("_a")[0]) & (r("lai") >= F.col("_l")[0]), F.lit(False)), 1).otherwise(cold)
    hot = F.when((hot == 0) & ~F.coalesce((r("albedo") >= F.col("_a")[1]) & (r("lai") <= F.col("_l")[1]), F.lit(False)), 1).otherwise(hot)
    kinds = F.explode(F.array(F.struct(F.lit("cold").alias("kind"), cold.alias("from")), F.struct(F.lit("hot").alias("kind"), hot.alias("from")))).alias("k")
    d = checkpoint(d.select("scene_id", "y", "x", "lst", "ndvi", "rn", "g", "_t", kinds).where(F.col("k.from") < len(LEVELS)).select("*", "k.kind", "k.from").drop("k"))
    counts = d.groupBy("scene_id", "kind", "from").agg(F.count("*").alias("n")).groupBy("scene_id").agg(F.collect_list(F.struct("kind", "from", "n")).alias("f"))  # two rows a level
    upto = lambda kind: F.transform(F.array(*map(F.lit, range(len(LEVELS)))), lambda i: F.aggregate(F.filter("f", lambda x: (x["kind"] == kind) & (x["from"] <= i)), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    counts = counts.select("scene_id", F.arrays_zip(upto("cold").alias("c"), upto("hot").alias("h")).alias("_n"))
    first = F.array_position(F.transform("_n", lambda x: (x["c"] >= ENOUGH) & (x["h"] >= ENOUGH)), True).cast("int")
    level = F.when(first > 0, first - 1).otherwise(len(LEVELS) - 1)
    counts = counts.select("scene_id", level.alias("level"), F.get("_n", level).alias("_k"))
    d = beside(d, counts, "scene_id").where(F.col("from") <= F.col("level"))
    order = Window.partitionBy("scene_id", "kind").orderBy(F.when(F.col("kind") == "cold", F.col("_t")).otherwise(-F.col("_t")), "y", "x")
    # The constant bound cuts each task's rows before the shuffle.
    d = d.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cluster).where(F.col("_r") <= F.least("_k.c", "_k.h"))
    half = F.lit(0.5)
    return d.groupBy("scene_id", "level", "kind").agg(F.count("*").alias("n"), *[F.percentile(c, half).alias(n) for c, n in (("lst", "ts"), ("ndvi", "ndvi"), ("rn", "rn"), ("g", "g"))])


def calibrate(clusters: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, dt_cold, dt_hot, le_cold, h_cold, a, valid) from the clusters of anchors() and scenes (scene_id, ta, et0, rs, rs_daily_mj).

    Latent heat of the cold cluster is what reference ET asks for, at most its available energy; a = (Rn - G) / dT of the
    hot one, 15 to 45. Valid: hotter than cold, dT of the cold cluster 0.5 K at most, positive latent heat.
    """
    side = lambda k: clusters.where(F.col("kind") == k).select("scene_id", *[F.col(c).alias(f"{c}_{k}") for c in ("ts", "rn", "g")])
    d = side("cold").join(side("hot"), "scene_id").join(scenes, "scene_id")
    et0_inst = F.when(F.col("rs_daily_mj") > 0, F.col("et0") * F.col("rs") / (F.col("rs_daily_mj") * 1e6 / 86400)).otherwise(0.0)
    free = F.col("rn_cold") - F.col("g_cold")
    d = d.withColumn("le_cold", F.least(et0_inst * LATENT / 86400, free)).withColumn("h_cold", free - F.col("le_cold"))
    d = d.withColumns({"dt_cold": F.col("ts_cold") - F.col("ta"), "dt_hot": F.col("ts_hot") - F.col("ta")})
    a = clip(F.try_divide(F.col("rn_hot") - F.col("g_hot"), F.col("dt_hot")), 15, 45)
    valid = (F.col("ts_cold") < F.col("ts_hot")) & (F.col("dt_cold") <= 0.5) & (F.col("le_cold") > 0)
    return d.select("scene_id", "dt_cold", "dt_hot", "le_cold", "h_cold", a.alias("a"), valid.alias("valid"))
