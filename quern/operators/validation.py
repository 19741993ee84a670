"""Checks of scenes: each is one aggregation by scene, and a summary that scores them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.expr import sdiv
from quern.operators.ranking import sized
from quern.session import checkpoint

#: Net radiation in W/m2 that counts as expected; tolerance of the sampled closure; least share of valid pixels of an area.
RN = (-200.0, 1000.0)
TOLERANCE, COVERAGE = 0.15, 0.55


def completeness(px: DataFrame, names: list[str]) -> DataFrame:
    """(scene_id, pixels, name, valid, fraction): values of each variable that aren't null; a variable that the table lacks has none."""
    have = [n for n in names if n in px.columns]
    counts = px.groupBy("scene_id").agg(F.count("*").alias("pixels"), *[F.count(n).alias(n) for n in have])
    counts = counts.withColumns({n: F.lit(0).cast("bigint") for n in names if n not in have})
    long = counts.unpivot(["scene_id", "pixels"], names, "name", "valid")
    return long.withColumn("fraction", F.col("valid") / F.col("pixels"))


def range_shares(px: DataFrame) -> DataFrame:
    """(scene_id, ndvi, emissivity, rn, rs, ok): shares of pixels in their expected ranges; ok from 0.8 of ndvi and 0.9 of the others on."""
    share = lambda c, lo, hi: F.count_if(F.col(c).between(lo, hi)) / F.count("*")
    s = px.groupBy("scene_id").agg(share("ndvi", -0.2, 1.0).alias("ndvi"), share("emissivity", 0.8, 1.0).alias("emissivity"), share("rn", *RN).alias("rn"), share("rs", 0, 1200).alias("rs"))
    return s.withColumn("ok", (F.col("ndvi") >= 0.8) & (F.col("emissivity") >= 0.9) & (F.col("rn") >= 0.9) & (F.col("rs") >= 0.9))


def sampled_closure(px: DataFrame, tolerance: float = TOLERANCE, terms: Callable[[DataFrame], DataFrame] = lambda px: px) -> DataFrame:
    """(scene_id, samples, mean_residual, mean_closure, ok) of the pixels at the centre, a quarter and three quarters of a scene's height and width.

    terms gives pixels their rn, g, h and le, if px lacks them; it gets the sampled ones only. These are found by their places, of
    which there are three for each scene, so no scene's pixels come to one task.
    """
    size = checkpoint(px.groupBy("scene_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")))
    at = lambda c, n: F.floor(F.col(c) * n / 4)
    places = size.select("scene_id", F.explode(F.array(*[F.struct(at("_h", n).cast(px.schema["y"].dataType).alias("y"), at("_w", n).cast(px.schema["x"].dataType).alias("x")) for n in (1, 2, 3)])).alias("p")).select("scene_id", "p.*")
    hint = sized(size)
    # First by place alone, which may be looked up before pixels are put together.
    s = px.join(hint(places.select("y", "x").distinct()), ["y", "x"], "left_semi").join(hint(places), ["scene_id", "y", "x"], "left_semi")
    s = terms(s)
    free = F.col("rn") - F.col("g")
    rest = free - F.col("h") - F.col("le")  # null where one of them is
    closure = F.when(free > 0, (F.col("h") + F.col("le")) / free)
    out = size.join(s.groupBy("scene_id").agg(F.count(rest).alias("samples"), F.avg(rest).alias("mean_residual"), F.avg(closure).alias("mean_closure")), "scene_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select("scene_id", F.coalesce("samples", F.lit(0)).alias("samples"), zero("mean_residual").alias("mean_residual"), zero("mean_closure").alias("mean_closure"), (F.abs(1 - zero("mean_closure")) <= tolerance).alias("ok"))


def coverage(px: DataFrame, band: str, least: float = COVERAGE, nodata: float = -9999.0) -> DataFrame:
    """(scene_id, ratio, accepted): share of pixels of an area whose band is neither no data nor 0 or less."""
    ratio = F.count_if((F.col(band) != nodata) & (F.col(band) > 0)) / F.count("*")
    return px.groupBy("scene_id").agg(ratio.alias("ratio"), (ratio >= least).alias("accepted"))


def anchor_physics(clusters: DataFrame) -> DataFrame:
    """clusters (kind, le, h, available) with shares and ok: LE 0.8 to 1 and H at most 0.2 of what is available for cold ones, 0.05 to 0.2 and 0.5 to 0.8 for hot ones."""
    le, h = sdiv(F.col("le"), F.col("available")), sdiv(F.col("h"), F.col("available"))
    cold = le.between(0.8, 1.0) & (h <= 0.2)
    hot = le.between(0.05, 0.2) & h.between(0.5, 0.8)
    return clusters.withColumns({"le_share": le, "h_share": h}).withColumn("ok", F.coalesce(F.when(F.col("kind") == "cold", cold).otherwise(hot), F.lit(False)))


def residuals(px: DataFrame) -> DataFrame:
    """px with residual, relative (to net radiation) and closure of each pixel's balance."""
    rest = F.col("rn") - F.col("g") - F.col("h") - F.col("le")
    return px.withColumns({"residual": rest, "relative": sdiv(rest, F.abs("rn")), "closure": sdiv(F.col("h") + F.col("le"), F.col("rn") - F.col("g"))})


def pattern(mean: Column) -> Column:
    """What a scene's mean ETrF says."""
    return F.when(mean >= 0.8, "Well-watered vegetation dominant").when(mean >= 0.5, "Mixed vegetation with moderate stress").when(mean >= 0.3, "Stressed vegetation or bare soil").otherwise("Dry/hot conditions or urban areas")


def quality_score(errors: Column, warnings: Column, balance: Column, physical: Column, bounds: Column, consistent: Column) -> Column:
    """1 less 0.1 an error, 0.02 a warning and a penalty for each failed check (0.2, 0.15, 0.15, 0.1); 0 to 1."""
    s = 1.0 - errors * 0.1 - warnings * 0.02
    for ok, cost in ((balance, 0.2), (physical, 0.15), (bounds, 0.15), (consistent, 0.1)):
        s = s - F.when(ok, 0.0).otherwise(cost)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def quality_flag(score: Column) -> Column:
    return F.when(score >= 0.9, "EXCELLENT").when(score >= 0.8, "GOOD").when(score >= 0.6, "FAIR").when(score >= 0.4, "POOR").otherwise("BAD")
