"""Grids: alignment by snapped cells, resampling, and weather points spread over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.raster import TILE, beside, haloed


def snap(x: Column, origin: float, step: float) -> Column:
    """Number of the cell that a coordinate lies in; a hair over a border counts as on it."""
    return F.floor((x - origin) / step + 1e-9).cast("bigint")


def align(left: DataFrame, right: DataFrame, step: float, band: str) -> DataFrame:
    """left (lon, lat) with the mean of right's band in the same cell of a grid; null where right has none. One equi-join on whole numbers."""
    cells = right.groupBy(snap(F.col("lon"), 0.0, step).alias("_i"), snap(F.col("lat"), 0.0, step).alias("_j")).agg(F.avg(band).alias(band))
    own = left.withColumn("_i", snap(F.col("lon"), 0.0, step)).withColumn("_j", snap(F.col("lat"), 0.0, step))
    return own.join(cells, ["_i", "_j"], "left").drop("_i", "_j")


def resample(px: DataFrame, band: str, factor: int) -> DataFrame:
    """A coarser grid by nearest neighbour: of each square of factor pixels the one at its middle, else the first there is."""
    mid = factor // 2
    off = F.abs(F.col("y") % factor - mid) + F.abs(F.col("x") % factor - mid)
    return px.groupBy("scene_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.min_by(band, F.struct(off, px["y"], px["x"])).alias(band))


#: How far kernels reach, in source pixels.
_REACH = {"bilinear": 1, "cubic": 2}


def _weight(kernel: str, d: Column) -> Column:
    """The kernel's weight of a source pixel at a distance; cubic: the convolution kernel with a = -1/2."""
    a = F.abs(d)
    if kernel == "bilinear":
        return F.greatest(1 - a, F.lit(0.0))
    return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)


def interpolated(px: DataFrame, band: str, step: float, kernel: str = "bilinear") -> DataFrame:
    """(scene_id, y, x, band): the scenes on a grid whose pixels are step source pixels wide, by a kernel over source pixels around each new one's centre.

    Missing pixels and those without a value have no weight, the others share it; a new pixel without any neighbour of a value,
    or whose weights cancel, is left out. Source pixels move once, with a halo of the kernel's reach around each tile; within a tile they
    are sent to the new pixels that they have a weight in.
    """
    reach = _REACH[kernel]
    ends = px.groupBy("scene_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    tiled = haloed(beside(px.where(F.col(band).isNotNull()).select("scene_id", "y", "x", F.col(band).cast("double").alias("_v")), ends, "scene_id"), reach)
    first = lambda c: F.ceil((F.col(c) - reach + 0.5) / step - 0.5).cast("bigint")
    last = lambda c: F.floor((F.col(c) + reach + 0.5) / step - 0.5).cast("bigint")
    to = lambda c: F.explode(F.when(first(c) <= last(c), F.sequence(first(c), last(c))))
    sent = tiled.withColumn("cy", to("y")).withColumn("cx", to("x"))
    sent = sent.withColumn("_u", (F.col("cy") + 0.5) * step - 0.5).withColumn("_t", (F.col("cx") + 0.5) * step - 0.5)
    sent = sent.where("cy >= 0 AND cx >= 0 AND _u < _h + 0.5 AND _t < _w + 0.5").where((F.floor(F.col("_u") / TILE) == F.col("ty")) & (F.floor(F.col("_t") / TILE) == F.col("tx")))
    w = _weight(kernel, F.col("_u") - F.col("y")) * _weight(kernel, F.col("_t") - F.col("x"))
    out = sent.withColumn("_k", w).groupBy("scene_id", "ty", "tx", "cy", "cx").agg(F.sum(F.col("_k") * F.col("_v")).alias("_s"), F.sum("_k").alias("_k"))
    return out.where("abs(_k) > 1e-6").select("scene_id", F.col("cy").alias("y"), F.col("cx").alias("x"), (F.col("_s") / F.col("_k")).alias(band))


def crop_pad(px: DataFrame, height: int, width: int) -> DataFrame:
    """Every place of a height x width grid of each scene; places that px lacks have nulls, pixels beyond are dropped."""
    places = px.select("scene_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(height - 1).cast("bigint")))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return places.join(px, ["scene_id", "y", "x"], "left")


def spread(px: DataFrame, stations: DataFrame, value: str, k: int = 3) -> DataFrame:
    """px (lon, lat) with value from a bounded set of stations (station, lon, lat, value): the k nearest, weighted by inverse squared distance; at a station its own.

    Stations are one array beside each pixel, so no pairs are shuffled and pixels never move.
    """
    near = stations.agg(F.array_sort(F.collect_list(F.struct("station", F.col("lon").alias("sx"), F.col("lat").alias("sy"), F.col(value).cast("double").alias("v")))).alias("_s"))
    d = px.crossJoin(F.broadcast(near))  # one row
    dist = F.transform("_s", lambda s: F.struct(F.round(F.pow(s["sx"] - F.col("lon"), 2) + F.pow(s["sy"] - F.col("lat"), 2), 12).alias("d"), s["station"].alias("station"), s["v"].alias("v")))
    d = d.withColumn("_s", F.slice(F.array_sort(dist), 1, k))
    total = F.aggregate("_s", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda t, s: F.struct((t["a"] + s["v"] / F.greatest(s["d"], F.lit(1e-12))).alias("a"), (t["b"] + 1 / F.greatest(s["d"], F.lit(1e-12))).alias("b")))
    return d.withColumn(value, F.when(F.col("_s")[0]["d"] == 0, F.col("_s")[0]["v"]).otherwise(total["a"] / total["b"])).drop("_s")
