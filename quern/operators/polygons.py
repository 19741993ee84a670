"""Rings of pixel regions: outer borders and holes of each connected region of one class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import lattice, raster
from quern.operators.ranking import sized
from quern.session import checkpoint

_KEY = ["scene_id", "region"]
#: Steps (x, y) of the four directions: along the top of a pixel, down its right, back along its bottom and up its left.
_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def _pick(values: tuple[int, ...], d: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(d) + 1)


def border_edges(px: DataFrame) -> DataFrame:
    """(scene_id, region, d, x, y): unit edges around regions, from (x, y) in direction d, the region on their right hand; px has scene_id, y, x and region.

    The edge between two pixels of one region is met twice, once each way, and cancels.
    """
    corner = ((0, 0), (1, 0), (1, 1), (0, 1))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(cx).alias("cx"), F.lit(cy).alias("cy")) for d, (cx, cy) in enumerate(corner)])).alias("e")
    edges = px.select(*_KEY, F.col("y").cast("bigint").alias("py"), F.col("x").cast("bigint").alias("px"), each)
    edges = edges.select(*_KEY, "e.d", (F.col("px") + F.col("e.cx")).alias("x"), (F.col("py") + F.col("e.cy")).alias("y"))
    # Named by its left or upper end and whether it lies flat.
    flat = F.col("d") % 2 == 0
    low_x, low_y = F.col("x") - F.when(F.col("d") == 2, 1).otherwise(0), F.col("y") - F.when(F.col("d") == 3, 1).otherwise(0)
    once = edges.groupBy(*_KEY, flat.alias("flat"), low_x.alias("lx"), low_y.alias("ly")).agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("x").alias("x"), F.max("y").alias("y"))
    return once.where("n = 1").select(*_KEY, "d", "x", "y")


def sides(edges: DataFrame) -> DataFrame:
    """(scene_id, region, id, d, x, y, ex, ey): edges in a line as one, from (x, y) to (ex, ey); id tells sides of a region apart."""
    flat = F.col("d") % 2 == 0
    line, along = F.when(flat, F.col("y")).otherwise(F.col("x")), F.when(flat, F.col("x")).otherwise(F.col("y"))
    own = edges.withColumn("line", line).withColumn("along", along)
    island = F.col("along") - F.row_number().over(Window.partitionBy(*_KEY, "d", "line").orderBy("along"))
    runs = own.withColumn("island", island).groupBy(*_KEY, "d", "line", "island").agg(F.min("along").alias("lo"), F.max("along").alias("hi"))
    # Directions 2 and 3 run towards smaller numbers: their edges begin at the higher end.
    first, last = F.when(F.col("d") < 2, F.col("lo")).otherwise(F.col("hi")), F.when(F.col("d") < 2, F.col("hi") + 1).otherwise(F.col("lo") - 1)
    place = lambda a, c: F.when(F.col("d") % 2 == 0, a).otherwise(F.col("line")).alias(c)
    up = lambda a, c: F.when(F.col("d") % 2 == 0, F.col("line")).otherwise(a).alias(c)
    out = runs.select(*_KEY, "d", place(first, "x"), up(first, "y"), place(last, "ex"), up(last, "ey"))
    return out.withColumn("id", (F.col("y") * 2**31 + F.col("x")) * 4 + F.col("d"))


def chained(lines: DataFrame) -> DataFrame:
    """(scene_id, region, id, next): the side that goes on where each ends. Where two pixels of a region touch at a corner only, a border turns right: it keeps to its pixel."""
    ends = lines.select(*_KEY, "id", "d", F.col("ex").alias("x"), F.col("ey").alias("y"))
    begins = lines.select(*_KEY, F.col("id").alias("next"), F.col("d").alias("nd"), "x", "y")
    both = ends.join(begins, [*_KEY, "x", "y"])
    return both.groupBy(*_KEY, "id").agg(F.min_by("next", F.pmod(F.col("nd") - F.col("d") - 1, F.lit(4))).alias("next"))


def numbered(chain: DataFrame) -> DataFrame:
    """(scene_id, region, id, ring, rank): the ring that each side is in (its smallest id) and its place from there on.

    Pointers double each round: first until no side learns of a smaller one, then from the ring's first side on; as many
    rounds as the logarithm of the longest ring's sides.
    """
    state = checkpoint(chain.withColumn("ring", F.least("id", "next")).withColumn("to", F.col("next")))
    while True:
        ahead = state.select(*_KEY, F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"))
        after = state.join(ahead, [*_KEY, "to"]).select(*_KEY, "id", "next", F.least("ring", "_ring").alias("ring"), F.col("_to").alias("to"), (F.col("_ring") < F.col("ring")).alias("new"))
        after = checkpoint(after)
        done = after.where("new").isEmpty()
        state = after.drop("new")
        if done:
            break
    before = state.select(*_KEY, "ring", F.col("next").alias("id"), F.col("id").alias("back"))
    first = F.col("id") == F.col("ring")
    rank = checkpoint(before.select(*_KEY, "ring", "id", F.when(first, F.col("id")).otherwise(F.col("back")).alias("back"), F.when(first, 0).otherwise(1).cast("bigint").alias("rank")))
    while True:
        far = rank.select(*_KEY, F.col("id").alias("back"), F.col("back").alias("_back"), F.col("rank").alias("_rank"))
        after = checkpoint(rank.join(far, [*_KEY, "back"]).select(*_KEY, "ring", "id", F.col("_back").alias("back"), (F.col("rank") + F.col("_rank")).alias("rank")))
        done = after.where("back <> ring").isEmpty()
        rank = after
        if done:
            break
    return rank.select(*_KEY, "id", "ring", "rank")


#: Pixels of a region up to which its rings are found within a task.
SMALL = 20_000


def rings(px: DataFrame, cls: str) -> DataFrame:
    """(scene_id, class, region, ring, hole, area, length, points) of the borders of all 4-connected regions of a class.

    region: the smallest pixel number in it; area: in pixels, negative for holes; points: the corners in order, as
    struct<px, py>, with the region on the right hand as one goes, without the first one again at the end. Pixels without a
    class belong to no region. Regions of up to SMALL pixels are dealt out whole, so their pixels move once; of a larger one
    sides are joined by pointers, and only a ring comes together, as one row.
    """
    own = checkpoint(raster.regions(px, cls))
    large = checkpoint(own.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*_KEY))
    few = sized(large)
    dealt = own.join(few(large), _KEY, "left_anti").select(*_KEY, "y", "x", F.col(cls).alias("class")).repartition(*_KEY).sortWithinPartitions(*_KEY)
    kind = f"scene_id {own.schema['scene_id'].dataType.simpleString()}, class {own.schema[cls].dataType.simpleString()}, region bigint, ring bigint, hole boolean, area double, length bigint, points array<struct<px:double,py:double>>"
    small = dealt.mapInArrow(_rings_of_whole, kind)
    return small if large.isEmpty() else small.unionByName(_rings_by_pointers(own.join(few(large), _KEY, "left_semi"), cls))


def _rings_of_whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in lattice.whole(parts, _KEY):
        r = lattice.rings(lattice.codes(t, *_KEY), t.column("y").to_numpy(), t.column("x").to_numpy())
        own = t.take(pa.array(r["at"]))
        points = pa.ListArray.from_arrays(np.append(0, np.cumsum(r["corners"])).astype(np.int32), pa.StructArray.from_arrays([r["px"], r["py"]], ["px", "py"]))
        columns = [*(own.column(c).combine_chunks() for c in ("scene_id", "class", "region")), r["ring"], r["twice"] < 0, r["twice"] / 2, r["length"], points]
        yield from pa.table(dict(zip(("scene_id", "class", "region", "ring", "hole", "area", "length", "points"), columns, strict=True))).to_batches()


def _rings_by_pointers(own: DataFrame, cls: str) -> DataFrame:
    lines = checkpoint(sides(border_edges(own)))
    found = lines.join(numbered(chained(lines)), [*_KEY, "id"])
    twice = F.sum(F.col("x") * F.col("ey") - F.col("ex") * F.col("y"))
    length = F.sum(F.abs(F.col("ex") - F.col("x")) + F.abs(F.col("ey") - F.col("y")))
    corners = F.array_sort(F.collect_list(F.struct("rank", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))))
    out = found.groupBy(*_KEY, "ring").agg((twice / 2).alias("area"), length.alias("length"), corners.alias("c"))
    classes = own.groupBy(*_KEY).agg(F.first(cls).alias("class"))
    points = F.transform("c", lambda p: F.struct(p["px"].alias("px"), p["py"].alias("py")))
    return out.join(classes, _KEY).select("scene_id", "class", "region", "ring", (F.col("area") < 0).alias("hole"), "area", "length", points.alias("points"))


def polygons(px: DataFrame, cls: str) -> DataFrame:
    """(scene_id, class, region, outer, holes, area): one polygon for each region: its outer ring's points, those of its holes, and its area in pixels."""
    r = rings(px, cls)
    outer = F.first(F.when(~F.col("hole"), F.col("points")), ignorenulls=True)
    holes = F.transform(F.array_sort(F.collect_list(F.when(F.col("hole"), F.struct("ring", "points")))), lambda h: h["points"])
    return r.groupBy("scene_id", "class", "region").agg(outer.alias("outer"), holes.alias("holes"), F.sum("area").alias("area"))
