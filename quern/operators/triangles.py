"""Linear interpolation over a Delaunay triangulation of stations; outside their hull the nearest station's value.

A key's stations are triangulated tile by tile. A triangle whose circle lies within its tile is one of the whole key's; only
points that have others, or stand at a border of settled triangles, go on to the next larger tile.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import sized

#: Stations of one key at most that triangulated() takes, which makes a key's triangles in one task.
STATIONS = 5000
#: Stations of a tile at most; halvings of a key's square at most; halvings from one tile to the next larger one.
LEAF, DEPTH, STEP = 500, 20, 2
#: A point this little beyond a side still counts as inside.
HAIR = 1e-9


def _turn(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed areas of triangles of point numbers; positive if they turn left. The sign is exact."""
    return _cross(p[a], p[b], p[c])


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed areas of triangles of points, with exact signs: what rounding might decide is done again in fractions."""
    a, b, c = np.broadcast_arrays(a, b, c)
    u, v = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    out, size = u - v, np.abs(u) + np.abs(v)
    for i in np.flatnonzero((np.abs(out) <= 1e-15 * size) & (size > 0)):
        (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(x)) for x in q[i]] for q in (a, b, c))
        out[i] = float((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    return out


def _circle_terms(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The determinant that tells whether the origin lies in the circles of triangles d, and the size of its terms."""
    s = (d**2).sum(2)
    x, y = d[:, :, 0], d[:, :, 1]
    out = size = 0.0
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        u, v = x[:, j] * y[:, k], x[:, k] * y[:, j]
        out, size = out + s[:, i] * (u - v), size + s[:, i] * (np.abs(u) + np.abs(v))
    return out, size


def _in_circle(p: np.ndarray, t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positive for triangles (turning left) whose circle has q inside. The sign is exact."""
    out, size = _circle_terms(p[t] - q)
    for i in np.flatnonzero((np.abs(out) <= 4e-15 * size) & (size > 0)):
        qx, qy = Fraction(float(q[0])), Fraction(float(q[1]))
        (ax, ay), (bx, by), (cx, cy) = ((Fraction(float(x)) - qx, Fraction(float(y)) - qy) for x, y in p[t[i]])
        s = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        out[i] = (s > 0) - (s < 0)
    return out


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (three numbers each, turning left) of distinct points, by insertion; none if all lie on a line.

    Beside each side of the hull there is a triangle with a corner at infinity (-1, its last), whose circle is the half plane
    outside; so the hull needs no points of its own, and flat triangles at its border are not missed.
    """
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), int)
    turns = _cross(p[0], p[1], p[2:])
    if not turns.any():
        return np.zeros((0, 3), int)
    third = int(np.flatnonzero(turns)[0]) + 2
    a, b, c = (0, 1, third) if turns[third - 2] > 0 else (1, 0, third)
    t = np.array([(a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)])
    for k in (x for x in range(2, n) if x != third):
        q, ghost = p[k], t[:, 2] < 0
        bad = np.zeros(len(t), bool)
        bad[~ghost] = _in_circle(p, t[~ghost], q) > 0
        u, v = p[t[ghost, 0]], p[t[ghost, 1]]
        side = _cross(u, v, q)
        between = ((q - u) * (q - v)).sum(1) < 0
        bad[ghost] = (side > 0) | (side == 0) & between
        gone = t[bad]
        edges = np.concatenate([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]])
        own = set(map(tuple, edges.tolist()))
        border = [(x, y) for x, y in own if (y, x) not in own]
        new = [(x, y, k) if x >= 0 and y >= 0 else (y, k, -1) if x < 0 else (k, x, -1) for x, y in border]
        t = np.concatenate([t[~bad], np.array(new).reshape(-1, 3)])
    return t[t[:, 2] >= 0]


def settled(p: np.ndarray, border: np.ndarray, box: tuple[float, float, float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles, border, open) of the points p of a tile: triangles that no point outside the box (x0, y0, x1, y1) can change, all for None; the border of what is settled so far, as directed sides with the settled area on their left; and which points the next larger tile needs.

    Points within the settled area are left out, so triangles of p that lie there (on the left of the border given) are none.
    Triangles on one circle, which any choice may cut, are settled together.
    """
    n, t = len(p), delaunay(p)
    if not len(t):
        return t, border, np.ones(n, bool)
    sides = t[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
    code, back = sides[:, 0] * n + sides[:, 1], sides[:, 1] * n + sides[:, 0]
    owner, order = np.repeat(np.arange(len(t)), 3), np.argsort(code)
    at = np.minimum(np.searchsorted(code[order], back), len(code) - 1)
    other = np.where(code[order][at] == back, owner[order][at], -1)
    walls = border[:, 0] * n + border[:, 1]
    if not np.isin(walls, code).all():
        raise RuntimeError("a side of settled triangles is missing in a larger tile")
    left, right = np.isin(code, walls), np.isin(back, walls)
    inner = np.zeros(len(t), bool)
    inner[owner[left]] = True
    free = (other >= 0) & ~left & ~right
    _flood(inner, owner[free], other[free])
    if inner[owner[right]].any():
        raise RuntimeError("settled triangles overlap")
    final = ~inner
    if box is not None:
        a, b, c = (p[t[:, i]] for i in range(3))
        d, e = b - a, c - a
        twice = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        dd, ee = (d**2).sum(1), (e**2).sum(1)
        with np.errstate(all="ignore"):
            mx, my = (e[:, 1] * dd - d[:, 1] * ee) / (2 * twice), (d[:, 0] * ee - e[:, 0] * dd) / (2 * twice)
            r = np.sqrt(mx**2 + my**2) * (1 + 1e-6) + 1e-9 * (box[2] - box[0])
            x, y = a[:, 0] + mx, a[:, 1] + my
            # The circle of a triangle nearly without area is not known well enough.
            inside = (twice > 1e-9 * np.maximum(dd, ee)) & (x - r > box[0]) & (y - r > box[1]) & (x + r < box[2]) & (y + r < box[3])
        det, size = _circle_terms(p[t[owner]] - p[t[np.maximum(other, 0)]][np.arange(len(owner)), _opposite(t, sides, other)][:, None])
        same = free & (np.abs(det) <= 1e-11 * size)
        loose = ~inside & ~inner
        _flood(loose, owner[same], other[same])
        final &= ~loose
    now = np.concatenate([walls, code[np.repeat(final, 3)]])
    now = now[~np.isin((now % n) * n + now // n, now)]
    border = np.stack([now // n, now % n], 1)
    still, any_ = np.zeros(n, bool), np.zeros(n, bool)
    any_[t.ravel()] = True
    still[t[~final & ~inner].ravel()] = True
    still[border.ravel()] = True
    return t[final], border, still | ~any_


def _flood(on: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Turn on what pairs (a, b) link to something that is on."""
    while (new := b[on[a] & ~on[b]]).size:
        on[new] = True


def _opposite(t: np.ndarray, sides: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which corner of the triangle beyond each side is not on it."""
    there = t[np.maximum(other, 0)]
    return np.argmax((there != sides[:, :1]) & (there != sides[:, 1:]), axis=1)


_TRIANGLE = "k bigint, t int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, v0 double, v1 double, v2 double, ox double, oy double, step double, cx array<int>, cy array<int>"


def triangulated(stations: DataFrame, key: str, value: str) -> DataFrame:
    """(k, t, corners and their values, the key's grid and the cells that each triangle's box touches) of stations (key bigint, lon, lat, value).

    Stations of one place count once, by their mean; those without a place or value not at all. A key of more than STATIONS
    stations is an error.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > STATIONS:
            raise ValueError(f"more than {STATIONS} stations of one key")
        pdf = pdf.sort_values(["lon", "lat"])
        p, v = pdf[["lon", "lat"]].to_numpy(), pdf["v"].to_numpy()
        t = delaunay(p)
        x, y = p[t][:, :, 0], p[t][:, :, 1]
        step = max(float(np.ptp(p, axis=0).max()), 1e-9) / max(1, round(len(p) ** 0.5))
        lo = p.min(0)
        cells = lambda c, o: [list(range(int(np.floor((a - o) / step)), int(np.floor((b - o) / step)) + 1)) for a, b in zip(c.min(1), c.max(1), strict=True)]
        columns = {f"{n}{i}": c[:, i] for i in range(3) for n, c in (("x", x), ("y", y), ("v", v[t]))}
        return pd.DataFrame({"k": pdf["k"].iloc[0], "t": range(len(t)), **columns, "ox": lo[0], "oy": lo[1], "step": step, "cx": pd.Series(cells(x, lo[0]), dtype=object), "cy": pd.Series(cells(y, lo[1]), dtype=object)})

    own = stations.select(F.col(key).cast("bigint").alias("k"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col(value).cast("double").alias("v")).dropna()
    own = own.groupBy("k", "lon", "lat").agg(F.avg("v").alias("v"))
    columns = [c.split()[0] for c in _TRIANGLE.split(", ")]
    return own.groupBy("k").applyInPandas(lambda pdf: of(pdf)[columns], _TRIANGLE)


_CORNERS = [f"{n}{i}" for i in range(3) for n in "xyv"]
_PART = "k bigint, cx bigint, cy bigint, kind string, " + ", ".join(f"{c} double" for c in _CORNERS)


def _merge(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of the rows of a tile of so many halvings: points (p) and sides (s) in; triangles (t), points and sides out."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        cx, cy, side = int(first["cx"]), int(first["cy"]), float(first["unit"]) * 2.0 ** (DEPTH - level)
        box = (first["ox"] + cx * side, first["oy"] + cy * side, first["ox"] + (cx + 1) * side, first["oy"] + (cy + 1) * side) if level else None
        own = pdf[pdf["kind"] == "p"].sort_values(["x0", "y0"])
        p, v = own[["x0", "y0"]].to_numpy(), own["v0"].to_numpy()
        number = {place: i for i, place in enumerate(map(tuple, p.tolist()))}
        ends = pdf.loc[pdf["kind"] == "s", ["x0", "y0", "x1", "y1"]].to_numpy().tolist()
        border = np.array([(number[x0, y0], number[x1, y1]) for x0, y0, x1, y1 in ends], int).reshape(-1, 2)
        t, border, still = settled(p, border, box)
        out = [pd.DataFrame({"kind": "t", **{f"{n}{i}": c[t[:, i]] for i in range(3) for n, c in (("x", p[:, 0]), ("y", p[:, 1]), ("v", v))}})]
        if level:
            out.append(pd.DataFrame({"kind": "p", "x0": p[still, 0], "y0": p[still, 1], "v0": v[still]}))
            out.append(pd.DataFrame({"kind": "s", **{f"{n}{i}": p[border[:, i], j] for i in range(2) for j, n in enumerate("xy")}}))
        out = pd.concat([o for o in out if len(o)] or out[:1])
        out[["k", "cx", "cy"]] = int(first["k"]), cx, cy
        return out.reindex(columns=["k", "cx", "cy", "kind", *_CORNERS])

    return of


def _cell(c: str, level: str) -> str:
    """SQL of the tile, of so many halvings, that a place of the finest grid lies in."""
    return f"shiftright({c}, {DEPTH} - {level})"


def tiled(stations: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(squares, places, triangles) of stations (key bigint, lon, lat, value), however many a key has.

    squares (k, ox, oy, unit): each key's square, whose side is 2 ** DEPTH units. places (k, lon, lat, v, level, cx, cy): stations with their
    tile; those of one place count once, by their mean, those without a place or value not at all. triangles (k, corners and their values).
    """
    from quern.session import checkpoint

    own = stations.select(F.col(key).cast("bigint").alias("k"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col(value).cast("double").alias("v")).dropna()
    own = checkpoint(own.groupBy("k", "lon", "lat").agg(F.avg("v").alias("v")))
    most = F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"), F.lit(1e-9))
    squares = checkpoint(own.groupBy("k").agg(F.min("lon").alias("ox"), F.min("lat").alias("oy"), (most / 2**DEPTH).alias("unit")))
    at = lambda c, o: F.least(F.floor((F.col(c) - F.col(o)) / F.col("unit")), F.lit(2**DEPTH - 1)).cast("bigint")
    beside = sized(squares)
    own = own.join(beside(squares), "k").select("k", "lon", "lat", "v", at("lon", "ox").alias("ix"), at("lat", "oy").alias("iy"))
    # A station's tile is the largest one that isn't too full.
    levels = own.select("*", F.explode(F.array(*map(F.lit, range(0, DEPTH, STEP)))).alias("l")).select("k", "lon", "lat", "l", F.expr(_cell("ix", "l")).alias("cx"), F.expr(_cell("iy", "l")).alias("cy"))
    full = checkpoint(levels.groupBy("k", "l", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).drop("n"))
    below = levels.join(sized(full)(full), ["k", "l", "cx", "cy"], "left_semi").groupBy("k", "lon", "lat").agg((F.max("l") + STEP).alias("level"))
    own = own.join(below, ["k", "lon", "lat"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    own = checkpoint(own.select("k", "lon", "lat", "v", "level", F.expr(_cell("ix", "level")).alias("cx"), F.expr(_cell("iy", "level")).alias("cy")))
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, rest = own.sparkSession.createDataFrame([], _PART), None
    for level in range(own.agg(F.max("level")).first()[0] or 0, -1, -STEP):
        here = own.where(F.col("level") == level).select("k", "cx", "cy", F.lit("p").alias("kind"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("v").alias("v0"), *[F.lit(None).cast("double").alias(c) for c in _CORNERS[3:]])
        here = here if rest is None else here.unionByName(rest.withColumn("cx", F.shiftright("cx", STEP)).withColumn("cy", F.shiftright("cy", STEP)))
        # Few bytes, but much to do for each tile.
        out = here.join(beside(squares), "k").repartition(tasks, "k", "cx", "cy").groupBy("k", "cx", "cy").applyInPandas(_merge(level), _PART)
        out = checkpoint(out)
        done, rest = done.unionByName(out.where("kind = 't'")), out.where("kind <> 't'")
    return squares, own, done.select("k", *_CORNERS)


def linear(px: DataFrame, stations: DataFrame, key: str, value: str) -> DataFrame:
    """px (key, lon, lat) with value: linear between the stations of the key, outside their hull that of the nearest one (of the first of equally near ones, by place); null for a key without stations.

    Each place is looked up once. Triangles lie in cells of about their own size, so a place meets those of its cell at each
    size, then by its weights in each; places outside meet the tiles that may hold the nearest station.
    """
    from quern.session import checkpoint

    squares, own, tri = tiled(stations, key, value)
    low, high = lambda n: F.least(f"{n}0", f"{n}1", f"{n}2"), lambda n: F.greatest(f"{n}0", f"{n}1", f"{n}2")
    size = F.greatest(high("x") - low("x"), high("y") - low("y"))
    tri = tri.join(sized(squares)(squares), "k").withColumn("l", F.greatest(F.least(F.lit(DEPTH) - F.ceil(F.log2(size / F.col("unit"))), F.lit(DEPTH)), F.lit(0)).cast("int")).withColumn("side", F.col("unit") * F.pow(F.lit(2.0), DEPTH - F.col("l")))
    cells = lambda n: F.explode(F.sequence(F.floor((low(n) - F.col(f"o{n}")) / F.col("side") - HAIR), F.floor((high(n) - F.col(f"o{n}")) / F.col("side") + HAIR)))
    spread = checkpoint(tri.select("*", cells("x").alias("cx")).select("k", "l", *_CORNERS, "cx", cells("y").alias("cy")))
    levels = squares.join(spread.groupBy("k").agg(F.collect_set("l").alias("_l")), "k", "left")
    places = px.where("lon is not null and lat is not null").select(F.col(key).cast("bigint").alias("k"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).distinct()
    places = checkpoint(places.join(sized(squares)(levels), "k"))
    probes = places.select("k", "lon", "lat", "ox", "oy", "unit", F.explode("_l").alias("l")).withColumn("side", F.col("unit") * F.pow(F.lit(2.0), DEPTH - F.col("l")))
    probes = probes.select("k", "lon", "lat", "l", F.floor((F.col("lon") - F.col("ox")) / F.col("side")).alias("cx"), F.floor((F.col("lat") - F.col("oy")) / F.col("side")).alias("cy"))
    met = probes.join(sized(spread)(spread), ["k", "l", "cx", "cy"])
    # A triangle without area, which points on a line may make, holds no point.
    whole = "((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))"
    met = met.withColumn("w1", F.expr(f"try_divide((lon - x0) * (y2 - y0) - (lat - y0) * (x2 - x0), {whole})")).withColumn("w2", F.expr(f"try_divide((x1 - x0) * (lat - y0) - (y1 - y0) * (lon - x0), {whole})"))
    met = met.where((F.col("w1") >= -HAIR) & (F.col("w2") >= -HAIR) & (F.col("w1") + F.col("w2") <= 1 + HAIR))
    inside = checkpoint(met.groupBy("k", "lon", "lat").agg(F.min_by(F.expr("v0 + w1 * (v1 - v0) + w2 * (v2 - v0)"), F.struct("x0", "y0", "x1", "y1", "x2", "y2")).alias("_in")))
    # Outside, tiles are left out by their boxes: each holds a station, so none is needed that begins beyond the farthest corner of another.
    tiles = checkpoint(own.groupBy("k", "level", "cx", "cy").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.collect_list(F.struct(F.col("lon").alias("sx"), F.col("lat").alias("sy"), "v")).alias("_s")))
    boxes = tiles.groupBy("k").agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", "level", "cx", "cy")).alias("_b"))
    square = lambda c: c * c
    far = lambda b, n: F.greatest(F.abs(b[f"{n[0]}0"] - F.col(n[1])), F.abs(b[f"{n[0]}1"] - F.col(n[1])))
    near = lambda b, n: F.greatest(b[f"{n[0]}0"] - F.col(n[1]), F.col(n[1]) - b[f"{n[0]}1"], F.lit(0.0))
    x, y = ("x", "lon"), ("y", "lat")
    outside = places.select("k", "lon", "lat").join(inside, ["k", "lon", "lat"], "left_anti").join(sized(squares)(boxes), "k")
    outside = outside.withColumn("_far", F.array_min(F.transform("_b", lambda b: square(far(b, x)) + square(far(b, y)))))
    outside = outside.select("k", "lon", "lat", F.explode(F.filter("_b", lambda b: square(near(b, x)) + square(near(b, y)) <= F.col("_far") * (1 + HAIR))).alias("b")).select("k", "lon", "lat", "b.level", "b.cx", "b.cy")
    outside = outside.join(tiles.select("k", "level", "cx", "cy", "_s"), ["k", "level", "cx", "cy"])
    best = F.array_min(F.transform("_s", lambda s: F.struct((square(s["sx"] - F.col("lon")) + square(s["sy"] - F.col("lat"))).alias("d"), s["sx"].alias("sx"), s["sy"].alias("sy"), s["v"].alias("v"))))
    outside = outside.groupBy("k", "lon", "lat").agg(F.min(best).alias("_n")).select("k", "lon", "lat", F.col("_n.v").alias("_in"))
    found = checkpoint(inside.unionByName(outside)).withColumnsRenamed({"k": "_k", "lon": "_x", "lat": "_y"})
    return px.join(sized(found)(found), (px[key].cast("bigint") == found["_k"]) & (px["lon"] == found["_x"]) & (px["lat"] == found["_y"]), "left").drop("_k", "_x", "_y").withColumnRenamed("_in", value)
