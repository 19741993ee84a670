"""Rings of regions and triangles of stations against plain versions."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quern.functions import projection
from quern.operators import grids, polygons, raster, triangles

PX = "scene_id string, y bigint, x int, class int"


def pictures(seed):
    rng = random.Random(seed)
    for n, (h, w, share) in enumerate([(1, 1, 1.0), (6, 6, 0.5), (9, 7, 0.7), (12, 12, 0.6), (5, 30, 0.8), (10, 10, 1.0)]):
        yield [(str(n), y, x, rng.choice([1, 1, 1, 2])) for y in range(h) for x in range(w) if rng.random() < share]
    ring = [("ring", y, x, 1) for y in range(5) for x in range(5) if not (1 <= y <= 3 and 1 <= x <= 3)]
    yield ring + [("ring", 2, 2, 1)]  # a region in the hole of another
    yield [("corner", 0, 0, 1), ("corner", 1, 1, 1), ("corner", 0, 2, 1), ("corner", 1, 2, 1), ("corner", 2, 0, 1), ("corner", 2, 1, 1), ("corner", 1, 0, 1), ("corner", 0, 1, 2)]
    yield [("none", 0, 0, None)]


def labelled(rows):
    """(scene, class, smallest pixel number) -> pixels of each 4-connected region."""
    left = {(s, y, x): c for s, y, x, c in rows if c is not None}
    out = {}
    while left:
        start, c = next(iter(left.items()))
        todo, own = [start], set()
        del left[start]
        while todo:
            s, y, x = todo.pop()
            own.add((y, x))
            for p in ((s, y + 1, x), (s, y - 1, x), (s, y, x + 1), (s, y, x - 1)):
                if left.get(p) == c:
                    del left[p]
                    todo.append(p)
        out[start[0], c, min(y * 2**31 + x for y, x in own)] = own
    return out


def crossings(points, py, px):
    """Whether a pixel's centre is inside a ring, by the even-odd rule."""
    inside = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if (ay > py + 0.5) != (by > py + 0.5) and px + 0.5 < ax + (bx - ax) * (py + 0.5 - ay) / (by - ay):
            inside = not inside
    return inside


def test_polygons_hold_their_pixels_and_no_others(spark):
    rows = [r for g in pictures(1) for r in g]
    got = polygons.polygons(spark.createDataFrame(rows, PX), "class").collect()
    want = labelled(rows)
    assert {(r.scene_id, r["class"], r.region): int(r.area) for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        outer, holes = [tuple(p) for p in r.outer], [[tuple(p) for p in h] for h in r.holes]
        for y in range(-1, 13):
            for x in range(-1, 31):
                assert (crossings(outer, y, x) and not any(crossings(h, y, x) for h in holes)) == ((y, x) in want[r.scene_id, r["class"], r.region])
        for ring in (outer, *holes):  # corners only: each side turns
            turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True)]
            assert all(turns) and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    named = {(r.scene_id, r["class"], r.region): (len(r.outer), len(r.holes)) for r in got}
    assert named["ring", 1, 0] == (4, 1) and named["ring", 1, 2 * 2**31 + 2] == (4, 0)


def test_rings_of_small_and_of_large_regions_are_the_same(spark, monkeypatch):
    px = spark.createDataFrame([(s, y - 70, x - 66, (y * y + 3 * x * y + x // 3) % 5 // 3) for s in "ab" for y in range(75) for x in range(70) if (y * x) % 7], "scene_id string, y int, x int, c int").repartition(3)
    every = lambda df: sorted((r.scene_id, r["class"], r.region, r.ring, r.hole, r.area, r.length, tuple(map(tuple, r.points))) for r in df.collect())
    small = every(polygons.rings(px, "c"))
    assert any(r[4] for r in small)
    monkeypatch.setattr(polygons, "SMALL", 0)
    assert every(polygons.rings(px, "c")) == small


def test_pixels_within_tiles_need_no_links(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(raster, "checkpoint", lambda df, f=raster.checkpoint: seen.append(f(df)) or seen[-1])
    px = spark.createDataFrame([("s", y, x, 1) for y in range(60, 68) for x in range(5)] + [("s", 0, 0, 1)], "scene_id string, y int, x int, c int")
    assert {(r.y, r.region) for r in raster.regions(px, "c").collect()} == {(0, 0), *((y, 60 * 2**31) for y in range(60, 68))}
    # The pixels, two links across the border, and two rounds of two labels.
    assert [t.count() for t in seen] == [41, 2, 2, 2]


def test_rings_of_nothing(spark):
    assert polygons.rings(spark.createDataFrame([], PX), "class").count() == 0


def empty_circles(p):
    """Triangles of points in general position whose circle holds no other point."""
    from itertools import combinations

    out = set()
    for t in combinations(range(len(p)), 3):
        a, b, c = p[list(t)]
        det = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        order = np.array([t if det > 0 else (t[0], t[2], t[1])])
        if all(triangles._in_circle(p, order, p[k])[0] <= 0 for k in range(len(p)) if k not in t):
            out.add(frozenset(t))
    return out


def test_triangles_have_empty_circles():
    rng = np.random.default_rng(1)
    for n in (3, 4, 5, 9, 25, 40):
        p = rng.random((n, 2)) * (100, 7)
        assert {frozenset(t) for t in triangles.delaunay(p).tolist()} == empty_circles(p)
    assert len(triangles.delaunay(np.c_[np.arange(9.0), 2 * np.arange(9.0)])) == 0 and len(triangles.delaunay(np.zeros((2, 2)))) == 0
    grid = np.array([(x, y) for x in range(8) for y in range(6)], float)
    t = triangles.delaunay(grid)  # many points on one circle: any choice, but the whole hull
    assert len(t) == 2 * 7 * 5 and abs(triangles._turn(grid, *t.T).sum() / 2 - 35) < 1e-9


def test_a_linear_field_is_met_exactly(spark):
    rng = random.Random(2)
    field = lambda g, x, y: 3 * g + 2 * x - 5 * y + 1
    stations = [(g, rng.uniform(-50, 50), rng.uniform(-30, 30)) for g in (0, 1) for _ in range(60)] + [(0, x, y) for x in (-60.0, 60.0) for y in (-40.0, 40.0)] + [(1, x, y) for x in (-60.0, 60.0) for y in (-40.0, 40.0)]
    stations = [(g, x, y, field(g, x, y)) for g, x, y in stations] + [(0, None, 1.0, 5.0), (0, 1.0, 1.0, None)]
    px = [(i, i % 2, rng.uniform(-59, 59), rng.uniform(-39, 39)) for i in range(300)] + [(1000, 0, 100.0, 0.0), (1001, 5, 0.0, 0.0), (1002, 0, None, 0.0), (1003, 0, -60.0, -40.0)]
    got = triangles.linear(spark.createDataFrame(px, "id bigint, g bigint, lon double, lat double"), spark.createDataFrame(stations, "g bigint, lon double, lat double, v double"), "g", "v")
    by = {r.id: r.v for r in got.collect()}
    assert len(by) == len(px) and by[1001] is None and by[1002] is None and by[1003] == field(0, -60, -40)
    assert all(abs(by[i] - field(g, x, y)) < 1e-6 for i, g, x, y in px[:300])
    near = min((s for s in stations if s[0] == 0 and None not in s), key=lambda s: (s[1] - 100) ** 2 + s[2] ** 2)
    assert by[1000] == near[3]


def test_stations_on_a_line_give_the_nearest(spark):
    stations = spark.createDataFrame([(1, float(i), 0.0, float(i)) for i in range(5)] + [(1, 2.0, 0.0, 4.0)], "g bigint, lon double, lat double, v double")
    px = spark.createDataFrame([(1, 1, 1.2, 3.0), (2, 1, 2.0, 0.0)], "id bigint, g bigint, lon double, lat double")
    assert {r.id: r.v for r in triangles.linear(px, stations, "g", "v").collect()} == {1: 1.0, 2: 3.0}


def test_too_many_stations_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(triangles, "STATIONS", 3)
    with pytest.raises(Exception):
        triangles.triangulated(spark.createDataFrame([(1, float(i), float(i * i), 0.0) for i in range(4)], "g bigint, lon double, lat double, v double"), "g", "v").collect()


def test_tiles_make_the_triangles_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(triangles, "LEAF", 10)
    rng = np.random.default_rng(4)
    near = np.concatenate([rng.random((60, 2)) + (50 * i, 20 * (i % 2)) for i in range(4)])  # dense places far apart
    grid = np.array([(x / 7, y / 7) for x in range(15) for y in range(12)])  # many points on one circle
    sets = {1: rng.random((150, 2)) * (100, 7), 2: near, 3: grid}
    rows = [(k, float(x), float(y), 0.0) for k, p in sets.items() for x, y in p]
    _, places, tri = triangles.tiled(spark.createDataFrame(rows, "g bigint, lon double, lat double, v double"), "g", "v")
    assert places.count() == len(rows) and places.where("level > 2").count() > 0
    got = {k: [] for k in sets}
    for r in tri.collect():
        got[r.k].append(((r.x0, r.y0), (r.x1, r.y1), (r.x2, r.y2)))
    for k in (1, 2):
        p = sets[k]
        assert sorted(map(sorted, got[k])) == sorted(sorted(map(tuple, p[t].tolist())) for t in triangles.delaunay(p))
    corners = np.array(got[3])
    a, b = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    areas = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) / 2
    assert abs(areas.sum() - 14 * 11 / 49) < 1e-9 and areas.max() < 0.5 / 49 + 1e-9


def test_more_stations_of_a_key_than_one_task_takes(spark):
    rng = random.Random(5)
    field = lambda x, y: 2 * x - 5 * y + 1
    at = [(rng.uniform(-50, 50), rng.uniform(-30, 30)) for _ in range(triangles.STATIONS + 200)] + [(x, y) for x in (-60.0, 60.0) for y in (-40.0, 40.0)]
    px = [(i, 0, rng.uniform(-59, 59), rng.uniform(-39, 39)) for i in range(200)] + [(i, 0, 70.0 + i % 7, i % 60 - 30.0) for i in range(200, 230)] + [(0, 0, 80.0, 1.5), (0, 0, 80.0, 1.5)]
    stations = spark.createDataFrame([(0, x, y, field(x, y)) for x, y in at], "g bigint, lon double, lat double, v double")
    got = triangles.linear(spark.createDataFrame(px, "id bigint, g bigint, lon double, lat double"), stations, "g", "v").collect()
    assert len(got) == len(px)  # also where an id or a place comes again
    for r in got:
        x, y = (r.lon, r.lat) if r.lon < 60 else min(at, key=lambda s: (s[0] - r.lon) ** 2 + (s[1] - r.lat) ** 2)
        assert abs(r.v - field(x, y)) < 1e-6


def test_regions_are_those_of_flooding(spark):
    rows = [r for g in pictures(3) for r in g]
    got = {}
    for r in raster.regions(spark.createDataFrame(rows, PX), "class").collect():
        got.setdefault((r.scene_id, r["class"], r.region), set()).add((r.y, r.x))
    assert got == labelled(rows)


def test_metres_of_known_places_and_back(spark):
    rng = random.Random(7)
    rows = [(k, 6 * z - 183 + rng.uniform(-3, 3), rng.uniform(-80, 84)) for k in range(400) for z in [rng.randrange(1, 61)]]
    df = spark.createDataFrame(rows, "k int, lon double, lat double").withColumn("epsg", F.when(F.col("lat") >= 0, 32600).otherwise(32700) + F.floor((F.col("lon") + 180) / 6).cast("int") + 1)
    df = df.withColumn("p", projection.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))).withColumn("b", projection.from_utm(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    for r in df.collect():
        assert abs(r.b.lon - r.lon) < 1e-8 and abs(r.b.lat - r.lat) < 1e-8
    # On the central meridian metres are those along the meridian, by quadrature.
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    t = np.linspace(0, np.radians(45.0), 200_001)
    f = projection.AXIS * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5
    along = float((f[:-1] + f[1:]).sum() / 2 * (t[1] - t[0]))
    one = spark.range(1).select(projection.to_utm(F.lit(3.0), F.lit(45.0), F.lit(32631)).alias("p"), projection.to_utm(F.lit(3.0), F.lit(-45.0), F.lit(32731)).alias("q")).first()
    assert abs(one.p.x - 500_000) < 1e-6 and abs(one.p.y - 0.9996 * along) < 1e-3 and abs(one.q.y - (10_000_000 - 0.9996 * along)) < 1e-3


@pytest.mark.parametrize(("kernel", "step"), [("bilinear", 0.5), ("bilinear", 1.7), ("cubic", 0.4), ("cubic", 3.0)])
def test_kernels_against_sums_over_all_pixels(spark, kernel, step):
    rng = random.Random(8)
    rows = [("s", y, x, rng.random()) for y in range(70) for x in range(9) if rng.random() < 0.9] + [("s", 69, 8, 1.0), ("e", 0, 0, 2.0), ("e", 0, 1, None)]
    rows = list({r[:3]: r for r in rows}.values())
    got = {(r.scene_id, r.y, r.x): r.v for r in grids.interpolated(spark.createDataFrame(rows, "scene_id string, y bigint, x bigint, v double"), "v", step, kernel).collect()}

    def weight(d):
        d = abs(d)
        if kernel == "bilinear":
            return max(0.0, 1 - d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    want = {}
    for s in ("s", "e"):
        own = [(y, x, v) for k, y, x, v in rows if k == s]
        h, w = max(y for y, _, _ in own), max(x for _, x, _ in own)
        for i in range(int(np.ceil((h + 1) / step)) + 1):
            for j in range(int(np.ceil((w + 1) / step)) + 1):
                u, t = (i + 0.5) * step - 0.5, (j + 0.5) * step - 0.5
                if u < h + 0.5 and t < w + 0.5:
                    k = [(weight(u - y) * weight(t - x), v) for y, x, v in own if v is not None and abs(u - y) < 2 and abs(t - x) < 2]
                    if abs(total := sum(a for a, _ in k)) > 1e-6:
                        want[s, i, j] = sum(a * v for a, v in k) / total
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
