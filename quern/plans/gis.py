"""Raster and vector queries, anchors and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import spectral as S
from quern.functions import surface as G
from quern.operators import calibration, polygons, raster, triangles
from quern.registry import query

from .energy import _BALANCE, _CLEAR, _half_up, balance, half_up
from .tables import PIXELS, pixels, table

_NDVI = f"{PIXELS}, v AS (SELECT *, (nir08 - red) / nullif(nir08 + red, 0) AS ndvi FROM px)"
RULES = ((-1.0, 0.4, 2), (0.4, 0.6, 1), (0.6, 0.75, 0))
_CLASS = "CASE WHEN ndvi >= -1 AND ndvi < 0.4 THEN 2 WHEN ndvi >= 0.4 AND ndvi < 0.6 THEN 1 WHEN ndvi >= 0.6 AND ndvi < 0.75 THEN 0 END"


def _with_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("ndvi", S.ndvi(F.col("nir08"), F.col("red"), clipped=False))


@query("reclassify_histogram", f"WITH {_NDVI}, c AS (SELECT scene_id, {_CLASS} AS class, count(*) AS n FROM v GROUP BY 1, 2) SELECT scene_id, class, n, round(CASE WHEN class IS NOT NULL THEN 100.0 * n / sum(CASE WHEN class IS NOT NULL THEN n END) OVER (PARTITION BY scene_id) END, 6) AS share FROM c")
def reclassify_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _with_ndvi(spark, sf_dir).withColumn("class", raster.reclassify(F.col("ndvi"), RULES))
    return raster.histogram(d, ["scene_id"], "class").withColumn("share", F.round("share", 6))


@query(
    "class_breaks",
    f"""WITH {_NDVI}, b AS (SELECT list_concat([min(ndvi)], quantile_cont(ndvi, [0.25, 0.5, 0.75]), [max(ndvi)]) AS q, [min(ndvi) + (max(ndvi) - min(ndvi)) * i / 4 FOR i IN range(0, 5)] AS e FROM v)
    SELECT s.scheme, CAST(i AS INTEGER) AS i, round(b, 6) AS brk FROM (SELECT 'quantiles' AS scheme, unnest(q) AS b, generate_subscripts(q, 1) - 1 AS i FROM b UNION ALL SELECT 'equal', unnest(e), generate_subscripts(e, 1) - 1 FROM b UNION ALL SELECT 'manual', unnest([0.1, 0.3, 0.9]), unnest([0, 1, 2])) s""",
)
def class_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _with_ndvi(spark, sf_dir)
    out = None
    for scheme, manual in (("quantiles", ()), ("equal", ()), ("manual", (0.3, 0.1, 0.9))):
        one = raster.breaks(v, "ndvi", scheme, 4, manual).select(F.lit(scheme).alias("scheme"), F.posexplode("breaks").alias("i", "brk"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("brk", F.round("brk", 6))


@query("class_index", f"WITH {_NDVI} SELECT scene_id, y, x, CAST(CASE WHEN ndvi >= 0.1 AND ndvi < 0.5 THEN 0 WHEN ndvi >= 0.5 AND ndvi < 0.7 THEN 1 WHEN ndvi >= 0.7 AND ndvi <= 0.9 THEN 2 END AS INTEGER) AS class FROM v")
def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.array(*map(F.lit, (0.1, 0.5, 0.7, 0.9)))
    return _with_ndvi(spark, sf_dir).select("scene_id", "y", "x", raster.class_index(F.col("ndvi"), b).alias("class"))


_ZONES = "zn AS (SELECT s_suppkey AS zone_id, [{'px': 0.5 + s_suppkey % 3, 'py': s_suppkey * 10.0}, {'px': 8.0, 'py': s_suppkey * 10.0 + 3 + s_suppkey % 7}, {'px': 6.0, 'py': s_suppkey * 10.0 + 30}, {'px': 1.0, 'py': s_suppkey * 10.0 + 22}] AS ring FROM supplier)"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("px"), y.cast("double").alias("py"))
    ring = F.array(corner(k % 3 + 0.5, k * 10.0), corner(F.lit(8.0), k * 10.0 + 3 + k % 7), corner(F.lit(6.0), k * 10.0 + 30), corner(F.lit(1.0), k * 10.0 + 22))
    return table(spark, sf_dir, "supplier").select(k.alias("zone_id"), ring.alias("ring"))


@query(
    "zonal_stats",
    f"""WITH {_NDVI}, {_ZONES}, b AS (SELECT zone_id, ring, list_min([p.py FOR p IN ring]) AS y0, list_max([p.py FOR p IN ring]) AS y1, list_concat(ring[2:], ring[1:1]) AS nxt FROM zn),
    m AS (SELECT zone_id, CASE WHEN y % 11 <> 0 THEN ndvi END AS v FROM v JOIN b ON y + 0.5 >= y0 AND y + 0.5 <= y1 WHERE len([1 FOR i IN range(1, 5) IF ((ring[i].py > y + 0.5) <> (nxt[i].py > y + 0.5)) AND x + 0.5 < (nxt[i].px - ring[i].px) * (y + 0.5 - ring[i].py) / nullif(nxt[i].py - ring[i].py, 0) + ring[i].px]) % 2 = 1)
    SELECT zone_id, count(v) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS nodata_share FROM m GROUP BY zone_id""",
)
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _with_ndvi(spark, sf_dir).withColumn("v0", F.when(F.col("y") % 11 != 0, F.col("ndvi")))
    out = raster.zonal(d, zones(spark, sf_dir), "v0")
    return out.select("zone_id", "n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "std", "p05", "p95", "nodata_share")])


@query("polygon_area", f"WITH {_ZONES} SELECT zone_id, round(abs(list_sum([ring[i].px * ring[i % 4 + 1].py - ring[i % 4 + 1].px * ring[i].py FOR i IN range(1, 5)])) / 2, 6) AS area, list_min([p.px FOR p IN ring]) AS min_lon, list_max([p.py FOR p IN ring]) AS max_lat FROM zn")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = zones(spark, sf_dir).withColumn("b", raster.bbox(F.col("ring")))
    return d.select("zone_id", F.round(raster.area(F.col("ring")), 6).alias("area"), F.col("b.min_lon").alias("min_lon"), F.col("b.max_lat").alias("max_lat"))


@query("tile_grid", f"WITH {PIXELS}, s AS (SELECT scene_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY scene_id), r AS (SELECT *, unnest(range(0, h, 256)) AS ro FROM s), c AS (SELECT *, unnest(range(0, w, 256)) AS co FROM r) SELECT scene_id, CAST(ro AS BIGINT) AS row_off, CAST(co AS BIGINT) AS col_off, CAST(least(256, h - ro) AS BIGINT) AS tile_h, CAST(least(256, w - co) AS BIGINT) AS tile_w, round(48.3 + co * 0.01, 6) AS tile_c, round(31.6 - ro * 0.01, 6) AS tile_f FROM c")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pixels(spark, sf_dir).groupBy("scene_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).cast("bigint").alias("width"))
    s = s.withColumns({n: F.lit(v) for n, v in zip("abcdef", (0.01, 0.0, 48.3, 0.0, -0.01, 31.6), strict=True)})
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return raster.tiles(s).select("scene_id", *map(big, ("row_off", "col_off", "tile_h", "tile_w")), F.round("tile_c", 6).alias("tile_c"), F.round("tile_f", 6).alias("tile_f"))


@query("block_mean", f"WITH {PIXELS} SELECT scene_id, y // 8 AS by, CAST(x // 8 AS BIGINT) AS bx, round(avg(red), 6) AS red, round(avg(nir08), 6) AS nir08 FROM px GROUP BY scene_id, y // 8, x // 8")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.block_mean(pixels(spark, sf_dir), ["red", "nir08"], 8)
    return out.select("scene_id", "by", "bx", F.round("red", 6).alias("red"), F.round("nir08", 6).alias("nir08"))


@query("percentile_stretch", f"WITH {PIXELS}, p AS (SELECT scene_id, quantile_cont(lwir11, 0.02) AS lo, quantile_cont(lwir11, 0.98) AS hi FROM px GROUP BY scene_id) SELECT scene_id, y, x, CAST(floor(round(greatest(0.0, least(1.0, (lwir11 - lo) / nullif(hi - lo, 0))) * 255, 6)) AS INTEGER) AS stretched FROM px JOIN p USING (scene_id)")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.stretch(pixels(spark, sf_dir), "lwir11").select("scene_id", "y", "x", "stretched")


@query("rgb_fallback", f"WITH {PIXELS} SELECT scene_id, y, x, {_half_up('red', 6)} AS r, {_half_up('red', 6)} AS g, {_half_up('blue', 6)} AS b FROM px")
def rgb_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.rgb(pixels(spark, sf_dir).drop("green"))
    return out.select("scene_id", "y", "x", *[half_up(F.col(c), 6).alias(c) for c in "rgb"])


_AROUND = "o AS (SELECT unnest([-1, 0, 1]) AS dy), o2 AS (SELECT dy, unnest([-1, 0, 1]) AS dx FROM o)"


@query(
    "spatial_outlier",
    f"""WITH {_BALANCE}, {_AROUND}, rg AS (SELECT scene_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM bal GROUP BY scene_id),
    m AS (SELECT b.scene_id, b.y, b.x, sum(coalesce(n.et_daily, 0)) / 9 AS m FROM bal b JOIN rg USING (scene_id) CROSS JOIN o2 LEFT JOIN bal n ON n.scene_id = b.scene_id AND n.y = least(greatest(b.y + dy, y0), y1) AND n.x = least(greatest(b.x + dx, x0), x1) GROUP BY b.scene_id, b.y, b.x)
    SELECT scene_id, y, x, round(m, 6) AS neighbour_mean, round(CASE WHEN m > 0 THEN abs(et_daily - m) / m ELSE 0 END, 9) > 0.5 AS outlier FROM bal JOIN m USING (scene_id, y, x)""",
)
def spatial_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.neighbour_mean(balance(pixels(spark, sf_dir)).select("scene_id", "y", "x", "et_daily"), "et_daily")
    return out.select("scene_id", "y", "x", F.round("neighbour_mean", 6).alias("neighbour_mean"), "outlier")


@query(
    "mask_dilate",
    f"WITH {PIXELS}, c AS (SELECT scene_id, y, x, NOT ({_CLEAR}) AND y % 5 = 0 AS cloud FROM px) SELECT a.scene_id, a.y, a.x, EXISTS (SELECT 1 FROM c b WHERE b.cloud AND b.scene_id = a.scene_id AND b.y BETWEEN a.y - 4 AND a.y + 4 AND b.x BETWEEN a.x - 4 AND a.x + 4) AS cloud FROM c a",
)
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pixels(spark, sf_dir).select("scene_id", "y", "x", (~G.is_clear(F.col("qa_pixel")) & (F.col("y") % 5 == 0)).alias("cloud"))
    return raster.dilate(d, "cloud", radius=4)


#: Every fourth line of a scene, as lines that lie beside each other, with their class.
_GRID = f"{_NDVI}, gr AS (SELECT scene_id, y // 4 AS y, CAST(x AS BIGINT) AS x, {_CLASS} AS class FROM v WHERE {_CLASS} IS NOT NULL)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _with_ndvi(spark, sf_dir).withColumn("y", F.floor(F.col("y") / 4)).withColumn("class", raster.reclassify(F.col("ndvi"), RULES))
    return d.select("scene_id", "y", "x", "class")


@query(
    "region_sizes",
    f"""WITH RECURSIVE {_GRID}, lb(scene_id, y, x, class, l) USING KEY (scene_id, y, x) AS (
      SELECT scene_id, y, x, class, y * 2147483648 + x FROM gr
      UNION SELECT r.scene_id, r.y, r.x, r.class, min(t.l) FROM (SELECT scene_id, y + dy AS y, x + dx AS x, class, l FROM lb, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(dy, dx)) t
      JOIN recurring.lb r ON r.scene_id = t.scene_id AND r.y = t.y AND r.x = t.x AND r.class = t.class WHERE t.l < r.l GROUP BY r.scene_id, r.y, r.x, r.class)
    SELECT scene_id, class, CAST(l AS BIGINT) AS region, count(*) AS n FROM lb GROUP BY scene_id, class, l""",
)
def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.regions(_grid(spark, sf_dir), "class")
    return d.groupBy("scene_id", "class", "region").agg(F.count("*").alias("n"))


@query(
    "region_rings",
    f"""WITH {_GRID}, pa AS (SELECT a.scene_id, a.class, count(*) AS pairs FROM gr a JOIN gr b ON b.scene_id = a.scene_id AND b.class = a.class AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.scene_id, a.class),
    bl AS (SELECT scene_id, class, count(*) AS blocks FROM (SELECT scene_id, class, vy, vx FROM (SELECT scene_id, class, y + dy AS vy, x + dx AS vx FROM gr, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dy, dx)) GROUP BY scene_id, class, vy, vx HAVING count(*) = 4) GROUP BY scene_id, class),
    ar AS (SELECT scene_id, class, count(*) AS n FROM gr GROUP BY scene_id, class)
    SELECT ar.scene_id, ar.class, CAST(n AS DOUBLE) AS area, 4 * n - 2 * coalesce(pairs, 0) AS length, n - coalesce(pairs, 0) + coalesce(blocks, 0) AS outer_less_holes FROM ar LEFT JOIN pa USING (scene_id, class) LEFT JOIN bl USING (scene_id, class)""",
)
def region_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rings of all regions of a class: their signed area, which is its pixels; their length, which is its pixels' free sides; and outer rings less holes, which is its Euler number."""
    r = polygons.rings(_grid(spark, sf_dir), "class")
    return r.groupBy("scene_id", "class").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.sum(F.when(F.col("hole"), -1).otherwise(1)).alias("outer_less_holes"))


_STATIONS = """st AS (SELECT s_suppkey AS k, s_suppkey % 2 AS g, CAST(s_suppkey * 13 % 120 - 60 AS DOUBLE) + CAST(s_suppkey * 37 % 101 AS DOUBLE) / 103 AS x, CAST(s_suppkey * 29 % 80 - 40 AS DOUBLE) + CAST(s_suppkey * 53 % 97 AS DOUBLE) / 99 AS y, CAST(s_suppkey * 17 % 50 AS DOUBLE) AS v FROM supplier),
    pt AS (SELECT c_custkey AS id, c_custkey % 2 AS g, CAST(c_custkey % 120 - 60 AS DOUBLE) + 0.25 AS x, CAST(c_custkey * 7 % 80 - 40 AS DOUBLE) + 0.5 AS y FROM customer)"""
_CIRCLE = "((x1 - d.x) * (x1 - d.x) + (y1 - d.y) * (y1 - d.y)) * ((x2 - d.x) * (y3 - d.y) - (x3 - d.x) * (y2 - d.y)) - ((x2 - d.x) * (x2 - d.x) + (y2 - d.y) * (y2 - d.y)) * ((x1 - d.x) * (y3 - d.y) - (x3 - d.x) * (y1 - d.y)) + ((x3 - d.x) * (x3 - d.x) + (y3 - d.y) * (y3 - d.y)) * ((x1 - d.x) * (y2 - d.y) - (x2 - d.x) * (y1 - d.y))"


@query(
    "weather_linear",
    f"""WITH {_STATIONS}, tr AS (SELECT a.g, a.k AS ka, b.k AS kb, c.k AS kc, a.x AS x1, a.y AS y1, a.v AS v1, b.x AS x2, b.y AS y2, b.v AS v2, c.x AS x3, c.y AS y3, c.v AS v3, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS det
      FROM st a JOIN st b ON b.g = a.g AND b.k > a.k JOIN st c ON c.g = a.g AND c.k > b.k),
    full_ AS (SELECT DISTINCT tr.g, ka, kb, kc FROM tr JOIN st d ON d.g = tr.g AND d.k NOT IN (ka, kb, kc) WHERE ({_CIRCLE}) * sign(det) > 1e-6),
    de AS (SELECT tr.* FROM tr ANTI JOIN full_ USING (g, ka, kb, kc) WHERE abs(det) > 1e-9),
    w AS (SELECT id, ka, kb, kc, v1, v2, v3, ((x - x1) * (y3 - y1) - (y - y1) * (x3 - x1)) / det AS w1, ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / det AS w2 FROM pt JOIN de ON de.g = pt.g),
    i AS (SELECT id, arg_min(v1 + w1 * (v2 - v1) + w2 * (v3 - v1), (ka, kb, kc)) AS v FROM w WHERE w1 >= -1e-9 AND w2 >= -1e-9 AND w1 + w2 <= 1 + 1e-9 GROUP BY id),
    o AS (SELECT id, arg_min(st.v, (round((st.x - pt.x) * (st.x - pt.x) + (st.y - pt.y) * (st.y - pt.y), 9), st.x, st.y)) AS v FROM pt JOIN st ON st.g = pt.g WHERE id NOT IN (SELECT id FROM i) GROUP BY id)
    SELECT id, round(v, 6) AS temperature FROM i UNION ALL SELECT id, round(v, 6) FROM o""",
)
def weather_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures of suppliers, as two sets of stations, at the places of customers."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    stations = table(spark, sf_dir, "supplier").select((k % 2).alias("g"), ((k * 13 % 120 - 60) + (k * 37 % 101) / 103).alias("lon"), ((k * 29 % 80 - 40) + (k * 53 % 97) / 99).alias("lat"), (k * 17 % 50).cast("double").alias("temperature"))
    px = table(spark, sf_dir, "customer").select(c.alias("id"), (c % 2).alias("g"), ((c % 120 - 60) + 0.25).cast("double").alias("lon"), ((c * 7) % 80 - 40 + 0.5).cast("double").alias("lat"))
    return triangles.linear(px, stations, "g", "temperature").select("id", F.round("temperature", 6).alias("temperature"))


@query(
    "farm_report",
    f"""WITH {_NDVI}, s AS (SELECT y // 100 AS farm, scene_id, round(avg(ndvi), 6) AS mean FROM v GROUP BY 1, 2), c AS (SELECT *, CASE WHEN mean >= 0.4 AND mean < 0.6 THEN 1 WHEN mean >= -1 AND mean < 0.4 THEN 2 WHEN mean >= 0.6 AND mean < 1 THEN 0 ELSE 2 END AS cls FROM s)
    SELECT farm, count(*) AS dates, min(scene_id) AS first_date, max(scene_id) AS last_date, arg_min(mean, scene_id) AS first_mean, arg_max(mean, scene_id) AS last_mean, arg_min(scene_id, (mean, scene_id)) AS worst_date, CASE arg_min(cls, (mean, scene_id)) WHEN 2 THEN 'severe' WHEN 1 THEN 'moderate' ELSE 'none' END AS worst_class FROM c GROUP BY farm""",
)
def farm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_ndvi(spark, sf_dir).groupBy(F.floor(F.col("y") / 100).alias("farm"), "scene_id").agg(F.round(F.avg("ndvi"), 6).alias("mean"))
    cls = F.coalesce(raster.reclassify(F.col("mean"), ((-1.0, 0.4, 2), (0.4, 0.6, 1), (0.6, 1.0, 0))), F.lit(2))
    s = s.withColumn("label", F.when(cls == 2, "severe").when(cls == 1, "moderate").otherwise("none"))
    worst = F.struct("mean", "scene_id")
    return s.groupBy("farm").agg(
        F.count("*").alias("dates"), F.min("scene_id").alias("first_date"), F.max("scene_id").alias("last_date"), F.min_by("mean", "scene_id").alias("first_mean"), F.max_by("mean", "scene_id").alias("last_mean"), F.min_by("scene_id", worst).alias("worst_date"), F.min_by("label", worst).alias("worst_class")
    )


@query("worst_zones", f"WITH {_NDVI} SELECT y // 100 AS zone, round(avg(ndvi), 4) AS mean FROM v GROUP BY 1 ORDER BY mean, zone LIMIT 5")
def worst_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_ndvi(spark, sf_dir).groupBy(F.floor(F.col("y") / 100).alias("zone")).agg(F.round(F.avg("ndvi"), 4).alias("mean")).orderBy("mean", "zone").limit(5)


_LEVELS = "lv AS (SELECT unnest(range(0, 13)) AS i)"
_ANCHORS = f"""{_BALANCE}, {_LEVELS}, ok AS (SELECT *, round(lst, 6) AS t, round(ndvi, 6) AS v FROM bal WHERE lst IS NOT NULL AND ndvi IS NOT NULL),
  ct AS (SELECT scene_id, quantile_cont(lst, [(15 + 2.5 * i) / 100 FOR i IN range(0, 13)]) AS tc, quantile_cont(lst, [(90 - 2.5 * i) / 100 FOR i IN range(0, 13)]) AS th, quantile_cont(ndvi, [(90 - 2.5 * i) / 100 FOR i IN range(0, 13)]) AS nc, quantile_cont(ndvi, [(10 + 2.5 * i) / 100 FOR i IN range(0, 13)]) AS nh, quantile_cont(albedo, 0.3) AS a3, quantile_cont(albedo, 0.7) AS a7, quantile_cont(lai, 0.8) AS l8, quantile_cont(lai, 0.2) AS l2 FROM ok GROUP BY scene_id),
  cd AS (SELECT ok.*, i, t <= round(tc[i + 1], 6) AND v >= round(nc[i + 1], 6) AND (i > 0 OR (round(albedo, 6) <= round(a3, 6) AND round(lai, 6) >= round(l8, 6))) AS cold, t >= round(th[i + 1], 6) AND v <= round(nh[i + 1], 6) AND (i > 0 OR (round(albedo, 6) >= round(a7, 6) AND round(lai, 6) <= round(l2, 6))) AS hot FROM ok JOIN ct USING (scene_id), lv),
  cn AS (SELECT scene_id, i, count(*) FILTER (WHERE cold) AS c, count(*) FILTER (WHERE hot) AS h FROM cd GROUP BY scene_id, i),
  ch AS (SELECT scene_id, coalesce(min(i) FILTER (WHERE c >= 5 AND h >= 5), 12) AS level FROM cn GROUP BY scene_id),
  pk AS (SELECT cd.*, level, 'cold' AS kind, row_number() OVER (PARTITION BY cd.scene_id ORDER BY t, y, x) AS r FROM cd JOIN ch ON ch.scene_id = cd.scene_id AND i = level WHERE cold UNION ALL SELECT cd.*, level, 'hot', row_number() OVER (PARTITION BY cd.scene_id ORDER BY -t, y, x) FROM cd JOIN ch ON ch.scene_id = cd.scene_id AND i = level WHERE hot),
  an AS (SELECT pk.scene_id, level, kind, count(*) AS n, quantile_cont(lst, 0.5) AS ts, quantile_cont(ndvi, 0.5) AS ndvi, quantile_cont(rn, 0.5) AS rn, quantile_cont(g, 0.5) AS g FROM pk JOIN cn ON cn.scene_id = pk.scene_id AND cn.i = pk.level WHERE r <= least(20, cn.c, cn.h) GROUP BY pk.scene_id, level, kind)"""


@query("anchor_clusters", f"WITH {_ANCHORS} SELECT scene_id, CAST(level AS INTEGER) AS level, kind, n, round(ts, 5) AS ts, round(ndvi, 5) AS ndvi, round(rn, 4) AS rn, round(g, 4) AS g FROM an")
def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.anchors(balance(pixels(spark, sf_dir)))
    return out.select("scene_id", "level", "kind", "n", F.round("ts", 5).alias("ts"), F.round("ndvi", 5).alias("ndvi"), F.round("rn", 4).alias("rn"), F.round("g", 4).alias("g"))


@query(
    "dt_calibration",
    f"""WITH {_ANCHORS}, j AS (SELECT c.scene_id, c.ts AS tc, h.ts AS th, c.rn - c.g AS free, h.rn - h.g AS hfree, 290.0 + CAST(c.scene_id AS INTEGER) * 2 AS ta, 5.0 + CAST(c.scene_id AS INTEGER) AS et0, 800.0 - CAST(c.scene_id AS INTEGER) * 50 AS rs FROM an c JOIN an h ON h.scene_id = c.scene_id AND c.kind = 'cold' AND h.kind = 'hot'),
    l AS (SELECT *, least(et0 * rs / (25.0 * 1e6 / 86400) * 2.45e6 / 86400, free) AS le FROM j)
    SELECT scene_id, round(tc - ta, 5) AS dt_cold, round(th - ta, 5) AS dt_hot, round(le, 4) AS le_cold, round(free - le, 4) AS h_cold, round(CASE WHEN hfree / nullif(th - ta, 0) IS NOT NULL THEN least(greatest(hfree / nullif(th - ta, 0), 15), 45) END, 5) AS a, tc < th AND tc - ta <= 0.5 AND le > 0 AS valid FROM l""",
)
def dt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    scenes = d.groupBy("scene_id").agg(F.max("ta").alias("ta"), F.max("et0").alias("et0"), F.max("rs").alias("rs")).withColumn("rs_daily_mj", F.lit(25.0))
    out = calibration.calibrate(calibration.anchors(d), scenes)
    return out.select("scene_id", F.round("dt_cold", 5).alias("dt_cold"), F.round("dt_hot", 5).alias("dt_hot"), F.round("le_cold", 4).alias("le_cold"), F.round("h_cold", 4).alias("h_cold"), F.round("a", 5).alias("a"), "valid")
