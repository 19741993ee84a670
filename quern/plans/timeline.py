"""Queries over scene dates, weather samples and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.energy import et_daily
from quern.operators import series
from quern.registry import query
from quern.sources import products

from .tables import table


def near(c: Column) -> Column:
    """Rounded to five digits by arithmetic, with ties moved off the border, so that noise in the last digits cannot show."""
    return F.floor(c * 1e5 + 0.500001) / 1e5


def _text(df: DataFrame) -> DataFrame:
    """df with its dates as text, which all engines hand out alike."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, day, etrf, calib_a, valid): one scene a site and day, from orders."""
    t = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("site"), F.to_date("o_orderdate").alias("day"))
    d = t.agg(F.max("o_totalprice").alias("p"), F.max("o_orderkey").alias("k"))
    return d.select("site", "day", (F.col("k") % 200 / 100).alias("etrf"), (F.col("k") % 31 + 15.0).alias("calib_a"), (F.col("k") % 3 != 0).alias("valid"))


_SCENES = "sc AS (SELECT o_custkey % 40 AS site, CAST(o_orderdate AS DATE) AS day, (max(o_orderkey) % 200) / 100 AS etrf, max(o_orderkey) % 31 + 15.0 AS calib_a, max(o_orderkey) % 3 <> 0 AS valid FROM orders GROUP BY 1, 2)"
_PAIRS = f"{_SCENES}, pr AS (SELECT site, day AS s, lead(day) OVER w AS e, etrf AS v, lead(etrf) OVER w AS v2 FROM sc WINDOW w AS (PARTITION BY site ORDER BY day)), dy AS (SELECT *, unnest(range(1, CAST(date_diff('day', s, e) AS BIGINT))) AS i FROM pr WHERE date_diff('day', s, e) > 1)"


@query("gap_detect", f"WITH {_SCENES}, g AS (SELECT site, day AS start, lead(day) OVER (PARTITION BY site ORDER BY day) AS \"end\" FROM sc) SELECT site, strftime(start, '%Y-%m-%d') AS start, strftime(\"end\", '%Y-%m-%d') AS \"end\", CAST(date_diff('day', start, \"end\") AS INTEGER) AS days FROM g WHERE date_diff('day', start, \"end\") > 8")
def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(series.gaps(scenes(spark, sf_dir), "site", "day", 8))


_ET0 = "(4 + (dayofyear(s + CAST(i AS INTEGER)) % 7) * 0.5)"


def _filled(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    pairs = series.scene_pairs(scenes(spark, sf_dir), "site", "day", "etrf")
    pairs = series.fill_weighted(pairs) if weighted else series.fill_linear(pairs)
    et0 = 4 + (F.dayofyear("day") % 7) * 0.5
    return _text(pairs.select("site", "day", near(F.col("filled")).alias("etrf"), near(et_daily(F.col("filled"), et0)).alias("et_daily")))


@query("gap_fill_linear", f"WITH {_PAIRS}, f AS (SELECT *, v + (v2 - v) * (i / date_diff('day', s, e)) AS f FROM dy) SELECT site, strftime(s + CAST(i AS INTEGER), '%Y-%m-%d') AS day, floor(f * 1e5 + 0.500001) / 1e5 AS etrf, floor(least(greatest(f * {_ET0}, 0), 30) * 1e5 + 0.500001) / 1e5 AS et_daily FROM f")
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, False)


@query("gap_fill_weighted", f"WITH {_PAIRS}, f AS (SELECT *, (v / i + v2 / (date_diff('day', s, e) - i)) / (1 / i + 1 / (date_diff('day', s, e) - i)) AS f FROM dy) SELECT site, strftime(s + CAST(i AS INTEGER), '%Y-%m-%d') AS day, floor(f * 1e5 + 0.500001) / 1e5 AS etrf, floor(least(greatest(f * {_ET0}, 0), 30) * 1e5 + 0.500001) / 1e5 AS et_daily FROM f")
def gap_fill_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, True)


@query("et_forecast", f"WITH {_SCENES}, l AS (SELECT site, arg_max(etrf, day) AS etrf, max(day) AS day FROM sc GROUP BY site), f AS (SELECT unnest([1, 2, 3]) AS ahead, unnest([4.5, 5.0, 6.25]) AS et0) SELECT site, CAST(ahead AS INTEGER) AS ahead, strftime(day + CAST(ahead AS INTEGER), '%Y-%m-%d') AS day, round(least(greatest(etrf * et0, 0), 30), 6) AS et_daily FROM l, f")
def et_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = scenes(spark, sf_dir).groupBy("site").agg(F.max_by("etrf", "day").alias("etrf"), F.max("day").alias("last"))
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("ahead"), F.lit(v).alias("et0")) for i, v in ((1, 4.5), (2, 5.0), (3, 6.25))])).alias("f")
    rows = last.select("site", "etrf", "last", ahead)
    return _text(rows.select("site", "f.ahead", F.date_add("last", F.col("f.ahead")).alias("day"), F.round(et_daily(F.col("etrf"), F.col("f.et0")), 6).alias("et_daily")))


@query("period_totals", f"WITH {_SCENES} SELECT site, month, round(avg(etrf) * 5 * days, 6) AS total FROM (SELECT site, etrf, strftime(date_trunc('month', day), '%Y-%m-%d') AS month, day(last_day(day)) AS days FROM sc) GROUP BY site, month, days")
def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scenes(spark, sf_dir).withColumn("month", F.to_date(F.date_trunc("month", "day")))
    return _text(d.groupBy("site", "month").agg(F.round(F.avg("etrf") * 5 * F.max(F.dayofmonth(F.last_day("day"))), 6).alias("total")))


@query(
    "calibration_carry_forward",
    f"WITH {_SCENES}, c AS (SELECT site, day, valid, calib_a, last_value(CASE WHEN valid THEN calib_a END IGNORE NULLS) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM sc) SELECT site, strftime(day, '%Y-%m-%d') AS day, used, CASE WHEN valid THEN 'NEW' WHEN used IS NOT NULL THEN 'REUSED' ELSE 'NONE' END AS source FROM c",
)
def calibration_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(series.carry_forward(scenes(spark, sf_dir), "site", ["day"], "calib_a", "valid").select("site", "day", "used", "source"))


_EV = "ev AS (SELECT user_id % 20 AS station, ts, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), pt AS (SELECT DISTINCT user_id % 20 AS station, ts FROM events WHERE event_id % 2 = 1)"


@query(
    "meteo_interpolate",
    f"""WITH {_EV}, b AS (SELECT p.station, p.ts, e.ts AS t0, e.value AS v0 FROM pt p ASOF LEFT JOIN ev e ON p.station = e.station AND p.ts >= e.ts), a AS (SELECT p.station, p.ts, e.ts AS t1, e.value AS v1 FROM pt p ASOF LEFT JOIN ev e ON p.station = e.station AND p.ts <= e.ts)
    SELECT b.station, b.ts, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(b.ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 6) AS value FROM b JOIN a ON a.station = b.station AND a.ts = b.ts""",
)
def meteo_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("station"), "ts", "event_id", "value")
    samples = t.where("event_id % 2 = 0").groupBy("station", "ts").agg(F.max("value").alias("value"))
    points = t.where("event_id % 2 = 1").select("station", "ts").distinct()
    out = series.as_of_linear(points, samples, "station", "ts", "value")
    return out.select("station", "ts", F.round("value", 6).alias("value"))


@query("overpass_nearest", "SELECT user_id % 20 AS station, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_id, (abs(epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '10 hours 30 minutes')), event_id)) AS event_id FROM events GROUP BY 1, 2")
def overpass_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("station"), F.to_date("ts").alias("day"), "ts", "event_id")
    target = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 37_800)
    return _text(series.nearest_sample(t, ["station", "day"], "ts", target, "event_id").select("station", "day", "event_id"))


@query(
    "scene_search",
    f"WITH {_SCENES} SELECT site, strftime(day, '%Y-%m-%d') AS day, etrf FROM sc WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND etrf <= 0.7 AND site BETWEEN 5 AND 20",
)
def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue search: place, dates and a bound on cloud cover."""
    return _text(scenes(spark, sf_dir).where("day between date'1996-01-01' and date'1996-12-31' and etrf <= 0.7 and site between 5 and 20").select("site", "day", "etrf"))


@query(
    "product_types",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NDVI' WHEN 1 THEN 'ETaDaily' WHEN 2 THEN 'LST' WHEN 4 THEN 'RGB' END AS product, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def product_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    names = [F.concat(F.lit("NDVI_L8_OLI_"), day), F.concat(F.lit("ETaDaily_L8_oli_166039_"), day, F.lit("_north.tif")), F.concat(F.lit("LST_L9_"), day), F.concat(F.lit("notes_"), day), F.lit("RGB.tif")]
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*names), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("file"))
    return t.select("o_orderkey", products.product_of(F.col("file")).alias("product"), products.date_of(F.col("file")).alias("day"))
