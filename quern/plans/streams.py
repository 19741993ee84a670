"""Streams over the events table, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import learning
from quern.registry import query
from quern.session import new_folder
from quern.sources.model_store import ModelStore
from quern.streaming import jobs

from .tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.events(spark, f"{sf_dir}/events.parquet")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of updates of each key the last."""
    names = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("r")).select(*keys, "r.*")


@query("stream_drift", "WITH e AS (SELECT event_id, user_id, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS r FROM events) SELECT user_id, event_id, round(r, 9) AS error_rate, r > 0.3 AS drift FROM e")
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.drain(jobs.error_drift(_events(spark, sf_dir), 60.0))
    return rows.select("user_id", "event_id", F.round("error_rate", 9).alias("error_rate"), "drift")


#: Each user's events in order, for SQL that goes from one to the next.
_ORDER = "e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
#: The last state of each user.
_ENDS = "FROM p QUALIFY k = max(k) OVER (PARTITION BY user_id)"


@query(
    "stream_page_hinkley",
    f"""WITH RECURSIVE {_ORDER}, p AS (
      SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 0 AS n, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS statistic, false AS drift FROM e GROUP BY user_id
      UNION ALL SELECT user_id, k, event_id, CASE WHEN s > 50 THEN 0 ELSE n1 END, CASE WHEN s > 50 THEN 0 ELSE m1 END, CASE WHEN s > 50 THEN 0 ELSE t1 END, CASE WHEN s > 50 THEN 0 ELSE least(low, t1) END, s, s > 50
      FROM (SELECT *, t1 - least(low, t1) AS s FROM (SELECT *, total + (value - m1 - 0.005) AS t1 FROM (SELECT *, mean + (value - mean) / n1 AS m1 FROM (
        SELECT e.user_id, e.k, e.event_id, e.value, p.n + 1 AS n1, p.mean, p.total, p.low FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)))))
    SELECT user_id, event_id, round(statistic, 6) AS statistic, drift FROM p WHERE k > 0""",
)
def stream_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.page_hinkley(_events(spark, sf_dir))).select("user_id", "event_id", F.round("statistic", 6).alias("statistic"), "drift")


@query("stream_batch_trigger", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) SELECT user_id, r // 10 AS batch, count(*) AS n, arg_min(event_id, r) AS first_id, arg_max(event_id, r) AS last_id FROM e GROUP BY user_id, r // 10 HAVING count(*) = 10")
def stream_batch_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.batch_trigger(_events(spark, sf_dir), seconds=float("inf")))


@query("stream_association", "SELECT user_id, event_type, round(sum(pow(2.0, -(epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 86400e6 / 90.0)), 6) AS score FROM events GROUP BY user_id, event_type")
def stream_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.drain(jobs.decayed(_events(spark, sf_dir), "2024-06-01"), "update")
    return _last(rows, ["user_id", "event_type"]).select("user_id", "event_type", F.round("score", 6).alias("score"))


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _last(jobs.drain(jobs.hourly(_events(spark, sf_dir)), "update"), ["start", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


_START = "SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b FROM e GROUP BY user_id"
_STEP = "SELECT e.user_id, e.k, p.wrong, p.w, p.b, e.value / 50 - 1 AS x, e.event_id % 2 = 0 AS y FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1"
_MODEL = f"SELECT user_id, k AS n, round(wrong / k, 6) AS error_rate, round(w, 6) AS w, round(b, 6) AS b {_ENDS}"


def _models(spark: SparkSession, job: DataFrame) -> DataFrame:
    last = _last(jobs.drain(job, "update"), ["user_id"])
    return last.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("error_rate", "w", "b")])


@query(
    "stream_online_model",
    f"""WITH RECURSIVE {_ORDER}, p AS ({_START} UNION ALL
      SELECT user_id, k, wrong + CASE WHEN (q > 0.5) <> y THEN 1 ELSE 0 END, w + 0.05 * (CASE WHEN y THEN 1 ELSE 0 END - q) * x, b + 0.05 * (CASE WHEN y THEN 1 ELSE 0 END - q)
      FROM (SELECT *, 1 / (1 + exp(-(w * x + b))) AS q FROM ({_STEP}))) {_MODEL}""",
)
def stream_online_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, jobs.online_logistic(_events(spark, sf_dir)))


@query(
    "stream_passive_aggressive",
    f"""WITH RECURSIVE {_ORDER}, p AS ({_START} UNION ALL
      SELECT user_id, k, wrong + CASE WHEN m <= 0 THEN 1 ELSE 0 END, w + t * s * x, b + t * s
      FROM (SELECT *, least(1, greatest(0, 1 - m) / (x * x + 1)) AS t FROM (SELECT *, s * (w * x + b) AS m FROM (SELECT *, CASE WHEN y THEN 1.0 ELSE -1.0 END AS s FROM ({_STEP}))))) {_MODEL}""",
)
def stream_passive_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, jobs.passive_aggressive(_events(spark, sf_dir)))


_NEAREST = "CASE WHEN k <= 3 THEN k - 1 WHEN abs(v - c0) <= abs(v - c1) AND abs(v - c0) <= abs(v - c2) THEN 0 WHEN abs(v - c1) <= abs(v - c2) THEN 1 ELSE 2 END"


@query(
    "stream_online_clusters",
    f"""WITH RECURSIVE {_ORDER}, p AS (
      SELECT user_id, CAST(0 AS BIGINT) AS k, {", ".join(f"0 AS n{i}, CAST(NULL AS DOUBLE) AS c{i}" for i in range(3))} FROM e GROUP BY user_id UNION ALL
      SELECT user_id, k, {", ".join(f"CASE WHEN j = {i} THEN n{i} + 1 ELSE n{i} END, CASE WHEN j = {i} THEN coalesce(c{i}, v) + (v - coalesce(c{i}, v)) / (n{i} + 1) ELSE c{i} END" for i in range(3))}
      FROM (SELECT *, {_NEAREST} AS j FROM (SELECT e.user_id, e.k, e.value AS v, {", ".join(f"p.n{i}, p.c{i}" for i in range(3))} FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)))
    SELECT user_id, k AS n, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 {_ENDS}""",
)
def stream_online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _last(jobs.drain(jobs.online_kmeans(_events(spark, sf_dir)), "update"), ["user_id"])
    return last.select("user_id", "n", *[F.round(F.get("centres", F.lit(i)), 6).alias(f"c{i}") for i in range(3)])


_SIZE, _WAIT, _REST = 8, 172_800, 216_000


@query(
    "stream_scheduled_training",
    f"""WITH RECURSIVE t AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events),
    g AS (SELECT *, row_number() OVER u AS k, CASE WHEN us - lag(us) OVER u >= {_REST}000000 THEN 1 ELSE 0 END AS cut FROM t WINDOW u AS (PARTITION BY user_id ORDER BY us, event_id)),
    s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY k) AS BIGINT) AS life FROM g),
    e AS (SELECT *, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id, life ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0.5 AS drift, min(us) OVER (PARTITION BY user_id, life) AS since FROM s),
    p AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS life, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first_id, CAST(0 AS BIGINT) AS last_id, CAST(0 AS BIGINT) AS last, false AS drift, false AS e1, false AS e2, CAST(0 AS BIGINT) AS n2 FROM t
      UNION ALL SELECT user_id, k, life, since, CASE WHEN e2 THEN batch0 + 1 ELSE batch0 END, CASE WHEN e2 THEN 0 ELSE n2 END, first2, event_id, CASE WHEN e2 THEN us ELSE last0 END, drift, e1, e2, n2
      FROM (SELECT *, NOT drift AND (n2 >= {_SIZE} OR us - last0 >= {_WAIT}000000) AS e2 FROM (SELECT *, n0 + 1 AS n2, CASE WHEN n0 = 0 THEN event_id ELSE first_id END AS first2 FROM (
        SELECT *, CASE WHEN fresh OR e1 THEN 0 ELSE n END AS n0, CASE WHEN fresh THEN 0 WHEN e1 THEN batch + 1 ELSE batch END AS batch0, CASE WHEN fresh THEN us WHEN e1 THEN last + {_WAIT}000000 ELSE last END AS last0 FROM (
          SELECT e.user_id, e.k, e.life, e.since, e.event_id, e.us, e.drift, p.batch, p.n, p.first_id, p.last, e.life <> p.life AS fresh, p.n > 0 AND NOT p.drift AND p.last + {_WAIT}000000 <= e.us AS e1
          FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1))))),
    l AS (SELECT *, lag(since) OVER u AS since_, lag(batch) OVER u AS batch_, lag(n) OVER u AS n_, lag(first_id) OVER u AS first_, lag(last_id) OVER u AS last_id_, lag(last) OVER u AS last_, k = max(k) OVER (PARTITION BY user_id) AS final FROM p WINDOW u AS (PARTITION BY user_id ORDER BY k))
    SELECT user_id, since_ AS since, batch_ AS batch, n_ AS n, first_ AS first_id, last_id_ AS last_id, last_ + {_WAIT}000000 AS at, 'time' AS reason FROM l WHERE e1
    UNION ALL SELECT user_id, since, batch - 1, n2, first_id, last_id, last, CASE WHEN n2 >= {_SIZE} THEN 'count' ELSE 'time' END FROM l WHERE e2
    UNION ALL SELECT user_id, since, batch, n, first_id, last_id, last + {_WAIT}000000, 'time' FROM l WHERE final AND n > 0 AND NOT drift AND last + {_WAIT}000000 < (SELECT max(us) - 600000000 FROM t)""",
)
def stream_scheduled_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainings by number and by time, with timers; none while a user's values drift."""
    return jobs.drain(jobs.scheduled_training(_events(spark, sf_dir), 60.0, _SIZE, _WAIT, _REST, threshold=0.5))


_HALF = 0.25


@query(
    "stream_decaying_pairs",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    p AS (
      SELECT DISTINCT user_id, event_type, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS us, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS ends, false AS fell FROM e
      UNION ALL SELECT user_id, event_type, k, event_id, us, score, us + CAST(ceil({_HALF * 86_400e6} * log2(score / 0.01)) AS BIGINT), fell
      FROM (SELECT e.user_id, e.event_type, e.k, e.event_id, e.us, p.k > 0 AND p.ends <= e.us AS fell, CASE WHEN p.k = 0 OR p.ends <= e.us THEN 1.0 ELSE p.score * pow(2.0, (p.us - e.us) / {_HALF * 86_400e6}) + 1.0 END AS score
        FROM p JOIN e ON e.user_id = p.user_id AND e.event_type = p.event_type AND e.k = p.k + 1)),
    l AS (SELECT *, lag(ends) OVER u AS ended, k = max(k) OVER (PARTITION BY user_id, event_type) AS final FROM p WINDOW u AS (PARTITION BY user_id, event_type ORDER BY k))
    SELECT user_id, event_type, event_id, us AS at, round(score, 6) AS score FROM l WHERE k > 0
    UNION ALL SELECT user_id, event_type, NULL, ended, 0.0 FROM l WHERE fell
    UNION ALL SELECT user_id, event_type, NULL, ends, 0.0 FROM l WHERE final AND ends < (SELECT max(us) - 600000000 FROM e)""",
)
def stream_decaying_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pairs that halve in six hours, and when each falls below a hundredth and is forgotten."""
    rows = jobs.drain(jobs.decaying_pairs(_events(spark, sf_dir), _HALF))
    return rows.select("user_id", "event_type", "event_id", "at", F.round("score", 6).alias("score"))


_CLASSES, _DIM = 3, 2


def _samples(spark: SparkSession, sf_dir: str, dim: int | None = _DIM) -> DataFrame:
    """(key, id, x, label): a stream of vectors, or of their first components; a stream takes a glob for a plain path."""
    rows = spark.readStream.schema("vec_id bigint, embedding array<float>, label int").parquet(f"{sf_dir}/embeddings.parquet*")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rows.select((F.col("vec_id") % 4).alias("key"), F.col("vec_id").alias("id"), (x if dim is None else F.slice(x, 1, dim)).alias("x"), (F.col("label") % _CLASSES).alias("label"))


def _z(c: int) -> str:
    """SQL of a class's margin for a sample r; weights are one list, each class's bias last."""
    at = c * (_DIM + 1)
    return " + ".join([*(f"p.w[{at + d + 1}] * r.x{d}" for d in range(_DIM)), f"p.w[{at + _DIM + 1}]"])


_GRADIENT = ", ".join(
    f"p.w[{c * (_DIM + 1) + d + 1}] + 0.5 * list_sum([((CASE WHEN r.z = {c} THEN 1.0 ELSE 0.0 END) - 1 / (1 + exp(-({_z(c)})))) * {'r.x%d' % d if d < _DIM else '1.0'} FOR r IN b.s]) / 10" for c in range(_CLASSES) for d in range(_DIM + 1)
)
_LEARNT = f"""v AS (SELECT vec_id % 4 AS key, vec_id AS id, {", ".join(f"CAST(embedding[{d + 1}] AS DOUBLE) AS x{d}" for d in range(_DIM))}, label % {_CLASSES} AS z, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS rn FROM embeddings),
    b AS (SELECT key, rn // 10 AS k, list({{'z': z, {", ".join(f"'x{d}': x{d}" for d in range(_DIM))}}} ORDER BY id) AS s FROM v GROUP BY key, rn // 10 HAVING count(*) = 10),
    p AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, [CAST(0 AS DOUBLE) FOR i IN range(0, {_CLASSES * (_DIM + 1)})] AS w FROM v
      UNION ALL SELECT p.key, p.k + 1, [{_GRADIENT}] FROM p JOIN b ON b.key = p.key AND b.k = p.k),
    m AS (SELECT * FROM p QUALIFY k = max(k) OVER (PARTITION BY key))"""


def _learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(jobs.drain(jobs.online_classifier(_samples(spark, sf_dir), "logistic", _CLASSES), "update"), ["key"])


@query("stream_classifier", f"WITH RECURSIVE {_LEARNT} SELECT key, k * 10 AS n, CAST(c AS INTEGER) AS class, {', '.join(f'round(w[c * {_DIM + 1} + {d + 1}], 6) AS w{d}' for d in range(_DIM))}, round(w[c * {_DIM + 1} + {_DIM + 1}], 6) AS b FROM m, (SELECT unnest(range(0, {_CLASSES})) AS c)")
def stream_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of three classes over the first two components of vectors, a model a key, a row a class."""
    own = _learnt(spark, sf_dir).select("key", "n", "bias", F.posexplode("weights").alias("class", "w"))
    return own.select("key", "n", "class", *[F.round(F.col("w")[d], 6).alias(f"w{d}") for d in range(_DIM)], F.round(F.get("bias", F.col("class")), 6).alias("b"))


_PROBA = ", ".join(f"1 / (1 + exp(-({_z(c)})))" for c in range(_CLASSES))


@query(
    "stored_model_predictions",
    f"WITH RECURSIVE {_LEARNT}, q AS (SELECT r.id, r.key, [{_PROBA}] AS s FROM v r JOIN m p ON p.key = r.key) SELECT id, key, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS label, {', '.join(f'round(s[{c + 1}] / list_sum(s), 6) AS p{c}' for c in range(_CLASSES))} FROM q",
)
def stored_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same models saved, loaded again and asked about all vectors."""
    store = ModelStore(spark, new_folder(spark, "models"))
    store.save(_learnt(spark, sf_dir))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("key"), F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, _DIM), lambda v: v.cast("double")).alias("x"))
    out = learning.predicted(store.load(), rows)
    return out.select("id", "key", "label", *[F.round(F.col("proba")[c], 6).alias(f"p{c}") for c in range(_CLASSES)])
