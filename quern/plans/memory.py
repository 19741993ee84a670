"""Places, times, graph, feedback, evaluation and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import corpus, evaluation, feedback, graph, learning, ranking, series, spatial
from quern.registry import query

from .retrieval import _BM25
from .tables import QUESTIONS, questions, table

BOX = (-20.0, -10.0, 15.0, 20.0)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes_of(table(spark, sf_dir, "customer"))


def boxes_of(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    has = k % 17 != 0
    lon, lat = (k % 120 - 60).cast("double"), ((k * 7) % 80 - 40).cast("double")
    side = (F.lit(1.0) + k % 5) * 5
    own = [F.when(has, v).alias(n) for n, v in (("min_lon", lon), ("min_lat", lat), ("max_lon", lon + side), ("max_lat", lat + side))]
    return customers.select(k.alias("id"), *own, "c_nationkey")


_BOXES = """bx AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 120 - 60 AS DOUBLE) END AS min_lon, CASE WHEN c_custkey % 17 <> 0 THEN CAST((c_custkey * 7) % 80 - 40 AS DOUBLE) END AS min_lat,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 120 - 60 AS DOUBLE) + (1.0 + c_custkey % 5) * 5 END AS max_lon, CASE WHEN c_custkey % 17 <> 0 THEN CAST((c_custkey * 7) % 80 - 40 AS DOUBLE) + (1.0 + c_custkey % 5) * 5 END AS max_lat FROM customer)"""


@query("bbox_intersects", f"WITH {_BOXES} SELECT id FROM bx WHERE min_lon <= 15 AND max_lon >= -20 AND min_lat <= 20 AND max_lat >= -10")
def bbox_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.intersects(boxes(spark, sf_dir), BOX).select("id")


@query("bbox_within", f"WITH {_BOXES} SELECT id FROM bx WHERE min_lon >= -20 AND max_lon <= 15 AND min_lat >= -10 AND max_lat <= 20")
def bbox_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within(boxes(spark, sf_dir), BOX).select("id")


@query("bbox_contains", f"WITH {_BOXES} SELECT id FROM bx WHERE min_lon <= -2 AND max_lon >= 1 AND min_lat <= 3 AND max_lat >= 5")
def bbox_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.contains(boxes(spark, sf_dir), (-2.0, 3.0, 1.0, 5.0)).select("id")


@query(
    "distance_lte",
    f"""WITH {_BOXES}, c AS (SELECT id, radians((min_lat + max_lat) / 2) AS p1, radians(4.0) AS p2, radians(-0.5 - (min_lon + max_lon) / 2) AS dl FROM bx),
    h AS (SELECT id, 2 * 6371000.0 * asin(sqrt(least(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2), 1.0))) AS d FROM c) SELECT id, round(d, 3) AS distance_m FROM h WHERE d <= 1500000""",
)
def distance_lte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.distance_lte(boxes(spark, sf_dir), (-2.0, 3.0, 1.0, 5.0), 1_500_000).select("id", F.round("distance_m", 3).alias("distance_m"))


@query("temporal_range", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS acquired_at FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') BETWEEN '1996-03-01' AND '1997-02-15'")
def temporal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("acquired_at"))
    return spatial.between(own, "acquired_at", "1996-03-01", "1997-02-15")


@query("sensor_fallback", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN 'x' || event_type END) IN ('click', 'xview', 'purchase')")
def sensor_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("sensor", F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).withColumn("other", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x"), "event_type")))
    return spatial.by_sensor(t, ["click", "xview", "purchase"], "sensor", "other").select("event_id")


@query("utm_zones", f"WITH {_BOXES} SELECT id, CAST(CASE WHEN (min_lat + max_lat) / 2 >= 0 THEN 32600 ELSE 32700 END + least(floor(((min_lon + max_lon) / 2 + 180) / 6) + 1, 60) AS INTEGER) AS epsg FROM bx WHERE min_lon IS NOT NULL")
def utm_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = boxes(spark, sf_dir).where("min_lon is not null")
    return own.select("id", spatial.utm_epsg((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2).alias("epsg"))


@query(
    "weather_grid",
    """WITH b AS (SELECT s_suppkey AS id, CAST(s_suppkey % 90 AS DOUBLE) AS x0, CAST(s_suppkey % 60 AS DOUBLE) AS y0 FROM supplier), s AS (SELECT *, 20000 / 111320.0 AS dy, (20000 / 111320.0) / greatest(0.01, cos(radians((y0 + y0 + 1) / 2))) AS dx FROM b)
    SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(x0 + i * dx, 9) AS lon, round(y0 + j * dy, 9) AS lat FROM (SELECT *, unnest(range(0, CAST(floor(1 / dx + 1e-9) AS BIGINT) + 1)) AS i FROM s), LATERAL (SELECT unnest(range(0, CAST(floor(1 / dy + 1e-9) AS BIGINT) + 1)) AS j)""",
)
def weather_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 90).cast("double").alias("min_lon"), (k % 60).cast("double").alias("min_lat"), (k % 90 + 1).cast("double").alias("max_lon"), (k % 60 + 1).cast("double").alias("max_lat"))
    return spatial.grid_points(own, 20).select("id", "i", "j", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id): orders as relations from their customer to another one of all."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))  # one row
    t = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % F.col("n")).alias("target_id"))


_REL = "rel AS (SELECT o_orderkey AS id, o_custkey AS source_id, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS target_id FROM orders), bo AS (SELECT id, source_id AS near, target_id AS far FROM rel UNION ALL SELECT id, target_id, source_id FROM rel), st AS (SELECT c_custkey AS start FROM customer WHERE c_custkey % 100 = 0)"


@query(
    "graph_traverse",
    f"""WITH {_REL}, h0 AS (SELECT start, id, min({{'near': near, 'far': far}}) AS e, 0 AS hop FROM st JOIN bo ON near = start GROUP BY start, id), f0 AS (SELECT DISTINCT start, e.far AS n FROM h0),
    h1 AS (SELECT start, id, min({{'near': near, 'far': far}}) AS e, 1 AS hop FROM f0 JOIN bo ON near = n WHERE (start, id) NOT IN (SELECT (start, id) FROM h0) GROUP BY start, id), a AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1)
    SELECT start, id AS relation_id, e.near AS near, e.far AS far, hop FROM a QUALIFY row_number() OVER (PARTITION BY start ORDER BY hop, id) <= 50""",
)
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("start"))
    return graph.traverse(relations(spark, sf_dir), start, depth=1)


@query(
    "relation_expand",
    f"""WITH {_REL}, en AS (SELECT c_custkey AS id, 'seg' || CAST(c_custkey AS VARCHAR) AS evidence_id FROM customer), h AS (SELECT c_custkey % 3 AS query_id, 'seg' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 100 = 0),
    o AS (SELECT query_id, en.id AS near FROM h JOIN en ON h.id = evidence_id), f AS (SELECT DISTINCT query_id, evidence_id AS segment_id FROM o JOIN bo USING (near) JOIN en ON en.id = far)
    SELECT query_id, segment_id FROM f WHERE (query_id, segment_id) NOT IN (SELECT (query_id, id) FROM h) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY segment_id) <= 50""",
)
def relation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("seg"), F.col("c_custkey").cast("string")).alias("evidence_id"))
    hits = named.where("id % 100 = 0").select((F.col("id") % 3).alias("query_id"), F.col("evidence_id").alias("id"))
    return graph.expand_hits(hits, named, relations(spark, sf_dir))


@query("pending_anti", "SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' WHEN quality = 1 THEN 'supported' ELSE 'rejected' END AS state FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").when(F.col("quality") == 1, "supported").otherwise("rejected")
    return graph.pending(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), state.alias("state")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query("latest_observation", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("upsert_latest", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) AS top FROM events GROUP BY user_id, event_type")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    last = corpus.latest_version(t, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "value")
    return last.join(t.groupBy("user_id", "event_type").agg(F.max("event_id").alias("top")), ["user_id", "event_type"])


@query(
    "retrieval_metrics",
    f"""WITH {QUESTIONS}, {_BM25}, gold AS (SELECT query_id, id FROM br WHERE rank % 4 = query_id // 100 % 4 AND rank < 12), gs AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id), ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
    m AS (SELECT br.query_id, br.id, br.rank, gold.id IS NOT NULL AS good FROM br LEFT JOIN gold ON gold.query_id = br.query_id AND gold.id = br.id WHERE rank < 10),
    p AS (SELECT query_id, k, count(*) AS n, count(*) FILTER (WHERE good) AS g, min(rank) FILTER (WHERE good) AS fr, sum(CASE WHEN good THEN 1 / log2(rank + 2) ELSE 0.0 END) AS dcg FROM m, ks WHERE rank < k GROUP BY query_id, k)
    SELECT gs.query_id, ks.k, round(coalesce(g / n_gold, 0.0), 9) AS recall, round(coalesce(g / n, 0.0), 9) AS precision, round(coalesce(1.0 / (fr + 1), 0.0), 9) AS mrr,
           round(coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_gold, n) + 1)]), 0.0), 9) AS ndcg FROM gs CROSS JOIN ks LEFT JOIN p ON p.query_id = gs.query_id AND p.k = ks.k""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 12).select("query_id", "id", "rank")
    gold = hits.where("rank % 4 = query_id div 100 % 4").select("query_id", "id")
    out = evaluation.retrieval_metrics(hits.where("rank < 10"), gold)
    return out.select("query_id", "k", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


@query(
    "qa_metrics",
    """WITH a AS (SELECT conv_id, turn, turn % 3 = 0 AS predicted, conv_id % 2 = 0 AS expected, [conv_id % 5, turn % 5 + 10] AS cited, [conv_id % 4, turn % 3 + 10] AS gold FROM conversations),
    s AS (SELECT *, len(list_intersect(cited, gold)) AS ok, 2 AS n FROM a) SELECT round(avg(CAST(predicted = expected AS DOUBLE)), 9) AS abstention_accuracy, round(avg(CAST(predicted AS DOUBLE)), 9) AS abstain_rate, round(sum(ok) / sum(n), 9) AS citation_correctness, round(avg(ok / n), 9) AS faithfulness FROM s""",
)
def qa_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    rows = t.select((F.col("turn") % 3 == 0).alias("predicted_abstain"), (F.col("conv_id") % 2 == 0).alias("expected_abstain"), F.array(F.col("conv_id") % 5, F.col("turn") % 5 + 10).alias("cited"), F.array(F.col("conv_id") % 4, F.col("turn") % 3 + 10).alias("gold"))
    out = evaluation.answer_metrics(rows)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "memory_score",
    """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS c, count(*) FILTER (WHERE event_type = 'view') AS u, count(DISTINCT event_type) > 3 AS m, count(*) FILTER (WHERE event_type = 'error' OR value < 2) AS r, count(*) FILTER (WHERE value > 95) AS x FROM events GROUP BY user_id),
    t AS (SELECT user_id, greatest(0.0, least(20.0, 5.0 + least(c * 3, 6) + least(u * 2, 4) + CASE WHEN m THEN 3 ELSE 0 END - r * 5 - x * 3)) AS score FROM s)
    SELECT user_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 14 THEN 'verified' WHEN score >= 8 THEN 'supported' ELSE 'proposed' END AS state, CAST(CASE WHEN score >= 14 THEN 0.8 WHEN score >= 8 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS weight FROM t""",
)
def memory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "purchase").alias("c"), F.count_if(kind == "view").alias("u"), (F.count_distinct(kind) > 3).alias("m"), F.count_if((kind == "error") | (F.col("value") < 2)).alias("r"), F.count_if(F.col("value") > 95).alias("x")
    )
    s = s.select("user_id", feedback.confidence(F.col("c"), F.col("u"), F.col("m"), F.col("r"), F.col("x")).alias("score"))
    s = s.withColumn("state", feedback.state_of(F.col("score")))
    return s.withColumn("weight", feedback.weight_of(F.col("state")))


_STATES = "CASE event_id % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'verified' WHEN 2 THEN 'rejected' ELSE 'proposed' END"


@query(
    "candidate_transitions",
    f"""WITH e AS (SELECT event_id, user_id, {_STATES} AS state, lag({_STATES}, 1, 'proposed') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, user_id, before, state, before = state OR (before = 'proposed' AND state IN ('supported', 'rejected')) OR (before = 'supported' AND state IN ('verified', 'rejected')) OR (before = 'verified' AND state = 'rejected') AS valid FROM e""",
)
def candidate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 5
    state = F.when(m == 0, "supported").when(m == 1, "verified").when(m == 2, "rejected").otherwise("proposed")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("state"))
    return feedback.transitions(rows, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "before", "state", "valid")


@query("dataset_dedup", "SELECT source AS task, md5(text) AS signature, max(doc_id) AS doc_id FROM documents GROUP BY source, md5(text)")
def dataset_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.md5("text").alias("signature"), "doc_id")
    return feedback.dedup_examples(rows, "task", "signature", [-F.col("doc_id")])


@query("dataset_duplicates", "SELECT task, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT lang AS task, md5(text) AS s, count(*) AS n FROM documents GROUP BY lang, md5(text) HAVING count(*) > 1) GROUP BY task")
def dataset_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), F.md5("text").alias("signature"))
    return feedback.duplicate_counts(rows, "task", "signature")


@query(
    "export_rows",
    """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
    SELECT '{"instruction":' || CAST(to_json(u.text) AS VARCHAR) || ',"context":[],"completion":' || CAST(to_json(coalesce(a.text, '')) AS VARCHAR) || '}' AS line FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""",
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    rows = asked.join(said, ["conv_id", "turn"], "left").select(F.create_map(F.lit("question"), "q", F.lit("answer"), F.coalesce("a", F.lit(""))).alias("payload"))
    return feedback.export_rows(rows, "sft")


@query("promote_events", "SELECT user_id AS target_id, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS events FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def promote_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("target_id"), "event_id")
    return feedback.promote(rows).select("target_id", F.array_join("events", ",").alias("events"))


@query(
    "workspace_stats",
    "SELECT 'documents' AS kind, lang AS part, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'pages', 'all', count(*) FROM pages UNION ALL SELECT 'embeddings', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role",
)
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").alias("n")
    parts = [("documents", F.col("lang")), ("pages", F.lit("all")), ("embeddings", F.col("label").cast("string")), ("conversations", F.col("role"))]
    out = None
    for name, part in parts:
        one = table(spark, sf_dir, name).groupBy(part.alias("part")).agg(n).select(F.lit(name).alias("kind"), "part", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "drift_error_rate",
    """WITH e AS (SELECT event_id, user_id, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS r FROM events)
    SELECT event_id, user_id, round(r, 9) AS error_rate, r > 0.3 AS drift FROM e""",
)
def drift_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.error_drift(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 60)
    return rows.select("event_id", "user_id", F.round("error_rate", 9).alias("error_rate"), "drift")


@query("fifo_window", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100")
def fifo_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fifo(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("batch_trigger", "SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS INTEGER) AS batch FROM events")
def batch_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.batches(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "batch")


@query(
    "association_decay",
    """SELECT user_id, event_type, round(sum(pow(2.0, -(epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 86400e6 / 90.0)), 6) AS score FROM events GROUP BY user_id, event_type
    HAVING sum(pow(2.0, -(epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 86400e6 / 90.0)) >= 0.01""",
)
def association_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.decayed_scores(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", F.lit("2024-06-01").cast("timestamp"))
    return out.select("user_id", "event_type", F.round("score", 6).alias("score"))


@query(
    "association_blend",
    """WITH a AS (SELECT label, user_id, count(*) * 1.0 AS s FROM (SELECT event_id % 3 AS label, user_id FROM events) GROUP BY label, user_id), t AS (SELECT user_id, sum(s) AS total FROM a GROUP BY user_id),
    p AS (SELECT user_id, label, CASE label WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END AS p FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2]) AS label)),
    b AS (SELECT p.user_id, p.label, 0.5 * p + 0.5 * coalesce(s, 0) / total AS b FROM p JOIN t USING (user_id) LEFT JOIN a ON a.user_id = p.user_id AND a.label = p.label)
    SELECT user_id, CAST(label AS INTEGER) AS label, round(b / sum(b) OVER (PARTITION BY user_id), 9) AS blended FROM b""",
)
def association_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).cast("int").alias("label"))
    scores = t.groupBy("user_id", "label").agg(F.count("*").cast("double").alias("score"))
    share = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.lit(p).alias("p")) for i, p in enumerate((0.5, 0.3, 0.2))])).alias("e")
    proba = t.select("user_id").distinct().select("user_id", share).select("user_id", "e.label", "e.p")
    return learning.blend(proba, scores, "user_id").select("user_id", "label", F.round("blended", 9).alias("blended"))


_KNN = """e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, label FROM embeddings), qv AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label END AS label, list_distance(v, q) AS dist FROM e, qv WHERE vec_id <> query_id),
    c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) <= 20),
    k AS (SELECT * FROM c WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) <= 5),
    w AS (SELECT query_id, label, sum(1 / (dist + 1e-5)) AS w FROM k GROUP BY query_id, label), p AS (SELECT query_id, label, w / sum(w) OVER (PARTITION BY query_id) AS p FROM w),
    z AS (SELECT query_id, arg_max(label, (round(p, 9), -label)) AS label, max(p) AS p, -sum(p * ln(p)) AS h FROM p GROUP BY query_id)"""


@query("knn_vote", f"WITH {_KNN} SELECT query_id, label, round(h, 6) AS entropy, round(0.7 * p + 0.3 * (1 - least(h / ln(2), 1)), 6) AS confidence, 0.7 * p + 0.3 * (1 - least(h / ln(2), 1)) < 0.6 OR h > 0.65 AS abstain FROM z")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    cached = t.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("label"))
    asked = t.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    out = learning.knn_vote(cached, asked)
    return out.select("query_id", "label", F.round("entropy", 6).alias("entropy"), F.round("confidence", 6).alias("confidence"), "abstain")


@query(
    "edge_logits",
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), l AS (SELECT vec_id, c, list_sum([v[i] * ((i * (c + 1)) % 7 - 3) / 10.0 FOR i IN range(1, 65)]) + c / 10.0 AS z FROM e, (SELECT unnest([0, 1, 2]) AS c)),
    s AS (SELECT vec_id, c, 1 / (1 + exp(-z)) AS s FROM l) SELECT vec_id, CAST(c AS INTEGER) AS class, round(s / sum(s) OVER (PARTITION BY vec_id), 9) AS proba FROM s""",
)
def edge_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = [[((i * (c + 1)) % 7 - 3) / 10.0 for i in range(1, 65)] for c in range(3)]
    t = table(spark, sf_dir, "embeddings").select("vec_id", learning.edge_proba(F.col("embedding"), weights, [0.0, 0.1, 0.2]).alias("p"))
    return t.select("vec_id", F.posexplode("p").alias("class", "proba")).select("vec_id", "class", F.round("proba", 9).alias("proba"))


@query("confidence_entropy", "WITH p AS (SELECT event_id, least(greatest(value / 100, 0.01), 0.99) AS p FROM events), h AS (SELECT event_id, p, -(p * ln(p) + (1 - p) * ln(1 - p)) AS h FROM p) SELECT event_id, round(h, 9) AS entropy, round(0.7 * greatest(p, 1 - p) + 0.3 * (1 - least(h / ln(2), 1)), 9) AS confidence FROM h")
def confidence_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.greatest(F.col("value") / 100, F.lit(0.01)), F.lit(0.99))
    t = table(spark, sf_dir, "events").select("event_id", F.array(p, 1 - p).alias("p"))
    h = learning.entropy(F.col("p"))
    return t.select("event_id", F.round(h, 9).alias("entropy"), F.round(learning.confidence(F.array_max("p"), h), 9).alias("confidence"))


@query("version_gc", "SELECT user_id, event_id, age_rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age_rank FROM events) WHERE age_rank > 10")
def version_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.old_versions(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "age_rank")


@query(
    "region_fallback",
    """WITH k AS (SELECT c_custkey, c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey % 4 AS VARCHAR) AS key FROM customer), w AS (SELECT key, avg(c_custkey) AS w FROM k WHERE c_custkey % 7 = 0 GROUP BY key),
    p AS (SELECT regexp_replace(key, '/[^/]*$', '') AS key, avg(w) AS w FROM w GROUP BY 1) SELECT k.c_custkey, round(coalesce(w.w, p.w, 0.0), 6) AS weight, CASE WHEN w.w IS NOT NULL THEN 'own' WHEN p.w IS NOT NULL THEN 'parent' ELSE 'default' END AS source
    FROM k LEFT JOIN w ON w.key = k.key LEFT JOIN p ON p.key = regexp_replace(k.key, '/[^/]*$', '')""",
)
def region_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 4).cast("string")).alias("key"))
    own = k.where("c_custkey % 7 = 0").groupBy("key").agg(F.avg("c_custkey").alias("weight"))
    return learning.with_parent_weights(k, own, "key").select("c_custkey", F.round("weight", 6).alias("weight"), "source")


@query(
    "isotonic_calibration",
    """WITH e AS (SELECT event_id, least(value / 100, 1) AS x, list({'x': least(value / 100, 1), 'y': CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS w FROM events),
    s AS (SELECT event_id, x, len(w) AS n, list_sort(w) AS w FROM e),
    f AS (SELECT event_id, x, n, [p.x FOR p IN w] AS xs, [coalesce(list_sum([p.y FOR p IN w[1:i]]), 0) FOR i IN range(0, n + 1)] AS c FROM s),
    pl AS (SELECT event_id, x, n, c, xs, len([1 FOR v IN xs IF v < x]) + 1 AS k FROM f)
    SELECT event_id, round(CASE WHEN n < 10 THEN x ELSE list_max([list_min([(c[b + 1] - c[a]) / (b - a + 1) FOR b IN range(k, n + 1) IF b = n OR xs[b + 1] <> xs[b]]) FOR a IN range(1, k + 1) IF a = 1 OR xs[a - 1] <> xs[a]]) END, 9) AS calibrated FROM pl""",
)
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value as a chance, by the isotonic fit of its user's last hundred events."""
    t = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (F.col("event_id") % 3 == 0).cast("double").alias("label"))
    return learning.recalibrated(t, "user_id", ["ts", "event_id"], "score", "label").select("event_id", F.round("calibrated", 9).alias("calibrated"))


@query("train_per_key")
def train_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("key"), F.col("vec_id").alias("id"), "embedding", (F.col("label") % 2).alias("label"))
    return learning.train_per_key(t, "key", "id", "embedding", "label")
