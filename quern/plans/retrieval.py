"""Corpus and retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import chunking, corpus, feedback, ranking
from quern.registry import query

from .tables import QUESTIONS, questions, table

_TERMS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
_GRAMS = "flatten([CASE WHEN len(w) < 3 THEN [w] ELSE [substr(w, i, 3) FOR i IN range(1, len(w) - 1)] END FOR w IN " + _TERMS + "])"
_BM25 = (
    "t AS (SELECT doc_id AS id, " + _TERMS.format("text") + " AS ts FROM documents),"
    " n AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM t),"
    " qt AS (SELECT query_id, unnest(list_distinct(" + _TERMS.format("query") + ")) AS term FROM q),"
    " f AS (SELECT id, term, count(*) AS tf, max(len) AS len FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY id, term),"
    " d AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, avg_len FROM (SELECT term, count(*) AS df FROM f GROUP BY term), n),"
    " b AS (SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM f JOIN d USING (term) JOIN qt USING (term) GROUP BY query_id, id),"
    " br AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM b)"
)
_DENSE = (
    "e AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),"
    " dq AS (SELECT id AS query_id, v AS qv FROM e WHERE id % 100 = 0),"
    " s AS (SELECT query_id, id, list_cosine_similarity(v, qv) AS score, list_distance(v, qv) AS dist FROM e, dq)"
)
_RRF = (
    "ls AS (SELECT query_id, 0 AS list_id, id, rank, score FROM br WHERE rank < 50 UNION ALL"
    " SELECT query_id, 1, id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, id) - 1, CAST(len AS DOUBLE) FROM (SELECT query_id, id, max(len) AS len FROM f JOIN qt USING (term) GROUP BY query_id, id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len DESC, id) <= 50)"
)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists for each question: by BM25, and by length among documents that share a term."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    first = ranking.bm25(docs, asked, 50).select("query_id", F.lit(0).alias("list_id"), "id", "rank", "score")
    second = ranking.longest(docs, asked, 50).select("query_id", F.lit(1).alias("list_id"), "id", "rank", "score")
    return first.unionByName(second)


@query("content_dedup", "SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS skipped FROM documents")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.content_dedup(table(spark, sf_dir, "documents"))


@query(
    "chunk_fixed",
    """WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM documents),
    c AS (SELECT doc_id, w, unnest([s FOR s IN range(0, len(w), 170) IF s = 0 OR s - 170 + 200 < len(w)]) AS first FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(first // 170 AS INTEGER) AS chunk, CAST(first AS INTEGER) AS first, CAST(least(first + 200, len(w)) AS INTEGER) AS last, array_to_string(w[first + 1 : least(first + 200, len(w))], ' ') AS text,
           CASE WHEN first > 0 THEN CAST(first // 170 AS INTEGER) - 1 END AS prev, CASE WHEN first + 200 < len(w) THEN CAST(first // 170 AS INTEGER) + 1 END AS next FROM c""",
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_size(table(spark, sf_dir, "documents"), size=200, overlap=30)


_SECTIONS = """WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), 1) AS line_no FROM documents),
    h AS (SELECT doc_id, line_no, line, trim(line) AS bare, regexp_matches(trim(line), '^#{1,6} ') OR (trim(line) = upper(trim(line)) AND trim(line) <> lower(trim(line)) AND len(trim(line)) > 2 AND len(trim(line)) < 120) AS h FROM l),
    r AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM h),
    s AS (SELECT doc_id, run, arg_min(CASE WHEN h THEN trim(regexp_replace(bare, '^[# ]+', '')) ELSE 'document' END, line_no) AS title, arg_min(h, line_no) AS is_header, string_agg(CASE WHEN h THEN bare ELSE line END, chr(10) ORDER BY line_no) AS text FROM r GROUP BY doc_id, run)"""


@query(
    "chunk_header",
    f"""{_SECTIONS}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS section, title, is_header, text, CAST(len(text) AS INTEGER) AS n_chars FROM s""",
)
def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.header_sections(table(spark, sf_dir, "documents"))


@query(
    "chunk_header_tokens",
    f"""{_SECTIONS}, n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS section, title, is_header, text, greatest(1, len(text) // 4) <= 1000 AS short FROM s),
    w AS (SELECT doc_id, section, title, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM n WHERE NOT short),
    c AS (SELECT doc_id, section, title, w, unnest([s FOR s IN range(0, len(w), 850) IF s = 0 OR s - 850 + 1000 < len(w)]) AS first FROM w)
    SELECT doc_id, section, title, CASE WHEN is_header THEN 'heading' ELSE 'paragraph' END AS kind, CAST(NULL AS INTEGER) AS first, CAST(NULL AS INTEGER) AS last, text FROM n WHERE short
    UNION ALL SELECT doc_id, section, title, 'paragraph', CAST(first AS INTEGER), CAST(least(first + 1000, len(w)) AS INTEGER), array_to_string(w[first + 1 : least(first + 1000, len(w))], ' ') FROM c""",
)
def chunk_header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.header_then_tokens(table(spark, sf_dir, "documents"))


@query(
    "chunk_greedy",
    """WITH RECURSIVE r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    l AS (SELECT doc_id, s, greatest(1, len(s) // 4) AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM r) WHERE s <> ''),
    c AS (SELECT doc_id, k, 0 AS chunk, cost AS total FROM l WHERE k = 1 UNION ALL
      SELECT l.doc_id, l.k, c.chunk + CASE WHEN c.total + l.cost > 1000 THEN 1 ELSE 0 END, CASE WHEN c.total + l.cost > 1000 THEN l.cost ELSE c.total + l.cost END FROM c JOIN l ON l.doc_id = c.doc_id AND l.k = c.k + 1)
    SELECT doc_id, chunk, string_agg(s, chr(10) ORDER BY k) AS text, CAST(sum(cost) AS INTEGER) AS tokens FROM c JOIN l USING (doc_id, k) GROUP BY doc_id, chunk""",
)
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.greedy_lines(table(spark, sf_dir, "documents"))


@query("tokenize_3gram", "SELECT g, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(" + _GRAMS.format("text") + ") AS g FROM documents) GROUP BY g")
def tokenize_3gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trigram_counts(table(spark, sf_dir, "documents"))


@query("bm25_topk", f"WITH {QUESTIONS}, {_BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank < 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "ngram_cosine_topk",
    f"""WITH {QUESTIONS}, g AS (SELECT doc_id AS id, unnest({_GRAMS.format("text")}) AS g FROM documents), c AS (SELECT id, g, count(*) AS tf FROM g GROUP BY id, g),
    z AS (SELECT id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS size FROM c GROUP BY id),
    qg AS (SELECT query_id, g, count(*) AS qf FROM (SELECT query_id, unnest({_GRAMS.format("query")}) AS g FROM q) GROUP BY query_id, g),
    qz AS (SELECT query_id, sqrt(CAST(sum(qf * qf) AS DOUBLE)) AS q_size FROM qg GROUP BY query_id),
    s AS (SELECT query_id, id, sum(tf * qf) / (max(size) * max(q_size)) AS score FROM c JOIN qg USING (g) JOIN z USING (id) JOIN qz USING (query_id) GROUP BY query_id, id)
    SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS INTEGER) AS rank FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10""",
)
def ngram_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trigram_cosine(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "hash_embed",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
    s AS (SELECT doc_id, CAST(('0x' || substr(md5(t), 7, 2) || substr(md5(t), 5, 2) || substr(md5(t), 3, 2) || substr(md5(t), 1, 2))::BIGINT % 256 AS INTEGER) AS slot, count(*) AS n FROM t GROUP BY ALL),
    z AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS z FROM s GROUP BY doc_id) SELECT doc_id, slot, round(n / z, 9) AS value FROM s JOIN z USING (doc_id)""",
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranking.hashed_embedding(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select("doc_id", "slot", F.round("value", 9).alias("value"))


@query("dense_cosine_topk", f"WITH {_DENSE} SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20 AND round(score, 9) > 0")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return ranking.dense(v, asked, 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("euclid_nearest", f"WITH {_DENSE} SELECT query_id, id, round(dist, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) - 1 AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) <= 20")
def euclid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return ranking.nearest(v, asked, 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "image_space_topk",
    f"WITH {_DENSE}, ok AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 5), z AS (SELECT s.query_id, s.id, s.score FROM s JOIN embeddings a ON a.vec_id = s.id JOIN embeddings b ON b.vec_id = s.query_id AND a.label = b.label WHERE a.label IN (SELECT label FROM ok)) "
    "SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS INTEGER) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10",
)
def image_space_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine within a space (the label); spaces of fewer than five vectors are left out, negative scores stay."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    spaces = v.groupBy("label").count().where("count >= 5").select("label")
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), "label")
    return ranking.dense(v.join(spaces, "label"), asked, 10, positive=False, on=["label"]).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "rrf_fuse",
    f"""WITH {QUESTIONS}, {_BM25}, {_RRF}, z AS (SELECT query_id, id, sum(1.0 / (60 + rank + 1)) AS score, min(list_id * 1000 + rank) AS first FROM ls GROUP BY query_id, id)
    SELECT query_id, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) - 1 AS INTEGER) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) <= 20""",
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reciprocal_rank(_lists(spark, sf_dir).drop("score"), 20).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(
    "linear_fuse",
    f"""WITH {QUESTIONS}, {_BM25}, {_RRF}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ls WINDOW w AS (PARTITION BY query_id, list_id)), nl AS (SELECT query_id, 1.0 / count(DISTINCT list_id) AS weight FROM ls GROUP BY query_id),
    z AS (SELECT query_id, id, sum(weight * (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) AS score, min(list_id * 1000 + rank) AS first FROM m JOIN nl USING (query_id) GROUP BY query_id, id)
    SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) - 1 AS INTEGER) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) <= 20""",
)
def linear_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.linear(_lists(spark, sf_dir), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_SEARCH = f"""WITH {QUESTIONS}, {_BM25}, g AS (SELECT doc_id AS id, unnest({_GRAMS.format("text")}) AS g FROM documents), c AS (SELECT id, g, count(*) AS tf FROM g GROUP BY id, g),
    z AS (SELECT id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS size FROM c GROUP BY id),
    qg AS (SELECT query_id, g, count(*) AS qf FROM (SELECT query_id, unnest({_GRAMS.format("query")}) AS g FROM q) GROUP BY query_id, g),
    qz AS (SELECT query_id, sqrt(CAST(sum(qf * qf) AS DOUBLE)) AS q_size FROM qg GROUP BY query_id),
    cs AS (SELECT query_id, id, sum(tf * qf) / (max(size) * max(q_size)) AS score FROM c JOIN qg USING (g) JOIN z USING (id) JOIN qz USING (query_id) GROUP BY query_id, id),
    ls AS (SELECT query_id, 0 AS list_id, id, rank FROM br WHERE rank < 50 UNION ALL SELECT query_id, 1, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 50),
    fu AS (SELECT query_id, id, sum(1.0 / (60 + rank + 1)) AS score, min(list_id * 1000 + rank) AS first FROM ls GROUP BY query_id, id),
    rk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS r FROM fu),
    dv AS (SELECT rk.*, source, lang, text, row_number() OVER (PARTITION BY query_id, source ORDER BY r, id) AS n FROM rk JOIN documents ON doc_id = id),
    sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS rank FROM dv WHERE n <= 3 AND lang IN ('en', 'de') AND r <= 50)"""


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and trigram cosine, fused by rank, at most three of a source, filtered by language."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    lists = ranking.bm25(docs, asked, 50).withColumn("list_id", F.lit(0)).unionByName(ranking.trigram_cosine(docs, asked, 50).withColumn("list_id", F.lit(1)))
    fused = ranking.reciprocal_rank(lists.drop("score"), 50)
    hits = ranking.with_documents(fused, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("revision_id"), "lang", "text"))
    hits = ranking.diverse(hits).where("lang in ('en', 'de')")
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order) - 1)


@query("hybrid_search", _SEARCH + " SELECT query_id, id, source AS revision_id, lang, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM sel WHERE rank < 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).where("rank < 5").select("query_id", "id", "revision_id", "lang", F.round("score", 9).alias("score"), "rank")


@query(
    "context_pack",
    f"""WITH {QUESTIONS}, {_BM25}, h AS (SELECT query_id, id, rank, text, least(greatest(1, len(text) // 4), 500) AS tokens FROM br JOIN documents ON doc_id = id WHERE rank < 10),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(tokens AS INTEGER) AS tokens, CAST(used AS BIGINT) AS used, CASE WHEN len(text) // 4 > 500 THEN substr(text, 1, 2000) ELSE text END AS text FROM u WHERE used <= 2000""",
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = ranking.with_documents(ranking.bm25(docs, questions(spark, sf_dir), 10), docs.select(F.col("doc_id").alias("id"), "text"))
    return ranking.pack(hits).select("query_id", "id", "rank", "tokens", "used", "text")


@query(
    "context_format",
    f"""WITH {QUESTIONS}, {_BM25}, h AS (SELECT query_id, rank, source, lang, text FROM br JOIN documents ON doc_id = id WHERE rank < 3)
    SELECT query_id, string_agg('[' || CAST(rank + 1 AS VARCHAR) || '] (source: source=' || source || ', lang=' || lang || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""",
)
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = ranking.with_documents(ranking.bm25(docs, questions(spark, sf_dir), 3), docs.select(F.col("doc_id").alias("id"), "source", "lang", "text"))
    return ranking.context(hits, F.concat(F.lit("source="), F.col("source"), F.lit(", lang="), F.col("lang")))


@query(
    "candidate_tiers",
    f"""WITH {QUESTIONS}, {_BM25}, cd AS (SELECT query_id, id, score, CASE id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'supported' WHEN 2 THEN 'rejected' ELSE 'new' END AS state FROM br WHERE rank >= 5 AND rank < 20),
    bo AS (SELECT query_id, id, score, 'authoritative' AS tier FROM br WHERE rank < 5 UNION ALL SELECT query_id, id, score * CASE state WHEN 'verified' THEN 0.8 WHEN 'supported' THEN 0.4 ELSE 0.1 END, 'candidate' FROM cd WHERE state <> 'rejected')
    SELECT query_id, id, round(score, 6) AS score, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9) DESC, id) - 1 AS INTEGER) AS rank FROM bo QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9) DESC, id) <= 12""",
)
def candidate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 20)
    state = F.when(F.col("id") % 4 == 0, "verified").when(F.col("id") % 4 == 1, "supported").when(F.col("id") % 4 == 2, "rejected").otherwise("new")
    out = ranking.tiers(ranked.where("rank < 5"), ranked.where("rank >= 5").withColumn("state", state), 12)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "tier", "rank")


@query(
    "candidate_search",
    """WITH c AS (SELECT d.doc_id AS id, lower(text) AS text, CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' WHEN quality = 1 THEN 'supported' WHEN toxic = 1 THEN 'rejected' ELSE 'proposed' END AS state FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    m AS (SELECT item_id AS query_id, id, state, CASE state WHEN 'verified' THEN 0.8 WHEN 'supported' THEN 0.4 ELSE 0.1 END AS score FROM benchmark b JOIN c ON contains(c.text, lower(b.text)) WHERE state <> 'rejected' AND trim(b.text) <> '')
    SELECT query_id, id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20""",
)
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' own search: labelled documents that contain a benchmark item, by the weight of their state; rejected ones are left out."""
    state = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").when(F.col("quality") == 1, "supported").when(F.col("toxic") == 1, "rejected").otherwise("proposed")
    marks = table(spark, sf_dir, "labels").select("doc_id", state.alias("state")).where("state <> 'rejected'")
    rows = table(spark, sf_dir, "documents").join(marks, "doc_id").select(F.col("doc_id").alias("id"), "text", feedback.weight_of(F.col("state")).alias("score"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ranking.containing(rows, asked, 20).select("query_id", "id", "score", "rank")


@query("diversity_cap", f"WITH {QUESTIONS}, {_BM25}, dv AS (SELECT br.*, source AS revision_id, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, id) AS n FROM br JOIN documents ON doc_id = id WHERE rank < 50) SELECT query_id, id, revision_id, CAST(rank AS INTEGER) AS rank FROM dv WHERE n <= 3")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = ranking.with_documents(ranking.bm25(docs, questions(spark, sf_dir), 50), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("revision_id")))
    return ranking.diverse(ranking.first_of_each(hits)).select("query_id", "id", "revision_id", "rank")


@query(
    "mime_kinds",
    """WITH e AS (SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '\\.([^.]*)$', 1)) AS ext FROM pages)
    SELECT page_id, CASE ext WHEN 'html' THEN 'text/html' WHEN 'txt' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' WHEN 'json' THEN 'application/json' ELSE 'application/octet-stream' END AS mime, 'document' AS kind FROM e""",
)
def mime_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0)
    named = table(spark, sf_dir, "pages").select("page_id", corpus.mime_of(name).alias("mime"))
    return named.select("page_id", "mime", corpus.kind_of(F.col("mime")).alias("kind"))


@query(
    "query_parse",
    """WITH p AS (SELECT conv_id, turn, [t FOR t IN regexp_split_to_array('sensor:' || role || ' type:doc-' || CAST(turn AS VARCHAR) || ' ' || text, '\\s+') IF t <> ''] AS t FROM conversations)
    SELECT conv_id, turn, array_to_string([regexp_extract(x, '^sensor:([\\w\\-.]+)', 1) FOR x IN t IF regexp_matches(x, '^sensor:[\\w\\-.]+')], '|') AS sensor,
           array_to_string([regexp_extract(x, '^type:([\\w\\-.]+)', 1) FOR x IN t IF regexp_matches(x, '^type:[\\w\\-.]+')], '|') AS type,
           array_to_string([x FOR x IN t IF NOT regexp_matches(x, '^(sensor|collection|type|language):[\\w\\-.]+')], ' ') AS rest FROM p""",
)
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("sensor:"), "role", F.lit(" type:doc-"), F.col("turn").cast("string"), F.lit(" "), "text").alias("query"))
    return corpus.parse_filters(t).select("conv_id", "turn", F.array_join("sensor", "|").alias("sensor"), F.array_join("type", "|").alias("type"), "rest")


_INTENT = """CASE WHEN regexp_matches(lower(text), 'how|what is|why|explain|compare|define') THEN 'grounded_qa' WHEN regexp_matches(lower(text), 'function|class|code|implement|def ') THEN 'code' ELSE 'search' END"""


@query("intent", f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", corpus.intent_of(F.col("text")).alias("intent"))


@query(
    "citation_map",
    f"""WITH {QUESTIONS}, {_BM25}, s AS (SELECT query_id, id, rank + 1 AS key FROM br WHERE rank < 5), a AS (SELECT query_id, 'see [1] and [' || CAST(query_id // 100 % 9 AS VARCHAR) || '], [2][2].' AS answer FROM q),
    k AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) AS BIGINT) AS key FROM a) SELECT k.query_id, CAST(k.key AS INTEGER) AS key, s.id, s.id IS NOT NULL AS valid FROM k LEFT JOIN s ON s.query_id = k.query_id AND s.key = k.key""",
)
def citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    sources = ranking.bm25(table(spark, sf_dir, "documents"), asked, 5).select("query_id", "id", "rank")
    answers = asked.select("query_id", F.concat(F.lit("see [1] and ["), F.expr("query_id div 100 % 9").cast("string"), F.lit("], [2][2].")).alias("answer"))
    return corpus.citations(answers, sources)


@query("citation_strip", "SELECT conv_id, turn, regexp_replace('a [1] b [' || CAST(turn + 3 AS VARCHAR) || '] ' || role, '\\[(?:[4-9]|\\d{2,})\\]', '', 'g') AS answer FROM conversations")
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("a [1] b ["), (F.col("turn") + 3).cast("string"), F.lit("] "), "role").alias("answer"))
    return t.select("conv_id", "turn", corpus.strip_citations(F.col("answer"), F.lit(3)).alias("answer"))


@query("abstain_rate", "SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(trim(text)), 'not found in selected sources|not found in the provided context|i don''t know|i do not know|cannot answer|insufficient information')) AS abstained FROM conversations GROUP BY role")
def abstain_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("role").agg(F.count("*").alias("n"), F.count_if(corpus.abstains(F.col("text"))).alias("abstained"))


@query("entity_extract", "SELECT DISTINCT page_id, 'domain' AS kind, regexp_extract(url, '(?i)example\\.(com|net|org)', 0) AS name FROM pages WHERE regexp_matches(url, '(?i)example\\.(com|net|org)') UNION SELECT DISTINCT page_id, 'language', regexp_extract(url, '/(de|en|es|fr)/', 0) FROM pages WHERE regexp_matches(url, '/(de|en|es|fr)/')")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.extract_entities(table(spark, sf_dir, "pages"), "page_id", "url", {"domain": r"(?i)example\.(com|net|org)", "language": "/(de|en|es|fr)/"})
