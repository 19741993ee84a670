"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The index holds postings (term, document, position) of the training texts for the terms that searches need. A phrase is
found from its rarest terms: their lists, each moved back by the term's offset in the phrase, are intersected, and what is
left is held against the words themselves. Proximity search intersects the lists of an item's rarest terms within a slop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Words of a window; for proximity the rarest terms of an item, and the words within which they stand from the rarest one.
WINDOW, TERMS, SLOP = 10, 3, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What separates words: all of ASCII but letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _cut(text: Column) -> Column:
    """A text cut at what separates words, which is much cheaper than looking for the words; there may be an empty one at either end."""
    return F.split(text, _BETWEEN, -1)


def _whole(cut: Column) -> Column:
    """A cut text without the empty words at its ends."""
    lead = F.when(cut[0] == "", 1).otherwise(0)
    return F.slice(cut, lead + 1, word_count(cut))


def word_count(cut: Column) -> Column:
    return F.size(cut) - F.when(cut[0] == "", 1).otherwise(0) - F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)


def words(text: Column) -> Column:
    """array<string>: the words of a text, A-Z lower-cased; empty for null."""
    return _whole(_cut(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)))


def coarse(text: Column) -> Column:
    """A text in lower case throughout, which costs less than A-Z alone: its words are equal wherever the text's own are.

    What becomes of a letter must not depend on what stands beside it: that is so for all but the sigma at a word's end.
    """
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\u03c2"), F.lit("\u03c3"))


def coarse_words(text: Column) -> Column:
    """As words, of the coarse text: as many."""
    return _whole(_cut(coarse(text)))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, row, pos) of the given terms; row is a hash of the text, which tells rows of one doc_id apart.

    terms comes from a stored table, so Spark knows its size: below its limit it is broadcast, beyond it the lists are
    joined by term, where the skew join splits frequent ones.
    """
    cut = docs.select("doc_id", F.xxhash64("text").alias("row"), _cut(coarse(F.col("text"))).alias("cut"))
    # outer: else Spark puts a filter on the array's size below, for which it cuts every text again
    each = cut.select("doc_id", "row", F.when(F.col("cut")[0] == "", 1).otherwise(0).alias("lead"), F.posexplode_outer("cut").alias("pos", "term"))
    return each.join(terms, "term").select("term", "doc_id", "row", (F.col("pos") - F.col("lead")).alias("pos"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, item_id, words, coarse, start, width) of every window; item numbers distinct rows by a hash of id and text."""
    own = items.select("item_id", words(F.col("text")).alias("words"), coarse_words(F.col("text")).alias("coarse")).where(F.size("words") > 0).distinct()
    own = own.withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "words"))).withColumn("width", F.least(F.size("words"), F.lit(size)))
    return own.select("item", "item_id", "words", "coarse", "width", F.explode(F.expr("sequence(0, size(words) - width)")).alias("start"))


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n) of the items' terms that occur, with how often they do."""
    vocabulary = store(items.select(F.explode(F.array_distinct(coarse_words(F.col("text")))).alias("term")).distinct(), "vocabulary")
    return store(postings(docs, vocabulary).groupBy("term").agg(F.count("*").alias("n")), "counts")


@dataclass
class Phrases:
    """What a search for phrases needs: windows of the items, the two rarest places of each, and those places by term."""

    windows: DataFrame
    chosen: DataFrame
    anchors: DataFrame


def phrases(items: DataFrame, counts: DataFrame, size: int = WINDOW) -> Phrases:
    wins = store(windows(items, size), "windows")
    places = wins.select("item", "start", F.expr("transform(slice(coarse, start + 1, width), (t, i) -> struct(t AS term, start + i AS offset))").alias("t"))
    places = places.select("item", "start", F.explode("t").alias("t")).select("item", "start", "t.*")
    # The two rarest places of each window; a window with a term that no document has cannot occur.
    ranked = places.join(counts, "term", "left").groupBy("item", "start").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.array_sort(F.collect_list(F.struct(F.col("n"), "offset", "term"))).alias("r")).where("least > 0")
    chosen = ranked.select("item", "start", F.col("r")[0].alias("a"), F.when(F.size("r") > 1, F.get("r", F.lit(1))).otherwise(F.col("r")[0]).alias("b"))
    chosen = store(chosen, "chosen")
    anchors = chosen.select("item", F.explode(F.array("a", "b")).alias("t")).select("item", F.col("t.term").alias("term"), F.col("t.offset").alias("offset")).distinct()
    return Phrases(wins, chosen, store(anchors, "anchors"))


def rarest(items: DataFrame, counts: DataFrame, terms: int = TERMS) -> DataFrame:
    """(item, item_id, k, term): the rarest terms of each item, from k = 0 on, by count and text; items whose rarest one doesn't occur have none."""
    own = items.select("item_id", F.array_distinct(coarse_words(F.col("text"))).alias("w")).distinct().withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "w")))
    places = own.select("item", "item_id", F.explode("w").alias("term"))
    ranked = places.join(counts, "term", "left").groupBy("item", "item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, terms).alias("r")).where("r[0].n > 0")
    return store(ranked.select("item", "item_id", F.posexplode("r").alias("k", "t")).select("item", "item_id", "k", "t.term"), "ranked")


def index_of(docs: DataFrame, *tables: DataFrame) -> DataFrame:
    """Postings of the terms of some tables, stored."""
    terms = tables[0].select("term")
    for t in tables[1:]:
        terms = terms.union(t.select("term"))
    return store(postings(docs, store(terms.distinct(), "terms")), "postings")


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, row, item_id, hits): for each document and item with a window in it, the positions of the words hit."""
    own = phrases(items, term_counts(docs, items), size)
    return found_phrases(docs, index_of(docs, own.anchors), own, size)


def found_phrases(docs: DataFrame, index: DataFrame, asked: Phrases, size: int = WINDOW) -> DataFrame:
    """As phrase_matches, from an index of the anchors' terms at least."""
    wins, chosen, anchors = asked.windows, asked.chosen, asked.anchors
    # Offset-adjusted lists: where the item would begin in the document.
    lists = index.join(anchors, "term").select("item", "doc_id", "row", (F.col("pos") - F.col("offset")).alias("begin"), "offset")
    met = lists.groupBy("item", "doc_id", "row", "begin").agg(F.collect_set("offset").alias("found")).where(F.size("found") > 1 if size > 1 else F.lit(True))
    single = chosen.where("a.offset = b.offset").select("item").distinct()
    if not single.isEmpty():  # windows of one word have one list
        met = lists.groupBy("item", "doc_id", "row", "begin").agg(F.collect_set("offset").alias("found"))
    pairs = chosen.groupBy("item").agg(F.collect_set(F.struct(F.col("a.offset").alias("a"), F.col("b.offset").alias("b"))).alias("pairs"))
    by_item = wins.select("item", "item_id", "words", "width").distinct().join(pairs, "item")
    by_item = store(by_item, "items")
    met = met.join(by_item, "item").where("exists(pairs, p -> array_contains(found, p.a) AND array_contains(found, p.b))")
    met = store(met.select("item", "doc_id", "row", "begin"), "candidates")
    # Only now the words: of the documents that are left, each place is compared.
    text = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    own = text.join(met.select("doc_id", "row").distinct().withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left_semi")
    own = own.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", words(F.col("text")).alias("doc"))
    at = met.join(by_item, "item").withColumnRenamed("doc_id", "d").withColumnRenamed("row", "r")
    both = own.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    same = "array_join(transform(words, (w, i) -> if(begin + i >= 0 AND get(doc, begin + i) <=> w, '1', '0')), '')"
    both = both.select("doc_id", "row", "item_id", "begin", "width", F.size("words").alias("n"), F.expr(same).alias("same"))
    starts = "filter(sequence(0, n - width), s -> substring(same, s + 1, width) = repeat('1', width))"
    hits = both.withColumn("starts", F.expr(starts)).where(F.size("starts") > 0)
    hits = hits.select("doc_id", "row", "item_id", F.expr("array_distinct(flatten(transform(starts, s -> sequence(begin + s, begin + s + width - 1))))").alias("hits"))
    return hits.groupBy("doc_id", "row", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, terms: int = TERMS) -> DataFrame:
    """(doc_id, item_id): documents in which an item's rarest terms all stand within slop words of the rarest one.

    Terms of equal rarity go by their text; a null text has no terms, neither has an item without words; null ids match as
    null, repeated rows give one match, empty tables none.
    """
    ranked = rarest(items, term_counts(docs, items), terms)
    return found_near(index_of(docs, ranked), ranked, slop).select("doc_id", "item_id").distinct()


def found_near(index: DataFrame, ranked: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, row, item_id) of proximity_matches, from an index of the ranked terms at least.

    Lists are met within a document, in pieces of slop positions, each with its two neighbours, so no pair of distant places
    is looked at.
    """
    lists = index.join(ranked, "term").select("item", "item_id", "k", "doc_id", "row", "pos", F.expr(f"pos div {slop}").alias("cell")).distinct()
    out = lists.where("k = 0").drop("k")
    near = lists.where("k > 0").select(F.col("item").alias("i"), F.col("doc_id").alias("d"), F.col("row").alias("r"), "k", F.col("pos").alias("p"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("c"))
    same = (F.col("item") == F.col("i")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("cell") == F.col("c"))
    met = out.join(near, same & (F.abs(F.col("pos") - F.col("p")) <= slop), "left")
    met = met.groupBy("item", "item_id", "doc_id", "row", "pos").agg(F.size(F.collect_set("k")).alias("n")).join(ranked.groupBy("item").agg(F.max("k").alias("last")), "item").where("n >= last")
    return met.select("doc_id", "row", "item_id").distinct()


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items whose rarest terms stand near each other) of every row of docs.

    A null or empty text has no words and no hits; an item without words has no windows; a null item_id counts as the text
    null. Repeated rows get repeated results; without items nothing is hit; an empty table gives none. Extra columns of
    either table are left out.
    """
    counts = term_counts(docs, items)
    own, ranked = phrases(items, counts, size), rarest(items, counts)
    index = index_of(docs, own.anchors, ranked)
    found = found_phrases(docs, index, own, size)
    near = found_near(index, ranked).groupBy(F.col("doc_id").alias("nd"), F.col("row").alias("nr")).agg(F.size(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).cast("bigint").alias("n_near"))
    by_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("bigint").alias("n_hit"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias("items"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), _cut(F.coalesce("text", F.lit(""))).alias("cut"))
    rows = rows.select("doc_id", "row", word_count(F.col("cut")).cast("bigint").alias("n_words"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    out = out.join(near, F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("row") == F.col("nr")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their own columns."""
    found = store(phrase_matches(docs, items, size).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_r"]), "left_anti")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, w, least(10, len(w)) AS width FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, width, array_to_string(w[s : s + width - 1], ' ') AS phrase
  FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM iw)),
runs AS (
  SELECT doc_id, p, width, array_to_string(w[p : p + width - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM dw, (SELECT DISTINCT width FROM wins))),
met AS (SELECT r.doc_id, r.p, r.width, i.item_id FROM runs r JOIN wins i ON r.phrase = i.phrase AND r.width = i.width),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS q FROM met) GROUP BY doc_id),
cw AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
it AS (SELECT DISTINCT item_id, w, unnest(w) AS term FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark)),
rk AS (SELECT item_id, w, term, row_number() OVER i - 1 AS k, min(n) OVER i AS least FROM (SELECT it.*, coalesce(n, 0) AS n FROM it LEFT JOIN (SELECT term, count(*) AS n FROM cw GROUP BY term) USING (term)) WINDOW i AS (PARTITION BY item_id, w ORDER BY n, term) QUALIFY k < 3 AND least > 0),
nb AS (
  SELECT DISTINCT z.doc_id, z.item_id FROM (SELECT doc_id, item_id, w, pos FROM rk JOIN cw USING (term) WHERE k = 0) z JOIN (SELECT item_id, w, max(k) AS last FROM rk GROUP BY item_id, w) m ON m.item_id = z.item_id AND m.w = z.w
  LEFT JOIN (SELECT doc_id, item_id, w, k, pos FROM rk JOIN cw USING (term) WHERE k > 0) o ON o.doc_id = z.doc_id AND o.item_id = z.item_id AND o.w = z.w AND abs(o.pos - z.pos) <= 20
  GROUP BY z.doc_id, z.item_id, z.w, z.pos, last HAVING count(DISTINCT k) >= last),
ne AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nb GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN ne ON ne.doc_id = dw.doc_id LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
