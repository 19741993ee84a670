"""URL filters: a list of rules by host and path, and association rules mined from labelled URLs, in DataFrame functions only.

Each URL is a set of terms (parts of its host, words of its path, keys of its query and words of their values). Terms that the
same labelled URLs show are one item, named by the least of them, and what all of them show tells nothing; so tracking
parameters, which come many at a time, don't multiply. A single item that goes with a bad label is a rule. Of the other items
Spark's FP-growth mines the sets that do, of however many items; of the rules of enough support and confidence those stay that
have no other rule within them. A URL is matched through an inverted index from terms to rules: a rule fires where all of its
terms are met.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

# The list of rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Mined rules: share of labelled URLs that bear one out, URLs behind it at least, share of those it meets that are bad.
SUPPORT, LEAST_URLS, CONFIDENCE = 0.005, 5, 0.8
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def query_of(url: Column) -> Column:
    """What follows the first ? after the host up to # or the end; empty without ://."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^?#]*\?([^#]*)", 1)).otherwise("")


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(n, rule, verdict) of the longest rule whose host is the URL's or a parent of it, and whose path begins the URL's; else null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.greatest(*fits, F.lit(None)) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[^0-9A-Za-z]+"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), "n").otherwise(x))


def terms_of(host: Column, path: Column, query: Column) -> Column:
    """array<string>: the labels of the host, the words of the path, each key of the query alone and with each word of its value; a number counts as one word, n."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h="), x))
    words = F.transform(_words(path), lambda x: F.concat(F.lit("p="), x))
    key = lambda x: F.concat(F.lit("q="), F.array_join(_words(F.regexp_extract(x, "^[^=]*", 0)), "_"))
    parts = F.transform(F.filter(F.split(query, "[&;]"), lambda x: x != ""), lambda x: F.struct(key(x).alias("key"), _words(F.regexp_extract(x, "(?s)^[^=]*=(.*)", 1)).alias("value")))
    asked = F.flatten(F.transform(parts, lambda x: F.concat(F.array(x["key"]), F.transform(x["value"], lambda w: F.concat(x["key"], F.lit("="), w)))))
    return F.array_distinct(F.concat(labels, words, asked))


def smallest(rules: DataFrame) -> DataFrame:
    """The rules (terms) that hold no other one, found from the shortest on: a longer rule is met by an inverted index of those that stay."""
    sizes = sorted(r[0] for r in rules.select(F.size("terms")).distinct().collect())  # at most terms of a URL
    keyed = rules.select(F.xxhash64("terms").alias("rule"), "terms")
    kept = keyed.limit(0)
    for n in sizes:
        some = keyed.where(F.size("terms") == n)
        index = kept.select(F.col("rule").alias("within"), F.size("terms").alias("size"), F.explode("terms").alias("term"))
        covered = some.select("rule", F.explode("terms").alias("term")).join(index, "term").groupBy("rule", "within", "size").agg(F.count("*").alias("met")).where("met = size")
        kept = store(kept.unionByName(some.join(covered.select("rule").distinct(), "rule", "left_anti")), "rules")
    return kept


def mine(urls: DataFrame, support: float = SUPPORT, least: int = LEAST_URLS, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, terms): the smallest sets of items that go with bad ones among urls (terms array<string>, bad boolean).

    Items of fewer bad URLs than the support asks for are left out before mining. The number of sets that FP-growth goes
    through is still exponential in the items that many URLs share in ever other combinations.
    """
    rows = store(urls.select(F.monotonically_increasing_id().alias("n"), F.array_distinct("terms").alias("terms"), "bad"), "labelled")
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    empty = rows.select(F.lit(0).cast("bigint").alias("rule"), "terms").limit(0)
    need = max(least, math.ceil(support * n))
    if bad < need:
        return empty
    # Which URLs show a term is told by how many there are and by two sums over hashes of their numbers.
    shown = rows.select(F.explode("terms").alias("t"), "bad", F.xxhash64("n").alias("h"), F.xxhash64("n", F.lit(1)).alias("g"))
    shown = shown.groupBy("t").agg(F.count("*").alias("all"), F.count_if("bad").alias("bad"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("bad") >= need)
    items = shown.groupBy("all", "bad", "h", "g").agg(F.min("t").alias("t"))
    items = items.select("t", (F.col("bad") >= confidence * F.col("all")).alias("alone"), (F.col("all") < n).alias("tells")).collect()  # at most terms of a URL / support of them
    single = store(rows.sparkSession.createDataFrame([([r["t"]],) for r in items if r["alone"]], "terms array<string>"), "single")
    rest = [r["t"] for r in items if r["tells"] and not r["alone"]]
    if len(rest) < 2:
        return single.select(F.xxhash64("terms").alias("rule"), "terms")
    baskets = rows.select("bad", F.array_intersect("terms", F.array(*map(F.lit, rest))).alias("items"))
    baskets = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("terms"))
    return smallest(store(found.unionByName(single), "found"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the least mined rule that fires, its terms joined by +) of every page.

    A listed rule decides first; a URL without one is blocked if a mined rule fires, else allowed. Mining learns from pages
    whose id has a label: bad means quality 0 (the least of several). A null URL, or one without ://, has an empty host and
    path and no terms. Repeated rows get repeated results; an empty table gives none; extra columns are left out.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"))
    terms = terms_of(F.col("host"), F.col("path"), F.col("query"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    learnt = mine(own.join(marks, "page_id").select(terms.alias("terms"), "bad"))
    learnt = store(learnt, "mined")
    index = learnt.select("rule", F.size("terms").alias("size"), F.array_join("terms", "+").alias("mined"), F.explode("terms").alias("term"))
    known = F.array(*[F.lit(r[0]) for r in index.select("term").distinct().collect()]).cast("array<string>")  # bounded as in mine()
    # URLs fall into few sets of known terms; each set is matched once.
    own = own.withColumn("set", F.array_join(F.array_sort(F.array_intersect(terms, known)), "+"))
    sets = own.where("set <> ''").select("set").distinct().select("set", F.explode(F.split("set", r"\+")).alias("term"))
    fired = sets.join(index, "term").groupBy("set", "mined", "size").agg(F.count("*").alias("met")).where("met = size").groupBy("set").agg(F.min("mined").alias("mined"))
    out = own.join(store(fired, "fired"), "set", "left").withColumn("r", listed(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("r").isNull(), F.col("mined")).alias("mined"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (
  SELECT DISTINCT page_id, host, path, unnest(list_concat(
    ['h=' || x FOR x IN string_split(host, '.') IF x <> ''],
    ['p=' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'n' ELSE x END FOR x IN regexp_split_to_array(path, '[^0-9A-Za-z]+') IF x <> ''])) AS term
  FROM own),
marks AS (SELECT doc_id AS page_id, min(quality) = 0 AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT o.page_id, m.bad FROM own o JOIN marks m ON o.page_id = m.page_id),
need AS (SELECT greatest(5, ceil(0.005 * count(*))) AS k FROM seen),
lt AS (SELECT t.page_id, t.term, s.bad FROM t JOIN seen s ON s.page_id = t.page_id),
item AS (
  SELECT min(term) AS term, n, b FROM (SELECT term, count(*) AS n, count(*) FILTER (WHERE bad) AS b, list(page_id ORDER BY page_id) AS p FROM lt GROUP BY term), need
  WHERE b >= k GROUP BY p, n, b),
li AS (SELECT lt.* FROM lt JOIN item USING (term) WHERE NOT b >= 0.8 * n AND n < (SELECT count(*) FROM seen)),
two AS (
  SELECT x.term AS t1, y.term AS t2, count(*) AS n, count(*) FILTER (WHERE x.bad) AS b
  FROM li x JOIN li y ON x.page_id = y.page_id AND x.term < y.term GROUP BY x.term, y.term HAVING b >= (SELECT k FROM need) AND b >= 0.8 * n),
three AS (
  SELECT x.term AS t1, y.term AS t2, z.term AS t3, count(*) AS n, count(*) FILTER (WHERE x.bad) AS b
  FROM li x JOIN li y ON x.page_id = y.page_id AND x.term < y.term JOIN li z ON z.page_id = y.page_id AND y.term < z.term
  GROUP BY x.term, y.term, z.term HAVING b >= (SELECT k FROM need) AND b >= 0.8 * n),
mined AS (
  SELECT terms, array_to_string(terms, '+') AS mined FROM (
    SELECT [term] AS terms FROM item WHERE b >= 0.8 * n UNION ALL SELECT [t1, t2] FROM two UNION ALL
    SELECT [t1, t2, t3] FROM three h WHERE NOT EXISTS (SELECT 1 FROM two p WHERE (p.t1 = h.t1 AND p.t2 = h.t2) OR (p.t1 = h.t1 AND p.t2 = h.t3) OR (p.t1 = h.t2 AND p.t2 = h.t3)))),
fired AS (
  SELECT page_id, min(mined) AS mined FROM (
    SELECT t.page_id, m.mined, count(*) AS met, len(m.terms) AS size FROM (SELECT mined, terms, unnest(terms) AS term FROM mined) m JOIN t ON t.term = m.term
    GROUP BY t.page_id, m.mined, len(m.terms)) WHERE met = size GROUP BY page_id),
listed AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM own)
SELECT l.page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN f.mined IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN f.mined END AS mined
FROM listed l LEFT JOIN fired f ON f.page_id = l.page_id
"""
