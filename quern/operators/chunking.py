"""Chunkers: from texts to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.expr import words

SIZE, OVERLAP = 1000, 150


def _windows(n: str, size: int, overlap: int) -> str:
    """SQL for the starts of windows over n words: every step until one reaches the end."""
    step = max(1, size - overlap)
    return f"filter(sequence(0, greatest({n} - 1, 0), {step}), s -> s = 0 OR s - {step} + {size} < {n})"


def fixed_size(docs: DataFrame, key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, first, last, text, prev, next): windows of so many words that overlap; a blank text has none."""
    own = docs.select(key, words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    own = own.withColumn("starts", F.expr(_windows("n", size, overlap)))
    own = own.select(key, "w", "n", F.size("starts").alias("chunks"), F.posexplode("starts").alias("chunk", "first"))
    last = F.least(F.col("first") + size, F.col("n"))
    return own.select(
        key, "chunk", "first", last.alias("last"), F.array_join(F.slice("w", F.col("first") + 1, last - F.col("first")), " ").alias("text"),
        F.when(F.col("chunk") > 0, F.col("chunk") - 1).alias("prev"), F.when(F.col("chunk") + 1 < F.col("chunks"), F.col("chunk") + 1).alias("next"),
    )


def header_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, title, is_header, text, n_chars): runs of lines that begin at a header: # to ###### or a line in capitals."""
    lines = docs.select(key, F.posexplode(F.split("text", "\r\n|[\n\r]")).alias("line_no", "line"))
    bare = F.trim("line")
    capitals = (bare == F.upper(bare)) & (bare != F.lower(bare)) & (F.length(bare) > 2) & (F.length(bare) < 120)
    header = bare.rlike("^#{1,6} ") | capitals
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("h", F.coalesce(header, F.lit(False)))
    lines = lines.withColumn("run", F.sum(F.col("h").cast("int")).over(order))
    first = F.min(F.struct("line_no", "h", F.when(F.col("h"), F.trim(F.regexp_replace(bare, "^[# ]+", ""))).otherwise(F.lit("document")).alias("title")))
    shown = F.when(F.col("h"), bare).otherwise(F.col("line"))
    out = lines.groupBy(key, "run").agg(first.alias("f"), F.array_sort(F.collect_list(F.struct("line_no", shown.alias("line")))).alias("ls"))
    out = out.select(key, "run", F.col("f.title").alias("title"), F.col("f.h").alias("is_header"), F.array_join("ls.line", "\n").alias("text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1
    return out.select(key, number.alias("section"), "title", "is_header", "text", F.length("text").alias("n_chars"))


def header_then_tokens(docs: DataFrame, key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, section, title, kind, first, last, text): a section of few tokens is one chunk, a longer one is cut into windows of words."""
    own = header_sections(docs, key).withColumn("short", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)) <= size)
    whole = own.where("short").select(key, "section", "title", F.when(F.col("is_header"), "heading").otherwise("paragraph").alias("kind"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "text")
    cut = own.where("not short").withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    cut = cut.select(key, "section", "title", "w", "n", F.explode(F.expr(_windows("n", size, overlap))).alias("first")).withColumn("last", F.least(F.col("first") + size, F.col("n")))
    cut = cut.select(key, "section", "title", F.lit("paragraph").alias("kind"), "first", "last", F.array_join(F.slice("w", F.col("first") + 1, F.col("last") - F.col("first")), " ").alias("text"))
    return whole.unionByName(cut)


#: Lines of a text that are put into chunks together; what is held of the last chunk goes on with the next ones.
LINES = 512


def greedy_lines(docs: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(key, chunk, text, tokens): lines gathered until the next would pass the budget.

    A line costs a quarter of its characters, one at least; blank lines are left out. Where chunks begin is found line by line
    over an array of costs, in blocks of LINES whose starts are one list each, so no list grows with the text's square.
    """
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    own = docs.select(key, lines.alias("l")).where(F.size("l") > 0)
    own = own.withColumn("c", F.transform("l", lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), none.alias("own"), F.array().cast("array<array<int>>").alias("all"))

    def step(a, cost):
        full = (a["held"] > 0) & (a["held"] + cost > size)
        mine = F.when(full | (a["i"] == 0), F.concat(a["own"], F.array(a["i"]))).otherwise(a["own"])
        over = F.size(mine) >= LINES
        return F.struct((a["i"] + 1).alias("i"), F.when(full, cost).otherwise(a["held"] + cost).alias("held"), F.when(over, none).otherwise(mine).alias("own"), F.when(over, F.concat(a["all"], F.array(mine))).otherwise(a["all"]).alias("all"))

    own = own.withColumn("s", F.aggregate("c", start, step, lambda a: F.flatten(F.concat(a["all"], F.array(a["own"])))))
    each = own.select(key, "l", "c", "s", F.posexplode("s").alias("chunk", "first"))
    last = F.coalesce(F.get("s", F.col("chunk") + 1), F.size("l"))
    part = lambda c: F.slice(c, F.col("first") + 1, last - F.col("first"))
    return each.select(key, "chunk", F.array_join(part("l"), "\n").alias("text"), F.aggregate(part("c"), F.lit(0), lambda a, x: a + x).alias("tokens"))
