"""Substring dedup by sliding sentence spans.

A text is cut into sentences: they end after . ! or ? before white space, after 。 ！ or ？, or at a line's end. From every sentence a run of
consecutive sentences goes on until it has enough words, and another goes back from it; both are hashed. These short runs
stand for all longer ones: sentences of a repeated passage of enough words, of whatever number and length, are each in a
repeated run. Runs are joined globally by hash; all sentences covered by an occurrence of a repeated run, other than its
first by doc_id and place, are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, free_name, mix, rows_of, store, words_of

#: Words of a span at least, so that a line of a licence or a greeting isn't one.
LEAST_WORDS = 20
_CUT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|(?<=[。！？])\s*")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(begin, end) of the sentences of a text; what separates them belongs to none."""
    if not text:
        return []
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def spans(text: str | None, known: WordHashes, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(first sentence, sentences, 128-bit hash) of every span; words decide, not case or punctuation."""
    sizes, hashes = [], []
    for a, b in sentences(text):
        w = words_of(text[a:b])
        sizes.append(len(w))
        hashes.append(known.of(w))
    # Sentences without words neither count nor break a run.
    real = np.flatnonzero(np.array(sizes, np.int64) > 0)
    # Words of the real sentences before each one, and the words' hashes, each sentence's last one marked as such.
    ends = np.r_[0, np.cumsum(np.array(sizes, np.int64)[real])] if len(real) else np.zeros(1, np.int64)
    if ends[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    flat = np.concatenate([hashes[i] for i in real])
    flat[ends[1:] - 1] = mix(flat[ends[1:] - 1] + np.uint64(1))
    raw = memoryview(flat.tobytes())
    # On to the first end, and back to the last begin, that leaves enough words between them.
    on = np.searchsorted(ends, ends[:-1] + least)
    forth = np.flatnonzero(on < len(ends))
    back = np.searchsorted(ends, ends[1:] - least, "right") - 1
    to = np.flatnonzero(back >= 0)
    runs = np.unique(np.r_[np.c_[forth, on[forth]], np.c_[back[to], to + 1]], axis=0)
    digest = [xxhash.xxh3_128_digest(raw[8 * ends[i] : 8 * ends[j]]) for i, j in runs]
    return real[runs[:, 0]], real[runs[:, 1] - 1] - real[runs[:, 0]] + 1, digest


_SPANS = "doc_id bigint, row bigint, first int, n int, high bigint, low bigint"


def all_spans(docs: DataFrame) -> DataFrame:
    """Spans of every row; row is a hash of its text, which tells rows of one doc_id apart. A span's hash is in two halves: numbers are smaller in a shuffle than bytes, and are grouped by hashing."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for rows in rows_of(parts):
            docs_of, rows_of_, first, n, digest = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for r in rows:
                a, k, h = spans(r["text"], known)
                docs_of += [r["doc_id"]] * len(h)
                rows_of_ += [r["row"]] * len(h)
                first.append(a)
                n.append(k)
                digest += h
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            columns = [pa.array(docs_of, pa.int64()), pa.array(rows_of_, pa.int64()), pa.array(np.concatenate(first).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "first", "n", "high", "low"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(of, _SPANS)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, row, cut): for each text with sentences to be removed their numbers."""
    spans_ = store(all_spans(docs), "spans")
    # Most spans occur once. Counts alone find the others, so places of spans are compared only where there are several.
    often = store(spans_.groupBy("high", "low").count().where("count > 1").select("high", "low"), "repeated")
    found = store(spans_.join(often, ["high", "low"], "left_semi"), "occurrences")
    discard(spans_)  # about as large as the texts; nothing reads it any more
    # Equal rows (one doc_id and text) are one document: the place of its first span is the same in each.
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "first")
    firsts = store(found.groupBy("high", "low").agg(F.min(place).alias("at")), "firsts")
    later = found.join(firsts, ["high", "low"]).where(place != F.col("at"))
    # A document's spans come together as they are, two a sentence at most, and only then are sentences counted out.
    own = later.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return own.select("doc_id", "row", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))).alias("cut"))


def _without(text: str, cut: set[int]) -> str:
    """The text without some sentences and what follows each up to the next one."""
    own = sentences(text)
    out = [text[: own[0][0]]] if own else [text]
    for i, (a, _) in enumerate(own):
        if i not in cut:
            out.append(text[a : own[i + 1][0] if i + 1 < len(own) else len(text)])
    return "".join(out)


def remove_repeats(docs: DataFrame, count: str | None = None) -> DataFrame:
    """docs with the text of every row cut; count: a name for a column of the number of sentences removed.

    Order of occurrences: by doc_id (null first), then by the text's hash, then by place. Rows of equal doc_id and text are
    one document: they get one result. A null text stays null; an empty one, or one of few words, has no spans; a document
    that only repeats others ends up empty and stays. Other columns stay as they are, n_chars, if there is one, follows the
    new text. An empty table gives none.
    """
    row, cut, key = free_name(docs, "row"), free_name(docs, "cut"), free_name(docs, "key")
    hits = repeats(docs).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("cut").alias(cut))
    keyed = docs.withColumn(row, F.xxhash64("text"))
    both = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits[key]) & (keyed[row] == hits[row]), "left")

    @F.pandas_udf("string")
    def rest(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else _without(t or "", {int(x) for x in g}) for t, g in zip(text, gone, strict=True)], dtype=object)

    new = F.when(hits[cut].isNull(), keyed["text"]).otherwise(rest(F.when(hits[cut].isNotNull(), keyed["text"]), hits[cut]))  # other texts aren't sent to Python
    removed = F.coalesce(F.size(hits[cut]), F.lit(0))
    out = both.select(*[new.alias(c) if c == "text" else keyed[c] for c in docs.columns], *([removed.alias(count)] if count else []))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
