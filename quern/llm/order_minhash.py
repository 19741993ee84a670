"""Near-duplicate documents by Order MinHash.

A document is its sequence of five-word shingles, each labelled with its occurrence (first, second, ... of equal ones). A
sketch takes the few shingles of the smallest hashes and keeps them in text order, so two documents share one only if they
agree on shingles and on their order. Documents that share a sketch are candidates; a banded alignment of their shingle
sequences decides: similarity is aligned / (shingles of both - aligned), at least 0.8 for a link. Classes are the connected
components of links. Equal texts are one node from the start.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, mix, rows_of, run_hashes, store, words_of

K, SIMILARITY = 5, 0.8
#: Sketches of each document and shingles of each: a pair at 0.8 shares none of them with a chance below 1 in 20 000.
SKETCHES, TAKEN = 14, 3
#: Documents of one side of a block in which a bucket's members are compared, about, and bytes of their word hashes.
BLOCK, BLOCK_BYTES = 256, 1 << 20
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the shingles of a sequence of word hashes, in order; the n-th of equal ones has a label of its own."""
    h = run_hashes(words.astype(np.uint64), k)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        if not new.all():
            at = np.arange(len(h))
            nth = np.empty(len(h), np.uint64)
            nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
            h = np.where(nth > 0, mix(h + nth * np.uint64(0xD6E8FEB86659FD93)), h)
    return h


def sketches(labels: np.ndarray) -> np.ndarray:
    """For each seed one hash of the TAKEN labels of the smallest hashes, in text order; none for no labels."""
    if not len(labels):
        return np.zeros(0, np.uint64)
    best_h = best_at = None
    for lo in range(0, len(labels), 30_000):
        part = labels[lo : lo + 30_000]
        h = mix(part[None, :] ^ _SEEDS[:, None])
        at = np.broadcast_to(np.arange(lo, lo + len(part)), h.shape)
        if best_h is not None:
            h, at = np.concatenate([best_h, h], 1), np.concatenate([best_at, at], 1)
        if h.shape[1] > TAKEN:
            least = np.argpartition(h, TAKEN - 1, axis=1)[:, :TAKEN]
            h, at = np.take_along_axis(h, least, 1), np.take_along_axis(at, least, 1)
        best_h, best_at = h, at
    chosen = labels[np.sort(best_at, axis=1)]
    out = _SEEDS.copy()
    for i in range(chosen.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
    return out


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence among alignments that stay within band of the diagonal."""
    n, m = len(a), len(b)
    row = np.zeros(m + 1, np.int64)
    for i in range(n):
        lo, hi = max(0, i - band), min(m, i + band + 1)
        if lo >= hi:
            break
        new = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (b[lo:hi] == a[i]))
        if lo:
            new[0] = max(new[0], row[lo])
        row[lo + 1 : hi + 1] = np.maximum.accumulate(new)
        row[hi + 1 :] = row[hi]
    return int(row[-1])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two labelled shingle sequences reach the similarity.

    More aligned than common is impossible; where the common shingles come in one order, all of them align. Only what is
    left is aligned step by step, within the band that a pair of this similarity can't leave.
    """
    if not len(a) or not len(b):
        return False
    need = least / (1 + least) * (len(a) + len(b)) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < need:
        return False
    ib = ib[np.argsort(ia)]
    if (np.diff(ib) > 0).all():
        return True
    ends: list[int] = []
    for x in ib.tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    if len(ends) < need and len(np.unique(a)) == len(a):
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    return start + banded(a[start:], b[start:], int(len(a) + len(b) - 2 * need) + 1) >= need


_PRINTS = "doc_id bigint, row bigint, content binary, sketches array<bigint>, words binary"
_PRINT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("content", pa.binary()), ("sketches", pa.list_(pa.int64())), ("words", pa.binary())])
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row doc_id, row (a hash of its text), content (a 128-bit hash of its words; null without words), sketches and words (32-bit hashes)."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for rows in rows_of(parts):
            out = []
            for r in rows:
                words = words_of(r["text"])
                h = known.of(words).astype("<u4")
                out.append({"doc_id": r["doc_id"], "row": r["row"], "content": xxhash.xxh3_128_digest(b" ".join(words)) if words else None, "sketches": sketches(labelled(h)).view(np.int64), "words": h.tobytes()})
            yield pa.RecordBatch.from_pylist(out, _PRINT)

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(of, _PRINTS)


def _labels(words: bytes) -> np.ndarray:
    return labelled(np.frombuffer(words, "<u4"))


def _verify(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, words_a, words_b) those that are similar."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(parts):
            yield pa.RecordBatch.from_pylist([{"a": r["a"], "b": r["b"]} for r in rows if similar(_labels(r["words_a"]), _labels(r["words_b"]))], _LINK)

    return pairs.mapInArrow(of, "a binary, b binary")


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join different components among the rows of one block (content, component, side, words), found by comparing all of the one side with all of the other."""
    pdf = pdf.sort_values("content").reset_index(drop=True)
    labels = [_labels(w) for w in pdf["words"]]
    side = pdf["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
    root = pdf["component"].tolist()
    size = np.array([len(x) for x in labels])
    values, codes = np.unique(np.concatenate(labels), return_inverse=True)
    doc = np.repeat(np.arange(len(labels)), size)
    often = np.bincount(codes, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[codes]
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(labels), -1), np.full(len(labels), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    d, c = doc[keep], column[codes[keep]]
    for lo in range(0, int(often.sum()), 8192):  # so many columns at a time
        some = (c >= lo) & (c < lo + 8192)
        x, y = np.zeros((len(left), 8192), np.float32), np.zeros((len(right), 8192), np.float32)
        for place, out in ((place_l, x), (place_r, y)):
            at = place[d[some]]
            out[at[at >= 0], c[some][at >= 0] - lo] = 1
        common += x @ y.T
    least = SIMILARITY / (1 + SIMILARITY) * (size[left][:, None] + size[right][None, :]) - 1e-3
    found = []
    above: dict = {}

    def top(x):
        while x in above:
            x = above[x]
        return x

    for i, j in np.argwhere(common >= least):
        p, q = int(left[i]), int(right[j])
        if p != q and (r := top(root[p])) != (s := top(root[q])) and similar(labels[p], labels[q]):
            above[r] = s
            found.append((pdf["content"][p], pdf["content"][q]))
    return pd.DataFrame(found, columns=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of contents whose components are those of all similar pairs that share a sketch.

    Members of a bucket are first held against one of them, the pivot. Where that leaves several components in a bucket,
    its members are compared with each other in blocks, of which each is a task of bounded size, and only links that join
    components come out. So a large group of near copies costs a row a member, and no pair across components goes unseen.
    """
    some = prints.where("content is not null")
    # Copies of one text are one member from the first step on; they have equal sketches and words, with or without an id.
    each = some.groupBy("content").agg(F.any_value("sketches").alias("s"), F.max(F.octet_length("words")).alias("bytes")).select("content", "bytes", F.posexplode("s").alias("i", "h"))
    members = store(each.select(F.xxhash64("i", "h").alias("bucket"), "content", "bytes"), "members")
    buckets = members.groupBy("bucket").agg(F.min("content").alias("pivot"), F.count("*").alias("n"), F.sum("bytes").alias("total")).where("n > 1")
    buckets = store(buckets, "buckets")
    pairs = members.join(buckets, "bucket").where("content <> pivot").select(F.col("pivot").alias("a"), F.col("content").alias("b")).distinct()
    pairs = store(pairs, "pairs")
    shared = members.join(buckets.select("bucket"), "bucket", "left_semi").select("content").distinct()
    texts = some.groupBy("content").agg(F.any_value("words").alias("words")).join(shared, "content", "left_semi")
    texts = store(texts, "texts")
    with_b = pairs.join(texts.select(F.col("content").alias("b"), F.col("words").alias("words_b")), "b")
    first = store(_verify(with_b.join(texts.select(F.col("content").alias("a"), F.col("words").alias("words_a")), "a")), "links")
    comp = store(connected_components(first), "components")
    now = members.join(buckets, "bucket").join(comp.withColumnRenamed("node", "content"), "content", "left")
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_BYTES)).cast("int")
    now = now.select("bucket", "content", parts.alias("parts"), F.coalesce("component", "content").alias("component"))
    now = store(now, "members")
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    now = now.join(store(mixed, "mixed"), "bucket", "left_semi")
    own = F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")
    now = now.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    now = now.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "content", "component")
    blocks = now.join(texts, "content").groupBy("bucket", "lo", "hi").applyInPandas(lambda pdf: block_links(pdf), "a binary, b binary")
    return first.unionByName(store(blocks, "links"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (that document itself), one row for each row of docs.

    A null or empty text, or one without words, has no copies: its class is its own doc_id. A row without doc_id gets the
    class of its text, null if no row of it has an id; it is kept then. A text of fewer than five words is one shingle.
    Repeated rows give repeated results; an empty table gives none; columns other than doc_id and text are left out.
    """
    return _classes(docs).drop("row")


def _classes(docs: DataFrame) -> DataFrame:
    prints = store(fingerprints(docs), "prints")
    found = connected_components(links(prints))
    contents = prints.where("content is not null").groupBy("content").agg(F.min("doc_id").alias("first"))
    named = contents.join(found.withColumnRenamed("node", "content"), "content", "left").select("content", "first", F.coalesce("component", "content").alias("component"))
    named = store(named, "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("class_id"))
    by_content = store(named.join(lowest, "component").select("content", "class_id"), "classes")
    # Rows without words stay out of the join: they have one key, null.
    out = prints.where("content is not null").select("doc_id", "row", "content").join(by_content, "content").select("doc_id", "row", "class_id")
    out = out.unionByName(prints.where("content is null").select("doc_id", "row", F.col("doc_id").alias("class_id")))
    return out.select("doc_id", "row", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with its own columns; of repeated rows with that id and equal text, one."""
    gone = store(_classes(docs).where("not kept").select("doc_id", "row").distinct(), "gone")
    # Merged at every size: a broadcast while it is small would give way to a shuffle of the texts later on.
    left = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["row"]), "left_anti")
    return left.dropDuplicates(["doc_id", "text"])
