"""Byte-level BPE: encoding in overlapping chunks, and decoding.

A text is cut into chunks that overlap. Chunks are pre-tokenised apart from each other; a chunk that begins within a
pre-token finds the true boundaries after a few steps, since a match depends only on where it begins and on what follows.
Two neighbours are stitched at the first boundary that both have in their overlap and that does not follow white space, and
each piece between two such places is encoded whole. Where an overlap has no common boundary (a run of letters longer than it), the left chunk goes on into
the right one until they agree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A boundary is sure if so many characters beyond it are known: no alternative of the pattern looks further ahead.
AHEAD = 4


class Codec:
    """Ranks of a vocabulary file and the pattern that cuts pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.table[v] = k

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes of the ids, joined."""
        return b"".join(map(self.table.__getitem__, ids))

    def boundaries(self, text: str, last: bool) -> list[int]:
        """Where pre-tokens begin; without the end of the text, only those that what follows cannot change."""
        sure = len(text) if last else len(text) - AHEAD
        return [m.start() for m in self.pattern.finditer(text) if m.start() <= sure]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec; it lives on from task to task."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def stitch(left: list[int], right: list[int]) -> int | None:
    """The first place that is a boundary of both chunks, in characters of the text; none if there is none."""
    other = set(right)
    return next((x for x in left if x in other), None)


def chunks_of(length: int, chunk: int, overlap: int) -> list[tuple[int, bool]]:
    """(where it begins, whether it reaches the end of the text) of each chunk of a text of so many characters."""
    return [(x, x + chunk + overlap >= length) for x in range(0, max(1, length), chunk)]


def pieces(chunks: list[tuple[int, str]], own: list[list[int]], coder: Codec) -> list[str]:
    """The text of chunks (start, characters) cut where neighbours agree; own: the boundaries that each chunk found.

    No piece ends in white space: there the pattern asks what follows, so the piece alone would be cut otherwise than the
    text. For the same reason a chunk that ends within white space may be wrong about boundaries in it, but not about others.
    """
    out, start, held = [], chunks[0][0], ""
    for k, (at, text) in enumerate(chunks):
        held = held + text[start + len(held) - at :] if held else text[start - at :]
        if k + 1 == len(chunks):
            out.append(held)
            break
        begins = [x for x in own[k] if x >= start] if start >= at else [start + x for x in coder.boundaries(held, False)]
        cut = stitch([x for x in begins if x > start and x >= chunks[k + 1][0] and not held[x - 1 - start].isspace()], own[k + 1])
        if cut is not None:
            out.append(held[: cut - start])
            start, held = cut, ""
            if cut >= at + len(text):
                raise AssertionError("a boundary beyond its chunk")
            held = text[cut - at :]
    return out


_CHUNK = pa.schema([("row", pa.string()), ("at", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])
_RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digest(ids: list[int], raw: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """array<int>: the ids of texts of at most a chunk, whole; null counts as empty."""

    @F.pandas_udf("array<int>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for part in parts:
            yield pd.Series([own.encode(t or "") for t in part], dtype=object)

    return of(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes that ids stand for."""

    @F.pandas_udf("binary")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern)
        for part in parts:
            yield pd.Series([own.decode([] if x is None else [int(i) for i in x]) for x in part], dtype=object)

    return of(ids)


def long_pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, text -> row, k, piece: long texts cut into pieces that can be encoded apart.

    Chunks of one text are spread over all tasks for pre-tokenising; then one task stitches each text.
    """

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r,) in rows_of(parts, 1):
            text = r["text"]
            all_of = chunks_of(len(text), chunk, overlap)
            for lo in range(0, len(all_of), 16):  # a text goes on a few chunks at a time, each cut once
                at, last = zip(*all_of[lo : lo + 16], strict=True)
                yield pa.RecordBatch.from_pydict({"row": [r["row"]] * len(at), "at": at, "last": last, "part": [text[x : x + chunk + overlap] for x in at]}, schema=_CHUNK)

    cut = docs.select("row", "text").mapInArrow(chunks, "row string, at int, last boolean, part string")

    def bounds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for pdf in parts:
            yield pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "part": pdf["part"], "own": [[int(a) + x for x in own.boundaries(t, bool(e)) if x < overlap or x >= chunk] for a, t, e in zip(pdf["at"], pdf["part"], pdf["last"], strict=True)]})

    cut = cut.repartition("row", "at").mapInPandas(bounds, "row string, at int, part string, own array<int>")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        coder = codec(path, pattern)
        out = pieces([(int(a), t) for a, t in zip(pdf["at"], pdf["part"], strict=True)], [[int(x) for x in o] for o in pdf["own"]], coder)
        return pd.DataFrame({"row": pdf["row"].iloc[0], "k": range(len(out)), "piece": out})

    return cut.groupBy("row").applyInPandas(join, "row string, k int, piece string")


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    A null text is empty: no ids, and the digests of nothing. Repeated rows give repeated results, an empty table none.
    Texts of at most a chunk are one piece and never leave their task; longer ones are cut, stitched, encoded in pieces on
    all tasks and put together again.
    """

    @F.pandas_udf(_RESULT)
    def whole(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for part in parts:
            rows = []
            for t in part:
                ids = own.encode(t or "")
                rows.append(_digest(ids, own.decode(ids)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    n = F.coalesce(F.length("text"), F.lit(0))
    short = docs.where(n <= chunk).select("doc_id", whole("text").alias("r")).select("doc_id", "r.*")
    # Equal texts of one doc_id share the work; copies counts their rows.
    long = docs.where(n > chunk).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    long = long.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))

    def ids_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for pdf in parts:
            ids = [own.encode(t) for t in pdf["piece"]]
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "ids": [np.asarray(x, "<u4").tobytes() for x in ids], "raw": [own.decode(x) for x in ids]})

    encoded = long_pieces(long.select("row", "text"), path, pattern, chunk, overlap).repartition("row", "k").mapInPandas(ids_of, "row string, k int, ids binary, raw binary")
    # The ids of one document, no more, come together.
    parts = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "raw"))).alias("p"))
    joined = lambda c: F.expr(f"aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.{c}))")
    parts = parts.select("row", joined("ids").alias("ids"), joined("raw").alias("raw"))
    parts = parts.select("row", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
    again = long.select("row", "doc_id", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return short.unionByName(again.join(parts, "row").select(*short.columns))
