"""Token ids in a compact file format with random access: directly addressable codes.

A segment holds the ids of consecutive documents. Each id is cut into chunks of 8 bits: level 0 has the lowest chunk of
every id, level 1 the next chunk of those ids that need one, and so on. A bitmap for each level tells which of its entries
go on; a rank directory beside it counts the marks before each block of 512 entries, so that the place of an id's next
chunk is one directory entry and a few popcounts away. Any id is read without decoding its neighbours.

Payload of a segment, little-endian: magic b"DAC1", count of ids (u64), count of levels (u32); for each level its length
(u64), its chunks (u8 each), its bitmap (one bit an entry, lowest bit first, in whole u64 words) and its directory (u64 for
each 512 entries). Segments are the rows of a Parquet table, written by Spark's committers to any store that Spark writes.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, store

BLOCK = 512
END_ID = 1
#: Ids of a segment, after which it ends with the document; documents longer than this are a segment of their own.
SEGMENT_IDS = 1 << 20
#: Distinct words whose ids a worker remembers, and the blocks of texts that must have had a word before it is remembered.
MEMORY_WORDS, TIMES = 500_000, 1


def pack(ids: np.ndarray) -> bytes:
    """The payload of a segment."""
    rest = np.asarray(ids, np.uint32)
    out, levels = [], 0
    n = len(rest)
    while len(rest):
        more = rest >> np.uint32(8) != 0
        bits = np.zeros(-(-len(rest) // 64) * 64, bool)
        bits[: len(rest)] = more
        marks = np.add.reduceat(more.astype(np.uint64), np.arange(0, len(rest), BLOCK))
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(marks) - marks).astype("<u8").tobytes()]
        rest = rest[more] >> np.uint32(8)
        levels += 1
    return b"".join([b"DAC1", struct.pack("<QI", n, levels), *out])


class Segment:
    """A packed segment: seg[i] reads one id, seg.slice(a, b) some, both without touching the others."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a segment of token ids")
        self.n, levels = struct.unpack_from("<QI", payload, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            words, blocks = -(-n // 64), -(-n // BLOCK)
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, "<u8", words, at + n)
            ranks = np.frombuffer(payload, "<u8", blocks, at + n + 8 * words)
            self.levels.append((chunks, bits, ranks))
            at += n + 8 * (words + blocks)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * level)
            word, bit = divmod(i, 64)
            if not int(bits[word]) >> bit & 1:
                break
            first = i // BLOCK * (BLOCK // 64)
            i = int(ranks[i // BLOCK]) + sum(int(x).bit_count() for x in bits[first:word]) + (int(bits[word]) & ((1 << bit) - 1)).bit_count()
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b: on each level a run of entries, found by one rank."""
        a, b = max(0, a), min(b, self.n)
        out = np.zeros(max(0, b - a), np.uint32)
        at = np.arange(len(out))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[a : a + len(at)].astype(np.uint32) << np.uint32(8 * level)
            first = a // BLOCK * BLOCK
            flags = np.unpackbits(bits[first // 64 : -(-(a + len(at)) // 64)].view(np.uint8), bitorder="little")
            before = int(ranks[a // BLOCK]) + int(flags[: a - first].sum())
            more = flags[a - first : a - first + len(at)].astype(bool)
            a, at = before, at[more]
        return out


#: Punctuation between a Latin letter or digit, which no normalisation takes apart, and white space. Not the apostrophe, which
#: may join what follows a word, nor signs that special tokens are written with.
_STOP = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:;=?@\[-^`{}~]+)(?=\s)")
#: Words that are encoded as one text.
TOGETHER = 400


def _plain(word: str) -> bool:
    """Whether a word is one run of letters, before and after lower-casing."""
    return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word) and word.lower().isalpha())


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Known(dict):
    """Ids of remembered words. A word that isn't one gets a place of its own in fresh, to be filled in later."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytearray:
        if (place := self.fresh.get(word)) is None:
            place = self.fresh[word] = bytearray()
        return place


class WordEncoder:
    """A tokenizer that drops white space and marks word ends, applied to the distinct words of texts.

    Ids don't depend on what stands beyond white space, nor beyond the border of a letter and punctuation that white space
    follows; so a text is cut there, each piece encoded once, and its ids joined as bytes. Plain words are encoded many at a
    time: the token that ends a word carries the vocabulary's suffix, which tells them apart again.
    """

    def __init__(self, path: str, most: int = MEMORY_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known = _Known()
        self.met = bytearray(1 << 22)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        out, rest = {}, []
        plain = [w for w in words if _plain(w)] if self.ends.any() else []
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(group):
                rest += group
                continue
            raw, stops = ids.tobytes(), (4 * at).tolist()
            out.update(zip(group, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        rest += [w for w in words if w not in out] if len(out) + len(rest) < len(words) else []
        rest = [*dict.fromkeys(rest)]
        out.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian u32."""
        known, met = self.known, self.met
        known.fresh = fresh = {}
        parts = [[*map(known.__getitem__, self._cut(t))] for t in texts]
        for w, ids in self._fresh([*fresh]).items():
            fresh[w] += ids
        out = [b"".join(p) for p in parts]
        if len(known) < self.most:
            for w, ids in fresh.items():
                at = hash(w) & 0x3FFFFF
                if met[at] == TIMES:
                    known[w] = bytes(ids)
                else:
                    met[at] += 1
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Pieces between white space; the four separators that only Python takes for white space stay in their pieces."""
        if text.isascii() or _is_latin1(text):  # here the tokenizer's lower case is Python's: fewer words differ
            text = text.lower()
        text = _STOP.sub(r" \1", text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.replace("\n", " ").split(" ")
        return text.split()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file; it lives on from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(text: str, chars: int = 1_000_000) -> Iterator[str]:
    """A text in parts that are cut at blanks, so that a very long one needs no more memory than a short one."""
    while len(text) > chars and (at := max(text.rfind(" ", chars // 2, chars), text.rfind("\n", chars // 2, chars))) > 0:
        yield text[:at]
        text = text[at:]
    yield text


SEGMENTS = "part int, seg int, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("tokens", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode every document and write the ids in ascending doc_id order as a table of packed segments.

    A null text is empty: it has the end id alone. A null doc_id comes first; rows of one doc_id stand together, ordered by
    their text's hash. Documents are dealt out by ranges of doc_id, so parts follow one another and no task holds more than a
    range; extra columns are left out.
    """

    def encode(parts_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, own, end = TaskContext.get().partitionId(), 0, encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        doc_ids, lengths, ids, n = [], [], [], 0

        def cut() -> pa.RecordBatch:
            packed = pack(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "doc_ids": doc_ids, "lengths": lengths, "payload": packed}], _SEGMENT)

        for rows in rows_of(parts_in):
            texts = [r["text"] or "" for r in rows]
            done = iter(own.encode([t for t in texts if len(t) <= 1_000_000]))
            for r, t in zip(rows, texts, strict=True):
                got = next(done) if len(t) <= 1_000_000 else b"".join(x for p in pieces(t) for x in own.encode([p]))
                doc_ids.append(r["doc_id"])
                lengths.append(len(got) // 4 + 1)
                ids += [got, end]
                n += lengths[-1]
                if n >= SEGMENT_IDS:
                    yield cut()
                    seg, n = seg + 1, 0
                    doc_ids, lengths, ids = [], [], []
        if doc_ids:
            yield cut()

    tie = F.xxhash64("text").alias("tie")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", tie).repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    rows.select("doc_id", "text").mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, tokens (its ids as little-endian u32) from the files."""
    seg = spark.read.schema(SEGMENTS).parquet(path)
    sizes = seg.select("part", "seg", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    # Two levels of running sums: within each part, and over the totals of the parts, of which there are as many as tasks wrote.
    totals = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(parts, "part").select("part", "seg", (F.col("base") + F.col("own")).alias("first"))
    starts = store(starts, "starts")  # of known size: while small it is broadcast, and no payload is shuffled

    def split(parts_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (r,) in rows_of(parts_in, 1):
            packed, at, rows = Segment(r["payload"]), 0, []
            for k, n in zip(r["doc_ids"], r["lengths"], strict=True):
                own = packed.slice(at, at + n).astype("<u4").tobytes()
                rows.append({"doc_id": k, "start": r["first"] + at, "n_tokens": n, "ids_crc32": zlib.crc32(own)} | ({"tokens": own} if tokens else {}))
                at += n
            yield pa.RecordBatch.from_pylist(rows, _DOCUMENT if tokens else _DOCUMENT.remove(4))

    return seg.join(starts, ["part", "seg"]).mapInArrow(split, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", tokens binary" if tokens else ""))
