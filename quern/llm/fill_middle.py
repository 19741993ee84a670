"""Fill-in-the-middle: a text is cut at two places into prefix, middle and suffix, which are put in another order between sentinels.

A byte automaton, given as a table, reads many texts in one scan. Its state says where in a unit it is (a unit is white space
and the word after it), how much of a sentinel it has seen and how many bytes of a character are to come; each transition
carries what it counts: a unit or a character that begins, a sentinel that is complete. The state depends on the last few
bytes only, so the bytes are read in many lanes at once, each of which starts a few bytes early. A second pass finds the
cuts from the places where units begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinels before prefix, suffix and middle, and white space.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACES = frozenset((0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20))
#: A byte that no UTF-8 text has: it stands before each text.
MARK = 0xFF
#: Bytes after which a lane knows its state, wherever it began: a character or a sentinel has fewer before its last one.
WARM = 4
#: Lanes at most, and bytes of the texts that are scanned together (or one longer text).
LANES, BATCH_BYTES = 4096, 2_000_000
#: Per cent of the texts that are cut, and of those that put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42


@dataclass(frozen=True)
class State:
    """Within a unit: "start" (of a text), "space" or "word"; bytes of a sentinel seen; bytes to come of a character; and what the last byte counted for."""

    within: str = "start"
    seen: int = 0
    due: int = 0
    unit: bool = False
    character: bool = False

    def after(self, byte: int) -> State:
        if byte == MARK:
            return State()
        within = "space" if byte in SPACES else "word"
        unit = self.within == "start" or self.within == "word" and within == "space"
        if byte == PREFIX[0]:
            seen = 1
        elif self.seen == 1 and byte in (PREFIX[1], SUFFIX[1], MIDDLE[1]):
            seen = 2
        else:
            seen = 3 if self.seen == 2 and byte == PREFIX[2] else 0
        more = self.due and 0x80 <= byte < 0xC0
        due = self.due - 1 if more else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
        return State(within, seen, due, unit, not more)


def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The table (state * 256 + byte -> next state * 256), and for each state whether it counts a unit, a character, a sentinel."""
    states, rows = [State()], []
    number = {states[0]: 0}
    while len(rows) < len(states):
        row = []
        for byte in range(256):
            to = states[len(rows)].after(byte)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to] * 256)
        rows.append(row)
    return np.array(rows, np.int32).ravel(), np.array([s.unit for s in states]), np.array([s.character for s in states]), np.array([s.seen == 3 for s in states])


TABLE, UNIT, CHARACTER, SENTINEL = automaton()


def scan(data: np.ndarray) -> np.ndarray:
    """The state after each byte; the first byte is a mark."""
    n = len(data)
    lanes = max(1, min(LANES, n // 256))
    width = -(-n // lanes)
    padded = np.full(WARM + lanes * width, MARK, np.uint8)
    padded[WARM : WARM + n] = data
    columns = np.lib.stride_tricks.as_strided(padded, (lanes, width + WARM), (width, 1)).T.astype(np.int32)
    state, out = np.zeros(lanes, np.int32), np.empty((width, lanes), np.uint8)
    for i, column in enumerate(columns):
        state = TABLE.take(state + column)
        if i >= WARM:
            out[i - WARM] = state >> 8
    return out.T.reshape(-1)[:n]


def cuts_of(doc_id: int | None, n: int, seed: int, rate: int, suffix_first: int) -> tuple[int, int, str]:
    """(units of the prefix, units of prefix and middle, form) that the hash of seed and id gives a text of n units."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    a, b, c, d = (int.from_bytes(h[i : i + 4]) for i in (0, 4, 8, 12))
    form = "plain" if c % 100 >= rate else "spm" if d % 100 < suffix_first else "psm"
    return min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1)), form


def rearranged(ids: list[int | None], texts: list[bytes], seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    data = np.frombuffer(bytes((MARK,)) + bytes((MARK,)).join(texts), np.uint8)
    states = scan(data)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]  # of the marks
    units = np.flatnonzero(UNIT[states])
    first = np.searchsorted(units, begin)
    counts = np.diff(np.r_[first, len(units)])
    odd = np.add.reduceat(SENTINEL[states], begin, dtype=np.int64) > 0
    chars = np.cumsum(CHARACTER[states])
    out = []
    for i, text in enumerate(texts):
        n = int(counts[i])
        a, b, form = cuts_of(ids[i], n, seed, rate, suffix_first)
        if form == "plain" or odd[i] or not n:
            out.append((n, "plain", None, None, text))
            continue
        at, end = int(begin[i]) + 1, int(begin[i]) + 1 + len(text)
        x, y = (int(units[first[i] + k]) if k < n else end for k in (a, b))
        prefix, middle, suffix = text[: x - at], text[x - at : y - at], text[y - at :]
        parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        out.append((n, form, int(chars[x - 1] - chars[at - 1]), int(chars[y - 1] - chars[x - 1]), b"".join(parts)))
    return out


_RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every whole text.

    A null text is empty; an empty text, or one that holds a sentinel, stays plain; plain ones have null counts. A row
    without an id is cut as the hash of no digits says. Repeated rows give repeated results, an empty table none; columns
    other than doc_id and text are left out.
    """

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            n, form, prefix, middle, output = zip(*rearranged(ids, texts, seed, rate, suffix_first), strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

        ids, texts, held = [], [], 0
        for part in parts:
            for i in range(part.num_rows):
                text = part.column(1)[i].as_py() or b""
                if texts and held + len(text) > BATCH_BYTES:
                    yield done()
                    ids, texts, held = [], [], 0
                ids.append(part.column(0)[i].as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield done()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(of, _RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts stand between sentinels, of which neither text nor joints hold another."""
    first, second = F.when(form == "psm", SUFFIX.decode()).otherwise(PREFIX.decode()), F.lit(MIDDLE.decode())
    x = F.instr(output, first)
    y = F.instr(output, second)
    a, b, middle = F.substring(output, F.lit(4), x - 4), F.substring(output, x + 3, y - x - 3), F.substring(output, y + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars and middle_chars of every text, and digests of its output and of the text that is rebuilt from it."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
k AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
