"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words with a period that no neighbouring word keeps. A suffix automaton of the words, whose states know
where their strings first end, gives the factors of Lempel and Ziv: each the longest string that began earlier, or one new
word. Main's algorithm finds the runs that touch or cross the border between two factors from four tables of longest common
extensions. All other runs lie strictly within a factor, so they are copied from its earlier occurrence.

Words that can't be in a run are screened out first: in a run of at least 24 words and three periods every string of eight
words occurs again, so only stretches of repeated strings of eight are factorised, each apart.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, rows_of

#: Words of a run at least, and its periods.
LEAST, PERIODS = 24, 3
#: Words of the strings by which stretches are screened. A run of LEAST words and PERIODS periods holds each of its own twice.
SCREEN = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of numbers from 0: for each state its longest string's length, its suffix link, where its strings first end, and transitions.

    Most states have one transition; it stands in two arrays, further ones in a dictionary: about 50 bytes a word.
    """

    def __init__(self, w: list[int]):
        self.length, self.link, self.first, self.letter, self.to = (array("i", [x]) for x in (0, -1, -1, -1, -1))
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(w):
            last = self._add(last, i, c)

    def _new(self, length: int, link: int, first: int, letter: int, to: int) -> int:
        for column, x in ((self.length, length), (self.link, link), (self.first, first), (self.letter, letter), (self.to, to)):
            column.append(x)
        return len(self.length) - 1

    def next(self, s: int, c: int) -> int:
        """The state after s on c, -1 without."""
        if self.letter[s] == c:
            return self.to[s]
        more = self.more.get(s)
        return more.get(c, -1) if more else -1

    def _put(self, s: int, c: int, to: int) -> None:
        if self.letter[s] in (-1, c):
            self.letter[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _add(self, last: int, i: int, c: int) -> int:
        length, link = self.length, self.link
        new = self._new(length[last] + 1, 0, i, -1, -1)
        p = last
        while p >= 0 and (q := self.next(p, c)) < 0:
            self._put(p, c, new)
            p = link[p]
        if p < 0:
            return new
        if length[p] + 1 < length[q]:
            copy = self._new(length[p] + 1, link[q], self.first[q], self.letter[q], self.to[q])
            if q in self.more:
                self.more[copy] = dict(self.more[q])
            while p >= 0 and self.next(p, c) == q:
                self._put(p, c, copy)
                p = link[p]
            link[q] = copy
            q = copy
        link[new] = q
        return new


def factors(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """(begin, length, begin of an earlier occurrence) of the factors in order; -1 and length 1 for a new word."""
    own, i = Automaton(w), 0
    while i < len(w):
        s, n = 0, 0
        while i + n < len(w) and own.first[to := own.next(s, w[i + n])] < i + n:
            s, n = to, n + 1
        yield (i, n, own.first[s] - n + 1) if n else (i, 1, -1)
        i += n or 1


def extensions(x: list[int]) -> list[int]:
    """For each place but the first the length of the longest string that begins both there and at the begin."""
    n = len(x)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def at_border(w: list[int], k: int, before: int, size: int, least: int, periods: int) -> dict[tuple[int, int], int]:
    """(begin, end) -> period of the runs that touch or cross place k, where a factor of so many words ends and one of size begins, and end within the latter.

    Such a run has fewer than (before + size) / 2 words a period and begins at most before + (before + size) / 2 words before
    k: else the factor before k would have been longer. One that goes further on is found at a later border, and one that
    begins further back and ends at k at an earlier one.
    """
    out: dict[tuple[int, int], int] = {}
    most, end = (before + size) // 2, k + size
    back = min(k, before + most + 2)
    u, v = w[k - back : k], w[k : end + 1]
    n = len(v)
    on = extensions(v)  # of what begins at k and q words later
    turned = u[::-1]
    behind = extensions([*turned, -1, *v[::-1], *turned])  # of what ends at k, q words before and q words later
    early = extensions([*v, -1, *u, *v])  # of what begins at k and q words before
    for q in range(1, most + 1):
        need = max(least, periods * q)
        if q <= n:
            lo, hi = k - behind[back + 1 + n - q], k + q + (on[q] if q < n else 0)
            if hi - lo >= need and hi <= end and (lo > k - back or lo == 0):
                out.setdefault((lo, hi), q)
        if q <= back:
            lo, hi = k - q - (behind[q] if q < back else 0), k + early[n + 1 + back - q]
            if hi - lo >= need and hi <= end and (lo > k - back or lo == 0):
                out.setdefault((lo, hi), q)
    return out


def runs(w: list[int], least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """(begin, end, smallest period) of all runs of at least so many words and periods (3 or more), by begin and end."""
    found: list[Run] = []

    def add(run: Run) -> None:
        at = bisect_left(found, (run[0], run[1], 0))
        if at == len(found) or found[at][:2] != run[:2]:
            found.insert(at, run)

    before = 0
    for k, size, earlier in factors(w):
        if 3 * (before + size) >= 2 * least:  # no shorter ones hold a run
            for (lo, hi), q in at_border(w, k, before, size, least, periods).items():
                add((lo, hi, q))
        if earlier >= 0 and size >= least:
            i = bisect_right(found, (earlier, len(w) + 1, 0))
            while i < len(found) and found[i][0] < earlier + size:
                lo, hi, q = found[i]
                if hi < earlier + size:
                    add((lo + k - earlier, hi + k - earlier, q))
                i += 1
        before = size
    if before >= least:
        for (lo, hi), q in at_border(w, len(w), before, 0, least, periods).items():
            add((lo, hi, q))
    return found


def stretches(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """[begin, end) of the stretches in which every string of SCREEN words occurs at least twice; all runs lie in one each."""
    if len(codes) < least:
        return []
    h, k = mix(codes.astype(np.uint64) + np.uint64(1)), 1
    while k < SCREEN:
        h, k = mix(h[:-k] * _ODD + h[k:]), 2 * k
    order = np.argsort(h, kind="stable")
    same = np.r_[False, h[order][1:] == h[order][:-1], False]
    again = np.zeros(len(h) + 2, np.int8)
    again[order + 1] = same[:-1] | same[1:]
    edge = np.flatnonzero(np.diff(again)).reshape(-1, 2)
    return [(int(a), int(b) + SCREEN - 1) for a, b in edge if b - a >= least - SCREEN + 1]


def runs_of(words: list[bytes], least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """Runs of a text's words, by begin and end."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    codes = [number.setdefault(x, len(number)) for x in words]
    out: list[Run] = []
    for a, b in stretches(np.array(codes), least):
        for lo, hi, q in runs(codes[a:b], least, periods):
            insort(out, (lo + a, hi + a, q))
    return out


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words, each run down to its first period."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for lo, hi, q in found:
        gone[lo + q] += 1
        gone[hi] -= 1
    left = np.cumsum(gone)[:-1] == 0
    return b" ".join([w for w, x in zip(words, left.tolist(), strict=True) if x])


_RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and collapsed (each run down to its first period) of every whole text.

    Runs have at least LEAST words and PERIODS periods. A null text has no words, as an empty one: no runs, and an empty
    collapsed text; a text without runs has its words joined by one blank. Repeated rows give repeated results, an empty
    table none; columns other than doc_id and text are left out. A task holds one text and its automaton at a time.
    """

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(parts, 32):
            ids, sizes, out, rest = [], [], [], []
            for r in rows:
                words = (r["text"] or b"").split()  # at the six spaces of ASCII
                found = runs_of(words)
                ids.append(r["doc_id"])
                sizes.append(len(words))
                out.append(sorted((lo, q, hi) for lo, hi, q in found))
                rest.append(collapsed(words, found))
            spans = [[{"start": lo, "length": hi - lo, "period": q} for lo, q, hi in x] for x in out]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(_RUN)), pa.array(rest, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(of, _RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """docs with repetitions in the texts of about a tenth of all ids, as their checksum says; for those, words are joined by one blank.

    With h the checksum, g = h / 10 and n words, all words from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of
    them. A row without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    some = docs.withColumn("_w", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")))
    a = F.col("_g") % F.col("_n")
    some = some.withColumn("_n", F.nullif(F.size("_w"), F.lit(0))).withColumn("_g", g).withColumn("_a", a.cast("int"))
    some = some.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    new = F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get(F.col("_w"), F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return some.select(*[F.coalesce(F.array_join(new, " "), F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def longest(found: Column) -> Column:
    """The run of the greatest exact length / period; of several the first, of the smallest period. Null without runs."""
    before = lambda a, b: F.coalesce(F.nullif(b["length"] * a["period"] - a["length"] * b["period"], F.lit(0)), F.nullif(a["start"] - b["start"], F.lit(0)), a["period"] - b["period"])
    return F.get(F.array_sort(found, lambda a, b: F.sign(before(a, b)).cast("int")), 0)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the most periods and digests of all runs and of the collapsed text, for every row of docs with planted repetitions."""
    own = periodic_runs(planted(docs.select("doc_id", "text"))).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    milli = F.expr("best.length * 1000 div best.period")
    return own.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
