import hashlib
import random
import re
import zlib
from fractions import Fraction

from quern.llm import periodic_runs as P

from .helpers import documents, long_text


def brute(w, least=P.LEAST, periods=P.PERIODS):
    """(begin, end, period) of all runs, by comparing words at every distance."""
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def sequences(n, seed):
    """Random sequences with repetitions and with parts that occur again."""
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(size)]
        if rng.random() < 0.6 and size:
            a = rng.randrange(size)
            p = 1 + rng.randrange((size - a) // 3 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        if rng.random() < 0.5:
            w = w + w[: rng.randrange(size + 1)] + [9] * rng.randrange(3) + w[: rng.randrange(size + 1)]
        yield rng.choice([3, 4, 6, 24]), w


def test_runs_against_all_distances():
    met = 0
    for least, w in sequences(4000, 1):
        want = brute(w, least)
        met += len(want)
        assert P.runs(w, least) == want, (w, least)
    assert met > 5000


def test_screening_loses_no_run():
    for _, w in sequences(4000, 2):
        words = [b"%d" % x for x in w]
        assert P.runs_of(words) == brute(w), w


def test_factors_are_the_longest_earlier_strings():
    for _, w in sequences(500, 3):
        at = 0
        for begin, size, earlier in P.factors(w):
            assert begin == at
            longest = max((next((k for k in range(len(w) - begin) if w[j + k] != w[begin + k]), len(w) - begin) for j in range(begin)), default=0)
            assert size == max(1, longest) and (earlier < 0) == (longest == 0)
            assert earlier < 0 or w[earlier : earlier + size] == w[begin : begin + size] and earlier < begin
            at += size
        assert at == len(w)


def plain(i, text):
    """The contract's row for one document, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    found = [(a, b - a, q) for a, b, q in brute(words)]
    found.sort(key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return str(i), len(found), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))


def test_table(spark):
    rng = random.Random(4)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 23), (4, "a " * 24), (None, "b c\n" * 30), (None, "b c\n" * 30), (5, "é\xa0日 " * 40), (6, long_text(3000))]
    texts += [(7, "  x\x1cy " * 30 + "z " + "u v w " * 20 + "v w " * 20 + "end"), (8, "p q " * 12 + "r " + "p q " * 12 + "s s s " * 30)]
    texts += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 400)))) for i in range(100, 300)]
    got = P.digests(documents(spark, texts)).collect()
    assert sorted(((str(r.doc_id), *tuple(r)[1:]) for r in got), key=str) == sorted((plain(*t) for t in texts), key=str)
    assert sum(r.n_runs > 0 for r in got) > 10 and max(r.n_runs for r in got) > 2
    assert P.digests(documents(spark, [])).count() == 0


def test_ties_and_exact_exponents(spark):
    rows = spark.createDataFrame([(1, [(9, 30, 10), (50, 60, 20), (0, 24, 8)]), (2, []), (3, [(0, 100000001, 30000000), (1, 100000002, 30000000), (5, 100000002, 30000000)])], "k int, runs array<struct<start: bigint, length: bigint, period: bigint>>")
    got = {r.k: r.best and tuple(r.best) for r in rows.select("k", P.longest(P.F.col("runs")).alias("best")).collect()}
    assert got == {1: (0, 24, 8), 2: None, 3: (1, 100000002, 30000000)}


def test_long_repetition_takes_little_time():
    import time

    w = [b"%d" % (i % 700) for i in range(200_000)]
    start = time.process_time()
    assert P.runs_of(w) == [(0, 200_000, 700)]
    assert time.process_time() - start < 30
