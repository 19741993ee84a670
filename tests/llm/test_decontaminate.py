import re

from quern.llm import decontaminate as D

from ..compare import DATA, same
from .helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_against_sql(spark):
    same(spark, lambda s, d: D.report(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/benchmark.parquet")), D.ORACLE, DATA)


def brute(docs, items, size):
    import hashlib

    out = []
    for k, t in docs:
        w, hit, met = words(t), set(), set()
        for i, it in items:
            x = words(it)
            n = min(size, len(x))
            for s in range(len(x) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        met.add(str(i) if i is not None else "null")
        out.append((k, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PHRASE = "one two three four five six seven eight nine ten eleven twelve"


def test_edge_cases(spark):
    docs = [(1, f"x {PHRASE} y"), (2, PHRASE.upper() + "!"), (3, None), (4, ""), (5, "one two three"), (6, "...Élan, élan; ÉLAN"), (7, " ".join(PHRASE.split()[:9])), (1, f"x {PHRASE} y"), (1, "short item"), (None, "short item short item"), (8, "the " * 30_000 + PHRASE + " the" * 30_000), (9, "a a a a a a a a a a a a")]
    items = [(1, PHRASE), (2, "Short, item"), (3, ""), (4, None), (10, "Élan"), (None, "short item"), (2, "short item"), (12, "a a a a a a a a a a a"), (13, "never seen words here")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, hits string")
    got = sorted((tuple(r)[:6] for r in D.report(documents(spark, docs), table).collect()), key=str)
    assert got == brute(docs, items, 10)
    near = {(r.doc_id, r.n_near) for r in D.report(documents(spark, docs), table).collect()}
    pairs = {(r.doc_id, str(r.item_id)) for r in D.proximity_matches(documents(spark, docs), table).collect()}
    assert {k for k, n in near if n} == {k for k, _ in pairs} and (3, 0) in near and (8, 1) in near
    assert D.report(documents(spark, []), table).count() == 0
    assert {r.contaminated for r in D.report(documents(spark, docs), table.limit(0)).collect()} == {False}
    clean = D.keep_clean(documents(spark, docs), table)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 7] and "cut" in clean.columns


def test_letters_whose_lower_case_depends_on_what_follows(spark):
    docs = [(1, "αρχη ΟΔΟΣ.ΑΒ ΓΔ ΕΖ ΗΘ ΙΚ ΛΜ ΝΞ ΟΠ ΡΣ τελος"), (2, "x ΟΔΟΣ ΑΒ ΓΔ ΕΖ ΗΘ ΙΚ ΛΜ ΝΞ ΟΠ ΡΣ"), (3, "οδος αβ γδ εζ ηθ ικ λμ νξ οπ ρς"), (4, "İI ﬁ"), (5, "İi ﬁ."), (6, "Δ'Σ one")]
    items = [(1, "ΟΔΟΣ ΑΒ ΓΔ ΕΖ ΗΘ ΙΚ ΛΜ ΝΞ ΟΠ ΡΣ"), (2, "İI-ﬁ"), (3, "Σ ONE")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r)[:6] for r in D.report(documents(spark, docs), table).collect()), key=str)
    assert got == brute(docs, items, 10)
    assert [g[2] for g in got] == [10, 10, 0, 2, 2, 2]


def test_proximity(spark):
    docs = [(1, "alpha x x beta x gamma"), (2, "gamma " + "x " * 50 + "beta alpha"), (3, "alpha beta"), (4, None), (5, "beta gamma alpha")]
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in D.proximity_matches(documents(spark, docs), items, slop=10).collect()) == [1, 5]


def test_proximity_edge_cases(spark):
    docs = [(None, "alpha beta"), (1, "alpha beta"), (1, "alpha beta"), (1, "alpha x x x beta"), (2, "alpha " + "x " * 3 + "beta"), (3, None), (4, ""), (5, "beta " * 30 + "alpha"), (6, "BETA, alpha!")]
    items = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "..."), (None, "beta alpha"), (4, "alpha nowhere")], "item_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in D.proximity_matches(documents(spark, docs), items, slop=2).collect())
    assert got == sorted((d, i) for d in ("None", "1", "5", "6") for i in ("1", "None"))
    assert D.proximity_matches(documents(spark, []), items).count() == 0
    assert D.proximity_matches(documents(spark, docs), items.limit(0)).count() == 0
