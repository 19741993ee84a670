import os
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import order_minhash as O
from quern.llm import projection_forest as R
from quern.llm.common import WordHashes, connected_components, discard, release, store, words_of

from ..compare import DATA, same
from .helpers import documents, long_text


def groups(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 50), (60, 60)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {n: g for n, g in groups(pairs, {x for p in pairs for x in p}).items() if n != 60}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_stored_tables_can_be_released(spark):
    table = store(spark.range(5).toDF("n"), "some")
    other = store(spark.range(3).toDF("n"), "other")
    discard(table)
    assert other.count() == 3 and not os.path.exists(table._quern_path) and release(spark) >= 1 and release(spark) == 0
    assert not os.path.exists(other._quern_path)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_alignment(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert O.banded(np.array(a, int), np.array(b, int), 50) == table[-1][-1]
    la, lb = (O.labelled(np.array(x, "u4") * 7919) for x in (a, b))
    t = [[0] * (len(lb) + 1) for _ in range(len(la) + 1)]
    for i, x in enumerate(la):
        for j, y in enumerate(lb):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    n = t[-1][-1]
    assert O.similar(la, lb) == (n > 0 and n / (len(la) + len(lb) - n) >= 0.8 - 1e-9)


def brute_classes(texts):
    labels = {i: O.labelled(WordHashes().of(words_of(t)).astype("<u4")) for i, t in texts}
    inverted = defaultdict(set)
    for i, x in labels.items():
        for h in x.tolist():
            inverted[h].add(i)
    seen = {(a, b) for s in inverted.values() for a in s for b in s if a < b}
    return groups([p for p in seen if O.similar(labels[p[0]], labels[p[1]])], labels)


def test_classes_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in O.classes(docs).collect()}
    assert got == brute_classes(texts)


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"new{p}"
    return " ".join(w)


def test_a_cloud_of_copies_near_the_threshold(spark):
    base = long_text(120)
    texts = [(i, edited(base, *[(7 * i + 11 * k) % 118 for k in range(i % 5)])) for i in range(60)]
    got = {r.doc_id: r.class_id for r in O.classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_blocks_join_what_pairs_join(monkeypatch, spark):
    monkeypatch.setattr(O, "BLOCK", 4)
    test_a_cloud_of_copies_near_the_threshold(spark)


def test_copies_edge_cases(spark):
    a = long_text(200)
    texts = [(5, a), (3, a.upper() + "!"), (9, edited(a, 100)), (4, None), (6, ""), (7, "..."), (8, "one two"), (2, "One, two"), (10, "two one"), (5, a), (None, a), (11, long_text(30_000, "l")), (12, edited(long_text(30_000, "l"), 5, 900))]
    docs = documents(spark, texts)
    got = sorted((str(r.doc_id), r.class_id, r.kept) for r in O.classes(docs).collect())
    assert got == sorted([("5", 3, False), ("5", 3, False), ("3", 3, True), ("9", 3, False), ("4", 4, True), ("6", 6, True), ("7", 7, True), ("8", 2, False), ("2", 2, True), ("10", 10, True), ("None", 3, False), ("11", 11, True), ("12", 11, False)])
    kept = O.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7, 10, 11]
    assert O.classes(documents(spark, [])).count() == 0
    twice = documents(spark, [(1, a), (1, a), (2, a)])
    assert [r.doc_id for r in O.keep_first(twice).collect()] == [1]
    other = documents(spark, [(1, a), (2, a), (2, long_text(50, "o"))])  # one id, two texts: only the copy goes
    assert sorted((r.doc_id, len(r.text.split())) for r in O.keep_first(other).collect()) == [(1, 200), (2, 50)]


def test_texts_without_an_id_are_compared(spark):
    t = long_text(100)
    got = sorted((str(r.doc_id), r.class_id, r.kept) for r in O.classes(documents(spark, [(1, t), (None, t + " tail"), (None, "x " + t), (None, "y " + t)])).collect())
    assert got == [("1", 1, True), ("None", 1, False), ("None", 1, False), ("None", 1, False)]
    got = sorted((r.class_id, r.kept) for r in O.classes(documents(spark, [(None, t), (None, t + " tail"), (7, long_text(90, "o"))])).collect() if r.class_id)
    assert got == [(7, True)]


def test_copies_in_scripts_without_blanks(spark):
    import random

    rng = random.Random(2)
    base = "".join(chr(rng.randrange(0x4E00, 0x9000)) + ("，" if i % 15 == 14 else "") for i in range(400))
    near = base[:200] + "改" + base[201:]
    texts = [(1, base), (2, near), (3, base[::-1]), (4, base.replace("，", "、"))]
    assert {r.doc_id: r.class_id for r in O.classes(documents(spark, texts)).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_labels_beyond_32_bits(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 2**40), (2, [2.0, 0.0], 2**40), (3, [1.0, 0.0], 2**40 + 1), (4, [1.0, 0.0], 0)], "vec_id bigint, embedding array<float>, label bigint")
    assert {r.vec_id: (r.n_links, r.component_id) for r in R.links(table).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


VECTORS = "vec_id bigint, embedding array<float>, label int, member string"


def brute_links(rows):
    ok = lambda e: e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)
    n, pairs = [0] * len(rows), []
    for i, (_, e, la) in enumerate(rows):
        for j, (_, f, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and ok(e) and ok(f) and len(e) == len(f):
                x, y = np.array(e, np.float32).astype(float), np.array(f, np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    n[i] += 1
                    pairs.append((i, j))
    g = groups(pairs, range(len(rows)))
    low = defaultdict(list)
    for i, k in g.items():
        if rows[i][0] is not None:
            low[k].append(rows[i][0])
    return sorted((str(rows[i][0]), n[i], min(low[g[i]], default=None), rows[i][0] is not None and rows[i][0] == min(low[g[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("leaf", [1000, 8])
def test_links_are_those_of_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, (centre + rng.standard_normal(16) * 0.08).astype("f4").tolist(), c % 3) for k in range(10)]
    rows += [(200 + k, rows[0][1], 0) for k in range(15)] + [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None, 1.0], 0), (305, rows[0][1], None), (None, rows[0][1], 0), (0, rows[0][1], 0), (306, [2 * x for x in rows[0][1]], 0), (307, [1.0, 0.0], 0), (308, [1.0, 0.0], 0)]
    table = spark.createDataFrame([(i, e, lab, "x") for i, e, lab in rows], VECTORS)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in R.links(table, leaf).collect())
    assert got == brute_links(rows)
    assert R.links(table.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "n", "leaf"), [(8, 3000, 100), (64, 6000, R.LEAF), (384, 3000, 100)])
def test_recall(spark, monkeypatch, dim, n, leaf):
    """Pairs just above the least cosine, the hardest ones, in random directions and in clusters."""
    monkeypatch.setattr(R, "SAMPLE", 1000)
    rng = np.random.default_rng(dim)
    e = rng.standard_normal((n, dim)) + rng.standard_normal((20, dim))[rng.integers(0, 20, n)]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    off = rng.standard_normal((n // 3, dim))
    e[1::3] = e[0::3] + 0.19 * off / np.linalg.norm(off, axis=1, keepdims=True)
    e = e.astype("f4")
    unit = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T >= 0.98
    np.fill_diagonal(s, False)
    table = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(e)], "vec_id bigint, embedding array<float>, label int")
    found = sum(r.n_links for r in R.links(table, leaf).collect())
    assert s.sum() > 100 and 0.95 * s.sum() <= found <= s.sum()


def test_small_leaves_give_the_rows_of_sql(spark):
    same(spark, lambda spark, data: R.links(spark.read.parquet(f"{data}/embeddings.parquet"), 12), R.ORACLE)


def test_a_cloud_that_cannot_be_split_is_compared_whole(spark):
    rng = np.random.default_rng(3)
    e = (rng.standard_normal(32) + rng.standard_normal((300, 32)) * 0.02).astype("f4")
    table = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(e)], "vec_id bigint, embedding array<float>, label int")
    assert {(r.n_links, r.component_id) for r in R.links(table, 20).collect()} == {(299, 0)}


def test_doubles_and_long_vectors(spark):
    rng = np.random.default_rng(4)
    e = rng.standard_normal((40, 5000))
    e[1::2] = e[0::2] * 3 + rng.standard_normal((20, 5000)) * 0.1
    table = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(e)], "vec_id bigint, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in R.links(table, 10).collect()} == {i: (1, i - i % 2) for i in range(40)}
