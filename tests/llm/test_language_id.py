import numpy as np
import pytest

from quern.llm import language_id as L

from ..compare import DATA
from .helpers import documents


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 20
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_held_out_is_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", L.is_held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_edge_cases(spark):
    texts = [(i, f"the cat and the dog number {'xyz'[i % 3]}", "en") for i in range(12)] + [(20 + i, f"der hund und die katze nummer {'xyz'[i % 3]}", "de") for i in range(12)]
    texts += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, "the dog and the cat " * 100_000, None), (None, "the cat", None), (20, "der hund und die katze nummer x", "de")]
    docs = documents(spark, texts)
    got = L.identify(docs).toPandas()
    assert len(got) == len(texts)
    by = {None if k != k else k: (p, s) for k, p, s in zip(got.doc_id, got.lang_pred, got.score, strict=True)}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[103][0] == "en" and by[None][0] == "en" and by[20][0] == "de"
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 3
    assert L.identify(docs.limit(0)).count() == 0


def test_without_labels_nothing_is_known(spark):
    assert [r.lang_pred for r in L.identify(documents(spark, [(1, "some text")])).collect()] == ["und"]


def test_margins_are_means_over_the_whole_text():
    rng = np.random.default_rng(0)
    w = rng.standard_normal(L.FEATURES + 1).astype("f4")
    model = L.LanguageModel(["en", "de"], {("de", "en"): w})
    texts = ["Hello  world", "ÄÖ x", "a", "zz 1 zz"]
    x = L.features(texts)
    want = 1 / (1 + np.exp(-2 * (x @ w[:-1] + w[-1])))
    for (lang, score), p in zip(model.predict(texts), want, strict=True):
        assert lang == ("de" if p >= 0.5 else "en") and score == pytest.approx(max(p, 1 - p), abs=1e-5)


def test_families_come_first():
    assert (f"{L.FAMILY}germanic", f"{L.FAMILY}romance") in L.LanguageModel.pairs(["en", "de", "fr"])
    assert ("de", "en") in L.LanguageModel.pairs(["en", "de", "fr"]) and ("en", "fr") not in L.LanguageModel.pairs(["en", "de", "fr"])
    assert L.family_of("xx") == "xx"


def test_machines_are_at_the_least_of_their_cost():
    """The gradient of |w|^2 / 2 + c sum max(0, 1 - y f)^2, a strictly convex function, vanishes at the fitted weights."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5))
    y = np.where(x @ [1.0, -2.0, 0.5, 0.0, 0.3] + rng.standard_normal(60) * 0.8 > 0.2, 1.0, -1.0)
    w = L.fit_svm(x, y, c=2.0, epochs=3000)
    one = np.c_[x, np.ones(60)]
    slack = np.maximum(0, 1 - y * (one @ w))
    assert np.abs(w - 2 * 2.0 * (slack * y) @ one).max() < 1e-6 and (slack > 0).any()


def test_votes_are_those_of_every_machine_on_every_text():
    rng = np.random.default_rng(6)
    langs = ["en", "de", "nl", "fr", "es", "ru", "zz"]
    model = L.LanguageModel(langs, {p: rng.standard_normal(L.FEATURES + 1).astype("f4") for p in L.LanguageModel.pairs(langs)})
    texts = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 40)))) + " a b" for _ in range(50)] + ["", "12 3"]

    def winner(names, prefix, f):
        chance = {n: [] for n in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w = model.machines[prefix + a, prefix + b].astype(float)
                p = 1 / (1 + np.exp(-2 * (f @ w[:-1] + w[-1])))
                chance[a].append(p)
                chance[b].append(1 - p)
        rank = lambda n: 4 * sum(p >= 0.5 for p in chance[n]) + (np.mean(chance[n]) if chance[n] else 1)
        best = max(names, key=rank)
        return best, float(np.mean(chance[best])) if chance[best] else 1.0

    for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        f = L.features([text])[0].astype(float)
        family, p = winner(sorted(model.families), L.FAMILY, f)
        own, q = winner(model.families[family], "", f)
        assert lang == own and abs(score - p * q) < 1e-4
