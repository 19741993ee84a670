import hashlib
import random
import re

from quern.llm import fill_middle as M

from .helpers import documents, long_text

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LETTERS = "ab <>PSM\n\t\x0b\x1c\x85é日🙂\xa0 "


def plain(i, text):
    """What the rules say, with a regular expression."""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_automaton_against_a_regular_expression():
    rng = random.Random(2)
    for _ in range(200):
        texts = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([0, 1, 2, 5, 40, 400]))) for _ in range(rng.randrange(1, 60))]
        ids = [rng.randrange(10**6) for _ in texts]
        got = M.rearranged(ids, [t.encode() for t in texts])
        assert [(*g[:4], g[4].decode()) for g in got] == [plain(i, t) for i, t in zip(ids, texts, strict=True)]


def test_lanes_do_not_matter():
    rng = random.Random(3)
    text = "".join(rng.choice(LETTERS + "<P" * 8) for _ in range(300_000)).encode()
    got = M.rearranged([1, 2], [text, text[:7].decode(errors="ignore").encode()], rate=0)
    assert got[0][0] == len(UNIT.findall(text.decode())) and got[0][1] == "plain"


def test_table(spark):
    texts = [(i, t) for i, t in enumerate(["a b c", "", "  ", "x <P> y", "<P", "no>end <", "one\n\ntwo  three ", long_text(3000), "日本 語　x 🙂 y"])]
    texts += [(i, f"some words of {i} \n") for i in range(50, 150)] + [(7, long_text(3000)), (7, long_text(3000)), (None, "no id here"), (160, None)]
    docs = documents(spark, texts)
    got = M.transform(docs).withColumn("back", M.restored(M.F.col("output"), M.F.col("form"))).collect()
    want = sorted((str(i), *plain(i, t or ""), t or "") for i, t in texts)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in M.digests(docs).collect()}
    assert digests == {(i, hashlib.sha256(plain(i, t or "")[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts}
    assert M.digests(documents(spark, [])).count() == 0
