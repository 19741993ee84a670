import re

from quern.llm import sentence_spans as S

from ..compare import DATA
from .helpers import documents, sentences


def plain_sentences(text):
    """(begin, end) of each sentence, character by character."""
    out, begin = [], 0
    for i, c in enumerate(text):
        after = text[begin:i]
        if c == "\n" or c.isspace() and after and text[i - 1] in ".!?":
            out.append((begin, i))
            begin = i + 1
        elif c.isspace() and not after.strip() and out:
            begin = i + 1
    return [(a, a + len(text[a:b].rstrip() if text[b : b + 1] == "\n" else text[a:b])) for a, b in [*out, (begin, len(text))]]


def brute(texts, least=S.LEAST_WORDS):
    """(doc_id, text) of distinct rows to their new text, by the words of every run of sentences with enough words, however long."""
    seen, out = {}, {}
    for k, t in texts:
        cut, bounds = set(), plain_sentences(t or "")
        own = [(i, w) for i, (a, b) in enumerate(bounds) if (w := tuple(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t[a:b]))))]
        for x in range(len(own)):
            n = 0
            for y in range(x, min(len(own), x + 40)):
                n += len(own[y][1])
                if n >= least and seen.setdefault(tuple(w for _, w in own[x : y + 1]), (k, t, x)) != (k, t, x):
                    cut |= set(range(own[x][0], own[y][0] + 1))
        kept = [t[: bounds[0][0]]] + [t[a : bounds[i + 1][0] if i + 1 < len(bounds) else len(t)] for i, (a, b) in enumerate(bounds) if i not in cut] if cut else [t]
        out[k, t] = "".join(kept) if t else t
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert got == {k: t for (k, _), t in brute(texts).items()}


def test_passages_go_and_the_rest_stays(spark):
    passage, own = sentences(4, "p", 15), [sentences(5, f"own{i}") for i in range(5)]
    talk = sentences(30, "talk", 4)  # 120 words
    long = " ".join(f"w{i}" for i in range(45)) + "."
    texts = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]}\n{passage.upper()}\n{own[3]}"), (3, None), (4, ""), (5, "Hi. Ho. Hu."), (6, "Hi. Ho. Hu."), (11, f"{talk} And so."), (12, f"{own[4]} {talk}"), (7, f"{long} {sentences(3, 'z')}"), (8, f"{sentences(3, 'y')} {long}"), (1, f"{own[0]} {passage} {own[1]}"), (9, passage), (10, f"{passage} {passage}")]
    docs = documents(spark, texts)
    got = S.remove_repeats(docs, "removed")
    by = {r.doc_id: r for r in got.collect()}
    assert got.columns == [*docs.columns, "removed"] and got.count() == len(texts)
    assert by[1].text == texts[0][1] and by[1].removed == 0
    assert by[2].text == f"{own[2]}\n{own[3]}" and by[2].removed == 4 and by[2].n_chars == len(by[2].text)
    assert by[3].text is None and by[4].text == "" and by[6].text == "Hi. Ho. Hu."
    assert by[11].text == f"{talk} And so." and by[12].text == own[4] + " " and by[12].removed == 30
    assert by[8].text == sentences(3, "y") + " " and by[9].text == "" and by[10].text == ""
    assert S.remove_repeats(documents(spark, [])).count() == 0


def test_passages_glued_to_unfinished_sentences_go(spark):
    def passage(seed, *sizes):
        return " ".join(sentences(1, f"{seed}{i}", n) for i, n in enumerate(sizes))

    two, one = passage("two", 8, 17, 18, 8), passage("one", 10, 31, 10)  # 51 words each
    texts = [(1, f"some words {two} And on."), (2, f"other text and {two.removesuffix('.')} more of it."), (3, f"a start {one} End."), (4, f"another start {one.removesuffix('.')} goes on.")]
    got = {r.doc_id: r.text for r in S.remove_repeats(documents(spark, texts)).collect()}
    assert got[1] == texts[0][1] and got[3] == texts[2][1]
    a, b = (t.split(". ") for t in (texts[1][1], texts[3][1]))
    assert got[2] == f"{a[0]}. {a[3]}" and got[4] == f"{b[0]}. {b[2]}"
    # A short line alone, such as one of a licence, is no span.
    line = sentences(1, "licence", 12)
    lines = [(5, f"{sentences(2, 'a')} {line}"), (6, f"{sentences(2, 'b')} {line}")]
    assert {r.doc_id: r.text for r in S.remove_repeats(documents(spark, lines)).collect()} == dict(lines)


def test_sentences_cover_the_text():
    t = "  One. Two!  Three?\n\nfour\n five. "
    assert [t[a:b] for a, b in S.sentences(t)] == ["  One.", "Two!", "Three?", "four", "five."]
    assert S._without(t, {1, 3}) == "  One. Three?\n\nfive. "


def test_scripts_without_blanks(spark):
    import random

    rng = random.Random(1)
    line = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) + "。"
    passage, own = line(40) + line(25) + line(60), [line(30) for _ in range(4)]
    texts = [(1, own[0] + passage + own[1]), (2, own[2] + passage.replace("。", "！") + own[3]), (3, "短い。短い。"), (4, "短い。短い。"), (5, f"{own[0]}\nEnglish words here.")]
    got = {r.doc_id: r.text for r in S.remove_repeats(documents(spark, texts)).collect()}
    assert got == {1: texts[0][1], 2: own[2] + own[3], 3: texts[2][1], 4: texts[3][1], 5: "English words here."}
    assert [t for a, b in S.sentences(own[0] + own[1] + " x") for t in [(own[0] + own[1] + " x")[a:b]]] == [own[0], own[1], "x"]
