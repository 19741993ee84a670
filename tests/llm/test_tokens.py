import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quern.llm import byte_bpe, token_counts, token_store

from .helpers import documents, long_text

TEXTS = [(5, "It's a test... of 5,000 words, isn't it? Ünïcödé ſß 日本語。"), (3, None), (4, ""), (9, "  \n\t x \x1c y\x85z "), (7, long_text(3000)), (7, long_text(3000)), (7, "other"), (None, "no id"), (11, "a" * 5000 + " " * 3000 + "b" * 10)]


def test_packing_gives_random_access():
    rng = np.random.default_rng(1)
    ids = rng.choice([3, 300, 70_000, 2**31], 5000).astype(np.uint32) + rng.integers(0, 100, 5000).astype(np.uint32)
    seg = token_store.Segment(token_store.pack(ids))
    assert len(seg) == 5000 and all(seg[i] == ids[i] for i in [0, 1, 511, 512, 513, 4095, 4999])
    for a, b in [(0, 5000), (17, 17), (500, 1600), (4990, 6000)]:
        assert (seg.slice(a, b) == ids[a:b]).all()
    assert len(token_store.Segment(token_store.pack(np.zeros(0, np.uint32)))) == 0
    with pytest.raises(IndexError):
        seg[5000]


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    token_store.write_tokens(documents(spark, TEXTS), str(tmp_path / "t"), path, parts=3)
    got = token_store.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    tok, start = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in got] == sorted((t[0] for t in TEXTS), key=lambda k: (k is not None, k))
    texts = {}
    for k, t in TEXTS:
        texts.setdefault(k, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        ids = np.frombuffer(r.tokens, "<u4").tolist()
        assert ids in texts[r.doc_id] and r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.tokens)
        start += r.n_tokens
    token_store.write_tokens(documents(spark, []), str(tmp_path / "e"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_store.WordEncoder(P.path("word_bpe_49k.json"), most=20)
    texts = ["", " ", "İstanbul ŞIĞ ﬁ ｆｕｌｌ ﬁx, K. Σ ΑΣ", "<|startoftext|> hi<|endoftext|>. a", "é e ́ x", "A.B. C,D, e.\tf,\rg foo_. ..", "don't we'll 'RE x's.", "🙂🙂. a🙂b", "word " * 50, "\x1c a\x1cb \xa0 c"]
    for _ in range(3):
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def _tiktoken():
    return byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (64, 16), (100, 40)])
def test_bytes_round_trip_in_chunks(spark, chunk, overlap):
    coder = _tiktoken()
    got = byte_bpe.encode_documents(documents(spark, TEXTS), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap).collect()
    want = sorted((str(k), *byte_bpe._digest(ids := coder.encode(t or ""), coder.decode(ids))) for k, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS}
    assert byte_bpe.encode_documents(documents(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 40), (16, 4)])
def test_pieces_of_random_texts_encode_as_the_whole(chunk, overlap):
    """Words, paragraph breaks, tabs and runs of blanks of any length, in chunks that end anywhere."""
    import random

    coder, rnd = _tiktoken(), random.Random(chunk)
    parts = ["word", "a", "Next", "it's", "'ll", "42", "…", "é日", "🙂", "...", "\n\n", "\n", "\t", " ", "  ", " \n ", "\r\n", "\x1c", "\x85", "\xa0", " " * 30, "\n" * 20, "\t\n" * 9]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 120)))
        cut = byte_bpe.chunks_of(len(text), chunk, overlap)
        chunks = [(at, text[at : at + chunk + overlap]) for at, _ in cut]
        own = [[at + x for x in coder.boundaries(t, last) if x < overlap or x >= chunk] for (at, t), (_, last) in zip(chunks, cut, strict=True)]
        out = byte_bpe.pieces(chunks, own, coder)
        assert "".join(out) == text
        assert [i for piece in out for i in coder.encode(piece)] == coder.encode(text), text


def test_a_paragraph_that_begins_at_a_chunk(spark):
    texts = [(k, "x y " * 16384 + "z" * k + "\n\nNext paragraph of the text, " + "and more of it. " * 3000) for k in range(-2, 3)] + [(9, "a" * 65534 + "\n\nNext paragraph " + "b c " * 9000)]
    texts += [(10, ("x" * 65534) + "\n\n" + "Next paragraph of a text that goes on. " * 3000)]
    coder = _tiktoken()
    got = byte_bpe.encode_documents(documents(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == {k: byte_bpe._digest(coder.encode(t), b"")[:2] for k, t in texts}


def test_columns_encode_and_decode(spark):
    docs = documents(spark, TEXTS[:4])
    path = P.path("byte_bpe_50k.tiktoken")
    ids = docs.select("text", byte_bpe.encode_column(docs.text, path, P.PATTERN).alias("ids"))
    back = ids.select("text", byte_bpe.decode_column(ids.ids, path, P.PATTERN).alias("raw")).collect()
    assert all(bytes(r.raw) == (r.text or "").encode() for r in back)


def brute_count(unigram, word):
    full, best = token_counts.MARK + word, [(0.0, 0)]
    for end in range(1, len(full) + 1):
        size = len(full[end - 1].encode())
        options = [(best[end - 1][0] + unigram.byte_score * size, best[end - 1][1] + size)]
        options += [(best[s][0] + unigram.scores[full[s:end]], best[s][1] + 1) for s in range(end) if full[s:end] in unigram.scores]
        top = max(o[0] for o in options)
        best.append((top, min(o[1] for o in options if o[0] == top)))
    return best[-1][1]


def test_trie_counts_are_those_of_each_word_alone(spark):
    unigram = token_counts.Unigram.from_sentencepiece(P.path("piece_bpe_32k.model"))
    words = ["the", "them", "theme", "a", "antidisestablishment", "Ünïcödé", "日本語", "🙂x", "the"]
    assert unigram.counts(words) == {w: brute_count(unigram, w) for w in words}
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(documents(spark, TEXTS), P.path("piece_bpe_32k.model")).collect()}
    assert got == {(k, sum(brute_count(unigram, w) for w in (t or "").split())) for k, t in TEXTS}
    assert token_counts.count_tokens(documents(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def test_words_encode_as_whole_texts_at_random():
    import random

    from tokenizers import Tokenizer

    tok, own, rnd = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_store.WordEncoder(P.path("word_bpe_49k.json")), random.Random(1)
    letters = "aAbZé́ßİΣक़09 .,!'$%&_<|>~^`\n\t\x1c\x85\xa0-–🙂ﬁ日 st"
    for k in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "<|endoftext|>", "<|startoftext|>.", " 's 're"]) + rnd.choice(letters)
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
