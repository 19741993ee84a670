import public_tokenizers as P

import corpus_pipeline
from quern.llm import byte_bpe

from ..compare import DATA
from .helpers import long_text, sentences
from .test_decontaminate import brute as brute_hits
from .test_near_copies import brute_classes
from .test_sentence_spans import brute as brute_spans


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE"]


def plain(docs, items):
    """The same pipeline on plain lists of (doc_id, text)."""
    docs = [(k, t) for k, t in docs if t and any(c.isalpha() for c in t)]
    classes = brute_classes(docs)
    docs = sorted((k, t) for k, t in docs if classes[k] == k)
    docs = [(k, t) for (k, _), t in brute_spans(docs).items() if t.strip(" ")]
    clean = {r[0] for r in brute_hits(docs, items, 10) if not r[5]}
    coder = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return sorted((k, *byte_bpe._digest(ids := coder.encode(t), coder.decode(ids))) for k, t in docs if k in clean)


def write(spark, tmp_path, docs, items):
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_against_the_plain_one(spark, tmp_path):
    base, passage = long_text(150), sentences(4, "p", 15)
    item = " ".join(f"item{i}" for i in range(14))
    docs = [(1, base), (2, base + " tail"), (3, f"{sentences(4, 'a')} {passage}"), (4, f"{sentences(4, 'b')} {passage} {sentences(2, 'c')}"), (5, f"lead {item} end"), (6, None), (7, ""), (8, "12 34"), (9, passage), (10, sentences(6, "d"))]
    assert write(spark, tmp_path, docs, [(1, item)]) == plain(docs, [(1, item)])


def test_against_the_plain_one_on_the_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == plain(docs, items)


def test_empty_tables(spark, tmp_path):
    assert write(spark, tmp_path, [], []) == []
