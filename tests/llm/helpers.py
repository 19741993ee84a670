"""Small tables with the awkward cases that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, cut int"


def documents(spark, texts):
    """texts: (doc_id, text[, lang]); columns that clash with names used inside the operators stand beside them."""
    rows = [(t[0], t[1], t[2] if len(t) > 2 else None, None, None if t[1] is None else len(t[1]), "r", 1) for t in texts]
    return spark.createDataFrame(rows, DOCUMENTS)


def long_text(words, seed="x"):
    return " ".join(hashlib.md5(f"{seed}{i}".encode()).hexdigest()[: 3 + i % 5] for i in range(words))


def sentences(n, seed="s", words=9):
    return " ".join(" ".join(hashlib.md5(f"{seed}{i}-{k}".encode()).hexdigest()[:5] for k in range(words)) + "." for i in range(n))
