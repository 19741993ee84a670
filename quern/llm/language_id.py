"""Language identification in two levels: the language family first, then the language within it.

Every decision is made by one-versus-one linear support vector machines over hashed character n-grams: those between
families at the first level, those between the languages of the winning family at the second. A text's features are the
shares of its bigrams and trigrams of letters, so a margin is the mean of n-gram weights over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, free_name

# Languages by family (ISO 639-1 codes).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
    "austronesian": "id jv mg mi ms su tl",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

#: Hashed features, and labelled documents of each side of one machine at most (the bound of the training sample).
FEATURES, PER_SIDE = 1 << 14, 200
_SALTS = 8
#: What names of families begin with, beside those of languages.
FAMILY = "\0family:"


def family_of(lang: str) -> str:
    """A language outside the table is a family of its own."""
    return _FAMILY.get(lang.lower().split("-")[0], lang)


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the index of each text's first one, and whether each text has letters."""
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)
    c = _letters()[codes]
    ends = np.cumsum([len(t) + 2 for t in texts])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    keep[np.r_[0, ends[:-1]]] = True  # each text begins and ends with a space; no n-gram starts at its last one
    at = np.r_[0, np.cumsum(keep)[ends - 1]]
    has = np.add.reduceat((c != 32).astype(np.int64), np.r_[0, ends[:-1]]) > 0
    c = np.r_[c[keep], np.full(2, 32, np.uint32)]
    two = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77)
    three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    two = (two ^ (two >> np.uint32(13))) * np.uint32(0x165667B1)
    shift = np.uint32(33 - FEATURES.bit_length())
    grams = np.empty((2, len(two)), np.int32)
    grams[0], grams[1] = two >> shift, three >> shift
    return grams, at, has


def features(texts: list[str]) -> np.ndarray:
    """One row of n-gram shares for each text, scaled to length 1 or so."""
    grams, at, _ = _grams(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i in range(len(texts)):
        part = grams[:, at[i] : at[i + 1] - 1]
        out[i] = np.bincount(part.ravel(), minlength=FEATURES) / max(1, part.size)
    out *= _SCALE
    return out


_SCALE = np.float32(16)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 25, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge loss, by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(x.shape[1] + 1, np.float64), np.zeros(len(x))
    size = np.einsum("ij,ij->i", x, x) + 1 + 0.5 / c
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / size[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[:-1] += d * x[i]
                w[-1] += d
                alpha[i] = new
    return w


_FIT = T.StructType([T.StructField("machine", T.IntegerType()), T.StructField("weights", T.BinaryType())])


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["side", "h", "text"])
    y = np.where(pdf["side"].to_numpy() > 0, 1.0, -1.0)
    return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "weights": [fit_svm(features(list(pdf["text"])), y).astype("<f4").tobytes()]})


class LanguageModel:
    """Languages by family and a linear machine for each pair of families and each pair of languages within a family."""

    def __init__(self, langs: list[str], machines: dict[tuple[str, str], np.ndarray]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.machines = machines

    @staticmethod
    def pairs(langs: list[str]) -> list[tuple[str, str]]:
        families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            families.setdefault(family_of(lang), []).append(lang)
        out = [(f"{FAMILY}{a}", f"{FAMILY}{b}") for a, b in combinations(sorted(families), 2)]
        return out + [p for own in families.values() for p in combinations(own, 2)]

    def _vote(self, names: list[str], prefix: str, margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each text among names and its mean chance; more pairs won, then the larger chance, then the first name."""
        won, chance = np.zeros((len(names), n)), np.zeros((len(names), n))
        for i, j in combinations(range(len(names)), 2):
            p = 1 / (1 + np.exp(np.clip(-2 * margins[f"{prefix}{names[i]}", f"{prefix}{names[j]}"], -50, 50)))
            won[i] += p >= 0.5
            won[j] += p < 0.5
            chance[i] += p
            chance[j] += 1 - p
        chance = chance / max(1, len(names) - 1) if len(names) > 1 else np.ones((len(names), n))
        best = np.argmax(won * 4 + chance, axis=0)
        return best, chance[best, np.arange(n)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score from 0 to 1) of each whole text; und and 0 for one without letters, or if no language is known."""
        grams, at, has = _grams(texts)
        names = sorted(self.families)
        if not names:
            return [("und", 0.0)] * len(texts)
        first, score = self._vote(names, FAMILY, self._margins(grams, at, [p for p in self.machines if p[0].startswith(FAMILY)]), len(texts))
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        # Only now the machines within a family, and only for the texts that it has won.
        for k, f in enumerate(names):
            won = np.flatnonzero((first == k) & has)
            if not len(won):
                continue
            own = np.concatenate([np.arange(at[i], at[i + 1]) for i in won])
            ends = np.r_[0, np.cumsum(at[won + 1] - at[won])]
            best, p = self._vote(self.families[f], "", self._margins(grams[:, own], ends, list(combinations(self.families[f], 2))), len(won))
            for i, j, q in zip(won, best, p, strict=True):
                out[i] = self.families[f][j], float(score[i] * q)
        return out

    def _margins(self, grams: np.ndarray, at: np.ndarray, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], np.ndarray]:
        """For each machine the margin of each text, whose n-grams begin at at."""
        counts, out = 2.0 * np.maximum(1, at[1:] - at[:-1] - 1), {}
        for pair in pairs:
            w = self.machines[pair]
            each = w[grams[0]] + w[grams[1]]
            each[at[1:] - 1] = 0
            out[pair] = np.add.reduceat(each, at[:-1], dtype=np.float64) / counts * _SCALE + w[-1]
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_side: int = PER_SIDE) -> LanguageModel:
    """Fit on a bounded sample: for each side of a machine per_side labelled documents at most, those with the smallest hashes.

    Rows with a null text or label, or a text without letters, teach nothing; repeated texts count once. Without labelled
    rows the model knows no language. Machines are fitted side by side, one group each; only their weights come to the driver.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    # In two steps, of which the first deals each language out; what is left for the second is bounded.
    deal, first = Window.partitionBy("lang", F.pmod("h", F.lit(_SALTS))).orderBy("h"), Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(deal)).where(F.col("k") <= per_side)
    chosen = chosen.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_side)
    langs = [r[0] for r in chosen.select("lang").distinct().collect()]
    pairs = LanguageModel.pairs(langs)
    if not pairs:
        return LanguageModel(langs, {})
    sides = []
    for k, pair in enumerate(pairs):
        for side, who in zip((1, -1), pair, strict=True):
            own = [x for x in langs if family_of(x) == who.removeprefix(FAMILY)] if who.startswith(FAMILY) else [who]
            sides += [(k, side, x, max(1, per_side // len(own))) for x in own]
    plan = labelled.sparkSession.createDataFrame(sides, "machine int, side int, lang string, most int")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # per_side rows a language
    fitted = sample.join(F.broadcast(plan), "lang").where("k <= most").select("machine", "side", "h", "text").groupBy("machine").applyInPandas(_fit_group, _FIT)
    return LanguageModel(langs, {pairs[r["machine"]]: np.frombuffer(r["weights"], "<f4") for r in fitted.collect()})


def predict(model: LanguageModel, text: Column | str) -> Column:
    """struct(lang_pred string, score double) of a text column; null counts as empty, so und."""
    shared = SparkContext._active_spark_context.broadcast(model)  # machines of at most FEATURES weights each

    @F.arrow_udf("lang_pred string, score double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = (t.as_py() for t in part)  # one at a time: a batch is never unpacked whole
            out = [x for some in batches(texts) for x in shared.value.predict(some)]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], ["lang_pred", "score"])

    return of(text)


def is_held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that aren't held out and predict all: doc_id, held_out, lang_pred, score.

    A null or empty text, or one without letters, is und with score 0; equal texts get equal results; an empty table gives
    none. Columns other than doc_id, text and lang have no influence.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()))
    out = docs.select("doc_id", is_held_out().alias("held_out"), predict(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told (not und), with their own columns."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()))
    name = free_name(docs, "p")
    return docs.withColumn(name, predict(model, F.col("text"))).where(F.col(f"{name}.lang_pred") != "und").select(*[docs[c] for c in docs.columns])
