"""Null-safe arithmetic and small vector and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def lit(x: Num | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(x: Column, lo: float | None, hi: float | None) -> Column:
    """x within [lo, hi]; null stays null (least and greatest alone would skip it)."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def sdiv(a: Num, b: Num) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(lit(a), lit(b))


def ratio(a: Column, b: Column) -> Column:
    """The normalised difference (a - b) / (a + b)."""
    return sdiv(a - b, a + b)


def bit(mask: Column, n: int) -> Column:
    """Bit n of an integer mask, as a boolean."""
    return F.shiftright(mask, n).bitwiseAND(F.lit(1)) == 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """a scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if one is zero."""
    return F.coalesce(sdiv(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def terms(text: Column) -> Column:
    """Lower-case runs of a-z, digits and the underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Of each term its runs of three characters; shorter terms whole."""
    return F.flatten(F.transform(terms(text), lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def approx_tokens(text: Column) -> Column:
    """One for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def words(text: Column) -> Column:
    """What stands between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
