"""Spectral indices of a pixel's bands. An index is null where a band is null or its denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import clip, ratio, sdiv


def ndvi(nir: Column, red: Column, clipped: bool = True) -> Column:
    return clip(ratio(nir, red), -1, 1) if clipped else ratio(nir, red)


def evi(nir: Column, red: Column, blue: Column, clipped: bool = True) -> Column:
    x = sdiv(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)
    return clip(x, 0, 1) if clipped else x


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return clip(sdiv((1 + soil) * (nir - red), nir + red + soil), -1, 1)


def ndwi(green: Column, nir: Column) -> Column:
    return clip(ratio(green, nir), -1, 1)


def cover_fraction(v: Column, bare: float = 0.0, full: float = 0.8) -> Column:
    """Fraction of ground under vegetation from NDVI."""
    return clip(F.pow((v - bare) / (full - bare), F.lit(2.0)), 0, 1)


def lai(v: Column) -> Column:
    """Leaf area index from NDVI, piecewise."""
    return clip(F.when(v < 0, 0.0).when(v < 0.2, 0.1).when(v > 0.8, 6.0).otherwise(0.57 * F.exp(2.33 * v)), 0, 6)


def ndmi(nir: Column, swir1: Column) -> Column:
    return ratio(nir, swir1)


def msi(nir: Column, swir1: Column) -> Column:
    return sdiv(swir1, nir)


def nmdi(nir: Column, swir1: Column, swir2: Column) -> Column:
    return ratio(nir, swir1 - swir2)


def mndwi(green: Column, swir1: Column) -> Column:
    return clip(ratio(green, swir1), -1, 1)


def nirv(v: Column, nir: Column) -> Column:
    return v * nir


def gci(nir: Column, green: Column) -> Column:
    return sdiv(nir, green) - 1


def ndsi(red: Column, nir: Column) -> Column:
    """Salinity index."""
    return ratio(red, nir)


def si_t(red: Column, swir1: Column) -> Column:
    return F.when(red * swir1 >= 0, F.sqrt(F.greatest(red * swir1, F.lit(0.0))))


def vswi(v: Column, lst: Column) -> Column:
    return sdiv(v, lst)


#: Indices by name, each from a mapping of band names to columns.
INDICES = {
    "ndvi": lambda b: ndvi(b["nir08"], b["red"]),
    "evi": lambda b: evi(b["nir08"], b["red"], b["blue"]),
    "savi": lambda b: savi(b["nir08"], b["red"]),
    "ndwi": lambda b: ndwi(b["green"], b["nir08"]),
    "ndmi": lambda b: ndmi(b["nir08"], b["swir16"]),
    "msi": lambda b: msi(b["nir08"], b["swir16"]),
    "nmdi": lambda b: nmdi(b["nir08"], b["swir16"], b["swir22"]),
    "mndwi": lambda b: mndwi(b["green"], b["swir16"]),
    "gci": lambda b: gci(b["nir08"], b["green"]),
    "ndsi": lambda b: ndsi(b["red"], b["nir08"]),
    "si_t": lambda b: si_t(b["red"], b["swir16"]),
}


def index(name: str, columns: list[str]) -> Column:
    """An index by name over a table that has these columns; an error names the unknown index or the missing band."""
    if name not in INDICES:
        raise ValueError(f"no index named {name}; known: {', '.join(sorted(INDICES))}")
    bands = _Bands(columns)
    return INDICES[name](bands).alias(name)


class _Bands(dict):
    def __init__(self, columns: list[str]):
        super().__init__({c: F.col(c) for c in columns})

    def __missing__(self, band: str) -> Column:
        raise ValueError(f"the index needs band {band}")
