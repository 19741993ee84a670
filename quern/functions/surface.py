"""Surface properties of a pixel: QA masks, albedo, emissivity, temperature, roughness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import bit, clip

# Broadband albedo coefficients (blue, red, near infrared, two shortwave infrared bands, intercept).
ALBEDO = {1: (0.356, 0.130, 0.373, 0.085, 0.072, -0.0018), 2: (0.254, 0.149, 0.295, 0.243, 0.091, 0.066)}
# Thermal wavelength in metres, and Planck's constant times the speed of light by Boltzmann's constant.
WAVELENGTH, RHO = 10.895e-6, 1.438e-2


# Confidence of a cloud in bits 8 and 9.
LOW, MEDIUM, HIGH = 0, 1, 2


def is_cloud(qa: Column, threshold: int = MEDIUM) -> Column:
    """Bit 3 with a confidence of the threshold at least (HIGH: just that), or the dilated-cloud bit 1; beyond HIGH bit 3 alone."""
    if threshold not in (LOW, MEDIUM, HIGH):
        return bit(qa, 3)
    sure = F.shiftright(qa, 8).bitwiseAND(F.lit(3))
    return ((sure == HIGH if threshold == HIGH else sure >= threshold) & bit(qa, 3)) | bit(qa, 1)


def is_clear(qa: Column, threshold: int = MEDIUM, include_snow: bool = False, include_water: bool = True) -> Column:
    """No cloud, no shadow (bit 4), no snow (bit 5) unless included; water (bit 7) is clear whatever else, if included, and else isn't."""
    ok = ~is_cloud(qa, threshold) & ~bit(qa, 4)
    if not include_snow:
        ok = ok & ~bit(qa, 5)
    return (ok | bit(qa, 7)) if include_water else (ok & ~bit(qa, 7))


def is_valid(qa: Column) -> Column:
    """The mask of surface terms: none of bits 1, 2 and 3."""
    return ~(bit(qa, 1) | bit(qa, 2) | bit(qa, 3))


def albedo(blue: Column, red: Column, nir: Column, swir1: Column, swir2: Column, collection: int = 2) -> Column:
    c = ALBEDO[collection]
    return clip(blue * c[0] + red * c[1] + nir * c[2] + swir1 * c[3] + swir2 * c[4] + c[5], 0, 0.5)


def directional_albedo(a: Column, sun_elevation_deg: Column) -> Column:
    """Black-sky albedo at a sun elevation."""
    return clip(a * (1 + 0.1 * (1 - F.greatest(F.sin(F.radians(sun_elevation_deg)), F.lit(0.1)))), 0, 0.5)


def hemispherical_albedo(a: Column, mean_zenith: float = 0.5) -> Column:
    """White-sky albedo at a mean sun zenith in radians."""
    return clip(a * (1 + 0.05 * (1 - math.cos(mean_zenith))), 0, 0.5)


def by_cover(cover: Column, table: dict[str, float]) -> Column:
    """A table's value for a class of land cover; its default for others and null."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), cover), F.lit(table["default"]))


# Emissivities by land cover.
EMISSIVITY = {"water": 0.985, "bare_soil": 0.960, "sand": 0.955, "grass": 0.970, "forest": 0.985, "urban": 0.920, "crops": 0.970, "snow": 0.990, "default": 0.960}
# Roughness lengths in metres by land cover.
ROUGHNESS = {"water": 0.001, "bare_soil": 0.01, "sand": 0.005, "grass": 0.03, "shrub": 0.1, "forest": 1.0, "urban": 0.5, "crops": 0.1, "snow": 0.001, "default": 0.01}


def broadband_emissivity(thermal: Column, hottest: Column) -> Column:
    """From a thermal band and its largest value in the scene."""
    return clip(F.when(thermal > 0, 0.95 + 0.004 * (thermal / hottest)).otherwise(0.96), 0.9, 1)


def emissivity(v: Column) -> Column:
    """From NDVI, piecewise."""
    return clip(F.when(v < 0, 0.985).when(v < 0.2, 0.96 + 0.025 * v).when(v > 0.5, 0.98).otherwise(0.96 + 0.018 * v), 0.9, 1)


def emissivity_pv(v: Column, bare: float = 0.0, full: float = 0.8) -> Column:
    """From the share of vegetation."""
    return clip(0.973 + 0.047 * F.ln(clip(F.pow((v - bare) / (full - bare), F.lit(2.0)), 0.001, 1)), 0.9, 1)


def lst(tb: Column, e: Column) -> Column:
    """Surface temperature from brightness temperature and emissivity; null outside 200 to 400 K or 0.8 to 1."""
    t = tb / (1 + (tb * WAVELENGTH / RHO) * F.ln(e))
    return F.when(tb.between(200, 400) & e.between(0.8, 1), clip(t, 250, 350))


def roughness_ndvi(v: Column, lo: float = 0.01, hi: float = 2.0) -> Column:
    z = 0.005 + 0.5 * v
    return clip(F.when(z < 0.001, F.lit(lo)).otherwise(z), lo, hi)


def roughness_lai(leaf: Column, lo: float = 0.01, hi: float = 2.0) -> Column:
    return clip(F.when(leaf < 1, 0.01).otherwise(0.1 * (1 - F.exp(-0.4 * leaf))), lo, hi)


def displacement(leaf: Column, z0m: Column) -> Column:
    return clip(0.66 * leaf * z0m, 0, 10)


LOG_RATIO = math.log(10.0)
