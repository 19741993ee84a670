"""Radiation, energy balance and evapotranspiration of a pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import clip, sdiv

# Physical constants in SI units.
SIGMA = 5.670374419e-8
KARMAN = 0.41
CP = 1013.0
GRAVITY = 9.81
LATENT = 2.45e6
GAS = 287.058


def net_shortwave(albedo: Column, down: Column) -> Column:
    return (1 - albedo) * down


def direct_diffuse(down: Column, sun_elevation_deg: Column, tau: float) -> tuple[Column, Column]:
    """The direct and the diffuse part of incoming shortwave radiation."""
    mu = F.greatest(F.sin(F.radians(sun_elevation_deg)), F.lit(0.05))
    f = clip(F.pow(F.lit(tau), 1 / mu), 0, 1)
    return f * down, (1 - f) * down


def vapour_pressure(dewpoint_c: Column) -> Column:
    """kPa."""
    return 0.6108 * F.exp(17.27 * dewpoint_c / (dewpoint_c + 237.3))


def sky_emissivity(ea: Column, cloud: Column | None = None) -> Column:
    """Brunt: the simplified form, or with a cloud cover the full one."""
    root = F.sqrt(ea)
    return clip(0.70 + 0.005 * root, 0, 1) if cloud is None else clip(0.23 + 0.433 * root * (1 - 0.14 * cloud) - 0.1, 0, 1)


def longwave(e: Column, t: Column) -> Column:
    return e * SIGMA * F.pow(t, F.lit(4.0))


def net_radiation(albedo: Column, down: Column, up_long: Column, down_long: Column, documented: bool = True) -> Column:
    """Net shortwave plus net longwave (in less out). documented=False gives the sign that another form of it has: shortwave less (in less out)."""
    short, net_long = net_shortwave(albedo, down), down_long - up_long
    return short + net_long if documented else short - net_long


def soil_ratio(v: Column, method: str = "document", ts: Column | None = None, ta: Column | None = None, albedo: Column | None = None) -> Column:
    """G / Rn, 0.01 to 0.4. Methods: bastiaanssen, allen, moran, simple, document, automatic; without what it needs a method falls back to bastiaanssen."""
    if method == "automatic":
        method = "document" if albedo is not None and ts is not None else "moran" if ta is not None and ts is not None else "bastiaanssen"
    if method == "document" and ts is None:
        raise ValueError("the document method needs the surface temperature")
    if method == "allen":
        x = F.when(v > 0.2, 0.95 - 0.19 * v).otherwise(0.5 * (1 - v))
    elif method == "simple":
        x = (1.05 - v * 0.9) * 0.1
    elif method == "moran" and ts is not None and ta is not None:
        x = 0.4 * (ts - ta) - 0.5 * v
    elif method == "document" and albedo is not None:
        x = (ts - 273.15) * (0.0038 + 0.0074 * albedo * (1 - 0.98 * F.pow(v, F.lit(4.0))))
    elif method in ("bastiaanssen", "moran", "document"):
        x = F.when(v > 0.2, 0.05 + 0.25 * v).otherwise(0.31 * (1 - v))
    else:
        raise ValueError(f"no method named {method}")
    return F.when(v.isNotNull(), clip(x, 0.01, 0.4))


def soil_flux(rn: Column, g_ratio: Column) -> Column:
    g = rn * g_ratio
    return F.when(g.isNotNull(), F.greatest(F.when(rn < 0, F.least(g, rn * 0.5)).otherwise(g), F.lit(0.0)))


def air_density(ta: Column, pressure: Column) -> Column:
    return clip(pressure / (GAS * F.greatest(ta, F.lit(100.0))), 0.5, 2)


def flux_displacement(z0m: Column, leaf: Column | None) -> Column:
    d = 0.67 * z0m * F.sqrt(F.greatest(leaf, F.lit(0.0))) if leaf is not None else 2.0 / 3.0 * z0m * 100
    return F.least(F.greatest(d, F.lit(0.0)), F.greatest(z0m * 10, F.lit(0.1)))


def resistance(z0m: Column, d: Column, u: Column, psi_m: Column | float = 0.0, psi_h: Column | float = 0.0, z_wind: float = 10.0, z_temp: float = 2.0) -> Column:
    """Aerodynamic resistance in s/m, 10 to 500; neutral without stability terms."""
    zm, zh = F.greatest(z0m, F.lit(0.0001)), F.greatest(z0m * 0.1, F.lit(0.00001))
    safe = F.least(d, z_wind - zm - 0.1)
    a = F.ln(F.greatest((z_wind - safe) / zm, F.lit(1.001))) - psi_m
    b = F.ln(F.greatest((z_temp - safe) / zh, F.lit(1.001))) - psi_h
    return clip(a * b / (KARMAN**2 * F.greatest(u, F.lit(0.1))), 10, 500)


def stability(h: Column, rah: Column, ta: Column, z: float = 2.0) -> Column:
    return GRAVITY * z * h / (ta * CP * F.greatest(rah, F.lit(1.0))) * 10


def psi(z_l: Column, z: float = 2.0) -> tuple[Column, Column]:
    """Stability corrections of momentum and heat: -5 z/L where stable; where unstable from 1 - 16 |z/L| / z, 0 at least."""
    arg = F.greatest(F.lit(0.0), 1 - 16 * F.abs(z_l) / z)
    x, y = F.least(F.pow(arg, F.lit(0.25)), F.lit(10.0)), F.least(F.sqrt(arg), F.lit(10.0))
    m = 2 * F.ln((1 + x) / 2) + F.ln((1 + x * x) / 2) - 2 * F.atan(x) + math.pi / 2
    h = 2 * F.ln((1 + y) / 2) + F.ln((1 + y * y) / 2)
    return (F.when(z_l < 0, m).when(z_l > 0, -5 * z_l).otherwise(0.0), F.when(z_l < 0, h).when(z_l > 0, -5 * z_l).otherwise(0.0))


def sensible_limits(h: Column, rn: Column) -> Column:
    """-500 to 3000 W/m2, and 0.95 of what 0.95 Rn leaves at most."""
    return F.when(h.isNotNull() & rn.isNotNull(), F.least(clip(h, -500, 3000), F.greatest(rn - rn * 0.05, F.lit(1.0)) * 0.95))


def evaporative_fraction(le: Column, available: Column, least: float = 10.0) -> Column:
    """LE / available energy, 0 to 2; an available energy nearer to 0 than the least counts as that, with its sign."""
    safe = F.when(F.abs(available) < least, F.signum(available) * least).otherwise(available)
    return clip(sdiv(le, safe), 0, 2)


def latent_heat(t_kelvin: Column) -> Column:
    return 2.501e6 - 2361.0 * (t_kelvin - 273.15)


def et_rate(le: Column, heat: Column | float = LATENT) -> Column:
    """mm an hour."""
    return clip(le * 3600 / heat, 0, 2.5)


def et_fraction(et: Column, reference: Column, most: float | None = None) -> Column:
    """et / reference, 0 where the reference is 0.01 or less; 0 at least."""
    return clip(F.when(reference > 0.01, sdiv(et, reference)).otherwise(F.lit(0.0)), 0, most)


def et_daily(fraction: Column, reference: Column) -> Column:
    return clip(fraction * reference, 0, 30)


def et_quality(etrf: Column, daily: Column) -> Column:
    """4 excellent, 3 good, 2 acceptable, 1 poor, 0 uncertain."""
    excellent = etrf.between(0.8, 1.2) & daily.between(0.1, 10)
    good = etrf.between(0.6, 2.0) & daily.between(0.05, 12)
    return F.when(excellent, 4).when(good, 3).when(etrf.between(0.3, 1.4), 2).when((etrf >= 0) & (etrf < 0.3), 1).otherwise(0)


def greenhouse(up_long: Column, e: Column) -> Column:
    """What a black body of the surface's temperature would emit beyond it."""
    return up_long / e - up_long


def dt_linear(ts: Column, ta: Column, a: float, b: float) -> Column:
    return a * (ts - ta) + b


def dt_empirical(ts: Column, ta: Column, v: Column) -> Column:
    """Temperature difference less 2 K at full NDVI."""
    return ts - ta - 2.0 * v


def stress_indicator(le: Column, available: Column, ts: Column) -> Column:
    """Heat (from 290 K on, over 30 K) times what the evaporative fraction leaves of 1."""
    safe = F.when(F.abs(available) < 10, F.signum(available) * 10).otherwise(available)
    return clip((ts - 290.0) / 30.0, 0, 1) * (1 - clip(sdiv(le, safe), 0, 1))


def anchor_confidence(valid: Column, shaped: Column, t_diff: Column, t_std: Column, relaxation: Column, candidates: Column) -> Column:
    """0 to 1: 0.5, and 0.15 and 0.1 for passed checks; scaled by temperature difference (20 K) and spread (8 K), relaxation and candidates (50)."""
    base = 0.5 + F.when(valid, 0.15).otherwise(0.0) + F.when(shaped, 0.10).otherwise(0.0)
    part = lambda x, lo: F.least(F.lit(1.0), F.greatest(F.lit(lo), x))
    return clip(base * part(t_diff / 20, 0.5) * part(t_std / 8, 0.5) * F.exp(-2 * relaxation) * (0.8 + 0.2 * part(candidates / 50, 0.7)), 0, 1)
