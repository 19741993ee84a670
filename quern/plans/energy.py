"""Per-pixel queries: indices, masks, surface, radiation, energy balance, evapotranspiration and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import energy as E
from quern.functions import spectral as S
from quern.functions import surface as G
from quern.operators import raster
from quern.operators.quantiles import quantiles
from quern.registry import query

from .tables import PIXELS, pixels

KEY = ["scene_id", "y", "x"]


def _c(x: str, lo: float | None, hi: float | None) -> str:
    """SQL of a clip that keeps null."""
    inner = x if lo is None else f"greatest({x}, {lo}.0)" if isinstance(lo, int) else f"greatest({x}, {lo})"
    inner = inner if hi is None else f"least({inner}, {hi}.0)" if isinstance(hi, int) else f"least({inner}, {hi})"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {inner} END"


def _nd(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / nullif(({a}) + ({b}), 0)"


def _bit(n: int) -> str:
    return f"((qa_pixel >> {n}) & 1) = 1"


_CLEAR = f"((NOT ((((qa_pixel >> 8) & 3) >= 1 AND {_bit(3)}) OR {_bit(1)})) AND NOT {_bit(4)} AND NOT {_bit(5)}) OR {_bit(7)}"


def surface(px: DataFrame) -> DataFrame:
    """pixels with indices, surface terms and the scalars of their scene."""
    k = F.col("scene_id").cast("int")
    px = px.withColumns({"ta": 290.0 + k * 2, "u": 2.0 + k * 0.5, "pressure": 101325.0 - k * 500, "rs": 800.0 - k * 50, "ea": 1.2 + k * 0.1, "et0": 5.0 + k})
    px = px.withColumn("ndvi", S.ndvi(F.col("nir08"), F.col("red")))
    px = px.withColumns({"lai": S.lai(F.col("ndvi")), "albedo": G.albedo(F.col("blue"), F.col("red"), F.col("nir08"), F.col("swir16"), F.col("swir22")), "emissivity": G.emissivity(F.col("ndvi"))})
    return px.withColumns({"lst": G.lst(F.col("lwir11"), F.col("emissivity")), "z0m": G.roughness_ndvi(F.col("ndvi"))})


def balance(px: DataFrame) -> DataFrame:
    """surface() with radiation, fluxes and evapotranspiration."""
    d = surface(px)
    d = d.withColumns({"up": E.longwave(F.col("emissivity"), F.col("lwir11")), "down": E.longwave(E.sky_emissivity(F.col("ea")), F.col("ta"))})
    d = d.withColumn("rn", E.net_radiation(F.col("albedo"), F.col("rs"), F.col("up"), F.col("down")))
    d = d.withColumn("g", E.soil_flux(F.col("rn"), E.soil_ratio(F.col("ndvi"), "document", F.col("lwir11"), albedo=F.col("albedo"))))
    d = d.withColumns({"rho": E.air_density(F.col("ta"), F.col("pressure")), "fd": E.flux_displacement(F.col("z0m"), F.col("lai")), "dt": F.col("lwir11") - F.col("ta")})
    d = d.withColumn("rah", E.resistance(F.col("z0m"), F.col("fd"), F.col("u")))
    d = d.withColumn("h", E.sensible_limits(F.col("rho") * E.CP * F.col("dt") / F.col("rah"), F.col("rn")))
    d = d.withColumn("le", F.greatest(F.col("rn") - F.col("g") - F.col("h"), F.lit(0.0)))
    d = d.withColumns({"ef": E.evaporative_fraction(F.col("le"), F.col("rn") - F.col("g")), "et_inst": E.et_rate(F.col("le"))})
    d = d.withColumn("etrf", E.et_fraction(F.col("et_inst"), F.col("et0") * 1.15 / 10, 2.0))
    d = d.withColumn("et_daily", E.et_daily(F.col("etrf"), F.col("et0")))
    return d.withColumn("quality", E.et_quality(F.col("etrf"), F.col("et_daily")))


_SURFACE = f"""{PIXELS}, s0 AS (SELECT *, CAST(scene_id AS INTEGER) AS k FROM px), s1 AS (SELECT *, 290.0 + k * 2 AS ta, 2.0 + k * 0.5 AS u, 101325.0 - k * 500 AS pressure, 800.0 - k * 50 AS rs, 1.2 + k * 0.1 AS ea, 5.0 + k AS et0, {_c(_nd("nir08", "red"), -1, 1)} AS ndvi FROM s0),
  s2 AS (SELECT *, {_c("CASE WHEN ndvi < 0 THEN 0.0 WHEN ndvi < 0.2 THEN 0.1 WHEN ndvi > 0.8 THEN 6.0 ELSE 0.57 * exp(2.33 * ndvi) END", 0, 6)} AS lai, {_c("blue * 0.254 + red * 0.149 + nir08 * 0.295 + swir16 * 0.243 + swir22 * 0.091 + 0.066", 0, 0.5)} AS albedo,
         {_c("CASE WHEN ndvi < 0 THEN 0.985 WHEN ndvi < 0.2 THEN 0.96 + 0.025 * ndvi WHEN ndvi > 0.5 THEN 0.98 ELSE 0.96 + 0.018 * ndvi END", 0.9, 1)} AS emissivity FROM s1),
  sf AS (SELECT *, CASE WHEN lwir11 BETWEEN 200 AND 400 AND emissivity BETWEEN 0.8 AND 1 THEN {_c("lwir11 / (1 + (lwir11 * 10.895e-6 / 1.438e-2) * ln(emissivity))", 250, 350)} END AS lst, {_c("CASE WHEN 0.005 + 0.5 * ndvi < 0.001 THEN 0.01 ELSE 0.005 + 0.5 * ndvi END", 0.01, 2)} AS z0m FROM s2)"""

_RAH = "ln(greatest((10 - least(fd, 10 - greatest(z0m, 0.0001) - 0.1)) / greatest(z0m, 0.0001), 1.001)) * ln(greatest((2 - least(fd, 10 - greatest(z0m, 0.0001) - 0.1)) / greatest(z0m * 0.1, 0.00001), 1.001)) / (0.41 * 0.41 * greatest(u, 0.1))"
_BALANCE = f"""{_SURFACE}, b1 AS (SELECT *, emissivity * 5.670374419e-8 * pow(lwir11, 4) AS up, {_c("0.70 + 0.005 * sqrt(ea)", 0, 1)} * 5.670374419e-8 * pow(ta, 4) AS down FROM sf),
  b2 AS (SELECT *, (1 - albedo) * rs + down - up AS rn, {_c("(lwir11 - 273.15) * (0.0038 + 0.0074 * albedo * (1 - 0.98 * pow(ndvi, 4)))", 0.01, 0.4)} AS gr, {_c("pressure / (287.058 * greatest(ta, 100))", 0.5, 2)} AS rho,
         least(greatest(0.67 * z0m * sqrt(greatest(lai, 0)), 0), greatest(z0m * 10, 0.1)) AS fd, lwir11 - ta AS dt FROM b1),
  b3 AS (SELECT *, CASE WHEN rn * gr IS NOT NULL THEN greatest(CASE WHEN rn < 0 THEN least(rn * gr, rn * 0.5) ELSE rn * gr END, 0) END AS g, {_c(_RAH, 10, 500)} AS rah FROM b2),
  b4 AS (SELECT *, least({_c("rho * 1013.0 * dt / rah", -500, 3000)}, greatest(rn - rn * 0.05, 1) * 0.95) AS h FROM b3),
  b5 AS (SELECT *, greatest(rn - g - h, 0) AS le FROM b4),
  b6 AS (SELECT *, {_c("le / nullif(CASE WHEN abs(rn - g) < 10 THEN sign(rn - g) * 10 ELSE rn - g END, 0)", 0, 2)} AS ef, {_c("le * 3600 / 2.45e6", 0, 2.5)} AS et_inst FROM b5),
  b7 AS (SELECT *, {_c("CASE WHEN et0 * 1.15 / 10 > 0.01 THEN et_inst / (et0 * 1.15 / 10) ELSE 0 END", 0, 2)} AS etrf FROM b6), b8 AS (SELECT *, {_c("etrf * et0", 0, 30)} AS et_daily FROM b7),
  bal AS (SELECT *, CASE WHEN etrf BETWEEN 0.8 AND 1.2 AND et_daily BETWEEN 0.1 AND 10 THEN 4 WHEN etrf BETWEEN 0.6 AND 2 AND et_daily BETWEEN 0.05 AND 12 THEN 3 WHEN etrf BETWEEN 0.3 AND 1.4 THEN 2 WHEN etrf >= 0 AND etrf < 0.3 THEN 1 ELSE 0 END AS quality FROM b8)"""


def half_up(c: Column, digits: int) -> Column:
    """Rounded by plain arithmetic: engines disagree on ties where they round by decimal text."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def _half_up(c: str, digits: int) -> str:
    return f"floor(({c}) * 1e{digits} + 0.5) / 1e{digits}"


def _rounded(df: DataFrame, names: list[str], keys: list[str] = KEY, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[half_up(F.col(c), digits).alias(c) for c in names])


def _sql(names: list[str], source: str, keys: list[str] = KEY, digits: int = 6) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'{_half_up(c, digits)} AS {c}' for c in names)} FROM {source}"


_INDICES = ["ndvi", "evi", "savi", "ndwi"]


@query(
    "spectral_indices",
    f"WITH {PIXELS}, i AS (SELECT *, {_c(_nd('nir08', 'red'), -1, 1)} AS ndvi, {_c('2.5 * (nir08 - red) / nullif(nir08 + 6 * red - 7.5 * blue + 1, 0)', 0, 1)} AS evi, {_c('1.5 * (nir08 - red) / nullif(nir08 + red + 0.5, 0)', -1, 1)} AS savi, {_c(_nd('green', 'nir08'), -1, 1)} AS ndwi FROM px) {_sql(_INDICES, 'i')}",
)
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return _rounded(px.select(*KEY, *[S.index(n, px.columns) for n in _INDICES]), _INDICES)


_MOIST = ["ndmi", "msi", "nmdi", "mndwi"]


@query("moisture_indices", f"WITH {PIXELS}, i AS (SELECT *, {_nd('nir08', 'swir16')} AS ndmi, swir16 / nullif(nir08, 0) AS msi, {_nd('nir08', 'swir16 - swir22')} AS nmdi, {_c(_nd('green', 'swir16'), -1, 1)} AS mndwi FROM px) {_sql(_MOIST, 'i')}")
def moisture_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return _rounded(px.select(*KEY, *[S.index(n, px.columns) for n in _MOIST]), _MOIST)


_PROD = ["nirv", "gci", "ndsi", "si_t", "vswi"]


@query("productivity_salinity", f"WITH {_SURFACE}, i AS (SELECT *, ndvi * nir08 AS nirv, nir08 / nullif(green, 0) - 1 AS gci, {_nd('red', 'nir08')} AS ndsi, sqrt(red * swir16) AS si_t, ndvi / nullif(lst, 0) AS vswi FROM sf) {_sql(_PROD, 'i')}")
def productivity_salinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface(pixels(spark, sf_dir))
    own = d.select(*KEY, S.nirv(F.col("ndvi"), F.col("nir08")).alias("nirv"), S.index("gci", d.columns), S.index("ndsi", d.columns), S.index("si_t", d.columns), S.vswi(F.col("ndvi"), F.col("lst")).alias("vswi"))
    return _rounded(own, _PROD)


@query("lai_fvc", f"WITH {_SURFACE}, i AS (SELECT *, {_c('pow(ndvi / 0.8, 2)', 0, 1)} AS fvc FROM sf) {_sql(['lai', 'fvc'], 'i')}")
def lai_fvc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface(pixels(spark, sf_dir))
    return _rounded(d.select(*KEY, "lai", S.cover_fraction(F.col("ndvi")).alias("fvc")), ["lai", "fvc"])


@query("qa_cloud_mask", f"WITH {PIXELS} SELECT scene_id, y, x, {_CLEAR} AS clear, NOT ({_bit(1)} OR {_bit(2)} OR {_bit(3)}) AS valid FROM px")
def qa_cloud_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select(*KEY, G.is_clear(F.col("qa_pixel")).alias("clear"), G.is_valid(F.col("qa_pixel")).alias("valid"))


@query("cloud_coverage", f"WITH {PIXELS} SELECT scene_id, count(*) AS n, round(100.0 * count(*) FILTER (WHERE NOT ({_CLEAR})) / count(*), 9) AS cloud_percent FROM px GROUP BY scene_id")
def cloud_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    clear = G.is_clear(F.col("qa_pixel"))
    return pixels(spark, sf_dir).groupBy("scene_id").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(~clear) / F.count("*"), 9).alias("cloud_percent"))


@query("shadow_threshold", f"WITH {PIXELS}, t AS (SELECT scene_id, avg(nir08) - 0.5 * stddev_pop(nir08) AS t FROM px GROUP BY scene_id) SELECT scene_id, count(*) FILTER (WHERE round(nir08, 9) < round(t, 9)) AS dark, count(*) FILTER (WHERE round(nir08, 9) < round(t, 9) AND ({_CLEAR})) AS shadow FROM px JOIN t USING (scene_id) GROUP BY scene_id")
def shadow_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = raster.shadow(pixels(spark, sf_dir), "nir08", sigmas=0.5)
    return px.groupBy("scene_id").agg(F.count_if("dark").alias("dark"), F.count_if(F.col("dark") & G.is_clear(F.col("qa_pixel"))).alias("shadow"))


@query("albedo", f"WITH {_SURFACE} SELECT scene_id, y, x, {_half_up('albedo', 8)} AS albedo, {_half_up(_c('albedo * (1 + 0.1 * (1 - sin(radians(50.0))))', 0, 0.5), 8)} AS directional FROM sf")
def albedo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface(pixels(spark, sf_dir))
    return d.select(*KEY, half_up(F.col("albedo"), 8).alias("albedo"), half_up(G.directional_albedo(F.col("albedo"), F.lit(50.0)), 8).alias("directional"))


@query("emissivity", f"WITH {_SURFACE} SELECT scene_id, y, x, round(emissivity, 9) AS emissivity, round({_c('0.973 + 0.047 * ln(' + _c('pow(ndvi / 0.8, 2)', 0.001, 1) + ')', 0.9, 1)}, 9) AS by_cover FROM sf")
def emissivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface(pixels(spark, sf_dir))
    return d.select(*KEY, F.round("emissivity", 9).alias("emissivity"), F.round(G.emissivity_pv(F.col("ndvi")), 9).alias("by_cover"))


@query("lst", f"WITH {_SURFACE} {_sql(['lst'], 'sf')}")
def lst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(surface(pixels(spark, sf_dir)), ["lst"])


@query("roughness", f"WITH {_SURFACE}, i AS (SELECT *, {_c('0.66 * lai * z0m', 0, 10)} AS d, {_c('CASE WHEN lai < 1 THEN 0.01 ELSE 0.1 * (1 - exp(-0.4 * lai)) END', 0.01, 2)} AS by_lai FROM sf) {_sql(['z0m', 'd', 'by_lai'], 'i')}")
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface(pixels(spark, sf_dir))
    return _rounded(d.select(*KEY, "z0m", G.displacement(F.col("lai"), F.col("z0m")).alias("d"), G.roughness_lai(F.col("lai")).alias("by_lai")), ["z0m", "d", "by_lai"])


@query("net_radiation", f"WITH {_BALANCE}, i AS (SELECT *, (1 - albedo) * rs - (down - up) AS rn_other FROM bal) {_sql(['up', 'down', 'rn', 'rn_other'], 'i')}")
def net_radiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    other = E.net_radiation(F.col("albedo"), F.col("rs"), F.col("up"), F.col("down"), documented=False)
    return _rounded(d.withColumn("rn_other", other), ["up", "down", "rn", "rn_other"])


@query("shortwave_split", f"WITH {_SURFACE}, f AS (SELECT *, {_c('pow(0.7, 1 / greatest(sin(radians(35.0 + k)), 0.05))', 0, 1)} AS f FROM sf) SELECT scene_id, y, x, {_half_up('(1 - albedo) * rs', 6)} AS net, {_half_up('albedo * rs', 6)} AS reflected, {_half_up('f * rs', 6)} AS direct, {_half_up('(1 - f) * rs', 6)} AS diffuse FROM f")
def shortwave_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = surface(pixels(spark, sf_dir))
    a, b = E.direct_diffuse(F.col("rs"), F.lit(35.0) + F.col("scene_id").cast("int"), 0.7)
    own = d.select(*KEY, E.net_shortwave(F.col("albedo"), F.col("rs")).alias("net"), (F.col("albedo") * F.col("rs")).alias("reflected"), a.alias("direct"), b.alias("diffuse"))
    return _rounded(own, ["net", "reflected", "direct", "diffuse"])


_METHODS = ["bastiaanssen", "allen", "moran", "simple", "document", "automatic"]


@query(
    "soil_heat_flux",
    f"""WITH {_BALANCE}, i AS (SELECT *, {_c("CASE WHEN ndvi > 0.2 THEN 0.05 + 0.25 * ndvi ELSE 0.31 * (1 - ndvi) END", 0.01, 0.4)} AS bastiaanssen, {_c("CASE WHEN ndvi > 0.2 THEN 0.95 - 0.19 * ndvi ELSE 0.5 * (1 - ndvi) END", 0.01, 0.4)} AS allen, {_c("0.4 * (lwir11 - ta) - 0.5 * ndvi", 0.01, 0.4)} AS moran,
    {_c("(1.05 - ndvi * 0.9) * 0.1", 0.01, 0.4)} AS simple, gr AS document, gr AS automatic FROM bal) {_sql([*_METHODS, 'g'], 'i')}""",
)
def soil_heat_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    return _rounded(d.withColumns({m: E.soil_ratio(F.col("ndvi"), m, F.col("lwir11"), F.col("ta"), F.col("albedo")) for m in _METHODS}), [*_METHODS, "g"])


@query("rah_neutral", f"WITH {_BALANCE} {_sql(['rho', 'fd', 'rah'], 'bal')}")
def rah_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(balance(pixels(spark, sf_dir)), ["rho", "fd", "rah"])


def _iterated() -> str:
    zm, zh = "greatest(z0m, 0.0001)", "greatest(z0m * 0.1, 0.00001)"
    safe = f"least(fd, 10 - {zm} - 0.1)"
    out, t, r = [], "it0", "rah"
    for n in range(1, 6):
        out.append(f"zl{n} AS (SELECT *, 9.81 * 2 * h0 / (ta * 1013.0 * greatest({r}, 1)) * 10 AS z{n} FROM {t})")
        out.append(f"ar{n} AS (SELECT *, greatest(0, 1 - 16 * abs(z{n}) / 2) AS a{n} FROM zl{n})")
        x, y = f"least(pow(a{n}, 0.25), 10)", f"least(sqrt(a{n}), 10)"
        m = f"CASE WHEN z{n} < 0 THEN 2 * ln((1 + {x}) / 2) + ln((1 + {x} * {x}) / 2) - 2 * atan({x}) + pi() / 2 WHEN z{n} > 0 THEN -5 * z{n} ELSE 0 END"
        h = f"CASE WHEN z{n} < 0 THEN 2 * ln((1 + {y}) / 2) + ln((1 + {y} * {y}) / 2) WHEN z{n} > 0 THEN -5 * z{n} ELSE 0 END"
        new = f"(ln(greatest((10 - {safe}) / {zm}, 1.001)) - ({m})) * (ln(greatest((2 - {safe}) / {zh}, 1.001)) - ({h})) / (0.41 * 0.41 * greatest(u, 0.1))"
        out.append(f"it{n} AS (SELECT *, {_c(new, 10, 500)} AS r{n} FROM ar{n})")
        t, r = f"it{n}", f"r{n}"
    return ", ".join(out)


@query("rah_iterative", f"WITH {_BALANCE}, it0 AS (SELECT *, rho * 1013.0 * dt / rah AS h0 FROM bal), {_iterated()} SELECT scene_id, y, x, round(r5, 5) AS rah, round(least({_c('rho * 1013.0 * dt / r5', -500, 3000)}, greatest(rn - rn * 0.05, 1) * 0.95), 5) AS h FROM it5")
def rah_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.stable_resistance(balance(pixels(spark, sf_dir)))
    h = E.sensible_limits(F.col("rho") * E.CP * F.col("dt") / F.col("rah"), F.col("rn"))
    return d.select(*KEY, F.round("rah", 5).alias("rah"), F.round(h, 5).alias("h"))


@query("sensible_heat", f"WITH {_BALANCE} SELECT scene_id, y, x, round(h, 6) AS h, round(least({_c('20 * dt', -500, 3000)}, greatest(rn - rn * 0.05, 1) * 0.95), 6) AS h_calibrated FROM bal")
def sensible_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    return d.select(*KEY, F.round("h", 6).alias("h"), F.round(E.sensible_limits(20 * F.col("dt"), F.col("rn")), 6).alias("h_calibrated"))


@query("latent_heat_ef", f"WITH {_BALANCE} {_sql(['le', 'ef'], 'bal')}")
def latent_heat_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(balance(pixels(spark, sf_dir)), ["le", "ef"])


@query("et_inst_daily", f"WITH {_BALANCE}, i AS (SELECT *, {_c('le * 3600 / (2.501e6 - 2361.0 * (ta - 273.15))', 0, 2.5)} AS et_warm FROM bal) {_sql(['et_inst', 'et_warm', 'etrf', 'et_daily'], 'i')}")
def et_inst_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    return _rounded(d.withColumn("et_warm", E.et_rate(F.col("le"), E.latent_heat(F.col("ta")))), ["et_inst", "et_warm", "etrf", "et_daily"])


@query("et_quality_class", f"WITH {_BALANCE} SELECT scene_id, quality, count(*) AS n, round(avg(et_daily), 6) AS mean_et FROM bal GROUP BY scene_id, quality")
def et_quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(pixels(spark, sf_dir)).groupBy("scene_id", "quality").agg(F.count("*").alias("n"), F.round(F.avg("et_daily"), 6).alias("mean_et"))


@query("eta_class", f"WITH {_BALANCE} SELECT scene_id, y, x, CASE WHEN et_daily IS NULL THEN NULL WHEN et_daily <= 0 THEN 0 WHEN et_daily <= 3 THEN 1 WHEN et_daily <= 6 THEN 2 WHEN et_daily <= 9 THEN 3 WHEN et_daily <= 12 THEN 4 WHEN et_daily <= 15 THEN 5 WHEN et_daily <= 20 THEN 6 ELSE 7 END AS class, round(1 - et_daily / et0, 6) AS cwsi FROM bal")
def eta_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    return d.select(*KEY, raster.classify(F.col("et_daily"), [0, 3, 6, 9, 12, 15, 20]).alias("class"), F.round(1 - F.col("et_daily") / F.col("et0"), 6).alias("cwsi"))


@query("energy_closure", f"WITH {_BALANCE}, c AS (SELECT scene_id, (g + h + le) / nullif(rn, 0) AS closure, abs(rn - g - h - le) / nullif(abs(rn), 0) AS rest FROM bal) SELECT scene_id, round(avg(closure), 6) AS mean_closure, round(stddev_pop(closure), 6) AS std_closure, round(avg(rest), 6) AS residual_ratio, abs(avg(closure) - 1) <= 0.15 AS valid FROM c GROUP BY scene_id")
def energy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.closure(balance(pixels(spark, sf_dir)))


@query(
    "scene_statistics",
    f"WITH {_BALANCE} SELECT scene_id, round(100.0 * count(*) FILTER (WHERE {_CLEAR}) / count(*), 6) AS clear_percent, round(quantile_cont(ndvi, 0.05), 6) AS ndvi_p05, round(quantile_cont(ndvi, 0.95), 6) AS ndvi_p95, round(avg(ef), 6) AS ef_mean, round(min(h), 6) AS h_min, round(avg(etrf), 6) AS etrf_mean FROM bal GROUP BY scene_id",
)
def scene_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    p = quantiles(d.select("scene_id", "ndvi"), ["scene_id"], {"ndvi": [0.05, 0.95]})
    own = d.groupBy("scene_id").agg(
        F.round(100.0 * F.count_if(G.is_clear(F.col("qa_pixel"))) / F.count("*"), 6).alias("clear_percent"), F.round(F.avg("ef"), 6).alias("ef_mean"), F.round(F.min("h"), 6).alias("h_min"), F.round(F.avg("etrf"), 6).alias("etrf_mean"),
    )
    return own.join(p, "scene_id", "left").select("scene_id", "clear_percent", F.round(F.col("ndvi")[0], 6).alias("ndvi_p05"), F.round(F.col("ndvi")[1], 6).alias("ndvi_p95"), "ef_mean", "h_min", "etrf_mean")


@query(
    "global_validation",
    f"""WITH {_BALANCE}, a AS (SELECT scene_id, min(ef) AS ef_min, round(quantile_cont(ef, 0.95), 9) AS ef_p95, avg(ef) AS ef_mean, avg(CASE WHEN h < 0 THEN 1.0 ELSE 0.0 END) AS neg, count(*) FILTER (WHERE h < -20) AS very, round(quantile_cont(etrf, 0.95), 9) AS etrf_p95, avg(etrf) AS etrf_mean FROM bal GROUP BY scene_id)
    SELECT scene_id, round(ef_mean, 6) AS ef_mean, ef_min >= 0.15 AND ef_p95 <= 0.95 AND ef_mean <= 0.85 AS ef_ok, neg <= 0.01 AND very = 0 AS h_ok, etrf_p95 <= 1.15 AND etrf_mean <= 1.05 AS etrf_ok FROM a""",
)
def global_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.global_checks(balance(pixels(spark, sf_dir))).select("scene_id", F.round("ef_mean", 6).alias("ef_mean"), "ef_ok", "h_ok", "etrf_ok")


@query("scene_prevalidation", f"WITH {_SURFACE} SELECT scene_id, round(count(*) FILTER (WHERE ({_CLEAR}) AND lst IS NOT NULL) / count(*), 9) AS valid_fraction, count(*) FILTER (WHERE ({_CLEAR}) AND lst IS NOT NULL) / count(*) < 0.3 AS rejected FROM sf GROUP BY scene_id")
def scene_prevalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = G.is_clear(F.col("qa_pixel")) & F.col("lst").isNotNull()
    share = F.count_if(good) / F.count("*")
    return surface(pixels(spark, sf_dir)).groupBy("scene_id").agg(F.round(share, 9).alias("valid_fraction"), (share < 0.3).alias("rejected"))


@query("etrf_bounds", f"WITH {_BALANCE} SELECT scene_id, count(*) FILTER (WHERE etrf < 0 OR etrf > 2) AS errors, count(*) FILTER (WHERE etrf > 1.5) AS warnings, round(stddev_pop(etrf), 6) AS std, stddev_pop(etrf) > 0.5 AS uneven FROM bal GROUP BY scene_id")
def etrf_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("etrf")
    return balance(pixels(spark, sf_dir)).groupBy("scene_id").agg(F.count_if((v < 0) | (v > 2)).alias("errors"), F.count_if(v > 1.5).alias("warnings"), F.round(F.stddev_pop(v), 6).alias("std"), (F.stddev_pop(v) > 0.5).alias("uneven"))


@query("le_et_consistency", f"WITH {_BALANCE}, d AS (SELECT scene_id, le * 3600 / 2.45e6 - et_inst * 1.01 AS d, et_inst FROM bal) SELECT scene_id, round(avg(abs(d)), 6) AS mean_abs, round(max(abs(d)), 6) AS max_abs, round(avg(d), 6) AS bias, avg(abs(d) / greatest(et_inst, 0.01)) < 0.1 AS consistent FROM d GROUP BY scene_id")
def le_et_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir)).withColumn("d", F.col("le") * 3600 / 2.45e6 - F.col("et_inst") * 1.01)
    return d.groupBy("scene_id").agg(F.round(F.avg(F.abs("d")), 6).alias("mean_abs"), F.round(F.max(F.abs("d")), 6).alias("max_abs"), F.round(F.avg("d"), 6).alias("bias"), (F.avg(F.abs("d") / F.greatest("et_inst", F.lit(0.01))) < 0.1).alias("consistent"))


@query("metric_rules", f"WITH {_BALANCE} SELECT scene_id, count(*) FILTER (WHERE le > rn - g + 1e-6) AS le_above, count(*) FILTER (WHERE et_daily > 15) AS et_daily_above, count(*) FILTER (WHERE et_inst > 1) AS et_inst_above, count(*) FILTER (WHERE lst < 250 OR lst > 350) AS t_outside FROM bal GROUP BY scene_id")
def metric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(pixels(spark, sf_dir)).groupBy("scene_id").agg(
        F.count_if(F.col("le") > F.col("rn") - F.col("g") + 1e-6).alias("le_above"), F.count_if(F.col("et_daily") > 15).alias("et_daily_above"), F.count_if(F.col("et_inst") > 1).alias("et_inst_above"), F.count_if((F.col("lst") < 250) | (F.col("lst") > 350)).alias("t_outside")
    )


@query(
    "band_statistics",
    "WITH " + PIXELS + ", l AS (UNPIVOT (SELECT scene_id, blue, green, red, nir08, swir16, swir22, lwir11 FROM px) ON blue, green, red, nir08, swir16, swir22, lwir11 INTO NAME band VALUE v) SELECT scene_id, band, count(v) AS n, floor(min(v) * 1e5 + 0.5000001) / 1e5 AS lo, floor(max(v) * 1e5 + 0.5000001) / 1e5 AS hi, floor(avg(v) * 1e5 + 0.5000001) / 1e5 AS mean, floor(stddev_pop(v) * 1e5 + 0.5000001) / 1e5 AS std, floor(quantile_cont(v, 0.05) * 1e5 + 0.5000001) / 1e5 AS p05, floor(quantile_cont(v, 0.95) * 1e5 + 0.5000001) / 1e5 AS p95 FROM l GROUP BY scene_id, band",
)
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.statistics(pixels(spark, sf_dir), ["scene_id"], ["blue", "green", "red", "nir08", "swir16", "swir22", "lwir11"])
    return out.select("scene_id", "band", "n", *[(F.floor(F.col(c) * 1e5 + 0.5000001) / 1e5).alias(c) for c in ("lo", "hi", "mean", "std", "p05", "p95")])


_BINS = """v AS (SELECT *, CAST(floor((ndvi - 0.2) / 0.02 + 1e-9) AS INTEGER) AS bin FROM sf WHERE ndvi >= 0.2 AND ndvi <= 0.9 AND lst IS NOT NULL), e AS (SELECT scene_id, least(bin, 34) AS bin, 0.21 + 0.02 * least(bin, 34) AS c, quantile_cont(lst, 0.05) AS wet, quantile_cont(lst, 0.95) AS dry FROM v GROUP BY scene_id, least(bin, 34))"""


@query(
    "cwsi_lst",
    f"""WITH {_SURFACE}, {_BINS}, seg AS (SELECT scene_id, c, wet, dry, lead(c) OVER w AS c2, lead(wet) OVER w AS wet2, lead(dry) OVER w AS dry2, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY scene_id ORDER BY c)),
    j AS (SELECT sf.scene_id, y, x, lst, wet + coalesce((wet2 - wet) * greatest(ndvi - c, 0) / (c2 - c), 0) AS wet, dry + coalesce((dry2 - dry) * greatest(ndvi - c, 0) / (c2 - c), 0) AS dry FROM sf JOIN seg ON seg.scene_id = sf.scene_id AND (ndvi >= c OR n = 1) AND (ndvi < c2 OR c2 IS NULL) WHERE lst IS NOT NULL)
    SELECT scene_id, y, x, round({_c('(lst - wet) / nullif(round(dry - wet, 9), 0)', 0, 1)}, 5) AS cwsi FROM j""",
)
def cwsi_lst(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.water_stress(surface(pixels(spark, sf_dir)))
    return out.select(*KEY, F.round("cwsi", 5).alias("cwsi"))


@query(
    "tvdi",
    f"""WITH {_SURFACE}, {_BINS}, f AS (SELECT scene_id, regr_slope(dry, c) AS b, regr_intercept(dry, c) AS a FROM e GROUP BY scene_id HAVING count(*) >= 2), m AS (SELECT scene_id, quantile_cont(lst, 0.05) AS lo FROM sf GROUP BY scene_id)
    SELECT sf.scene_id, y, x, round({_c('(lst - lo) / nullif(round(a + b * ndvi - lo, 9), 0)', 0, 1)}, 5) AS tvdi FROM sf JOIN f USING (scene_id) JOIN m USING (scene_id)""",
)
def tvdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.dryness(surface(pixels(spark, sf_dir)))
    return out.select(*KEY, F.round("tvdi", 5).alias("tvdi"))


@query(
    "tci_vci_vhi",
    f"""WITH {_SURFACE}, w AS (SELECT y % 50 AS site, ndvi, lst, y, x, min(ndvi) OVER p AS n0, max(ndvi) OVER p AS n1, min(lst) OVER p AS t0, max(lst) OVER p AS t1 FROM sf WINDOW p AS (PARTITION BY y % 50)),
    i AS (SELECT y, x, site, (t1 - lst) / nullif(t1 - t0, 0) AS tci, (ndvi - n0) / nullif(n1 - n0, 0) AS vci FROM w) SELECT y, x, round(tci, 6) AS tci, round(vci, 6) AS vci, round(0.5 * vci + 0.5 * tci, 6) AS vhi FROM i""",
)
def tci_vci_vhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.condition_indices(surface(pixels(spark, sf_dir)).withColumn("site", F.col("y") % 50), "site")
    return out.select("y", "x", *[F.round(c, 6).alias(c) for c in ("tci", "vci", "vhi")])


_MORE = ["white", "broadband", "greenhouse", "dt_lin", "dt_emp", "stress"]


@query(
    "surface_extras",
    f"""WITH {_BALANCE}, m AS (SELECT scene_id, max(lwir11) AS top FROM bal GROUP BY scene_id), i AS (SELECT bal.*, {_c('albedo * (1 + 0.05 * (1 - cos(0.5)))', 0, 0.5)} AS white, {_c('CASE WHEN lwir11 > 0 THEN 0.95 + 0.004 * (lwir11 / top) ELSE 0.96 END', 0.9, 1)} AS broadband,
    up / emissivity - up AS greenhouse, 0.4 * (lwir11 - ta) + 1.5 AS dt_lin, lwir11 - ta - 2.0 * ndvi AS dt_emp,
    {_c('(lwir11 - 290.0) / 30.0', 0, 1)} * (1 - ({_c('le / nullif(CASE WHEN abs(rn - g) < 10 THEN sign(rn - g) * 10 ELSE rn - g END, 0)', 0, 1)})) AS stress FROM bal JOIN m USING (scene_id))
    SELECT scene_id, y, x, {', '.join(f"floor({c} * 1e5 + 0.500001) / 1e5 AS {c}" for c in _MORE)}, CASE y % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 0.1 ELSE 0.01 END AS z0 FROM i""",
)
def surface_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = balance(pixels(spark, sf_dir))
    d = raster.beside(d, d.groupBy("scene_id").agg(F.max("lwir11").alias("top")), "scene_id")
    cover = F.element_at(F.array(*map(F.lit, ("water", "forest", "crops", "unknown", "bare_soil"))), (F.col("y") % 5 + 1).cast("int"))
    d = d.withColumns({
        "white": G.hemispherical_albedo(F.col("albedo")), "broadband": G.broadband_emissivity(F.col("lwir11"), F.col("top")), "greenhouse": E.greenhouse(F.col("up"), F.col("emissivity")),
        "dt_lin": E.dt_linear(F.col("lwir11"), F.col("ta"), 0.4, 1.5), "dt_emp": E.dt_empirical(F.col("lwir11"), F.col("ta"), F.col("ndvi")), "stress": E.stress_indicator(F.col("le"), F.col("rn") - F.col("g"), F.col("lwir11")),
    })
    return d.select(*KEY, *[(F.floor(F.col(c) * 1e5 + 0.500001) / 1e5).alias(c) for c in _MORE], G.by_cover(cover, G.ROUGHNESS).alias("z0"))
