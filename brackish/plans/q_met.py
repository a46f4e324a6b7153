"""Queries on meteorology scalars and spectral indices."""

from pyspark.sql import functions as F

from brackish.functions import gates, meteorology as met, spectral
from brackish.operators import pixels
from brackish.plans.registry import query, r, rsql
from brackish.sources.readers import gridded_met


def svp(t):
    return f"(0.6108 * exp(17.27 * ({t}) / (({t}) + 237.3)))"


def clip(x, lo, hi=None):
    top = f" WHEN {x} > {hi} THEN {hi}" if hi is not None else ""
    return f"CASE WHEN {x} < {lo} THEN {lo}{top} ELSE {x} END"


TX, TN = "(tmmx - 273.15)", "(tmmn - 273.15)"
ES = f"(({svp(TX)} + {svp(TN)}) / 2)"
EA = f"(({svp(TN)} * rmax / 100 + {svp(TX)} * rmin / 100) / 2)"


@query(
    "m1_m2_m6_gridded_met",
    f"""SELECT site, date, {rsql(f'({TX} + {TN}) / 2', 'TA_C')}, {rsql(clip(f'({ES} - {EA})', 0), 'VPD_kPa')}, {rsql(clip(f'({EA} / {ES} * 100)', 0, 100), 'RH_pct')},
    {rsql('vs', 'WS_ms')}, {rsql('srad', 'SRAD_Wm2')}, {rsql('etr', 'ETr_mm')}, {rsql('pet', 'ETo_mm')}, {rsql('pr', 'P_mm')} FROM met_daily""",
)
def _(v):
    cols = ["TA_C", "VPD_kPa", "RH_pct", "WS_ms", "SRAD_Wm2", "ETr_mm", "ETo_mm", "P_mm"]
    return gridded_met(v.met_daily).select("site", "date", *[r(c) for c in cols])


@query(
    "m3_dewpoint_humidity",
    f"SELECT site, slot, {rsql(clip(f'({svp('TA')} - {svp('TA - H / 10')})', 0), 'vpd')}, {rsql(clip(f'({svp('TA - H / 10')} / {svp('TA')} * 100)', 0, 100), 'rh')}, "
    f"{rsql(clip(f'({svp('TA')} - {svp('TA - H / 10')})', 0) .replace('CASE', '(CASE', 1) + ') * 10', 'vpd_hpa')} FROM flux_hh",
)
def _(v):
    t, d = F.col("TA"), F.col("TA") - F.col("H") / 10
    vpd = met.vpd_dew(t, d)
    return v.flux_hh.select("site", "slot", r(vpd, "vpd"), r(met.rh_dew(t, d), "rh"), r(met.kpa_to_hpa(vpd), "vpd_hpa"))


@query(
    "m4_m5_m6_wind_radiation_units",
    f"""SELECT site, slot, {rsql('sqrt(USTAR * USTAR + G * G)', 'ws')}, {rsql('NETRAD + G', 'rn')}, {rsql('TA - 273.15', 'c')}, {rsql('NETRAD / 3600', 'watt')},
    {rsql('G * 1000', 'mm')}, {rsql('abs(-G) * 1000', 'pet')} FROM flux_hh""",
)
def _(v):
    c = F.col
    return v.flux_hh.select(
        "site",
        "slot",
        r(met.wind_speed(c("USTAR"), c("G")), "ws"),
        r(met.net_radiation(c("NETRAD"), c("G")), "rn"),
        r(met.kelvin_to_c(c("TA")), "c"),
        r(met.joule_hour_to_watt(c("NETRAD")), "watt"),
        r(met.metre_to_mm(c("G")), "mm"),
        r(met.pet_to_mm(-c("G")), "pet"),
    )


SLOPE = f"(4098 * {svp('TA')} / power(TA + 237.3, 2))"
ETEQ = f"({SLOPE} / ({SLOPE} + 0.066) * NETRAD * 86400 / 2.45e6)"
ETAV = "(NETRAD * 86400 / 2.45e6)"


@query(
    "m7_m8_m9_m10_equilibrium",
    f"""SELECT site, slot, {rsql(SLOPE, 'slope')}, {rsql(ETEQ, 'et_eq')}, {rsql(clip(f'(LE / 28.4 / {ETEQ})', 0, 2.0), 'alpha')},
    {rsql(clip(f'(LE / 28.4 / {ETAV})', 0, 1.2), 'ef')}, {rsql('NETRAD - coalesce(G, 0) - LE / 28.4 / (86400 / 2.45e6)', 'h_obs')} FROM flux_hh WHERE {ETEQ} > 0.2""",
)
def _(v):
    et = F.col("LE") / 28.4
    eq = met.equilibrium_et(F.col("TA"), F.col("NETRAD"))
    return v.flux_hh.where(eq > 0.2).select(
        "site",
        "slot",
        r(met.svp_slope(F.col("TA")), "slope"),
        r(eq, "et_eq"),
        r(met.priestley_taylor(et, eq), "alpha"),
        r(met.evaporative_fraction(et, F.col("NETRAD") * met.W2MM), "ef"),
        r(met.sensible_residual(F.col("NETRAD"), F.col("G"), et), "h_obs"),
    )


@query(
    "m11_reference_fraction_kc",
    f"""SELECT site, date, {rsql('ET / nullif(pet, 0)', 'ef_ratio')}, {rsql('ET / CASE WHEN pet < 0.3 THEN 0.3 ELSE pet END', 'kc')} FROM et_daily JOIN met_daily USING (site, date)""",
)
def _(v):
    rows = v.et_daily.join(v.met_daily, ["site", "date"])
    et, eto = F.col("ET"), F.col("pet")
    return rows.select("site", "date", r(met.reference_fraction(et, eto), "ef_ratio"), r(met.crop_coefficient(et, eto), "kc"))


@query(
    "m12_sar_decibel",
    f"""SELECT site, scene, pos, {rsql('10 * log10(CASE WHEN nir < 1e-6 THEN 1e-6 ELSE nir END)', 'vv_db')},
    {rsql('10 * log10(CASE WHEN nir < 1e-6 THEN 1e-6 ELSE nir END) - 10 * log10(CASE WHEN red < 1e-6 THEN 1e-6 ELSE red END)', 'gap')} FROM pixels""",
)
def _(v):
    return v.pixels.select("site", "scene", "pos", r(met.sar_db(F.col("nir")), "vv_db"), r(met.polarisation_gap(F.col("nir"), F.col("red")), "gap"))


@query(
    "m13_m16_solar_hour_utm",
    f"""SELECT site, {rsql('(((site % 24 + lon / 15) % 24) + 24) % 24', 'solar')}, CAST(32600 + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS INTEGER) AS epsg,
    CAST(32700 + CAST(floor((-lon + 180) / 6) AS INTEGER) + 1 AS INTEGER) AS epsg_south FROM geo_sites""",
)
def _(v):
    lon, lat = F.col("lon"), F.col("lat")
    return v.geo_sites.select(
        "site", r(met.solar_hour(F.col("site") % 24, lon), "solar"), met.utm_epsg(lon, lat).alias("epsg"), met.utm_epsg(-lon, -lat).alias("epsg_south")
    )


RHO = "((90000 + LE) / ((TA + 273.15) * 287.05))"
OBU = f"(-power(USTAR, 3) / nullif(0.4 * 9.81 / (TA + 273.15) * (H / ({RHO} * 1004.0)), 0))"


@query(
    "m14_turbulence",
    f"""SELECT site, slot, {rsql(RHO, 'rho')}, {rsql(clip(OBU, '-1e4', '1e4'), 'obukhov')}, {rsql('1.9 * USTAR', 'sigma_v')} FROM flux_hh""",
)
def _(v):
    rho = met.air_density(F.col("LE") + 90000, F.col("TA") + 273.15)
    length = met.obukhov_length(F.col("USTAR"), F.col("TA") + 273.15, F.col("H"), rho)
    return v.flux_hh.select("site", "slot", r(rho, "rho"), r(length, "obukhov"), r(met.sigma_v(F.col("USTAR")), "sigma_v"))


@query(
    "m15_pooled_radiation_line",
    f"""WITH p AS (SELECT site, slot, CASE WHEN site <> 'view' THEN NETRAD END AS rn, LE AS srad FROM flux_hh),
    n AS (SELECT site, count(rn) AS k FROM p GROUP BY 1),
    f AS (SELECT regr_slope(rn, srad) AS b, regr_intercept(rn, srad) AS a FROM p JOIN n USING (site) WHERE k > 30)
    SELECT site, slot, {rsql('CASE WHEN k = 0 THEN a + b * srad ELSE rn END', 'rn')} FROM p JOIN n USING (site) CROSS JOIN f""",
)
def _(v):
    from brackish.operators.energy_supply import fill_net_radiation

    rows = v.flux_hh.select("site", "slot", F.when(F.col("site") != "view", F.col("NETRAD")).alias("rn"), F.col("LE").alias("srad"))
    return fill_net_radiation(rows, ["site"], "rn", "srad").select("site", "slot", r("rn"))


def safe(a, b):
    x = f"(({a} - {b}) / ({a} + {b}))"
    return f"CASE WHEN {a} + {b} > 0.02 THEN {clip(x, -1, 1)} END"


SAVI = clip("(1.5 * (nir - red) / (nir + red + 0.5))", -1, 1.5)
BOUNDED = clip("savi", 0, 0.685)


@query(
    "r1_r2_clipped_indices",
    f"""SELECT site, scene, pos, {rsql(safe('nir', 'red'), 'NDVI')}, {rsql('savi', 'SAVI')}, {rsql(clip('(2.5 * (nir - red) / (nir + 2.4 * red + 1))', -1, 1.5), 'EVI2')},
    {rsql(safe('nir', 'swir'), 'NDWI')}, {rsql(safe('green', 'swir'), 'MNDWI')}, {rsql(clip(f'(-ln((0.69 - ({BOUNDED})) / 0.59) / 0.91)', 0, 6), 'LAI')}
    FROM (SELECT *, {SAVI} AS savi FROM pixels)""",
)
def _(v):
    out = pixels.with_indices(v.pixels, "clip")
    return out.select("site", "scene", "pos", *[r(c) for c in ("NDVI", "SAVI", "EVI2", "NDWI", "MNDWI", "LAI")])


def strict(num, den, limit, least=0.02):
    x = f"({num}) / ({den})"
    return f"CASE WHEN {den} > {least} AND abs({x}) <= {limit} THEN {x} END"


POSITIVE = "(SELECT site, scene, pos, " + ", ".join(f"CASE WHEN {c} > 0 THEN {c} END AS {c[0]}" for c in ("red", "nir", "green", "swir")) + " FROM pixels)"


@query(
    "r1b_nulled_indices",
    f"""SELECT site, scene, pos, {rsql(strict('n - r', 'n + r', 1), 'NDVI')}, {rsql(strict('g - s', 'g + s', 1), 'MNDWI')}, {rsql(strict('1.5 * (n - r)', '(n + r + 0.5)', 1.5, 0.05), 'SAVI')},
    {rsql(strict('2.5 * (n - r)', '(n + 2.4 * r + 1)', 1.5, 0.05), 'EVI2')}, {rsql(strict('n - s', 'n + s', 1), 'NDWI')} FROM {POSITIVE}""",
)
def _(v):
    out = pixels.with_indices(v.pixels)
    return out.select("site", "scene", "pos", *[r(c) for c in ("NDVI", "MNDWI", "SAVI", "EVI2", "NDWI")])


@query(
    "r1c_sentinel_indices",
    f"""SELECT site, scene, pos, {rsql(strict('n - r', 'n + r', 1), 'NDVI_S2')}, {rsql(strict('g - s', 'g + s', 1), 'MNDWI_S2')}, {rsql(strict('g - n', 'g + n', 1), 'NDWI_S2')} FROM {POSITIVE}""",
)
def _(v):
    made = spectral.sentinel_indices(F.col("green"), F.col("red"), F.col("nir"), F.col("swir"))
    return v.pixels.withColumns(made).select("site", "scene", "pos", *[r(c) for c in made])


@query(
    "q10_q11_cloud_and_class_masks",
    f"""SELECT site, scene, pos, {rsql('CASE WHEN qa & 62 = 0 THEN LST END', 'LST_clear')}, {rsql('CASE WHEN scl IN (4, 5, 6, 7) THEN LST END', 'LST_class')} FROM pixels""",
)
def _(v):
    lst = F.col("LST")
    clear, kept = gates.is_clear(F.col("qa")), gates.is_clear_class(F.col("scl"))
    return v.pixels.select("site", "scene", "pos", r(gates.mask(lst, clear), "LST_clear"), r(gates.mask(lst, kept), "LST_class"))


@query("r14_open_water", "SELECT site, scene, pos, coalesce(MNDWI > 0 AND NDVI < 0.10, false) AS water FROM strict")
def _(v):
    return v.strict.select("site", "scene", "pos", spectral.open_water(F.col("MNDWI"), F.col("NDVI")).alias("water"))


@query(
    "r20_bounding_box",
    f"""SELECT site, {rsql('lon - 1.5 / (111.32 * cos(radians(lat)))', 'west')}, {rsql('lat - 1.5 / 111.32', 'south')}, {rsql('lon + 1.5 / (111.32 * cos(radians(lat)))', 'east')},
    {rsql('lat + 1.5 / 111.32', 'north')} FROM geo_sites""",
)
def _(v):
    box = pixels.bounding_box(F.col("lat"), F.col("lon"), 1.5)
    return v.geo_sites.select("site", *[r(c, n) for n, c in box.items()])
