"""Queries on pixel tables: masks, windows, weights, mosaics, regions, downscaling."""

from pyspark.sql import functions as F

from brackish.functions import spectral
from brackish.operators import downscale, footprint, joins, pixels, series
from brackish.plans.registry import query, r, rsql

SCENE = ["site", "scene"]
AX, AY = "abs(px_x)", "abs(px_y)"


@query("q12_valid_fraction", f"SELECT site, scene, {rsql('count(LST) / count(*)', 'valid_frac')} FROM clear GROUP BY 1, 2 HAVING count(LST) / count(*) >= 0.03")
def _(v):
    return pixels.gate_valid_fraction(v.clear, SCENE, "LST", 0.03).select("site", "scene", r("valid_frac"))


@query(
    "q13_thermal_window",
    f"""SELECT site, scene, {rsql('avg(t)', 'LST_mean')}, {rsql('stddev_pop(t)', 'LST_sd')} FROM (SELECT site, scene, CASE WHEN LST > 286 AND LST < 340 THEN CASE WHEN LST > 200 AND LST < 340 THEN LST END END AS t FROM pixels)
    GROUP BY 1, 2 HAVING count(t) / count(*) >= 0.5""",
)
def _(v):
    rows = v.pixels.withColumn("LST", F.when((F.col("LST") > 286) & (F.col("LST") < 340), F.col("LST")))
    return pixels.thermal_window_stats(rows, SCENE).select("site", "scene", r("LST_mean"), r("LST_sd"))


WINDOWS = f"""win AS (SELECT site, scene, window_m, avg(LST) AS LST, avg(red) AS red, avg(nir) AS nir, avg(green) AS green, avg(swir) AS swir, avg(NDVI) AS NDVI, count(LST) / count(*) AS valid_frac
    FROM strict JOIN (SELECT unnest([90, 150, 250]) AS window_m) ON greatest({AX}, {AY}) <= window_m / 2.0 GROUP BY 1, 2, 3)"""


def windows(v):
    return pixels.window_means(v.strict, SCENE, ["LST", "red", "nir", "green", "swir", "NDVI"], (90, 150, 250))


@query("r3_window_means", f"WITH {WINDOWS} SELECT site, scene, window_m, {rsql('LST')}, {rsql('NDVI')}, {rsql('valid_frac')} FROM win")
def _(v):
    return windows(v).select("site", "scene", "window_m", r("LST"), r("NDVI"), r("valid_frac"))


@query(
    "r3_window_means_gated",
    f"WITH {WINDOWS} SELECT site, scene, window_m, {rsql('LST')} FROM win WHERE (site, scene) IN (SELECT (site, scene) FROM win WHERE window_m = 150 AND valid_frac >= 0.05)",
)
def _(v):
    out = pixels.window_means(v.strict, SCENE, ["LST"], (90, 150, 250), min_valid=0.05, primary=150)
    return out.select("site", "scene", "window_m", r("LST"))


RADII = """rad AS (SELECT site, scene, radius_m, avg(LST) AS LST, avg(NDVI) AS NDVI FROM strict JOIN (SELECT unnest([60, 100, 140]) AS radius_m) ON sqrt(px_x * px_x + px_y * px_y) * cos(radians(25.5)) <= radius_m GROUP BY 1, 2, 3)"""


def radii(v):
    return pixels.radius_means(v.strict, SCENE, ["LST", "NDVI"], (60, 100, 140), F.cos(F.radians(F.lit(25.5))))


@query("r4_radius_means", f"WITH {RADII} SELECT site, scene, radius_m, {rsql('LST')}, {rsql('NDVI')} FROM rad")
def _(v):
    return radii(v).select("site", "scene", "radius_m", r("LST"), r("NDVI"))


@query(
    "r1d_ratio_of_window_means",
    f"WITH {WINDOWS} SELECT site, scene, window_m, {rsql('(nir - red) / nullif(nir + red, 0)', 'NDVI')}, {rsql('(green - swir) / nullif(green + swir, 0)', 'MNDWI')} FROM win",
)
def _(v):
    return pixels.ratio_of_means(windows(v)).select("site", "scene", "window_m", r("NDVI"), r("MNDWI"))


@query(
    "r5_chip_stats",
    "SELECT site, scene, " + ", ".join(f"{rsql(f'avg({c})', f'{c}_mean')}, {rsql(f'stddev_pop({c})', f'{c}_std')}" for c in ("red", "nir", "NDVI")) + " FROM strict GROUP BY 1, 2",
)
def _(v):
    out = pixels.chip_stats(v.strict, SCENE, ["red", "nir", "NDVI"])
    return out.select("site", "scene", *[r(f"{c}_{s}") for c in ("red", "nir", "NDVI") for s in ("mean", "std")])


def wmean(col, w="w", cond="w > 0"):
    ww = f"CASE WHEN {cond} AND {col} IS NOT NULL THEN {w} END"
    return f"CASE WHEN sum({ww}) > 0 THEN sum(({ww}) * {col}) / sum({ww}) END"


@query("r6_weighted_mean_drop", f"SELECT site, date, {rsql(wmean('LST'), 'LST')}, {rsql(wmean('NDVI'), 'NDVI')} FROM strict GROUP BY 1, 2")
def _(v):
    return pixels.weighted_mean(v.strict, ["site", "date"], ["LST", "NDVI"], "w").select("site", "date", r("LST"), r("NDVI"))


@query(
    "r6_weighted_mean_zero",
    f"SELECT site, date, {rsql(wmean('LST', cond='w IS NOT NULL'), 'LST')}, {rsql(wmean('NDVI', cond='w IS NOT NULL'), 'NDVI')} FROM strict GROUP BY 1, 2",
)
def _(v):
    return pixels.weighted_mean(v.strict, ["site", "date"], ["LST", "NDVI"], "w", "zero").select("site", "date", r("LST"), r("NDVI"))


@query("r7_weighted_predictions", f"SELECT site, date, {rsql(wmean('pred'), 'pred')} FROM (SELECT site, date, w, 2 + 3 * NDVI - 0.01 * (LST - 290) AS pred FROM strict) GROUP BY 1, 2")
def _(v):
    rows = v.strict.withColumn("pred", F.col("NDVI") * 3 + 2 - (F.col("LST") - 290) * 0.01)
    return pixels.weighted_mean(rows, ["site", "date"], ["pred"], "w").select("site", "date", r("pred"))


@query(
    "r8_scene_drop_rules",
    """SELECT site, scene, pos FROM clear WHERE LST IS NOT NULL AND w > 0 AND (site, scene) IN
    (SELECT (site, scene) FROM clear GROUP BY site, scene HAVING count(LST) / count(*) >= 0.03 AND count(CASE WHEN LST IS NOT NULL AND w > 0 THEN 1 END) >= 1)""",
)
def _(v):
    return pixels.keep_scenes(v.clear, SCENE, weight="w", least_finite=0.03, least_pixels=1).select("site", "scene", "pos")


WEIGHTS = "wt AS (SELECT site, px_x, px_y, sum(red * (1 + w)) AS w FROM pixels GROUP BY 1, 2, 3), nw AS (SELECT site, px_x, px_y, w / sum(w) OVER (PARTITION BY site) AS w FROM wt)"


def weights(v):
    return v.pixels.groupBy("site", "px_x", "px_y").agg(F.sum(F.col("red") * (F.col("w") + 1)).alias("w"))


@query("r10_normalised_weights", f"WITH {WEIGHTS} SELECT site, px_x, px_y, {rsql('w', 'w', 7)} FROM nw")
def _(v):
    return pixels.normalise_weights(weights(v), ["site"]).select("site", "px_x", "px_y", r("w", "w", 7))


@query(
    "r9_source_area",
    f"""WITH {WEIGHTS}, c AS (SELECT site, w, sum(w) OVER (PARTITION BY site ORDER BY w DESC ROWS UNBOUNDED PRECEDING) AS cum FROM nw),
    l AS (SELECT site, max(CASE WHEN cum >= 0.5 THEN w END) AS l50, max(CASE WHEN cum >= 0.8 THEN w END) AS l80 FROM c GROUP BY 1)
    SELECT site, {rsql('l50', 'level_50', 7)}, {rsql('count(CASE WHEN w >= l50 THEN 1 END) * 900 / 1e4', 'area_50_ha')}, {rsql('l80', 'level_80', 7)}, {rsql('count(CASE WHEN w >= l80 THEN 1 END) * 900 / 1e4', 'area_80_ha')}
    FROM nw JOIN l USING (site) GROUP BY site, l50, l80""",
)
def _(v):
    out = pixels.source_area(weights(v), ["site"], cell_m2=900.0)
    return out.select("site", r("level_50", "level_50", 7), r("area_50_ha"), r("level_80", "level_80", 7), r("area_80_ha"))


X, Y = "(ix * 100.0 * sin(wd) + iy * 100.0 * cos(wd))", "(ix * 100.0 * cos(wd) - iy * 100.0 * sin(wd))"
TURB = """hh AS (SELECT site, 0.1 + H / 100 AS ustar, 2 + TA / 10 AS umean, radians(H * 360 / 97) AS wd, 0.2 + H / 200 AS sigmav, CASE WHEN H < 40 THEN -50.0 - H ELSE 200.0 + H END AS obukhov FROM flux_hh WHERE LE IS NOT NULL)"""


@query(
    "r11_footprint_climatology",
    f"""WITH {TURB}, c AS (SELECT *, umean / ustar * 0.4 AS pr, 1 - 4.0 / 1000 AS thin, {X} AS x, {Y} AS y FROM hh, range(-3, 4) a(ix), range(-3, 4) b(iy)),
    s AS (SELECT *, x / 4 * thin / pr AS xs FROM c), f AS (SELECT site, ix, iy, CASE WHEN xs - 0.1359 > 0 THEN 1.4524 * power(xs - 0.1359, -1.9914) * exp(-1.4622 / (xs - 0.1359)) / 4 * thin / pr
    * exp(-(y * y) / (2 * sg * sg)) / (sg * 2.5066282746310002) ELSE 0 END AS w FROM (SELECT *, CASE WHEN xs > 0.1359 THEN 2.17 * sqrt(1.66 * xs * xs / (1 + 20 * xs)) /
    least(1, abs(obukhov / 4) * 1e-5 + CASE WHEN obukhov <= 0 THEN 0.8 ELSE 0.55 END) * 4 * sigmav / ustar END AS sg FROM s)),
    m AS (SELECT site, ix, iy, avg(w) AS w FROM f GROUP BY 1, 2, 3)
    SELECT site, CAST(ix * 100 AS INTEGER) AS x, CAST(iy * 100 AS INTEGER) AS y, {rsql('w / sum(w) OVER (PARTITION BY site)', 'w', 7)} FROM m""",
)
def _(v):
    return footprint.climatology(turbulence(v), ["site"], F.lit(4.0), domain=300, step=100).select("site", "x", "y", r("w", "w", 7))


@query("r11_footprint_grid")
def _(v):
    """The grid of the operator: 121 x 121 cells of 10 m."""
    return footprint.climatology(turbulence(v), ["site"], F.lit(4.0))


def turbulence(v):
    h = F.col("H")
    return v.flux_hh.where("LE IS NOT NULL").select(
        "site",
        (h / 100 + 0.1).alias("ustar"),
        (F.col("TA") / 10 + 2).alias("umean"),
        (h * 360 / 97).alias("wind_dir"),
        (h / 200 + 0.2).alias("sigmav"),
        F.when(h < 40, -h - 50.0).otherwise(h + 200.0).alias("obukhov"),
    )


@query("r12_mosaic", f"SELECT site, date, pos, {rsql('avg(red)', 'red')}, {rsql('avg(LST)', 'LST')} FROM clear GROUP BY 1, 2, 3")
def _(v):
    return pixels.mosaic(v.clear, ["site", "date", "pos"], ["red", "LST"]).select("site", "date", "pos", r("red"), r("LST"))


@query("r13_temporal_median", f"SELECT site, pos, {rsql('median(LST)', 'LST')}, {rsql('median(nir)', 'nir')} FROM clear GROUP BY 1, 2")
def _(v):
    return pixels.temporal_median(v.clear, ["site", "pos"], ["LST", "nir"]).select("site", "pos", r("LST"), r("nir"))


@query(
    "r15_scene_selection",
    """SELECT region, scene, CAST(cloud AS BIGINT) AS cloud, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY tier, cloud, scene) AS n FROM
    (SELECT site AS region, scene, scene * 7 % 40 AS cloud, CASE WHEN scene * 7 % 40 < 8 THEN 0 WHEN scene * 7 % 40 < 15 THEN 1 WHEN scene * 7 % 40 < 25 THEN 2 END AS tier,
    min(px_x) + scene % 200 AS x_lo, max(px_x) + scene % 200 AS x_hi, count(red) AS k FROM pixels GROUP BY site, scene) WHERE tier IS NOT NULL AND 40.0 BETWEEN x_lo AND x_hi AND k >= 64) WHERE n = 1""",
)
def _(v):
    shift = F.col("scene") % 200
    scenes = (
        v.pixels.groupBy(F.col("site").alias("region"), "scene")
        .agg(F.min("px_x").alias("a"), F.max("px_x").alias("b"), F.min("px_y").alias("y_lo"), F.max("px_y").alias("y_hi"), F.count("red").alias("n_assets"))
        .select("region", "scene", (F.col("scene") * 7 % 40).alias("cloud"), (F.col("a") + shift).alias("x_lo"), (F.col("b") + shift).alias("x_hi"), "y_lo", "y_hi", "n_assets")
    )
    regions = scenes.select("region").distinct().select("region", F.lit(40.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(64).alias("need"))
    return pixels.pick_scene(scenes, regions)


REGION = "rp AS (SELECT region, site, scene, coalesce(MNDWI > 0 AND NDVI < 0.10, false) AS water, 2 + 3 * NDVI AS et FROM strict s JOIN inside i ON s.pos = i.pos)"


@query(
    "r16_region_summary",
    f"""WITH {REGION} SELECT region, site, count(*) AS inside_px, count(CASE WHEN water THEN 1 END) AS water_px, count(CASE WHEN NOT water THEN et END) AS pixels,
    {rsql('avg(CASE WHEN NOT water THEN et END)', 'mean_ET')}, {rsql('min(CASE WHEN NOT water THEN et END)', 'min_ET')}, {rsql('max(CASE WHEN NOT water THEN et END)', 'max_ET')},
    {rsql('count(CASE WHEN water THEN 1 END) * 100.0 / count(*)', 'water_pct')} FROM rp GROUP BY 1, 2""",
)
def _(v):
    rows = joins.in_rings(v.strict, v.edges, "region", "px_x", "px_y")
    rows = rows.withColumn("water", spectral.open_water(F.col("MNDWI"), F.col("NDVI"))).withColumn("et", F.col("NDVI") * 3 + 2)
    out = pixels.region_summary(rows, ["region", "site"])
    return out.select("region", "site", "inside_px", "water_px", "pixels", r("mean_ET"), r("min_ET"), r("max_ET"), r("water_pct"))


UNMIX = """um AS (SELECT site, scene, n_water / n_all AS water_frac, LST_all, LST_veg, CASE WHEN n_water >= 3 THEN wet END AS LST_water, LST_veg - LST_all AS dT FROM
    (SELECT site, scene, count(t) AS n_all, count(CASE WHEN MNDWI <= 0.1 THEN t END) AS n_veg, count(CASE WHEN MNDWI > 0.1 THEN t END) AS n_water, avg(t) AS LST_all, avg(CASE WHEN MNDWI <= 0.1 THEN t END) AS LST_veg,
    avg(CASE WHEN MNDWI > 0.1 THEN t END) AS wet FROM (SELECT site, scene, MNDWI, CASE WHEN sqrt(px_x * px_x + px_y * px_y) <= 120 THEN LST END AS t FROM raw) GROUP BY 1, 2) WHERE n_all >= 20 AND n_veg >= 5)"""
RAW = "raw AS (SELECT site, scene, px_x, px_y, LST, CASE WHEN green + swir > 0.02 AND green > 0 AND swir > 0 AND abs((green - swir) / (green + swir)) <= 1 THEN (green - swir) / (green + swir) END AS MNDWI FROM pixels)"


def unmixed(v):
    return pixels.unmix(pixels.with_indices(v.pixels), SCENE, 120.0, water_above=0.1, least=(20, 5, 3))


@query("r17_thermal_unmixing", f"WITH {RAW}, {UNMIX} SELECT site, scene, {rsql('water_frac')}, {rsql('LST_all')}, {rsql('LST_veg')}, {rsql('LST_water')}, {rsql('dT')} FROM um")
def _(v):
    return unmixed(v).select("site", "scene", r("water_frac"), r("LST_all"), r("LST_veg"), r("LST_water"), r("dT"))


@query(
    "r17_unmixing_summary",
    f"WITH {RAW}, {UNMIX} SELECT site, count(*) AS n, {rsql('avg(water_frac)', 'water_frac')}, {rsql('avg(dT)', 'dT_mean')}, {rsql('max(abs(dT))', 'dT_max')}, {rsql('avg(LST_veg - LST_water)', 'veg_minus_water')} FROM um GROUP BY 1",
)
def _(v):
    out = pixels.unmix_summary(unmixed(v), ["site"])
    return out.select("site", "n", r("water_frac"), r("dT_mean"), r("dT_max"), r("veg_minus_water"))


CELLS = "cl AS (SELECT *, CAST(floor(px_x / 60) AS BIGINT) AS cx, CAST(floor(px_y / 60) AS BIGINT) AS cy FROM pixels)"


@query(
    "r18_downscale",
    f"""WITH {CELLS}, co AS (SELECT site, scene, cx, cy, avg(LST) AS L, avg(swir) AS g FROM cl GROUP BY 1, 2, 3, 4), ft AS (SELECT site, regr_slope(L, g) AS b, regr_intercept(L, g) AS a FROM co GROUP BY 1)
    SELECT site, scene, pos, {rsql('a + b * swir', 'pred')}, {rsql('L + b * (swir - g)', 'sharp')} FROM cl JOIN co USING (site, scene, cx, cy) JOIN ft USING (site)""",
)
def _(v):
    fine = downscale.coarsen(v.pixels, SCENE, "px_x", "px_y", 60.0, ["LST"])
    out = downscale.downscale(fine.drop("LST"), ["site"], ["scene", "cell_x", "cell_y"], "LST_coarse", ["swir"])
    return out.select("site", "scene", "pos", r("pred"), r("sharp"))


@query(
    "r19_fine_vs_coarse",
    f"""WITH {CELLS}, b AS (SELECT *, avg(LST) OVER (PARTITION BY site, scene, cx, cy) AS L FROM cl), m AS (SELECT site, scene, radius_m, avg(LST) AS f, avg(L) AS c FROM b JOIN (SELECT unnest([60, 100, 140]) AS radius_m)
    ON sqrt(px_x * px_x + px_y * px_y) <= radius_m GROUP BY 1, 2, 3) SELECT radius_m, {rsql('avg(f)', 'mean_fine')}, {rsql('avg(c)', 'mean_coarse')}, {rsql('avg(abs(f - c))', 'mean_abs_diff')} FROM m GROUP BY 1""",
)
def _(v):
    both = downscale.coarsen(v.pixels, SCENE, "px_x", "px_y", 60.0, ["LST"])
    coarse = both.drop("LST").withColumnRenamed("LST_coarse", "LST")
    out = pixels.compare_scales(v.pixels, coarse, SCENE, "LST", (60, 100, 140))
    return out.select("radius_m", r("mean_fine"), r("mean_coarse"), r("mean_abs_diff"))


@query(
    "r21_scale_sensitivity",
    f"WITH {RADII} SELECT site, radius_m, variable, {rsql('median(x)', 'median')} FROM (SELECT site, radius_m, 'LST' AS variable, LST AS x FROM rad UNION ALL SELECT site, radius_m, 'NDVI', NDVI FROM rad) GROUP BY 1, 2, 3 HAVING count(x) > 0",
)
def _(v):
    return pixels.scale_sensitivity(radii(v), ["site", "radius_m"], ["LST", "NDVI"]).select("site", "radius_m", "variable", r("median"))


@query(
    "s10_pixel_table",
    f"SELECT site, date, px_x, px_y, {rsql('w', 'fp_weight')}, {rsql('LST', 'LST_K')}, {rsql('NDVI')}, {rsql('MNDWI')} FROM strict WHERE LST IS NOT NULL AND w > 0",
)
def _(v):
    from brackish.session import durable_folder
    from brackish.sources.sinks import write_pixels
    import uuid

    rows = v.strict.where("LST IS NOT NULL AND w > 0").select("site", "date", "px_x", "px_y", F.col("w").alias("fp_weight"), F.col("LST").alias("LST_K"), "NDVI", "MNDWI")
    path = f"{durable_folder(v.spark)}/pixels-{uuid.uuid4().hex}"
    write_pixels(rows, path)
    back = v.spark.read.parquet(path)
    return back.select("site", "date", "px_x", "px_y", r("fp_weight"), r("LST_K"), r("NDVI"), r("MNDWI"))


@query(
    "t18_scene_collapse",
    f"SELECT site, date, {rsql('avg(LST)', 'LST')}, {rsql('max(vf)', 'vf')} FROM (SELECT site, date, scene, avg(LST) AS LST, count(LST) / count(*) AS vf FROM clear GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def _(v):
    scenes = v.clear.groupBy("site", "date", "scene").agg(F.avg("LST").alias("LST"), (F.count("LST") / F.count(F.lit(1))).alias("vf"))
    return series.collapse_timestamps(scenes, ["site", "date"], ["LST"], ["vf"]).select("site", "date", r("LST"), r("vf"))
