"""Queries on joins in time and space, and on site inventories."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from brackish.operators import blocks, catalog, fusion, joins
from brackish.plans.registry import query, r, rsql


@query(
    "j1_join_streams",
    f"""SELECT e.site, e.date, {rsql('e.ET', 'ET')}, {rsql('m.tmmx', 'tmmx')}, {rsql('s.LST_K', 'LST_K')}, {rsql('t.NDVI2', 'NDVI2')} FROM et_daily e
    LEFT JOIN met_daily m USING (site, date) LEFT JOIN sat_daily s USING (site, date) LEFT JOIN sat2_daily t USING (site, date)""",
)
def _(v):
    out = joins.join_streams(v.et_daily, ["site", "date"], v.met_daily, v.sat_daily, v.sat2_daily)
    return out.select("site", "date", r("ET"), r("tmmx"), r("LST_K"), r("NDVI2"))


@query(
    "j2_training_table",
    f"""SELECT s.site, s.date, CAST(year(s.date) AS INTEGER) AS year, {rsql('s.LST_K', 'LST_K')}, {rsql('s.NDVI', 'NDVI')}, {rsql('e.ET', 'ET')}, {rsql('m.srad', 'srad')}, {rsql('m.pet', 'pet')},
    {rsql('sin(2 * pi() * dayofyear(s.date) / 365.25)', 'DOY_sin')} FROM sat_daily s JOIN et_daily e USING (site, date) LEFT JOIN met_daily m USING (site, date)
    WHERE s.LST_K IS NOT NULL AND m.srad IS NOT NULL""",
)
def _(v):
    from brackish.plans.training_table import training_table

    out = training_table(v.sat_daily, v.et_daily, v.met_daily, ["LST_K", "NDVI"], ["srad", "pet"])
    return out.select("site", "date", "year", r("LST_K"), r("NDVI"), r("ET"), r("srad"), r("pet"), r("DOY_sin"))


@query(
    "j3_pixels_by_date",
    f"SELECT site, p.date, scene, pos, {rsql('LST')}, {rsql('ET')} FROM pixels p JOIN (SELECT 'L' || CAST(k AS VARCHAR) AS site, date, LE / 10 AS ET FROM "
    "(SELECT date, k, avg(LE) AS LE FROM flux_hh, range(10) t(k) GROUP BY 1, 2)) d USING (site, date)",
)
def _(v):
    day = v.flux_hh.groupBy("date").agg((F.avg("LE") / 10).alias("ET"))
    sites = day.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        F.concat(F.lit("L"), F.col("k").cast("string")).alias("site"), "date", "ET"
    )
    return v.pixels.join(sites, ["site", "date"]).select("site", "date", "scene", "pos", r("LST"), r("ET"))


ASOF = """(SELECT l.site, l.date, l.LST_K, r.date AS rd, r.NDVI2, abs(r.date - l.date) AS gap, row_number() OVER (PARTITION BY l.site, l.date ORDER BY abs(r.date - l.date), r.date) AS n
    FROM sat_daily l LEFT JOIN sat2_daily r ON r.site = l.site AND r.date BETWEEN l.date - 2 AND l.date + 2)"""


@query("j4_asof_nearest", f"SELECT site, date, {rsql('LST_K')}, CAST(rd AS DATE) AS matched, CAST(gap AS DOUBLE) AS gap, {rsql('NDVI2')} FROM {ASOF} WHERE n = 1")
def _(v):
    left = v.sat_daily.select("site", "date", "LST_K", blocks.day_slot("date").alias("t"))
    right = v.sat2_daily.select("site", blocks.day_slot("date").alias("t"), "NDVI2")
    out = joins.asof_nearest(left, right, ["site"], "t", 2, ["NDVI2"])
    matched = F.date_from_unix_date(F.col("t_match").cast("int"))
    return out.select("site", "date", r("LST_K"), matched.alias("matched"), F.col("t_gap").cast("double").alias("gap"), r("NDVI2"))


@query(
    "j5_nearest_scene",
    f"""WITH c AS (SELECT DISTINCT site, scene, date, scene * 3600 % 86400 + (date - DATE '1970-01-01') * 86400 AS t FROM pixels),
    f AS (SELECT site, scene + 100000 AS fine, scene * 7919 % 86400 + (date - DATE '1970-01-01') * 86400 + 200000 AS t FROM (SELECT DISTINCT site, scene, date FROM pixels WHERE scene % 3 = 0)),
    g AS (SELECT site, t, min(fine) AS fine FROM f GROUP BY 1, 2)
    SELECT site, scene, CAST(fine AS DOUBLE) AS fine, {rsql('gap / 86400.0', 'gap_days')} FROM (SELECT c.site, c.scene, CASE WHEN abs(g.t - c.t) <= 259200 THEN g.fine END AS fine,
    CASE WHEN abs(g.t - c.t) <= 259200 THEN abs(g.t - c.t) END AS gap, row_number() OVER (PARTITION BY c.site, c.scene ORDER BY abs(g.t - c.t), g.t) AS n
    FROM c LEFT JOIN g ON c.site = g.site) WHERE n = 1""",
)
def _(v):
    scenes = v.pixels.select("site", "scene", "date").distinct()
    day = blocks.day_slot("date") * 86400
    coarse = scenes.select("site", "scene", (F.col("scene") * 3600 % 86400 + day).alias("t"))
    fine = scenes.where("scene % 3 = 0").select(
        "site", (F.col("scene") + 100000).alias("fine"), (F.col("scene") * 7919 % 86400 + day + 200000).alias("t")
    )
    fine = fine.groupBy("site", "t").agg(F.min("fine").alias("fine"))
    out = joins.asof_nearest(coarse, fine, ["site"], "t", 3 * 86400, ["fine"])
    return out.select("site", "scene", F.col("fine").cast("double").alias("fine"), r(F.col("t_gap") / 86400.0, "gap_days"))


HAVERSINE = """2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * power(sin(radians(glon - lon) / 2), 2))))"""


@query(
    "j6_nearest_gauge",
    f"SELECT site, gauge, {rsql('km', 'dist_km')} FROM (SELECT site, gauge, km, row_number() OVER (PARTITION BY site ORDER BY km, gauge) AS n FROM (SELECT site, gauge, {HAVERSINE} AS km FROM geo_sites CROSS JOIN gauges)) WHERE n = 1",
)
def _(v):
    return joins.nearest_place(v.geo_sites, v.gauges, "lat", "lon", "gauge", "glat", "glon").select("site", "gauge", r("dist_km"))


GRID = "(SELECT gy, gx, avg(s_acctbal) AS value FROM (SELECT s_acctbal, CAST((s_suppkey * 7) % 21 AS BIGINT) AS gy, CAST((s_suppkey * 11) % 51 AS BIGINT) AS gx FROM supplier) GROUP BY 1, 2)"


@query(
    "j7_nearest_grid_cell",
    f"SELECT site, {rsql('value')} FROM geo_sites LEFT JOIN {GRID} g ON CAST(round(lat - 25.005) AS BIGINT) = g.gy AND CAST(round(lon + 120.005) AS BIGINT) = g.gx",
)
def _(v):
    grid = (
        v.table("supplier")
        .groupBy((F.col("s_suppkey") * 7 % 21).alias("gy"), (F.col("s_suppkey") * 11 % 51).alias("gx"))
        .agg(F.avg("s_acctbal").alias("value"))
        .select((F.col("gy") + 25.005).alias("lat"), (F.col("gx") - 120.005).alias("lon"), "value")
    )
    return joins.nearest_grid_cell(v.geo_sites, grid, "lat", "lon", 1.0, ["value"], (25.005, -120.005)).select("site", r("value"))


@query(
    "j8_nearest_valid_cell",
    f"""WITH valid AS (SELECT DISTINCT gauge AS cell, glat, glon FROM gauges JOIN orders ON o_custkey % 100 = gauge % 100 WHERE o_orderkey % 200 < 48 AND (gauge % 3 > 0))
    SELECT site, cell, {rsql('km', 'dist_km')}, km > 15 AS far FROM (SELECT site, cell, km, row_number() OVER (PARTITION BY site ORDER BY km, cell) AS n FROM
    (SELECT site, cell, sqrt(power((glat - lat) * 111.32, 2) + power((glon - lon) * 111.32 * cos(radians(lat)), 2)) AS km FROM geo_sites CROSS JOIN valid)) WHERE n = 1""",
)
def _(v):
    series = v.table("orders").select((F.col("o_custkey") % 100).alias("m"), (F.col("o_orderkey") % 200).alias("step"), "o_totalprice")
    grid = v.gauges.withColumn("m", F.col("gauge") % 100).join(series, "m").select(
        F.col("gauge").alias("cell"),
        F.col("glat").alias("cell_lat"),
        F.col("glon").alias("cell_lon"),
        "step",
        F.when(F.col("gauge") % 3 > 0, F.col("o_totalprice")).alias("value"),
    )
    return joins.nearest_valid_cell(v.geo_sites, grid, "lat", "lon", "value", "step").select("site", "cell", r("dist_km"), "far")


@query("j9_distance_to_coast", f"SELECT site, {rsql('km', 'dist_km')} FROM site_dist")
def _(v):
    return v.site_dist.select("site", r("dist_km"))


@query(
    "j10_point_in_polygon",
    "SELECT site, scene, p.pos, region FROM pixels p JOIN inside i ON p.pos = i.pos",
)
def _(v):
    out = joins.in_rings(v.pixels.select("site", "scene", "pos", "px_x", "px_y"), v.edges, "region", "px_x", "px_y")
    return out.select("site", "scene", "pos", "region")


@query(
    "j11_label_with_default",
    "SELECT c_custkey AS site, coalesce(n_name, 'alone') AS estuary FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3",
)
def _(v):
    table = v.table("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("estuary"))
    rows = v.table("customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("key"))
    return joins.lookup(rows, table, "key", "estuary", "alone").select("site", "estuary")


@query(
    "j12_inventory",
    f"SELECT site, {rsql('lat')}, count(o_orderkey) AS n_rows FROM geo_sites LEFT JOIN orders ON o_custkey = site GROUP BY site, lat",
)
def _(v):
    rows = v.table("orders").select(F.col("o_custkey").alias("site"))
    return joins.inventory(v.geo_sites, rows, "site", "lat").select("site", r("lat"), "n_rows")


@query(
    "j13_bilinear_weight",
    f"""WITH n AS (SELECT i * 40.0 AS x, j * 40.0 AS y, (i * 7 + j * 3 + 40) / 1000.0 AS w, i, j FROM range(-2, 3) a(i), range(-2, 3) b(j)),
    p AS (SELECT site, scene, pos, px_x, px_y, CAST(floor(px_x / 40) AS BIGINT) AS ci, CAST(floor(px_y / 40) AS BIGINT) AS cj FROM pixels)
    SELECT site, scene, pos, {rsql('coalesce(a.w * (1 - fx) * (1 - fy) + b.w * fx * (1 - fy) + c.w * (1 - fx) * fy + d.w * fx * fy, 0)', 'fp_weight')} FROM
    (SELECT *, px_x / 40 - ci AS fx, px_y / 40 - cj AS fy FROM p) q LEFT JOIN n a ON a.i = ci AND a.j = cj LEFT JOIN n b ON b.i = ci + 1 AND b.j = cj
    LEFT JOIN n c ON c.i = ci AND c.j = cj + 1 LEFT JOIN n d ON d.i = ci + 1 AND d.j = cj + 1""",
)
def _(v):
    side = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    nodes = v.pixels.select("site").distinct().withColumn("i", side).withColumn("j", side).select(
        "site", (F.col("i") * 40.0).alias("x"), (F.col("j") * 40.0).alias("y"), ((F.col("i") * 7 + F.col("j") * 3 + 40) / 1000.0).alias("w")
    )
    out = joins.bilinear(v.pixels.drop("w"), nodes, ["site"], "px_x", "px_y", 40.0)
    return out.select("site", "scene", "pos", r("fp_weight"))


@query(
    "j14_sensor_alignment",
    f"SELECT coalesce(a.site, b.site) AS site, coalesce(a.date, b.date) AS date, {rsql('a.LST_K', 'LST_K')}, {rsql('b.NDVI2', 'NDVI2')} FROM sat_daily a FULL JOIN sat2_daily b ON a.site = b.site AND a.date = b.date",
)
def _(v):
    return joins.align_sensors(["site", "date"], v.sat_daily, v.sat2_daily).select("site", "date", r("LST_K"), r("NDVI2"))


# -- inventories and counts ---------------------------------------------------


@query(
    "a1_buffer_counts",
    """SELECT CAST(km AS INTEGER) AS buffer_km, count(SITE_ID) AS n_all, count(CASE WHEN TIDAL_IGBP THEN 1 END) AS n_tidal, count(CASE WHEN TIDAL_IGBP AND ACTIVE THEN 1 END) AS n_tidal_active
    FROM (SELECT unnest([1, 5, 10, 25, 50, 100]) AS km) LEFT JOIN flagged ON DIST_COAST_KM <= km AND COASTAL_STATE GROUP BY 1""",
)
def _(v):
    return catalog.buffer_counts(v.flagged)


@query("a2_category_counts", "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '(none)' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(v):
    rows = v.table("customer").select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return catalog.category_counts(rows, "segment")


@query(
    "a3_core_sites",
    f"SELECT SITE_ID, {rsql('DIST_COAST_KM')}, COASTAL_STATE, TIDAL_IGBP, ACTIVE FROM flagged WHERE DIST_COAST_KM <= 100 AND COASTAL_STATE AND TIDAL_IGBP",
)
def _(v):
    return catalog.core_sites(v.flagged, 100.0).select("SITE_ID", r("DIST_COAST_KM"), "COASTAL_STATE", "TIDAL_IGBP", "ACTIVE")


@query(
    "a4_pivot_site_year",
    "SELECT site, " + ", ".join(f'count(CASE WHEN year(date) = {y} THEN 1 END) AS "{y}"' for y in range(1995, 2002)) + " FROM et_daily GROUP BY 1",
)
def _(v):
    return catalog.pivot_counts(v.et_daily.withColumn("year", F.year("date")), "site", "year", range(1995, 2002))


@query(
    "a6_box_stats",
    f"SELECT site, {rsql('quantile_cont(y, 0.25)', 'q25')}, {rsql('median(y)', 'median')}, {rsql('quantile_cont(y, 0.75)', 'q75')} FROM samples GROUP BY 1",
)
def _(v):
    return catalog.box_stats(v.samples, ["site"], "y").select("site", r("q25"), r("median"), r("q75"))


@query(
    "a6_histogram",
    "SELECT least(CAST(floor((x1 - 0.37) / (50.2 / 30)) AS BIGINT), 29) AS bin, count(*) AS n FROM samples WHERE x1 BETWEEN 0.37 AND 50.57 GROUP BY 1",
)
def _(v):
    return catalog.histogram(v.samples, "x1", 0.37, 50.57)


SPLIT = "((((7 * 31 + CAST(substr(site, 2) AS BIGINT) % 1000003 * 7919) % 1000003) * 31 + (date - DATE '1970-01-01') % 1000003 * 7919) % 1000003 * 104729) % 1000003 % 1000"


@query("a8_v6_block_split", f"SELECT site, date, {SPLIT} < 700 AS is_train, count(*) AS n FROM sat_obs GROUP BY 1, 2, 3")
def _(v):
    keys = [F.substring("site", 2, 2).cast("long"), blocks.day_slot("date")]
    return catalog.block_split(v.sat_obs, keys).groupBy("site", "date", "is_train").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a9_top_k",
    f"SELECT CAST(row_number() OVER (ORDER BY ET DESC, site, date) AS INTEGER) AS place, site, date, {rsql('ET')} FROM et_daily ORDER BY place LIMIT 25",
)
def _(v):
    order = [F.desc("ET"), F.col("site"), F.col("date")]
    best = catalog.top_k(v.et_daily, order, 25)  # a report of 25 rows, so one window over it is bounded
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "site", "date", r("ET"))


@query(
    "a10_sorted_rows",
    f"SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY ET, date) AS INTEGER) AS place, date, {rsql('ET')} FROM et_daily",
)
def _(v):
    rows = v.et_daily.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("ET", "date")))
    return rows.orderBy("site", "place").select("site", "place", "date", r("ET"))


@query("a11_members", "SELECT site, count(*) AS n FROM et_daily WHERE site NOT IN ('S01', 'S05') GROUP BY 1")
def _(v):
    return catalog.members(v.et_daily, "site", ["S01", "S05"], exclude=True).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a12_column_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {rsql(f'avg({c})', 'mean')}, {rsql(f'stddev_samp({c})', 'std')}, {rsql(f'CAST(min({c}) AS DOUBLE)', 'min')}, {rsql(f'CAST(max({c}) AS DOUBLE)', 'max')} FROM samples"""
        for c in ("x1", "x2", "x3", "y")
    ),
)
def _(v):
    return catalog.column_summary(v.samples, ["x1", "x2", "x3", "y"]).select("column", "count", r("mean"), r("std"), r("min"), r("max"))


@query("a13_availability", "SELECT site, count(LE) AS LE, count(G) AS G, count(USTAR) AS USTAR, count(QC) AS QC FROM flux_hh GROUP BY 1")
def _(v):
    from brackish.operators.pixels import availability

    return availability(v.flux_hh, ["site"], ["LE", "G", "USTAR", "QC"])


@query(
    "a14_bin_counts_2d",
    "SELECT CAST(floor(y / 0.31) AS BIGINT) AS bin_x, CAST(floor((0.05 * x1 + x2) / 0.31) AS BIGINT) AS bin_y, count(*) AS n FROM samples GROUP BY 1, 2",
)
def _(v):
    return catalog.bin_counts_2d(v.samples.withColumn("pred", F.col("x1") * 0.05 + F.col("x2")), "y", "pred", 0.31)


@query(
    "a15_first_source",
    f"""SELECT coalesce(a.id, b.id) AS id, {rsql('CASE WHEN a.id IS NOT NULL THEN a.x ELSE b.x END', 'x')} FROM (SELECT c_custkey AS id, c_acctbal AS x FROM customer WHERE c_nationkey < 12) a
    FULL JOIN (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier) b ON a.id = b.id""",
)
def _(v):
    a = v.table("customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    b = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return catalog.first_source(["id"], a, b).select("id", r("x"))


# -- fusion ---------------------------------------------------------------------


PAIRS = """pairs AS (SELECT site, a, b FROM (SELECT l.site, l.NDVI AS a, r.NDVI2 AS b, row_number() OVER (PARTITION BY l.site, l.date ORDER BY abs(r.date - l.date), r.date) AS n
    FROM sat_daily l JOIN sat3_daily r ON r.site = l.site AND r.date BETWEEN l.date - 2 AND l.date + 2) WHERE n = 1),
    lines AS (SELECT site, count(*) AS n_pairs, regr_slope(a, b) AS slope, regr_intercept(a, b) AS intercept, corr(a, b) AS r, count(*) >= 8 AND stddev_samp(b) > 1e-3 AND abs(corr(a, b)) >= 0.3 AS ok FROM pairs GROUP BY 1)"""


@query("x1_calibration", f"WITH {PAIRS} SELECT site, n_pairs, {rsql('slope')}, {rsql('intercept')}, {rsql('r')}, coalesce(ok, false) AS accepted FROM lines")
def _(v):
    out = fusion.calibrate(v.sat_daily, v.sat3_daily, ["site"], "NDVI", "NDVI2")
    return out.select("site", "n_pairs", r("slope"), r("intercept"), r("r"), "accepted")


def fused(v):
    lines = fusion.calibrate(v.sat_daily, v.sat2_daily.unionByName(v.sat3_daily).groupBy("site", "date").agg(F.avg("NDVI2").alias("NDVI2")), ["site"], "NDVI", "NDVI2")
    return fusion.fuse(v.sat_daily, v.sat2_daily, lines, ["site"], "NDVI", "NDVI2")


FUSED = """s23 AS (SELECT site, date, avg(NDVI2) AS NDVI2 FROM (SELECT * FROM sat2_daily UNION ALL SELECT * FROM sat3_daily) GROUP BY 1, 2),
    pairs AS (SELECT site, a, b FROM (SELECT l.site, l.NDVI AS a, r.NDVI2 AS b, row_number() OVER (PARTITION BY l.site, l.date ORDER BY abs(r.date - l.date), r.date) AS n
    FROM sat_daily l JOIN s23 r ON r.site = l.site AND r.date BETWEEN l.date - 2 AND l.date + 2) WHERE n = 1),
    lines AS (SELECT site, regr_slope(a, b) AS slope, regr_intercept(a, b) AS intercept FROM pairs GROUP BY 1
    HAVING count(*) >= 8 AND stddev_samp(b) > 1e-3 AND abs(corr(a, b)) >= 0.3),
    fused AS (SELECT coalesce(a.site, b.site) AS site, coalesce(a.date, b.date) AS date, a.NDVI, b.NDVI2 FROM sat_daily a FULL JOIN sat2_daily b ON a.site = b.site AND a.date = b.date),
    filled AS (SELECT f.site, f.date, f.NDVI, coalesce(f.NDVI, intercept + slope * NDVI2) AS fused FROM fused f LEFT JOIN lines USING (site))"""


@query("x2_fusion", f"WITH {FUSED} SELECT site, date, {rsql('fused')} FROM filled")
def _(v):
    return fused(v).select("site", "date", r("fused"))


@query("x3_fusion_gain", f"WITH {FUSED} SELECT site, count(NDVI) AS primary_days, count(fused) AS fused_days, count(fused) - count(NDVI) AS gained FROM filled GROUP BY 1")
def _(v):
    return fusion.fusion_gain(fused(v), ["site"], "NDVI")
