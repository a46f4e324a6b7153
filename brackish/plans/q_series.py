"""Queries on time series: resampling, gaps, staleness, trailing windows, gap filling."""

from pyspark.sql import functions as F

from brackish.operators import blocks, fusion, models, series
from brackish.plans.registry import query, r, rsql


def filled_sql(source: str, col: str, limit: int, mode: str = "prefix") -> str:
    """Linear filling of `col` of a dense daily relation (site, date, col), as a subquery."""
    rule = f"date - pd <= {limit}" if mode == "prefix" else f"nd - pd - 1 <= {limit}"
    return f"""(SELECT site, date, v AS obs, date - pd AS age,
      CASE WHEN v IS NOT NULL THEN v WHEN nd IS NOT NULL AND {rule} THEN pv + (nv - pv) * (date - pd) / (nd - pd) END AS filled FROM (
      SELECT site, date, {col} AS v, last_value({col} IGNORE NULLS) OVER p AS pv, first_value({col} IGNORE NULLS) OVER f AS nv,
      last_value(CASE WHEN {col} IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd,
      first_value(CASE WHEN {col} IS NOT NULL THEN date END IGNORE NULLS) OVER f AS nd FROM {source}
      WINDOW p AS (PARTITION BY site ORDER BY date ROWS UNBOUNDED PRECEDING),
      f AS (PARTITION BY site ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


def dense_sql(source: str) -> str:
    return f"""(SELECT g.site, g.date, s.* EXCLUDE (site, date) FROM (SELECT site, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
      FROM {source} GROUP BY site) g LEFT JOIN {source} s USING (site, date))"""


def dense_et(v):
    return series.dense_daily(v.et_daily, ["site"]).withColumn("slot", blocks.day_slot("date"))


@query(
    "t1_t2_resample_daily",
    f"""SELECT site, date, {rsql('avg(LE)', 'LE_mean')}, {rsql('max(LE)', 'LE_max')}, {rsql('min(LE)', 'LE_min')},
    {rsql('sum(LE)', 'LE_sum')}, {rsql('stddev_samp(LE)', 'LE_std')}, {rsql('max(LE) - min(LE)', 'LE_range')} FROM flux_hh GROUP BY 1, 2""",
)
def _(v):
    aggs = {f"LE_{how}": ("LE", how) for how in ("mean", "max", "min", "sum", "std")}
    day = series.resample_daily(v.flux_hh.withColumnRenamed("date", "_d"), ["site"], "ts", aggs)
    return day.select("site", "date", *[r(c) for c in aggs], r(F.col("LE_max") - F.col("LE_min"), "LE_range"))


@query("t3_upsample_half_hourly", f"SELECT site, slot, {rsql('level')} FROM tide_hh")
def _(v):
    up = series.upsample_hourly(v.tide, ["site"], "ts", "level")
    return up.select("site", blocks.step_slot("ts", 1800).alias("slot"), r("level"))


@query("t4_densify", f"SELECT site, date, {rsql('ET')} FROM et_dense")
def _(v):
    return series.dense_daily(v.et_daily, ["site"]).select("site", "date", r("ET"))


@query(
    "t4_densify_fixed_period",
    f"""SELECT g.site, g.date, {rsql('e.ET', 'ET')} FROM (SELECT site, CAST(unnest(generate_series(DATE '1997-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT DISTINCT site FROM et_daily)) g LEFT JOIN et_daily e USING (site, date)""",
)
def _(v):
    return series.dense_daily(v.et_daily, ["site"], lo="1997-01-01", hi="1998-12-31").select("site", "date", r("ET"))


@query("t5_interpolate_prefix", f"SELECT site, date, {rsql('filled', 'ET_int')} FROM {filled_sql('et_dense', 'ET', 16)}")
def _(v):
    sparse = v.et_daily.select("site", blocks.day_slot("date").alias("slot"), "ET")
    out = series.fill_dense(sparse, ["site"], "slot", ["ET"], 16)
    return out.select("site", F.date_from_unix_date(F.col("slot").cast("int")).alias("date"), r("ET_int"))


@query(
    "t5_interpolate_whole_gap",
    f"SELECT site, date, {rsql('filled', 'ET_int')} FROM {filled_sql('et_dense', 'ET', 16, 'whole_gap')}",
)
def _(v):
    return series.interpolate(dense_et(v), ["site"], "slot", ["ET"], 16, "whole_gap").select("site", "date", r("ET_int"))


@query("t6_observation_age", f"SELECT site, date, CAST(age AS BIGINT) AS age FROM {filled_sql('et_dense', 'ET', 16)}")
def _(v):
    out = series.interpolate(dense_et(v), ["site"], "slot", ["ET"], 16, age=True)
    return out.select("site", "date", F.col("ET_age").alias("age"))


@query(
    "t7_staleness_triplets",
    f"""WITH d AS {dense_sql('sat_daily')} SELECT a.site, a.date, {rsql('a.obs', 'LST_K_obs')}, {rsql('a.filled', 'LST_K_int')}, CAST(a.age AS BIGINT) AS LST_K_age,
    {rsql('b.obs', 'NDVI_obs')}, {rsql('b.filled', 'NDVI_int')}, CAST(b.age AS BIGINT) AS NDVI_age
    FROM {filled_sql('d', 'LST_K', 16)} a JOIN {filled_sql('d', 'NDVI', 16)} b USING (site, date)""",
)
def _(v):
    out = series.with_staleness(v.sat_daily, ["site"], "date", ["LST_K", "NDVI"])
    return out.select("site", "date", *[c for n in ("LST_K", "NDVI") for c in (r(f"{n}_obs"), r(f"{n}_int"), F.col(f"{n}_age"))])


@query(
    "t8_rolling_rows",
    f"""SELECT site, date, {rsql('sum(ET) OVER w7', 'ET_7')}, {rsql('CASE WHEN count(ET) OVER w30 >= 10 THEN avg(ET) OVER w30 END', 'ET_30')} FROM et_daily
    WINDOW w7 AS (PARTITION BY site ORDER BY date ROWS 6 PRECEDING), w30 AS (PARTITION BY site ORDER BY date ROWS 29 PRECEDING)""",
)
def _(v):
    rows = v.et_daily.withColumn("slot", blocks.day_slot("date"))
    week = series.rolling(rows, ["site"], "slot", 7, {"ET_7": ("ET", "sum")})
    out = series.rolling(week, ["site"], "slot", 30, {"ET_30": ("ET", "mean")}, min_periods=10)
    return out.select("site", "date", r("ET_7"), r("ET_30"))


@query(
    "t8_rolling_calendar",
    f"""SELECT site, date, {rsql('sum(pr) OVER (PARTITION BY site ORDER BY date ROWS 6 PRECEDING)', 'P_7d')},
    {rsql('sum(pr) OVER (PARTITION BY site ORDER BY date ROWS 29 PRECEDING)', 'P_30d')} FROM met_daily""",
)
def _(v):
    rows = v.met_daily.withColumn("slot", blocks.day_slot("date"))
    out = blocks.trailing(
        rows, ["site"], "slot", {"P_7d": (7, lambda w: F.sum("pr").over(w)), "P_30d": (30, lambda w: F.sum("pr").over(w))}
    )
    return out.select("site", "date", r("P_7d"), r("P_30d"))


@query(
    "t9_rolling_time_median",
    f"""SELECT site, date, {rsql('quantile_cont(ET, 0.5) OVER (PARTITION BY site ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)', 'ET_90d')} FROM et_daily""",
)
def _(v):
    return series.rolling_days(v.et_daily, ["site"], "date", 90, {"ET_90d": ("ET", "median")}).select("site", "date", r("ET_90d"))


@query(
    "t10_rolling_masked",
    f"""SELECT site, date, {rsql('CASE WHEN count(ET) OVER w >= 3 AND count(*) OVER w - count(ET) OVER w < 25 THEN avg(ET) OVER w END', 'ET_roll')} FROM et_dense
    WINDOW w AS (PARTITION BY site ORDER BY date ROWS 29 PRECEDING)""",
)
def _(v):
    return series.rolling_masked(v.et_daily, ["site"], "date", "ET", min_periods=3).select("site", "date", r("ET_roll"))


@query(
    "t11_t12_tide_features",
    f"""WITH q AS (SELECT site, quantile_cont(level, 0.9) AS hi FROM tide_hh GROUP BY 1)
    SELECT site, slot, {rsql('level', 'water_level_m')}, {rsql('(level - lag(level) OVER o) * 2', 'wl_rate_m_per_hr')}, {rsql('avg(level) OVER w48', 'wl_mean_24h')},
    {rsql('max(level) OVER w48', 'wl_max_24h')}, {rsql('avg(level) OVER w336', 'wl_mean_7d')},
    {rsql('avg(CASE WHEN level > hi THEN 1.0 ELSE 0.0 END) OVER w48', 'inundation_frac_24h')} FROM tide_hh JOIN q USING (site)
    WINDOW o AS (PARTITION BY site ORDER BY slot), w48 AS (PARTITION BY site ORDER BY slot ROWS 47 PRECEDING), w336 AS (PARTITION BY site ORDER BY slot ROWS 335 PRECEDING)""",
)
def _(v):
    out = series.tide_features(v.tide.withColumnRenamed("level", "water_level_m"), ["site"])
    cols = ["water_level_m", "wl_rate_m_per_hr", "wl_mean_24h", "wl_max_24h", "wl_mean_7d", "inundation_frac_24h"]
    return out.select("site", blocks.step_slot("ts", 1800).alias("slot"), *[r(c) for c in cols])


@query(
    "t1_daily_tide_features",
    f"""SELECT site, CAST(DATE '1970-01-01' + CAST(hr // 24 AS INTEGER) AS DATE) AS date, {rsql('avg(level)', 'WL_mean_m')}, {rsql('max(level)', 'WL_max_m')},
    {rsql('min(level)', 'WL_min_m')}, {rsql('max(level) - min(level)', 'WL_range_m')}, {rsql('stddev_samp(level * 2)', 'WL_rate_std')} FROM tide GROUP BY 1, 2""",
)
def _(v):
    rows = v.tide.select(
        "site", "ts", F.col("level").alias("water_level_m"), (F.col("level") * 2).alias("wl_rate_m_per_hr"), F.lit(0.0).alias("inundation_frac_24h")
    )
    cols = ["WL_mean_m", "WL_max_m", "WL_min_m", "WL_range_m", "WL_rate_std"]
    return series.daily_tide(rows).select("site", "date", *[r(c) for c in cols])


ACCUM = "sum(level) OVER (PARTITION BY site, hr // 24 ORDER BY hr ROWS UNBOUNDED PRECEDING)"


@query(
    "t13_deaccumulate",
    f"""SELECT site, hr, {rsql('CASE WHEN lag(tp) OVER d IS NULL THEN tp ELSE tp - lag(tp) OVER d END', 'tp')} FROM (SELECT site, hr, {ACCUM} AS tp FROM tide)
    WINDOW d AS (PARTITION BY site, hr // 24 ORDER BY hr)""",
)
def _(v):
    from pyspark.sql import Window

    day = Window.partitionBy("site", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = v.tide.withColumn("tp", F.sum("level").over(day))
    return series.deaccumulate(rows, ["site"], "ts", ["tp"]).select("site", "hr", r("tp"))


@query(
    "t14_day_features",
    f"SELECT site, date, CAST(dayofyear(date) AS INTEGER) AS DOY, {rsql('sin(2 * pi() * dayofyear(date) / 365.25)', 'DOY_sin')}, {rsql('cos(2 * pi() * dayofyear(date) / 365.25)', 'DOY_cos')} FROM et_daily",
)
def _(v):
    from brackish.functions.meteorology import day_features

    f = day_features(F.col("date"))
    return v.et_daily.select("site", "date", f["DOY"].alias("DOY"), r(f["DOY_sin"], "DOY_sin"), r(f["DOY_cos"], "DOY_cos"))


@query(
    "t15_period_mean_8_day",
    f"""SELECT site, CAST(s + CAST((date - s) // 8 * 8 AS INTEGER) AS DATE) AS date, {rsql('avg(ET)', 'ET')} FROM et_daily JOIN (SELECT site, min(date) AS s FROM et_daily GROUP BY 1) USING (site)
    GROUP BY 1, 2 HAVING count(ET) >= 2""",
)
def _(v):
    return series.period_mean(v.et_daily, ["site"], "date", ["ET"], "ET", "8D", 2).select("site", "date", r("ET"))


@query(
    "t15_period_mean_month",
    f"SELECT site, CAST(date_trunc('month', date) AS DATE) AS date, {rsql('avg(ET)', 'ET')} FROM et_daily GROUP BY 1, 2 HAVING count(ET) >= 3",
)
def _(v):
    return series.period_mean(v.et_daily, ["site"], "date", ["ET"], "ET", "month", 3).select("site", "date", r("ET"))


@query(
    "t16_monthly_grid",
    "SELECT site, CAST(year(date) AS INTEGER) AS year, "
    + ", ".join(rsql(f"CASE WHEN count(CASE WHEN month(date) = {m} THEN ET END) >= 3 THEN avg(CASE WHEN month(date) = {m} THEN ET END) END", f"m{m:02d}") for m in range(1, 13))
    + " FROM et_daily GROUP BY 1, 2",
)
def _(v):
    grid = series.monthly_grid(v.et_daily, ["site"], "date", "ET", need=3)
    return grid.select("site", "year", *[r(f"m{m:02d}") for m in range(1, 13)])


@query(
    "t17_combine_first",
    f"""SELECT coalesce(a.site, b.site, c.site) AS site, coalesce(a.date, b.date, c.date) AS date, {rsql('coalesce(a.ET, b.NDVI, c.NDVI2)', 'x')}, {rsql('coalesce(b.LST_K, c.NDVI2 * 100)', 'y')}
    FROM et_daily a FULL JOIN sat_daily b ON a.site = b.site AND a.date = b.date
    FULL JOIN sat2_daily c ON coalesce(a.site, b.site) = c.site AND coalesce(a.date, b.date) = c.date""",
)
def _(v):
    first = v.et_daily.select("site", "date", F.col("ET").alias("x"))
    second = v.sat_daily.select("site", "date", F.col("NDVI").alias("x"), F.col("LST_K").alias("y"))
    third = v.sat2_daily.select("site", "date", F.col("NDVI2").alias("x"), (F.col("NDVI2") * 100).alias("y"))
    return series.combine_first(["site", "date"], first, second, third).select("site", "date", r("x"), r("y"))


@query("t18_collapse_timestamps", f"SELECT site, date, {rsql('avg(NDVI)', 'NDVI')}, {rsql('max(MNDWI)', 'MNDWI')} FROM sat_obs GROUP BY 1, 2")
def _(v):
    return series.collapse_timestamps(v.sat_obs, ["site", "date"], ["NDVI"], ["MNDWI"]).select("site", "date", r("NDVI"), r("MNDWI"))


OVERPASS = """ef AS (SELECT site, date, avg(LE) AS LE_inst, avg(NETRAD) - avg(coalesce(G, 0)) AS avail FROM flux_hh WHERE hour >= 15 AND hour < 17 GROUP BY 1, 2
    HAVING avg(NETRAD) - avg(coalesce(G, 0)) > 50),
    rd AS (SELECT site, date, sum(greatest(coalesce(NETRAD - coalesce(G, 0), 0), 0)) * 1800.0 / 2.45e6 AS Rd_day FROM flux_hh GROUP BY 1, 2
    HAVING sum(greatest(coalesce(NETRAD - coalesce(G, 0), 0), 0)) * 1800.0 / 2.45e6 > 0.5)"""
EF = "least(greatest(LE_inst / avail, 0), 1.2)"


@query("t19_overpass_fraction", f"WITH {OVERPASS} SELECT site, date, {rsql(EF, 'EF')}, {rsql('LE_inst')}, {rsql('avail')} FROM ef")
def _(v):
    return series.overpass_fraction(v.flux_hh.drop("date")).select("site", "date", r("EF"), r("LE_inst"), r("avail"))


@query("t20_daytime_energy", f"WITH {OVERPASS} SELECT site, date, {rsql('Rd_day')} FROM rd")
def _(v):
    return series.daytime_energy(v.flux_hh.drop("date")).select("site", "date", r("Rd_day"))


@query("t21_scaled_daily_et", f"WITH {OVERPASS} SELECT site, date, {rsql(f'{EF} * Rd_day', 'ET_daily_from_EF')} FROM ef JOIN rd USING (site, date)")
def _(v):
    return series.scaled_daily_et(v.flux_hh.drop("date")).select("site", "date", r("ET_daily_from_EF"))


GAPFILL = f"""rel AS (SELECT d.site, d.date, d.ET, m.pet, CASE WHEN d.ET / nullif(m.pet, 0) < 0 THEN 0 WHEN d.ET / nullif(m.pet, 0) > 2 THEN 2 ELSE d.ET / nullif(m.pet, 0) END AS ef FROM et_dense d LEFT JOIN met_daily m USING (site, date)),
    gf AS (SELECT r.site, r.date, r.ET, f.filled AS EF, r.ET IS NULL AND f.filled * r.pet IS NOT NULL AS is_filled, coalesce(r.ET, f.filled * r.pet) AS ET_gapfilled
    FROM rel r JOIN {filled_sql('rel', 'ef', 30)} f USING (site, date))"""


def filled(v):
    return series.gapfill_reference(v.et_daily, v.met_daily, ["site"], eto="pet")


@query("t22_gapfill_reference", f"WITH {GAPFILL} SELECT site, date, {rsql('ET')}, {rsql('EF')}, is_filled, {rsql('ET_gapfilled')} FROM gf")
def _(v):
    return filled(v).select("site", "date", r("ET"), r("EF"), "is_filled", r("ET_gapfilled"))


@query(
    "t23_gapfill_report",
    f"""WITH {GAPFILL} SELECT site, count(*) AS days, count(ET) AS measured, count(CASE WHEN is_filled THEN 1 END) AS filled, count(CASE WHEN ET_gapfilled IS NULL THEN 1 END) AS still_missing,
    {rsql('count(ET) * 100.0 / count(*)', 'pct_measured')}, {rsql('(count(ET) + count(CASE WHEN is_filled THEN 1 END)) * 100.0 / count(*)', 'pct_after')},
    {rsql('avg(ET)', 'mean_measured')}, {rsql('avg(CASE WHEN is_filled THEN ET_gapfilled END)', 'mean_filled')} FROM gf GROUP BY 1""",
)
def _(v):
    rep = series.gapfill_report(filled(v), ["site"])
    return rep.select("site", "days", "measured", "filled", "still_missing", r("pct_measured"), r("pct_after"), r("mean_measured"), r("mean_filled"))


@query(
    "t24_gapfill_model",
    f"""WITH j AS (SELECT coalesce(e.site, m.site) AS site, coalesce(e.date, m.date) AS date, e.ET, m.tmmx FROM et_daily e FULL JOIN met_daily m ON e.site = m.site AND e.date = m.date),
    c AS (SELECT site, regr_slope(ET, tmmx) AS b, regr_intercept(ET, tmmx) AS a FROM j WHERE ET IS NOT NULL GROUP BY 1)
    SELECT site, date, {rsql('ET', 'ET_measured')}, {rsql('a + b * tmmx', 'ET_predicted')}, {rsql('coalesce(ET, a + b * tmmx)', 'ET_final')}, ET IS NULL AND a + b * tmmx IS NOT NULL AS is_filled FROM j LEFT JOIN c USING (site)""",
)
def _(v):
    from brackish.operators.linear import LinearModel

    out = models.gapfill_model(v.et_daily, v.met_daily, ["site"], ["tmmx"], model=LinearModel("line", ("tmmx",), "ols"))
    return out.select("site", "date", r("ET_measured"), r("ET_predicted"), r("ET_final"), "is_filled")


@query(
    "t25_overlap_counts",
    f"""WITH {GAPFILL}, o AS (SELECT DISTINCT site, date FROM sat_obs)
    SELECT site, count(ET) AS with_measured, count(CASE WHEN is_filled THEN 1 END) AS with_filled FROM o JOIN gf USING (site, date) GROUP BY 1""",
)
def _(v):
    return series.overlap_counts(v.sat_obs, filled(v), ["site"])


@query(
    "t26_stride_sample",
    """SELECT site, slot FROM (SELECT site, slot, row_number() OVER (PARTITION BY site ORDER BY slot) - 1 AS p, greatest(1, count(*) OVER (PARTITION BY site) // 100) AS s
    FROM flux_hh WHERE LE IS NOT NULL) WHERE p % s = 0 AND p / s < 100""",
)
def _(v):
    return series.stride_sample(v.flux_hh.where("LE IS NOT NULL"), ["site"], "slot", 100).select("site", "slot")


@query(
    "t27_best_per_day",
    """SELECT site, date, scene, cloud FROM (SELECT *, row_number() OVER (PARTITION BY site, date ORDER BY cloud, scene) AS n FROM
    (SELECT DISTINCT site, date, scene, scene % 40 AS cloud FROM pixels)) WHERE n = 1""",
)
def _(v):
    scenes = v.pixels.select("site", "date", "scene", (F.col("scene") % 40).alias("cloud")).distinct()
    return series.best_per_day(scenes, ["site"], "date", "cloud", "scene")


@query(
    "x4_thermal_daily",
    f"""WITH d AS {dense_sql('sat_daily')} SELECT site, date, {rsql('obs', 'LST_K_obs')}, {rsql('filled', 'LST_K_int')}, CAST(age AS BIGINT) AS LST_K_age FROM {filled_sql('d', 'LST_K', 16)}""",
)
def _(v):
    return fusion.thermal_daily(v.sat_obs, ["site"], "date", ["LST_K"]).select("site", "date", r("LST_K_obs"), r("LST_K_int"), "LST_K_age")
