"""Queries on quality control, energy balance and daily ET."""

from pyspark.sql import functions as F

from brackish.functions import energy, gates
from brackish.operators import catalog, checks, flux, series
from brackish.plans.registry import query, r, rsql

COVERAGE = 0.45  # the stand-in record is sparse; the operators' default is 0.80


def gated(v):
    return flux.qc_gates(v.flux_hh)


def closed(v):
    return flux.close_balance(gated(v))


def daily(v):
    return flux.daily_closed(closed(v), ["site"], F.col("date"), min_coverage=COVERAGE)


DAILY_SQL = f"""
daily AS (SELECT site, date, CASE WHEN count(c) / count(*) >= {COVERAGE} THEN sum(c) END AS ET_closed_mm,
  CASE WHEN count(c) / count(*) >= {COVERAGE} THEN sum(o) END AS ET_open_mm, avg(LE_closed) AS LE_closed,
  avg(LE_qc) AS LE_open, avg(NETRAD) AS NETRAD, avg(G) AS G, avg(TA) AS TA_C, count(c) / count(*) AS coverage,
  sum(CASE WHEN ok THEN tb END) AS sum_turb, sum(CASE WHEN ok THEN av END) AS sum_avail
  FROM (SELECT *, LE_closed * 1800.0 / lam AS c, LE_qc * 1800.0 / lam AS o FROM closed) GROUP BY 1, 2)"""
ROUNDED = ["ET_closed_mm", "ET_open_mm", "LE_closed", "NETRAD", "G", "TA_C", "coverage"]


THERMOMETER = "slot % 7 <> 0"  # elsewhere the temperature is missing and the site's median steps in

FILLED_SQL = f"""
thin AS (SELECT *, CASE WHEN {THERMOMETER} THEN TA END AS ta_seen FROM closed),
mid AS (SELECT site, quantile_cont(ta_seen, 0.5) AS m FROM thin GROUP BY 1),
full_ta AS (SELECT thin.* EXCLUDE (TA, lam, ta_seen), coalesce(ta_seen, m) AS TA, (2.501 - 0.00237 * coalesce(ta_seen, m)) * 1e6 AS lam
  FROM thin JOIN mid USING (site)), """


@query(
    "daily_closed_et",
    f"WITH {FILLED_SQL}{DAILY_SQL.replace('FROM closed', 'FROM full_ta')} SELECT site, date, {', '.join(rsql(c) for c in ROUNDED)}, "
    f"{rsql('sum_turb / nullif(sum_avail, 0)', 'EBR')}, 'BASE_bowen_ratio' AS CLOSURE FROM daily",
)
def _(v):
    from brackish.plans.daily_et import daily_et

    thin = v.flux_hh.withColumn("TA", F.when(F.expr(THERMOMETER), F.col("TA")))
    ratio = F.try_divide("sum_turb", "sum_avail")
    day = daily_et(thin, min_coverage=COVERAGE, date=F.col("date"))
    return day.select("site", "date", *[r(c) for c in ROUNDED], r(ratio, "EBR"), "CLOSURE")


@query("e6_best_daily_et")
def _(v):
    """Every route for some sites: published days for those of even name length, closed half hours for the rest, raw files below both."""
    from brackish.plans.daily_et import best_daily_et

    rows = v.flux_hh
    even = F.length("site") % 2 == 0
    days = rows.where(even & F.col("LE").isNotNull()).groupBy("site", "date").agg(F.avg(F.col("LE") * 1.1).alias("LE_closed"), F.avg("LE").alias("LE_open"), F.avg("TA").alias("TA_C"))
    return best_daily_et(days, rows.where("site < 'm'"), rows, min_coverage=COVERAGE, date=F.col("date"))


@query("q2_first_column", f"SELECT site, slot, {rsql('H', 'value')} FROM flux_hh")
def _(v):
    from brackish.functions.names import first_col

    df = v.flux_hh
    return df.select("site", "slot", r(first_col(df, "H_F_MDS", "H", "LE"), "value"))


@query("q1_variable_resolution", f"SELECT site, slot, {rsql('LE', 'LE')}, {rsql('TA', 'TA')}, CAST(NULL AS DOUBLE) AS WTD FROM flux_hh")
def _(v):
    from brackish.functions.names import variable

    named = v.flux_hh.select("site", "slot", F.col("LE").alias("LE_1_1_1"), F.col("H").alias("LE_RANDUNC"), F.col("TA").alias("TA_PI_F"))
    return named.select("site", "slot", r(variable(named, "LE"), "LE"), r(variable(named, "TA"), "TA"), variable(named, "WTD"))


@query("q1b_prefix_resolution", f"SELECT site, slot, {rsql('H', 'LE')} FROM flux_hh")
def _(v):
    from brackish.functions.names import pick_prefix, variable

    named = v.flux_hh.select("site", "slot", F.col("LE").alias("LE_LONG_NAME"), F.col("H").alias("LE_QQ"))
    return named.select("site", "slot", r(variable(named, "LE", pick_prefix), "LE"))


@query(
    "q3_q4_q5_gates",
    f"SELECT site, slot, {rsql('LE_flag')}, {rsql('LE_ustar')}, {rsql('LE_qc')} FROM gated",
)
def _(v):
    return gated(v).select("site", "slot", r("LE_flag"), r("LE_ustar"), r("LE_qc"))


@query(
    "q6_qc_attrition",
    "SELECT site, count(LE) AS n_raw, count(LE_flag) AS n_after_qc, count(LE_ustar) AS n_after_ustar, "
    f"count(LE_qc) AS n_final, {rsql('coalesce(count(LE_qc) * 100.0 / nullif(count(LE), 0), 0)', 'pct_kept')} FROM gated GROUP BY 1",
)
def _(v):
    return flux.qc_report(gated(v), ["site"]).withColumn("pct_kept", r("pct_kept"))


@query("q7_require", "SELECT site, slot FROM flux_hh WHERE LE IS NOT NULL AND G IS NOT NULL AND USTAR IS NOT NULL")
def _(v):
    return checks.require(v.flux_hh, ["LE", "G", "USTAR"]).select("site", "slot")


@query(
    "q8_column_contract",
    "SELECT site, 0 AS with_absent_column, count(CASE WHEN LE IS NOT NULL AND G IS NOT NULL THEN 1 END) AS kept, "
    "count(CASE WHEN LE IS NULL OR G IS NULL THEN 1 END) AS lost FROM flux_hh GROUP BY 1",
)
def _(v):
    absent = checks.require_columns(v.flux_hh, ["LE", "WTD"]).groupBy("site").agg(F.count("*").alias("absent"))
    kept = checks.require_columns(v.flux_hh, ["LE", "G"]).groupBy("site").agg(F.count("*").alias("kept"))
    rows = v.flux_hh.groupBy("site").agg(F.count("*").alias("n")).join(kept, "site", "left").join(absent, "site", "left")
    kept, absent = F.coalesce("kept", F.lit(0)), F.coalesce("absent", F.lit(0))
    return rows.select("site", absent.cast("int").alias("with_absent_column"), kept.alias("kept"), (F.col("n") - kept).alias("lost"))


@query(
    "q9_join_survival",
    "SELECT e.site, count(*) AS et_days, count(m.tmmx) AS with_met, count(CASE WHEN m.tmmx IS NOT NULL THEN s.LST_K END) AS with_sat "
    "FROM et_daily e LEFT JOIN met_daily m USING (site, date) LEFT JOIN sat_daily s USING (site, date) GROUP BY 1",
)
def _(v):
    rows = v.et_daily.join(v.met_daily, ["site", "date"], "left").join(v.sat_daily, ["site", "date"], "left")
    return checks.survival_report(rows, ["site"], {"et_days": ["ET"], "with_met": ["tmmx"], "with_sat": ["LST_K"]})


@query(
    "q14_plausibility",
    f"""SELECT site, rule, {rsql('value')}, holds FROM (
    SELECT site, 'median LST, K' AS rule, median(LST_K) AS value, coalesce(median(LST_K) BETWEEN 240 AND 330, true) AS holds FROM sat_obs GROUP BY 1
    UNION ALL SELECT site, 'usable LST', CAST(count(LST_K) AS DOUBLE), count(LST_K) >= 1 FROM sat_obs GROUP BY 1
    UNION ALL SELECT site, 'warm days', max(LST_K), max(LST_K) <= 304.5 FROM sat_obs GROUP BY 1)""",
)
def _(v):
    rules = [checks.LST_MEDIAN, checks.LST_PRESENT, checks.Rule("warm days", "LST_K", "max", float("-inf"), 304.5)]
    return checks.plausibility(v.sat_obs, ["site"], rules).withColumn("value", r("value"))


@query("q15_outliers", "SELECT site, count(CASE WHEN ET < -0.5 OR ET > 7.5 THEN 1 END) AS n_outliers FROM et_daily GROUP BY 1")
def _(v):
    return v.et_daily.groupBy("site").agg(F.count_if(gates.outlier(F.col("ET"), hi=7.5)).alias("n_outliers"))


@query(
    "q16_dedupe_first",
    "SELECT site, date, l_orderkey, l_linenumber, LST_K FROM (SELECT *, row_number() OVER "
    "(PARTITION BY site, date ORDER BY l_orderkey, l_linenumber) AS n FROM sat_obs) WHERE n = 1",
)
def _(v):
    rows = v.sat_obs.select("site", "date", "l_orderkey", "l_linenumber", "LST_K")
    return series.dedupe_first(rows, ["site", "date"], F.struct("l_orderkey", "l_linenumber"))


@query("q17_period", f"SELECT site, date, {rsql('ET')} FROM et_daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def _(v):
    return v.et_daily.where(gates.in_period(F.col("date"), "1996-01-01", "1998-12-31")).select("site", "date", r("ET"))


@query(
    "q18_footprint_stability",
    "SELECT site, slot FROM flux_hh WHERE USTAR > 0.1 AND TA > 0 AND H * 4 BETWEEN 0 AND 360 AND 4.0 / nullif(LE - 40, 0) > -15.5",
)
def _(v):
    keep = gates.footprint_usable(F.col("USTAR"), F.col("TA"), F.col("H") * 4, F.lit(4.0), F.col("LE") - 40)
    return v.flux_hh.where(keep).select("site", "slot")


@query(
    "e1_e2_latent_heat_et",
    f"SELECT site, slot, {rsql('(2.501 - 0.00237 * TA) * 1e6', 'lam')}, {rsql('LE * 1800.0 / ((2.501 - 0.00237 * TA) * 1e6)', 'ET_hh')}, "
    f"{rsql('LE * 86400.0 / ((2.501 - 0.00237 * TA) * 1e6)', 'ET_day')}, {rsql('LE * 86400.0 / 2.45e6', 'ET_const')} FROM flux_hh",
)
def _(v):
    le, ta = F.col("LE"), F.col("TA")
    return v.flux_hh.select(
        "site",
        "slot",
        r(energy.latent_heat(ta), "lam"),
        r(energy.le_to_et(le, ta, energy.HALF_HOUR), "ET_hh"),
        r(energy.le_to_et(le, ta), "ET_day"),
        r(energy.le_to_et_const(le), "ET_const"),
    )


@query(
    "e3_fill_ta",
    f"SELECT site, slot, {rsql('coalesce(TA, m)', 'TA')} FROM flux_hh JOIN (SELECT site, median(TA) AS m FROM flux_hh GROUP BY 1) USING (site)",
)
def _(v):
    return flux.fill_ta(v.flux_hh, ["site"]).select("site", "slot", r("TA"))


@query("e4_bowen_closure", f"SELECT site, slot, {rsql('LE_closed')} FROM closed")
def _(v):
    return closed(v).select("site", "slot", r("LE_closed"))


@query(
    "e5_rebuild_net_radiation",
    f"""WITH p AS (SELECT site, slot, CASE WHEN site IN ('view', 'click') THEN NULL ELSE NETRAD END AS rn, 3 * LE AS a, H AS b, TA AS c, G AS d FROM flux_hh)
    SELECT site, slot, {rsql('CASE WHEN n = 0 THEN a - b + c - d ELSE rn END', 'NETRAD')},
    CASE WHEN n = 0 AND a - b + c - d IS NOT NULL THEN 'components' END AS RN_SOURCE
    FROM p JOIN (SELECT site, count(rn) AS n FROM p GROUP BY 1) USING (site)""",
)
def _(v):
    rows = v.flux_hh.select(
        "site",
        "slot",
        F.when(~F.col("site").isin("view", "click"), F.col("NETRAD")).alias("NETRAD"),
        (F.col("LE") * 3).alias("SW_IN_F"),
        F.col("H").alias("SW_OUT"),
        F.col("TA").alias("LW_IN_F"),
        F.col("G").alias("LW_OUT"),
    )
    return flux.rebuild_rn(rows, ["site"]).select("site", "slot", r("NETRAD"), "RN_SOURCE")


@query(
    "e6_choose_closure",
    f"""WITH d AS (SELECT site, date, avg(LE_closed) AS LE_closed, avg(LE_qc) AS LE_open FROM closed GROUP BY 1, 2),
    p AS (SELECT * FROM d WHERE site = 'view'), h AS (SELECT site, date, LE_closed + 1 AS LE_closed, LE_open FROM d WHERE site IN ('view', 'click')),
    u AS (SELECT *, 0 AS k FROM p UNION ALL SELECT *, 1 FROM h UNION ALL SELECT *, 2 FROM d),
    b AS (SELECT site, min(k) AS k FROM u WHERE LE_closed IS NOT NULL GROUP BY 1)
    SELECT site, date, {rsql('LE_closed')}, ['ONEFlux_LE_CORR', 'FLUXNET_bowen_G0', 'BASE_bowen_ratio'][k + 1] AS CLOSURE
    FROM u JOIN b USING (site, k) WHERE LE_closed IS NOT NULL""",
)
def _(v):
    day = flux.daily_mean_closed(closed(v), ["site"], F.col("date"), min_coverage=0.0).select("site", "date", "LE_closed", "LE_open")
    half = day.where(F.col("site").isin("view", "click")).withColumn("LE_closed", F.col("LE_closed") + 1)
    return flux.choose_closure(["site"], day.where("site = 'view'"), half, day).select("site", "date", r("LE_closed"), "CLOSURE")


@query(
    "e7_e8_daily_mean_route",
    f"""SELECT site, date, {rsql('CASE WHEN cv >= 0.45 THEN lec * 86400 / l END', 'ET_closed_mm')},
    {rsql('CASE WHEN cv >= 0.45 THEN leo * 86400 / l END', 'ET_open_mm')}, {rsql('cv', 'coverage')} FROM (
    SELECT site, date, avg(LE_closed) AS lec, avg(LE_qc) AS leo, (2.501 - 0.00237 * avg(TA)) * 1e6 AS l,
    count(LE_closed) / count(*) AS cv FROM closed GROUP BY 1, 2)""",
)
def _(v):
    day = flux.daily_mean_closed(closed(v), ["site"], F.col("date"), min_coverage=COVERAGE)
    return day.select("site", "date", r("ET_closed_mm"), r("ET_open_mm"), r("coverage"))


@query(
    "e9_e10_balance_ratio_flags",
    f"""SELECT site, {rsql('EBR')}, has_NETRAD, false AS has_WTD, coalesce(EBR < 0.5 OR EBR > 1.2, false) AS suspect FROM (
    SELECT site, sum(CASE WHEN ok THEN tb END) / nullif(sum(CASE WHEN ok THEN av END), 0) AS EBR, count(NETRAD) > 0 AS has_NETRAD
    FROM closed GROUP BY 1)""",
)
def _(v):
    return flux.site_flags(closed(v), ["site"]).withColumn("EBR", r("EBR"))


UPLIFT_SQL = ", ".join(
    [rsql("avg(ET_open_mm)", "mean_open"), rsql("avg(ET_closed_mm)", "mean_closed"), rsql("(avg(ET_closed_mm) / nullif(avg(ET_open_mm), 0) - 1) * 100", "uplift_pct")]
)


@query("e11_uplift", f"WITH {DAILY_SQL} SELECT site, {UPLIFT_SQL} FROM daily GROUP BY 1 UNION ALL SELECT 'overall', {UPLIFT_SQL} FROM daily")
def _(v):
    day = daily(v)
    every = flux.uplift(day).withColumn("site", F.lit("overall"))
    return flux.uplift(day, ["site"]).unionByName(every).select("site", r("mean_open"), r("mean_closed"), r("uplift_pct"))


@query(
    "e12_uncertainty_band",
    f"""WITH {DAILY_SQL} SELECT site, date, {rsql('LE_open * 0.9 * 86400 / ((2.501 - 0.00237 * TA_C) * 1e6)', 'ET_lo_mm')},
    {rsql('LE_closed * 86400 / ((2.501 - 0.00237 * TA_C) * 1e6)', 'ET_hi_mm')}, CAST(NULL AS DOUBLE) AS ET_randunc_mm FROM daily""",
)
def _(v):
    band = daily(v).withColumn("LE_CORR_25", F.col("LE_open") * 0.9).withColumn("LE_CORR_75", F.col("LE_closed"))
    return flux.et_band(band).select("site", "date", r("ET_lo_mm"), r("ET_hi_mm"), "ET_randunc_mm")


@query(
    "e13_et_summary",
    f"""SELECT site, count(ET) AS n_days, {rsql('avg(ET)', 'mean')}, strftime(min(date), '%Y-%m') AS first_month,
    strftime(max(date), '%Y-%m') AS last_month, {rsql('median(ET)', 'median')}, {rsql('quantile_cont(ET, 0.99)', 'p99')},
    {rsql('quantile_cont(ET, 0.1)', 'p10')}, {rsql('quantile_cont(ET, 0.9)', 'p90')} FROM et_daily GROUP BY 1""",
)
def _(v):
    out = flux.et_summary(v.et_daily, ["site"], "ET")
    return out.select("site", "n_days", r("mean"), "first_month", "last_month", r("median"), r("p99"), r("p10"), r("p90"))


@query(
    "a7_union_of_sites",
    f"""SELECT site, date, {rsql('ET')}, CAST(NULL AS DOUBLE) AS LST_K FROM et_daily
    UNION ALL SELECT site, date, CAST(NULL AS DOUBLE), {rsql('LST_K')} FROM sat_daily""",
)
def _(v):
    both = catalog.union_sites([v.et_daily, v.sat_daily], ["site", "date", "ET", "LST_K", "absent"])
    return both.select("site", "date", r("ET"), r("LST_K"))
