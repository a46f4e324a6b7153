"""Queries on cross-validation, feature screening and models."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.energy import clip
from brackish.operators import energy_supply, evaluate, features, linear, models, robust, trees
from brackish.operators.linear import LinearModel
from brackish.plans.registry import query, r, rsql
from brackish.session import part_of_job

X = ["x1", "x2", "x3", "x4"]
LINE = LinearModel("line", ("x1",), "ols")
METRICS = ["r2", "rmse", "mae", "bias"]


def row_ids():
    return [F.col("l_orderkey"), F.col("l_linenumber")]



def scored(oof, by, y="y"):
    return evaluate.metrics(oof, by, y=y).select(*by, "n", *[r(m) for m in METRICS])


def score_sql(source, by="", y="y", p="pred"):
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}count(*) AS n, {rsql(f'1 - sum(({p} - {y}) * ({p} - {y})) / nullif(var_pop({y}) * count(*), 0)', 'r2')}, {rsql(f'sqrt(avg(({p} - {y}) * ({p} - {y})))', 'rmse')},
    {rsql(f'avg(abs({p} - {y}))', 'mae')}, {rsql(f'avg({p} - {y})', 'bias')} FROM {source} WHERE {y} IS NOT NULL AND {p} IS NOT NULL{group}"""


SUMS = "count(*) AS n, sum(x1) AS sx, sum(y) AS sy, sum(x1 * x1) AS sxx, sum(x1 * y) AS sxy"


def line_oof(fold, scope="", gate="true", table="samples", extra=""):
    """Held-out predictions of the line y ~ x1: training sums are the scope's less the fold's."""
    on = f"USING ({scope})" if scope else "ON true"
    keys = f"{scope}, " if scope else ""
    group = f" GROUP BY {scope}" if scope else ""
    fold_keys = ", ".join(f"o.{c.strip()}" for c in fold.split(","))
    return f"""own AS (SELECT {fold}, {SUMS} FROM {table} GROUP BY {fold}), tot AS (SELECT {keys}{SUMS} FROM {table}{group}),
    tr AS (SELECT {fold_keys}, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxx - o.sxx AS sxx, t.sxy - o.sxy AS sxy FROM own o JOIN tot t {on} WHERE {gate.replace('n_test', 'o.n').replace('n_train', '(t.n - o.n)')}),
    co AS (SELECT {fold}, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sy / n - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx / n AS a FROM tr),
    oof AS (SELECT s.*, a + b * x1 AS pred FROM {table} s JOIN co USING ({fold})){extra}"""


HASH10 = "(((7 * 31 + l_orderkey % 1000003 * 7919) % 1000003) * 31 + l_linenumber % 1000003 * 7919) % 1000003 * 104729 % 1000003 % 10"
FOLDED = f"folded AS (SELECT *, {HASH10} AS fold FROM samples)"


@query("v1_v7_kfold_ols", f"WITH {FOLDED}, {line_oof('fold', table='folded')} {score_sql('oof')}")
def _(v):
    df, scheme = evaluate.kfold(v.samples, row_ids(), 10)
    return scored(linear.cross_validate(df, X, "y", scheme, [LINE]), [])


@query("v2_leave_year_ols", f"WITH {line_oof('site, year', 'site', 'n_test >= 5 AND n_train >= 15')} {score_sql('oof', 'site')}")
def _(v):
    return scored(linear.cross_validate(v.samples, X, "y", evaluate.leave_year(), [LINE]), ["site"])


@query("v3_leave_site_ols", f"WITH {line_oof('site', '', 'n_test >= 5')} {score_sql('oof', 'site')}")
def _(v):
    return scored(linear.cross_validate(v.samples, X, "y", evaluate.leave_site(), [LINE]), ["site"])


@query("v7_pooled_metrics", score_sql("(SELECT y, 0.05 * x1 + x2 AS pred FROM samples)"))
def _(v):
    return scored(v.samples.withColumn("pred", F.col("x1") * 0.05 + F.col("x2")), [])


@query("v8_site_metrics", score_sql("(SELECT site, y, 0.05 * x1 + x2 AS pred FROM samples)", "site"))
def _(v):
    return scored(v.samples.withColumn("pred", F.col("x1") * 0.05 + F.col("x2")), ["site"])


TRAIN = "site IN ('P0', 'P1', 'P2') AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"
TEST = "site IN ('P3', 'P4') AND date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'"


def split(v):
    return evaluate.fixed_split(v.samples, ["P0", "P1", "P2"], ["P3", "P4"], ("1995-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31"))


@query("v4_fixed_split", f"SELECT site, {TRAIN} AS is_train, count(*) AS n FROM samples WHERE ({TRAIN}) OR ({TEST}) GROUP BY 1, 2")
def _(v):
    return split(v).groupBy("site", "is_train").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v5_month_blocks",
    f"""WITH RECURSIVE o AS (SELECT site, month, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, month) AS i, count(*) OVER (PARTITION BY site) AS k FROM monthly),
    d AS (SELECT DISTINCT site, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS month, CAST(0 AS BIGINT) AS month_fold, [0, 0, 0, 0, 0]::BIGINT[] AS filled FROM o
    UNION ALL SELECT o.site, o.i, o.month, list_position(d.filled, list_min(d.filled)) - 1, list_transform(d.filled, lambda x, j: CASE WHEN j = list_position(d.filled, list_min(d.filled)) THEN x + o.n ELSE x END)::BIGINT[]
    FROM d JOIN o ON o.site = d.site AND o.i = d.i + 1),
    m AS (SELECT d.site, d.month, d.month_fold, k FROM d JOIN (SELECT DISTINCT site, k FROM o) USING (site) WHERE i > 0),
    f AS (SELECT s.*, month_fold FROM samples s JOIN m ON s.site = m.site AND date_trunc('month', s.date) = m.month WHERE k >= 5), {line_oof('site, month_fold', 'site', table='f')} {score_sql('oof', 'site')}""",
)
def _(v):
    df, scheme = evaluate.month_blocks(v.samples, "date")
    return scored(linear.cross_validate(df, X, "y", scheme, [LINE]), ["site"])


@query(
    "v9_baselines",
    f"""SELECT 'train mean' AS model, * FROM ({score_sql(f"(SELECT y, (SELECT avg(y) FROM samples WHERE {TRAIN}) AS pred FROM samples WHERE {TEST})")})
    UNION ALL SELECT 'direct', * FROM ({score_sql(f"(SELECT y, x2 AS pred FROM samples WHERE {TEST})")})""",
)
def _(v):
    rows = split(v)
    a = evaluate.metrics(evaluate.train_mean(rows, "y"), []).withColumn("model", F.lit("train mean"))
    b = evaluate.metrics(evaluate.direct(rows, "x2"), []).withColumn("model", F.lit("direct"))
    return a.unionByName(b).select("model", "n", *[r(m) for m in METRICS])


@query("v10_identical_rows", "SELECT site, slot FROM flux_hh WHERE LE IS NOT NULL AND G IS NOT NULL AND QC IS NOT NULL")
def _(v):
    return evaluate.identical_rows(v.flux_hh, ["LE", "G"], ["LE", "QC"]).select("site", "slot")


@query("v11_observed_only", f"SELECT site, date, {rsql('LST_K')} FROM sat_daily WHERE LST_K IS NOT NULL")
def _(v):
    from brackish.operators.series import with_staleness

    days = with_staleness(v.sat_daily, ["site"], "date", ["LST_K"])
    return evaluate.observed_only(days, ["LST_K_age"]).select("site", "date", r("LST_K_int", "LST_K"))


@query("l2_offset_columns", f"SELECT site, {rsql('regr_slope(y, x1)', 'slope')}, {rsql('corr(y, x1) * stddev_pop(x1)', 'joint')} FROM samples GROUP BY 1")
def _(v):
    """Every other site measures x1 from a zero far away; slopes must not notice."""
    far = F.when(F.substring("site", 2, 2).cast("int") % 2 == 0, F.lit(2.0**26)).otherwise(0.0)
    fits, grams = linear.fit_by_key(v.samples.withColumn("x", F.col("x1") + far), ["x"], "y", ["site"], [LinearModel("m", ("x",), "ols")])
    spread = v.samples.groupBy("site").agg((F.corr("y", "x1") * F.stddev_pop("x1")).alias("joint"))
    slopes = linear.coefficients(fits, grams, ["site"]).where("feature = 'x'")
    return slopes.join(spread, "site").select("site", r("value", "slope"), r("joint"))


@query("v12_line_of_fit", f"SELECT site, {rsql('regr_slope(0.05 * x1 + x2, y)', 'slope')}, {rsql('regr_intercept(0.05 * x1 + x2, y)', 'intercept')} FROM samples GROUP BY 1")
def _(v):
    rows = v.samples.withColumn("pred", F.col("x1") * 0.05 + F.col("x2"))
    return evaluate.line_of_fit(rows, ["site"]).select("site", r("slope"), r("intercept"))


@query(
    "v13_diversity_test",
    f"""WITH few AS (SELECT * FROM samples WHERE site IN ('P0', 'P1', 'P2', 'P3', 'P4')), {line_oof('site', '', 'n_test >= 5', table='few')} SELECT 'few' AS sites, * FROM ({score_sql('oof')})
    UNION ALL SELECT 'all', * FROM (WITH {line_oof('site', '', 'n_test >= 5')} {score_sql('oof')})""",
)
def _(v):
    few = v.samples.where(F.col("site").isin("P0", "P1", "P2", "P3", "P4"))
    a = evaluate.metrics(linear.cross_validate(few, X, "y", evaluate.leave_site(), [LINE]), []).withColumn("sites", F.lit("few"))
    b = evaluate.metrics(linear.cross_validate(v.samples, X, "y", evaluate.leave_site(), [LINE]), []).withColumn("sites", F.lit("all"))
    return a.unionByName(b).select("sites", "n", *[r(m) for m in METRICS])


def schemes_sql(sites, table, filtered):
    """Scores of the line under the three schemes over one set of sites."""
    folded = f"folded AS (SELECT *, {HASH10} AS fold FROM {table})"
    parts = [
        ("kfold", f"WITH {filtered}{folded}, {line_oof('fold', table='folded')} {score_sql('oof')}"),
        ("leave_year", f"WITH {filtered}{line_oof('site, year', 'site', 'n_test >= 5 AND n_train >= 15', table=table)} {score_sql('oof')}"),
        ("leave_site", f"WITH {filtered}{line_oof('site', '', 'n_test >= 5', table=table)} {score_sql('oof')}"),
    ]
    return " UNION ALL ".join(f"SELECT '{sites}' AS sites, '{name}' AS scheme, * FROM ({sql})" for name, sql in parts)


@query(
    "v13_diversity_three_schemes",
    schemes_sql("few", "few", "few AS (SELECT * FROM samples WHERE site IN ('P0', 'P1', 'P2', 'P3', 'P4')), ") + " UNION ALL " + schemes_sql("all", "samples", ""),
)
def _(v):
    rows, schemes = three_schemes(v)
    out = None
    for name, part in (("few", rows.where(F.col("site").isin("P0", "P1", "P2", "P3", "P4"))), ("all", rows)):
        for scheme in schemes:
            scores = evaluate.metrics(linear.cross_validate(part, X, "y", scheme, [LINE]), [])
            scores = scores.select(F.lit(name).alias("sites"), F.lit(scheme.name).alias("scheme"), "n", *[r(m) for m in METRICS])
            out = scores if out is None else out.unionByName(scores)
    return out


@query(
    "v14_support_test",
    f"""WITH t AS (SELECT site, scene, window_m, avg(NDVI) AS x1, avg(LST) AS y FROM strict JOIN (SELECT unnest([90, 250]) AS window_m) ON greatest(abs(px_x), abs(px_y)) <= window_m / 2.0 GROUP BY 1, 2, 3 HAVING avg(NDVI) IS NOT NULL AND avg(LST) IS NOT NULL),
    {line_oof('window_m, site', 'window_m', table='t')} {score_sql('oof', 'window_m')}""",
)
def _(v):
    from brackish.operators.pixels import window_means

    means = window_means(v.strict, ["site", "scene"], ["NDVI", "LST"], (90, 250))
    scheme = evaluate.Scheme("leave_site", ("window_m", "site"), ("window_m",))
    oof = linear.cross_validate(means, ["NDVI"], "LST", scheme, [LinearModel("line", ("NDVI",), "ols")])
    return scored(oof, ["window_m"], "LST")


@query(
    "v15_target_transforms",
    f"SELECT site, date, {rsql('CASE WHEN ET / 4 > 1.2 THEN 1.2 ELSE ET / 4 END * srad / 100', 'et_ef')}, {rsql('ET / 4 * CASE WHEN pet < 0.3 THEN 0.3 ELSE pet END', 'et_kc')} FROM et_daily JOIN met_daily USING (site, date)",
)
def _(v):
    rows = v.et_daily.join(v.met_daily, ["site", "date"])
    ratio = F.col("ET") / 4
    return rows.select(
        "site", "date", r(evaluate.et_from_fraction(ratio, F.col("srad") / 100), "et_ef"), r(evaluate.et_from_crop_coefficient(ratio, F.col("pet")), "et_kc")
    )


@query("v16_timescales", f"WITH mo AS (SELECT site, x1, y FROM monthly WHERE n >= 12), {line_oof('site', '', 'n_test >= 5', table='mo')} SELECT 'month' AS scale, * FROM ({score_sql('oof')})"
    f" UNION ALL SELECT 'day', * FROM (WITH dy AS (SELECT site, date, avg(x1) AS x1, avg(y) AS y FROM samples GROUP BY 1, 2), {line_oof('site', '', 'n_test >= 5', table='dy')} {score_sql('oof')})")
def _(v):
    from brackish.operators.series import period_mean

    day = v.samples.groupBy("site", "date").agg(*[F.avg(c).alias(c) for c in [*X, "y"]])
    month = period_mean(v.samples, ["site"], "date", [*X, "y"], "y", "month", 12)
    out = None
    for name, rows in (("day", day), ("month", month)):
        part = evaluate.metrics(linear.cross_validate(rows, X, "y", evaluate.leave_site(), [LINE]), []).withColumn("scale", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("scale", "n", *[r(m) for m in METRICS])


# -- feature screening -----------------------------------------------------------

F5 = ["x1", "x2", "x3", "x4", "x5"]


@query("f1_target_correlation", " UNION ALL ".join(f"SELECT '{c}' AS feature, {rsql(f'corr({c}, y)', 'r')} FROM samples" for c in F5))
def _(v):
    return features.target_correlations(v.spark, features.moments(v.samples, F5, "y")).select("feature", r("r"))


@query(
    "f1_collinear_pairs",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rsql(f'abs(corr({a}, {b}))', 'abs_r')} FROM samples" for i, a in enumerate(F5) for b in F5[i + 1 :]),
)
def _(v):
    return features.collinear_pairs(v.spark, features.moments(v.samples, F5, "y")).select("a", "b", r("abs_r"))


@query(
    "f2_vif",
    f"SELECT f AS feature, {rsql('1 / greatest(1 - c * c, 1e-9)', 'vif', 4)} FROM (SELECT unnest(['x1', 'x5']) AS f, (SELECT corr(x1, x5) FROM samples) AS c)",
)
def _(v):
    return features.vif_table(v.spark, features.moments(v.samples, ["x1", "x5"], "y")).select("feature", r("vif", "vif", 4))


@query("f3_vif_elimination")
def _(v):
    m = features.moments(v.samples, F5, "y")
    kept, dropped = features.vif_elimination(m)
    final = features.inflation(m, kept)
    rows = [(f, False, x) for f, x in dropped] + [(f, True, final[f]) for f in kept]
    return v.spark.createDataFrame(rows, "feature string, kept boolean, vif double")


@query("f4_cluster_representatives")
def _(v):
    groups = features.cluster_representatives(features.moments(v.samples, F5, "y"))
    return v.spark.createDataFrame([(k, ",".join(m)) for k, m in groups.items()], "representative string, members string")


R1 = "(SELECT corr(x1, y) AS c1, count(*) AS n, var_pop(y) AS vy FROM samples)"


@query(
    "f5_information_criteria",
    f"""SELECT 'x1' AS feature_set, CAST(1 AS INTEGER) AS k, {rsql('4 + n * (ln(2 * pi() * vy * (1 - c1 * c1)) + 1)', 'aic', 3)}, {rsql('2 * ln(n) + n * (ln(2 * pi() * vy * (1 - c1 * c1)) + 1)', 'bic', 3)},
    {rsql('1 - (1 - c1 * c1) * (n - 1) / (n - 2)', 'adj_r2')} FROM {R1}""",
)
def _(v):
    m = features.moments(v.samples, X, "y")
    return features.information_table(v.spark, m, {"x1": ["x1"]}).select("feature_set", "k", r("aic", "aic", 3), r("bic", "bic", 3), r("adj_r2"))


@query("f6_forward_selection", f"SELECT CAST(1 AS INTEGER) AS step, f AS feature FROM (SELECT unnest(['x1', 'x2', 'x3', 'x4']) AS f, unnest([abs(corr(x1, y)), abs(corr(x2, y)), abs(corr(x3, y)), abs(corr(x4, y))]) AS c FROM samples) ORDER BY c DESC LIMIT 1")
def _(v):
    chosen = features.forward_selection(features.moments(v.samples, X, "y"), "bic")
    return v.spark.createDataFrame([(i + 1, f) for i, (f, _) in enumerate(chosen)], "step int, feature string").where("step = 1")


@query("f6_forward_selection_path")
def _(v):
    m = features.moments(v.samples, F5, "y")
    rows = [(c, i + 1, f, s) for c in ("aic", "bic") for i, (f, s) in enumerate(features.forward_selection(m, c))]
    return v.spark.createDataFrame(rows, "criterion string, step int, feature string, score double")


SETS = {"x1": ["x1"], "x2": ["x2"]}


def ridge_one(x, alpha, fold, table, name):
    """Ridge with one standardised feature: the slope shrinks by n / (n + alpha)."""
    return f"""SELECT '{name}' AS feature_set, * FROM (WITH own AS (SELECT {fold}, count(*) AS n, sum({x}) AS sx, sum(y) AS sy, sum({x} * {x}) AS sxx, sum({x} * y) AS sxy FROM {table} GROUP BY {fold}),
    tot AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM own),
    tr AS (SELECT {fold}, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxx - o.sxx AS sxx, t.sxy - o.sxy AS sxy FROM own o CROSS JOIN tot t),
    co AS (SELECT {fold}, (n * sxy - sx * sy) / (n * sxx - sx * sx) * n / (n + {alpha}) AS b, sx / n AS mx, sy / n AS my FROM tr),
    oof AS (SELECT y, my + b * ({x} - mx) AS pred FROM {table} JOIN co USING ({fold})) {score_sql('oof')})"""


@query("f9_f10_f11_feature_sets", f"{ridge_one('x1', 10.0, 'site', 'samples', 'x1')} UNION ALL {ridge_one('x2', 10.0, 'site', 'samples', 'x2')}")
def _(v):
    out = features.compare_feature_sets(v.samples, SETS, "y", [evaluate.leave_site()])
    return out.select("feature_set", "n", *[r(m) for m in METRICS])


@query("f9_group_ablation")
def _(v):
    df, kfold = evaluate.kfold(v.samples, row_ids(), 10)
    sets = {"all": X, "no size": ["x3", "x4"], "no price": ["x1", "x3", "x4"], "size": ["x1"]}
    return features.compare_feature_sets(df, sets, "y", [kfold, evaluate.leave_year(), evaluate.leave_site()])


@query("f7_permutation_importance")
def _(v):
    ids = ["l_orderkey", "l_linenumber"]
    return features.permutation_importance_folds(v.samples, ids, X, "y", evaluate.leave_site(), trees.extra(trees=10, depth=5), repeats=5)


@query("f8_impurity_importance")
def _(v):
    return features.saved_by_splits(v.spark, trees.fit(v.samples, X, "y", trees.extra(trees=20, depth=6)))


# -- models --------------------------------------------------------------------------


@query("l1_l2_ridge_leave_site", ridge_one("x1", 10.0, "site", "samples", "ridge").replace("AS feature_set", "AS model"))
def _(v):
    oof = linear.cross_validate(v.samples, X, "y", evaluate.leave_site(), [LinearModel("ridge", ("x1",), "ridge", 10.0)])
    return scored(oof, ["model"])


@query(
    "l2_ols_two_features",
    f"""WITH s AS (SELECT site, regr_sxx(x1, x2) AS a, regr_sxx(x2, x1) AS b, covar_pop(x1, x2) * count(*) AS c, covar_pop(x1, y) * count(*) AS p, covar_pop(x2, y) * count(*) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM samples GROUP BY 1),
    v AS (SELECT site, var_pop(x1) * count(*) AS v1, var_pop(x2) * count(*) AS v2 FROM samples GROUP BY 1),
    k AS (SELECT site, (p * v2 - q * c) / (v1 * v2 - c * c) AS b1, (q * v1 - p * c) / (v1 * v2 - c * c) AS b2, m1, m2, my FROM s JOIN v USING (site))
    SELECT site, feature, {rsql('value', 'value', 4)} FROM (SELECT site, 'x1' AS feature, b1 AS value FROM k UNION ALL SELECT site, 'x2', b2 FROM k UNION ALL SELECT site, '(intercept)', my - b1 * m1 - b2 * m2 FROM k)""",
)
def _(v):
    fits, grams = linear.fit_by_key(v.samples, ["x1", "x2"], "y", ["site"], [LinearModel("ols", ("x1", "x2"), "ols")])
    return linear.coefficients(fits, grams, ["site"]).select("site", "feature", r("value", "value", 4))


@query("l3_l5_elastic_net_and_pls")
def _(v):
    zoo = [LinearModel("elastic", tuple(X), "elastic", 0.05, 0.3), LinearModel("pls", tuple(X), "pls", components=3), LinearModel("ridge", tuple(X), "ridge", 10.0)]
    return evaluate.metrics(linear.cross_validate(v.samples, X, "y", evaluate.leave_site(), zoo), ["model", "scheme"])


TWO = """own AS (SELECT site, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM samples GROUP BY 1),
    tr AS (SELECT o.site, t.n - o.n AS n, t.s1 - o.s1 AS s1, t.s2 - o.s2 AS s2, t.sy - o.sy AS sy, t.s11 - o.s11 AS s11, t.s22 - o.s22 AS s22, t.s12 - o.s12 AS s12, t.s1y - o.s1y AS s1y, t.s2y - o.s2y AS s2y
    FROM own o CROSS JOIN (SELECT sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(sy) AS sy, sum(s11) AS s11, sum(s22) AS s22, sum(s12) AS s12, sum(s1y) AS s1y, sum(s2y) AS s2y FROM own) t),
    st AS (SELECT site, s1 / n AS m1, s2 / n AS m2, sy / n AS my, sqrt(s11 / n - s1 / n * s1 / n) AS d1, sqrt(s22 / n - s2 / n * s2 / n) AS d2, s12 / n - s1 / n * s2 / n AS v12, s1y / n - s1 / n * sy / n AS v1, s2y / n - s2 / n * sy / n AS v2 FROM tr),
    co AS (SELECT *, v1 / d1 AS c1, v2 / d2 AS c2, v12 / (d1 * d2) AS rho FROM st)"""


@query(
    "l3_elastic_net_one_feature",
    f"""WITH {TWO} {score_sql("(SELECT site, y, my + sign(c1) * greatest(abs(c1) - 0.05 * 0.3, 0) / (1 + 0.05 * 0.7) / d1 * (x1 - m1) AS pred FROM samples JOIN co USING (site))", "site")}""",
)
def _(v):
    zoo = [LinearModel("elastic", ("x1",), "elastic", 0.05, 0.3)]
    return scored(linear.cross_validate(v.samples, ["x1", "x2"], "y", evaluate.leave_site(), zoo), ["site"])


@query(
    "l5_pls_one_component",
    f"""WITH {TWO} {score_sql("(SELECT site, y, my + (c1 * c1 + c2 * c2) / (c1 * c1 + c2 * c2 + 2 * rho * c1 * c2) * (c1 * (x1 - m1) / d1 + c2 * (x2 - m2) / d2) AS pred FROM samples JOIN co USING (site))", "site")}""",
)
def _(v):
    zoo = [LinearModel("pls", ("x1", "x2"), "pls", components=1)]
    return scored(linear.cross_validate(v.samples, ["x1", "x2"], "y", evaluate.leave_site(), zoo), ["site"])


@query("l4_huber")
def _(v):
    rows = split(v)
    out = models.huber()(rows.where("is_train"), X, "y")(rows.where("NOT is_train"))
    return evaluate.metrics(out, [])


@query(
    "l6_knn",
    f"""WITH st AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM monthly WHERE year < 1999),
    z AS (SELECT site, month, year, y, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM monthly CROSS JOIN st),
    d AS (SELECT q.site, q.month, t.y, sqrt(power(q.a - t.a, 2) + power(q.b - t.b, 2)) AS d FROM z q JOIN z t ON t.year < 1999 AND q.year >= 1999),
    k AS (SELECT *, row_number() OVER (PARTITION BY site, month ORDER BY d) AS n FROM d)
    SELECT site, month, {rsql('CASE WHEN min(d) = 0 THEN avg(CASE WHEN d = 0 THEN y END) ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END', 'pred')} FROM k WHERE n <= 10 GROUP BY 1, 2""",
)
def _(v):
    predict = models.knn(10)(v.monthly.where("year < 1999"), ["x1", "x2"], "y")
    return predict(v.monthly.where("year >= 1999")).select("site", "month", r("pred"))


@query("l7_l8_forest_fixed_split")
def _(v):
    rows = split(v).withColumn("weight", F.col("x1") / 50)
    out = models.forest(trees=20, depth=6, weight="weight")(rows.where("is_train"), X, "y")(rows.where("NOT is_train"))
    return evaluate.metrics(out, [])


@query("l9_boosted_fixed_split")
def _(v):
    rows = split(v)
    out = models.boosted(rounds=10)(rows.where("is_train"), X, "y")(rows.where("NOT is_train"))
    return evaluate.metrics(out, [])


def physical(v):
    """Samples with energy terms: x1 as temperature, x2 as radiation."""
    rows = v.samples.select("site", "date", "year", *X, F.col("y").alias("ET"), (F.col("x2") * 100 + 60).alias("NETRAD"), F.lit(0.0).alias("G"), (F.col("x1") / 2 + 5).alias("TA_C"))
    return energy_supply.energy_terms(rows)


SVP = "(0.6108 * exp(17.27 * t / (t + 237.3)))"
SL = f"(4098 * {SVP} / power(t + 237.3, 2))"
PHYS = f"""ph AS (SELECT *, CASE WHEN ET / eq > 2 THEN 2 WHEN ET / eq < 0 THEN 0 ELSE ET / eq END AS alpha FROM (SELECT *, {SL} / ({SL} + 0.066) * rn * 86400 / 2.45e6 AS eq, rn * 86400 / 2.45e6 AS av FROM
    (SELECT site, x1, y AS ET, x2 * 100 + 60 AS rn, x1 / 2 + 5 AS t FROM samples)) WHERE av > 0.5 AND eq > 0.2)"""


@query("l10_priestley_taylor_fixed", f"WITH {PHYS} {score_sql('(SELECT site, ET AS y, 1.26 * eq AS pred FROM ph)', 'site')}")
def _(v):
    return scored(models.priestley_taylor(physical(v), evaluate.leave_site(), 1.26), ["site"], "ET")


@query(
    "l10_priestley_taylor_calibrated",
    f"""WITH {PHYS}, o AS (SELECT site, count(alpha) AS n, sum(alpha) AS s FROM ph GROUP BY 1), c AS (SELECT site, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS a FROM o)
    {score_sql('(SELECT site, ET AS y, a * eq AS pred FROM ph JOIN c USING (site))', 'site')}""",
)
def _(v):
    return scored(models.priestley_taylor(physical(v), evaluate.leave_site()), ["site"], "ET")


RATIO = "ra AS (SELECT site, x1, ET, eq, av, alpha, CASE WHEN ET / av > 1.2 THEN 1.2 WHEN ET / av < 0 THEN 0 ELSE ET / av END AS EF FROM ph)"


def ratio_sql(ratio, energy, hi):
    clipped = f"CASE WHEN pred > {hi} THEN {hi} WHEN pred < 0 THEN 0 ELSE pred END"
    table = f"rt AS (SELECT site, x1, ET, {ratio} AS y, {energy} AS energy FROM ra)"
    return f"WITH {PHYS}, {RATIO}, {table}, {line_oof('site', '', 'n_test >= 5', table='rt')} {score_sql(f'(SELECT site, ET AS y, {clipped} * energy AS pred FROM oof)', 'site')}"


@query("l11_fraction_target", ratio_sql("EF", "av", 1.2))
def _(v):
    return scored(models.cross_validate_ratio(physical(v), X, "EF", "ET_avail", evaluate.leave_site(), [LINE], 1.2), ["site"], "ET")


@query("l11_alpha_target", ratio_sql("alpha", "eq", 1.6))
def _(v):
    return scored(models.cross_validate_ratio(physical(v), X, "alpha", "ET_eq", evaluate.leave_site(), [LINE], 1.6), ["site"], "ET")


@query(
    "l12_crop_coefficient_target",
    f"""WITH kc AS (SELECT site, x1, y AS et, CASE WHEN x2 < 0.3 THEN 0.3 ELSE x2 END AS eto, y / CASE WHEN x2 < 0.3 THEN 0.3 ELSE x2 END AS y FROM samples), {line_oof('site', '', table='kc')} {score_sql('(SELECT et AS y, pred * eto AS pred FROM oof)')}""",
)
def _(v):
    return scored(models.cross_validate_kc(v.samples, X, "y", "x2", evaluate.leave_site(1), [LINE]), [])


@query("l13_ridge_search", " UNION ALL ".join(ridge_one("x1", a, "site", "samples", f"{a}") for a in (0.1, 1000.0)).replace("AS feature_set", "AS alpha"))
def _(v):
    out = models.ridge_search(v.samples, ["x1"], "y", evaluate.leave_site(), [0.1, 1000.0])
    return out.select(F.col("alpha").cast("string").alias("alpha"), "n", *[r(m) for m in METRICS])


@query("l13_forest_grid")
def _(v):
    grid = [trees.forest(f"depth {d}", trees=10, depth=d) for d in (3, 5)]
    oof = trees.cross_validate(v.samples, X, "y", [evaluate.leave_site()], grid)
    return evaluate.metrics(oof, ["model"]).orderBy(F.desc("r2"), "model")


def three_schemes(v):
    rows, kfold = evaluate.kfold(v.samples, row_ids(), 10)
    return rows, [kfold, evaluate.leave_year(), evaluate.leave_site()]


@query("l7_l8_l9_trees_three_schemes")
def _(v):
    rows, schemes = three_schemes(v)
    zoo = [trees.extra(trees=10, depth=6), trees.forest(trees=10, depth=5), trees.boosted(rounds=10, rate=0.3)]
    return evaluate.metrics(trees.cross_validate(rows, X, "y", schemes, zoo), ["model", "scheme"])


@query("l4_huber_three_schemes")
def _(v):
    rows, schemes = three_schemes(v)
    return evaluate.metrics(robust.cross_validate(rows, X, "y", schemes), ["model", "scheme"])


@query("l6_knn_three_schemes")
def _(v):
    rows, schemes = three_schemes(v)
    rows = rows.select(*dict.fromkeys(c for s in schemes for c in s.fold), *X, "y")
    scored = []
    for scheme in schemes:  # one after the other, so that disk holds the tables of one
        with part_of_job(v.spark) as kept:
            scored.append(kept(evaluate.metrics(models.cross_validate_knn(rows, X, "y", [scheme], 10), ["model", "scheme"])))
    return reduce(DataFrame.unionByName, scored)


def selection(v, path=None):
    """The zoo on all features and on those that inflation leaves, under the three schemes."""
    rows, schemes = three_schemes(v)
    every = [*X, "x5"]
    kept, _ = features.vif_elimination(features.moments(rows, every, "y"), 10.0)
    linear_zoo = [LinearModel("ridge", (), "ridge", 10.0), LinearModel("elastic", (), "elastic", 0.05, 0.3), LinearModel("pls", (), "pls", components=2)]
    tree_zoo = [trees.extra(trees=5, depth=5), trees.boosted(rounds=5, rate=0.5)]
    return models.select_model(rows, {"full": every, "pruned": kept}, "y", schemes, linear_zoo, tree_zoo, path=path)


@query("l14_l17_model_ranking")
def _(v):
    return selection(v)[0]


@query(
    "l16_score_region",
    f"""WITH q AS (SELECT site, date, pos, px_x, px_y, avg(CASE WHEN qa & 62 = 0 THEN red END) AS rd, avg(CASE WHEN qa & 62 = 0 THEN nir END) AS nr, avg(CASE WHEN qa & 62 = 0 THEN green END) AS gr,
    avg(CASE WHEN qa & 62 = 0 THEN swir END) AS sw, avg(CASE WHEN qa & 62 = 0 THEN LST END) AS LST_K FROM pixels GROUP BY ALL),
    p AS (SELECT *, CASE WHEN n + r > 0.02 THEN CASE WHEN (n - r) / (n + r) < -1 THEN -1 WHEN (n - r) / (n + r) > 1 THEN 1 ELSE (n - r) / (n + r) END END AS NDVI,
    CASE WHEN g + s > 0.02 THEN CASE WHEN (g - s) / (g + s) < -1 THEN -1 WHEN (g - s) / (g + s) > 1 THEN 1 ELSE (g - s) / (g + s) END END AS MNDWI FROM
    (SELECT *, CASE WHEN rd > 0 THEN rd END AS r, CASE WHEN nr > 0 THEN nr END AS n, CASE WHEN gr > 0 THEN gr END AS g, CASE WHEN sw > 0 THEN sw END AS s FROM q)),
    m AS (SELECT date, avg(LE) / 100 AS srad FROM flux_hh GROUP BY 1),
    z AS (SELECT region, site, date, coalesce(MNDWI > 0 AND NDVI < 0.10, false) AS water, CASE WHEN NOT coalesce(MNDWI > 0 AND NDVI < 0.10, false) THEN 1 + 2 * NDVI + 0.1 * (LST_K - 290) + srad END AS et
    FROM p JOIN inside USING (pos) LEFT JOIN m USING (date) WHERE region % 2 = CAST(substr(site, 2) AS BIGINT) % 2)
    SELECT region, site, date, count(*) AS inside_px, count(CASE WHEN water THEN 1 END) AS water_px, count(et) AS pixels, {rsql('avg(et)', 'mean_ET')}, {rsql('min(et)', 'min_ET')}, {rsql('max(et)', 'max_ET')} FROM z GROUP BY 1, 2, 3""",
)
def _(v):
    from brackish.plans.region_map import map_summary, mapped_pixels

    met = v.flux_hh.groupBy("date").agg((F.avg("LE") / 100).alias("srad"))
    met = v.pixels.select("site", "date").distinct().join(met, "date")

    def predict(df):
        return df.withColumn("pred", F.col("NDVI") * 2 + 1 + (F.col("LST_K") - 290) * 0.1 + F.col("srad"))

    looks = v.pixels.withColumn("zone", F.expr("cast(substring(site, 2) as bigint) % 2"))
    edges = v.edges.withColumn("zone", F.col("region") % 2)
    out = map_summary(mapped_pixels(looks, edges, met, ["NDVI", "LST_K", "srad"], predict, zone=["zone"]))
    return out.select("region", "site", "date", "inside_px", "water_px", "pixels", r("mean_ET"), r("min_ET"), r("max_ET"))


@query(
    "r15_l16_map_of_best_scenes",
    f"""WITH picks AS (SELECT region, scene FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY tier, cloud, scene) AS k FROM (SELECT DISTINCT CAST(substr(site, 2) AS BIGINT) % 5 AS region, scene, scene * 7 % 40 AS cloud,
    CASE WHEN scene * 7 % 40 < 8 THEN 0 WHEN scene * 7 % 40 < 15 THEN 1 WHEN scene * 7 % 40 < 25 THEN 2 END AS tier FROM pixels) WHERE tier IS NOT NULL) WHERE k = 1),
    q AS (SELECT site, scene, date, pos, px_x, px_y, avg(CASE WHEN qa & 62 = 0 THEN red END) AS rd, avg(CASE WHEN qa & 62 = 0 THEN nir END) AS nr, avg(CASE WHEN qa & 62 = 0 THEN green END) AS gr,
    avg(CASE WHEN qa & 62 = 0 THEN swir END) AS sw, avg(CASE WHEN qa & 62 = 0 THEN LST END) AS LST_K FROM pixels GROUP BY ALL),
    p AS (SELECT *, CASE WHEN n + r > 0.02 THEN CASE WHEN (n - r) / (n + r) < -1 THEN -1 WHEN (n - r) / (n + r) > 1 THEN 1 ELSE (n - r) / (n + r) END END AS NDVI,
    CASE WHEN g + s > 0.02 THEN CASE WHEN (g - s) / (g + s) < -1 THEN -1 WHEN (g - s) / (g + s) > 1 THEN 1 ELSE (g - s) / (g + s) END END AS MNDWI FROM
    (SELECT *, CASE WHEN rd > 0 THEN rd END AS r, CASE WHEN nr > 0 THEN nr END AS n, CASE WHEN gr > 0 THEN gr END AS g, CASE WHEN sw > 0 THEN sw END AS s FROM q)),
    z AS (SELECT region, scene, site, date, coalesce(MNDWI > 0 AND NDVI < 0.10, false) AS water, CASE WHEN NOT coalesce(MNDWI > 0 AND NDVI < 0.10, false) THEN 1 + 2 * NDVI + 0.1 * (LST_K - 290) END AS et
    FROM p JOIN inside USING (pos) JOIN picks USING (region, scene))
    SELECT region, site, scene, date, count(*) AS inside_px, count(CASE WHEN water THEN 1 END) AS water_px, count(et) AS pixels, {rsql('avg(et)', 'mean_ET')}, {rsql('min(et)', 'min_ET')}, {rsql('max(et)', 'max_ET')} FROM z GROUP BY 1, 2, 3, 4""",
)
def _(v):
    from brackish.plans.region_map import best_scene_map, map_summary

    of_site = F.expr("cast(substring(site, 2) as bigint) % 5")
    scenes = v.pixels.groupBy(of_site.alias("region"), "scene").agg(
        (F.col("scene") * 7 % 40).alias("cloud"),
        *[e(c).alias(n) for c, lo, hi in (("px_x", "x_lo", "x_hi"), ("px_y", "y_lo", "y_hi")) for e, n in ((F.min, lo), (F.max, hi))],
        F.lit(5).alias("n_assets"),
    )
    regions = v.edges.select("region").distinct().select("region", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(5).alias("need"))
    met = v.pixels.select("site", "date").distinct()

    def predict(df):
        return df.withColumn("pred", F.col("NDVI") * 2 + 1 + (F.col("LST_K") - 290) * 0.1)

    looks, edges = (t.withColumn("zone", F.lit(0)) for t in (v.pixels, v.edges))
    out = map_summary(best_scene_map(looks, scenes, regions, edges, met, ["NDVI", "LST_K"], predict, ["zone"]), ("site", "scene", "date"))
    return out.select("region", "site", "scene", "date", "inside_px", "water_px", "pixels", r("mean_ET"), r("min_ET"), r("max_ET"))


@query("l14_l15_l16_saved_forest")
def _(v):
    import uuid

    from brackish.session import work_folder

    path = f"{work_folder(v.spark)}/model-{uuid.uuid4().hex}"
    rows = v.strict.dropna(subset=["NDVI", "MNDWI", "LST"])
    fitted = models.forest(trees=10, depth=5)(rows, ["NDVI", "MNDWI"], "LST")
    models.save_model(fitted, path, {"features": ["NDVI", "MNDWI"]})
    predict, meta = models.load_model(v.spark, path, lambda: (fitted, {}))
    met = v.pixels.select("site", "scene").distinct()
    out = models.score_pixels(v.strict, met, ["site", "scene"], meta["features"], predict)
    return out.groupBy("site").agg(F.count("pred").alias("n"), F.avg("pred").alias("mean"))


@query("a5_pivot_models", f"WITH t AS ({ridge_one('x1', 10.0, 'site', 'samples', 'x1')} UNION ALL {ridge_one('x2', 10.0, 'site', 'samples', 'x2')}) SELECT 'ridge' AS model, max(CASE WHEN feature_set = 'x1' THEN r2 END) AS x1, max(CASE WHEN feature_set = 'x2' THEN r2 END) AS x2 FROM t")
def _(v):
    from brackish.operators.catalog import pivot_values

    out = features.compare_feature_sets(v.samples, SETS, "y", [evaluate.leave_site()]).withColumn("model", F.lit("ridge"))
    return pivot_values(out, "model", "feature_set", "r2", ["x1", "x2"]).select("model", r("x1"), r("x2"))
