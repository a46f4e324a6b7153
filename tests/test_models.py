"""Linear algebra against direct fits, screening against definitions, neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackish.operators import catalog, downscale, evaluate, features, linear, models
from brackish.operators.linear import LinearModel

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "site": rng.integers(0, 5, n).astype(str), "year": rng.integers(2000, 2004, n), "a": rng.normal(300, 2, n), "b": rng.normal(0, 1, n)})
    pdf["c"] = pdf["a"] + rng.normal(0, 0.5, n)
    pdf["y"] = 0.3 * pdf["a"] - 0.5 * pdf["b"] + rng.normal(0, 0.3, n)
    return pdf


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table)


def direct(train, test, alpha):
    mean, sd = train[X].mean(), train[X].std(ddof=0)
    z, y = ((train[X] - mean) / sd).to_numpy(), train["y"].to_numpy()
    b = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    return ((test[X] - mean) / sd).to_numpy() @ b + y.mean()


@pytest.mark.parametrize("turn", [1, -1])
def test_offsets_of_one_site_do_not_touch_another(spark, turn):
    rng = np.random.default_rng(5)
    rows = [(s, offset + float(x), 2 * float(x) + float(e)) for s, offset in (("low", 0.0), ("high", 1e8)) for x, e in zip(rng.normal(0, 1, 1500), rng.normal(0, 0.1, 1500))]
    df = spark.createDataFrame(rows[::turn], "site string, x double, y double").coalesce(1)
    fits, grams = linear.fit_by_key(df, ["x"], "y", ["site"], [LinearModel("m", ("x",), "ols")])
    got = {r["site"]: r["value"] for r in linear.coefficients(fits, grams, ["site"]).where("feature = 'x'").collect()}
    want = {r["site"]: r["b"] for r in df.groupBy("site").agg(F.regr_slope("y", "x").alias("b")).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("alpha", [0.0, 10.0])
def test_subtracted_fit_equals_direct_fit(df, table, alpha):
    model = LinearModel("m", tuple(X), "ridge" if alpha else "ols", alpha)
    got = linear.cross_validate(df, X, "y", evaluate.leave_site(), [model]).toPandas().set_index("id")["pred"]
    for s, test in table.groupby("site"):
        np.testing.assert_allclose(got[test["id"]], direct(table[table["site"] != s], test, alpha), atol=1e-8)


def test_leave_year_uses_same_site_and_gates(df, table):
    scheme = evaluate.leave_year(min_test=18, min_train=15)
    got = linear.cross_validate(df, X, "y", scheme, [LinearModel("m", tuple(X), "ridge", 1.0)]).toPandas().set_index("id")["pred"]
    sizes = table.groupby(["site", "year"]).size()
    assert len(got) == sizes[sizes >= 18].sum()
    for (s, y), test in table.groupby(["site", "year"]):
        if len(test) >= 18:
            train = table[(table["site"] == s) & (table["year"] != y)]
            np.testing.assert_allclose(got[test["id"]], direct(train, test, 1.0), atol=1e-8)


def test_feature_subset_is_a_submatrix(df, table):
    zoo = [LinearModel("two", ("a", "b"), "ols")]
    got = linear.cross_validate(df, X, "y", evaluate.leave_site(), zoo).toPandas().set_index("id")["pred"]
    test, train = table[table["site"] == "0"], table[table["site"] != "0"]
    design = np.c_[np.ones(len(train)), train[["a", "b"]]]
    b = np.linalg.lstsq(design, train["y"], rcond=None)[0]
    np.testing.assert_allclose(got[test["id"]], np.c_[np.ones(len(test)), test[["a", "b"]]] @ b, atol=1e-7)


def test_elastic_net_meets_its_optimality_conditions(df, table):
    fits, grams = linear.fit_by_key(df, X, "y", [], [LinearModel("e", tuple(X), "elastic", 0.05, 0.3)])
    row = fits.first()
    sd = table[X].std(ddof=0).to_numpy()
    b = np.array(row["beta"]) * sd
    z = (table[X].to_numpy() - table[X].mean().to_numpy()) / sd
    grad = z.T @ ((table["y"] - table["y"].mean()).to_numpy() - z @ b) / len(z) - 0.05 * 0.7 * b
    for g, coef in zip(grad, b):
        assert abs(g) <= 0.015 + 1e-8 if coef == 0 else g == pytest.approx(0.015 * np.sign(coef), abs=1e-7)


def test_full_rank_pls_is_least_squares(df):
    zoo = [LinearModel("pls", tuple(X), "pls", components=3), LinearModel("ols", tuple(X), "ols")]
    wide = linear.cross_validate(df, X, "y", evaluate.leave_site(), zoo).groupBy("id").pivot("model", ["pls", "ols"]).agg(F.first("pred"))
    assert wide.agg(F.max(F.abs(F.col("pls") - F.col("ols")))).first()[0] < 1e-6


def test_coefficients_in_data_units(df, table):
    fits, grams = linear.fit_by_key(df, X, "y", [], [LinearModel("o", tuple(X), "ols")])
    got = {r["feature"]: r["value"] for r in linear.coefficients(fits, grams).collect()}
    b = np.linalg.lstsq(np.c_[np.ones(len(table)), table[X]], table["y"], rcond=None)[0]
    np.testing.assert_allclose([got["(intercept)"], *[got[f] for f in X]], b, rtol=1e-6)


def test_vif_is_one_over_unexplained_share(df, table):
    got = features.inflation(features.moments(df, X, "y"), X)
    for f in X:
        rest = [g for g in X if g != f]
        design = np.c_[np.ones(len(table)), table[rest]]
        fit = design @ np.linalg.lstsq(design, table[f], rcond=None)[0]
        r2 = 1 - ((table[f] - fit) ** 2).sum() / ((table[f] - table[f].mean()) ** 2).sum()
        assert got[f] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_exact_collinearity_hits_the_floor(spark):
    rows = [(float(i), 2.0 * i, float(i % 7), float(i % 3)) for i in range(50)]
    m = features.moments(spark.createDataFrame(rows, "a double, b double, c double, y double"), ["a", "b", "c"], "y")
    vif = features.inflation(m, ["a", "b", "c"])
    assert vif["a"] > 1e8 and vif["b"] > 1e8 and vif["c"] < 2
    kept, dropped = features.vif_elimination(m)
    assert len(kept) == 2 and "c" in kept and dropped[0][0] in ("a", "b")


def test_clusters_join_correlated_features(df, table):
    groups = features.cluster_representatives(features.moments(df, X, "y"))
    best = max(("a", "c"), key=lambda f: abs(table[f].corr(table["y"])))
    assert groups == {best: ["a", "c"], "b": ["b"]}


def test_forward_selection_and_criteria(df, table):
    m = features.moments(df, X, "y")
    chosen = [f for f, _ in features.forward_selection(m, "bic")]
    assert set(chosen[:2]) == {"a", "b"}
    design = np.c_[np.ones(len(table)), table[["a", "b"]]]
    sse = float(((table["y"] - design @ np.linalg.lstsq(design, table["y"], rcond=None)[0]) ** 2).sum())
    n = len(table)
    loglik = -n / 2 * (np.log(2 * np.pi * sse / n) + 1)
    assert features.information(m, ["a", "b"])["aic"] == pytest.approx(6 - 2 * loglik, rel=1e-9)
    assert features.information(m, ["a", "b"])["bic"] == pytest.approx(3 * np.log(n) - 2 * loglik, rel=1e-9)


@pytest.mark.parametrize("weights,block", [("distance", 50_000), ("uniform", 50_000), ("distance", 70)])
def test_knn_brute_force(df, table, weights, block):
    train, test = table[table["year"] < 2003], table[table["year"] == 2003]
    got = models.knn(5, weights, block)(df.where("year < 2003"), X, "y")(df.where("year = 2003")).toPandas().set_index("id")["pred"]
    mean, sd = train[X].mean(), train[X].std(ddof=0)
    z, q = ((train[X] - mean) / sd).to_numpy(), ((test[X] - mean) / sd).to_numpy()
    for i, p in zip(test["id"], q):
        d = np.sqrt(((z - p) ** 2).sum(axis=1))
        near = np.argsort(d)[:5]
        w = np.ones(5) if weights == "uniform" else 1 / d[near]
        assert got[i] == pytest.approx(float((w * train["y"].to_numpy()[near]).sum() / w.sum()), rel=1e-9)


def test_knn_exact_hit_wins(spark):
    train = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, 9.0)], "a double, y double")
    out = models.knn(2)(train, ["a"], "y")(spark.createDataFrame([(1.0,)], "a double"))
    assert out.first()["pred"] == 2.0


def test_permuted_donors_are_a_permutation_within_the_group(df):
    out = features.shuffled_donors(df, ["id"], "site", ["b"], 2)
    assert out.count() == 2 * df.count()
    want = df.groupBy("site").agg(F.sum("b").alias("s"))
    got = out.groupBy("site", "repeat").agg(F.sum("_d_b").alias("t"), F.countDistinct("_d_b").alias("u"), F.countDistinct("b").alias("n"))
    rows = got.join(want, "site").collect()
    assert all(r["t"] == pytest.approx(r["s"]) and r["u"] == r["n"] for r in rows)
    assert out.where(F.col("b") != F.col("_d_b")).count() > 600


def test_permutation_importance_finds_the_drivers(df):
    fits, grams = linear.fit_by_key(df, X, "y", [], [LinearModel("o", ("a", "b"), "ols")])

    def predict(rows):
        return linear.apply_fits(rows, fits, grams, []).drop("model")

    got = {r["feature"]: r["importance"] for r in features.permutation_importance(df, ["id"], X, "y", predict, repeats=3).collect()}
    assert got["a"] > 0.1 and got["b"] > 0.1 and got["c"] == pytest.approx(0, abs=1e-9)


def test_month_blocks_keep_months_whole(spark):
    import datetime as dt

    rows = [("a", dt.date(2020, 1 + i // 20, 1 + i % 20), float(i)) for i in range(140)] + [("b", dt.date(2020, 1, 1), 1.0)]
    out, scheme = evaluate.month_blocks(spark.createDataFrame(rows, "site string, date date, y double"), "date")
    assert out.select("site").distinct().count() == 1
    assert out.groupBy(F.month("date")).agg(F.countDistinct("month_fold").alias("k")).where("k <> 1").count() == 0
    assert out.select("month_fold").distinct().count() == 5


def test_split_has_no_key_on_both_sides(df):
    out = catalog.block_split(df.withColumn("k", F.col("id") % 40), [F.col("k")])
    assert out.groupBy("k").agg(F.countDistinct("is_train").alias("n")).where("n > 1").count() == 0
    assert 0.4 < out.agg(F.avg(F.col("is_train").cast("int"))).first()[0] < 0.95


def test_downscaled_pixels_average_to_the_coarse_value(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame([(s, x * 10.0, y * 10.0) for s in "ab" for x in range(9) for y in range(9)], columns=["site", "px", "py"])
    pdf["ndvi"] = rng.random(len(pdf))
    pdf["LST"] = 300 - 8 * pdf["ndvi"] + rng.normal(0, 0.5, len(pdf))
    fine = downscale.coarsen(spark.createDataFrame(pdf), ["site"], "px", "py", 30.0, ["LST"])
    out = downscale.downscale(fine, ["site"], ["cell_x", "cell_y"], "LST_coarse", ["ndvi"])
    cells = out.groupBy("site", "cell_x", "cell_y").agg(F.avg("sharp").alias("s"), F.first("LST_coarse").alias("c"))
    assert cells.agg(F.max(F.abs(F.col("s") - F.col("c")))).first()[0] < 1e-9
    assert out.agg(F.corr("sharp", "LST")).first()[0] > 0.8


def test_gapfill_model_keeps_measurements_and_flags(spark):
    import datetime as dt

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    et = spark.createDataFrame([("a", d, 1.0 + 0.1 * i) for i, d in enumerate(days) if i % 3 == 0], "site string, date date, ET double")
    met = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days) if i % 5], "site string, date date, t double")
    out = models.gapfill_model(et, met, ["site"], ["t"], model=LinearModel("l", ("t",), "ols")).toPandas()
    known = out[out["ET_measured"].notna()]
    assert (known["ET_final"] == known["ET_measured"]).all() and not known["is_filled"].any()
    filled = out[out["is_filled"]].sort_values("date")
    want = [1.0 + 0.1 * (d - days[0]).days for d in filled["date"]]
    np.testing.assert_allclose(filled["ET_final"], want, atol=1e-9)


def test_failing_model_leaves_its_reason(df):
    def broken(*_):
        raise RuntimeError("no fit today")

    out = models.score_table(df, X, "y", [evaluate.leave_site()], [LinearModel("ols", tuple(X), "ols")], {"bad": ("forest", broken)})
    rows = {r["model"]: r for r in out.collect()}
    assert rows["ols"]["r2"] > 0.5 and rows["ols"]["family"] == "linear" and "no fit today" in rows["bad"]["error"]


def test_model_round_trip_and_fallback(spark, df, tmp_path):
    fitted = models.forest(trees=5, depth=3)(df, X, "y")
    models.save_model(fitted, str(tmp_path / "m"), {"features": X})
    loaded, meta = models.load_model(spark, str(tmp_path / "m"), lambda: pytest.fail("must load"))
    a, b = (f(df).orderBy("id").toPandas()["pred"] for f in (fitted, loaded))
    assert meta["features"] == X and (a == b).all()
    assert models.load_model(spark, str(tmp_path / "absent"), lambda: ("trained", {}))[0] == "trained"


def test_row_folds_agree_with_linear_folds(df):
    def ols(train, cols, target):
        fits, grams = linear.fit_by_key(train, cols, target, [], [LinearModel("o", tuple(cols), "ols")])
        return lambda rows: linear.apply_fits(rows, fits, grams, []).drop("model")

    slow = models.cross_validate_rows(df, X, "y", evaluate.leave_site(), ols, "o").select("id", F.col("pred").alias("p"))
    fast = linear.cross_validate(df, X, "y", evaluate.leave_site(), [LinearModel("o", tuple(X), "ols")])
    assert fast.join(slow, "id").agg(F.max(F.abs(F.col("pred") - F.col("p"))), F.count("p")).first()[:] == pytest.approx((0, 400), abs=1e-7)


def test_month_blocks_are_dealt_by_size(spark):
    """Largest month first, each into the fold with the fewest rows: a greedy deal by hand."""
    import datetime
    import random

    rng = random.Random(4)
    rows = []
    for site, months in (("a", 17), ("b", 5), ("c", 4)):
        for m in range(months):
            day = datetime.date(2000 + m // 12, m % 12 + 1, 1)
            rows += [(site, day + datetime.timedelta(days=d % 28), float(d)) for d in range(rng.randint(1, 40))]
    out, _ = evaluate.month_blocks(spark.createDataFrame(rows, "site string, date date, y double"), "date")
    got = {(r["site"], r["m"]): r["month_fold"] for r in out.select("site", F.trunc("date", "month").alias("m"), "month_fold").distinct().collect()}
    want = {}
    for site in "ab":
        sizes = {}
        for s, d, _ in rows:
            if s == site:
                sizes[d.replace(day=1)] = sizes.get(d.replace(day=1), 0) + 1
        full = [0] * 5
        for m, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            i = full.index(min(full))
            full[i] += n
            want[site, m] = i
    assert got == want


def test_huber_of_all_folds_is_the_fit_on_rows(spark):
    """Against Spark ML's fit on the rows of each fold, with outliers and four features."""
    import numpy as np

    from brackish.operators import robust

    rng = np.random.default_rng(9)
    x = rng.normal([0, 10, -3, 0.5], [1, 5, 0.1, 2], (600, 4))
    y = x @ [1.0, -0.3, 4.0, 0.0] + 2 + rng.normal(0, 0.5, 600) + np.where(rng.random(600) < 0.1, rng.normal(0, 20, 600), 0)
    cols = ["a", "b", "c", "d"]
    table = spark.createDataFrame([(i, f"S{i % 3}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, site string, a double, b double, c double, d double, y double")
    oof = robust.cross_validate(table, cols, "y", [evaluate.leave_site()]).toPandas()
    assert len(oof) == 600 and set(oof["scheme"]) == {"leave_site"}
    for site in ("S0", "S1", "S2"):
        slow = models.huber()(table.where(f"site <> '{site}'"), cols, "y")(table.where(f"site = '{site}'")).toPandas().set_index("id")["pred"]
        fast = oof[oof["site"] == site].set_index("id")["pred"]
        assert np.allclose(slow.sort_index(), fast.sort_index(), atol=5e-3)
