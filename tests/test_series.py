"""Hand-computed frames and brute-force comparisons for series operators."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brackish.operators import blocks, series


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def frame(spark, values, site="a"):
    return spark.createDataFrame([(site, i, v) for i, v in enumerate(values)], "site string, slot long, x double")


def column(df, name, order="slot"):
    return [row[name] for row in df.orderBy(order).collect()]


def test_prefix_fills_start_of_long_gap(spark):
    df = frame(spark, [None, 1.0, None, None, None, None, 6.0, None])
    prefix = series.interpolate(df, ["site"], "slot", ["x"], 2)
    whole = series.interpolate(df, ["site"], "slot", ["x"], 2, "whole_gap")
    assert column(prefix, "x_int") == [None, 1.0, 2.0, 3.0, None, None, 6.0, None]
    assert column(whole, "x_int") == [None, 1.0, None, None, None, None, 6.0, None]


def test_age_counts_from_last_known(spark):
    df = frame(spark, [None, 1.0, None, None, 2.0])
    assert column(series.interpolate(df, ["site"], "slot", ["x"], 1, age=True), "x_age") == [None, 0, 1, 2, 0]


@pytest.mark.parametrize("length", [4, 16, 1024])
def test_neighbours_do_not_depend_on_block_length(spark, length):
    rng = random.Random(3)
    rows = [(s, i, rng.random() if rng.random() < 0.2 else None) for s in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "site string, slot long, x double")
    got = blocks.with_neighbours(df, ["site"], "slot", ["x"], length).toPandas().sort_values(["site", "slot"])
    for _, part in got.groupby("site"):
        want = part["x"].ffill()
        prev = part["x__prev"].map(lambda r: np.nan if r is None else r["v"])
        after = part["x__next"].map(lambda r: np.nan if r is None else r["v"])
        np.testing.assert_array_equal(prev, want)
        np.testing.assert_array_equal(after, part["x"].bfill())


@pytest.mark.parametrize("length", [8, 1024])
def test_position_and_rolling_rows_match_pandas(spark, length):
    rng = random.Random(5)
    slots = sorted(rng.sample(range(400), 150))
    pdf = pd.DataFrame({"site": "a", "slot": slots, "x": [rng.random() if rng.random() < 0.8 else None for _ in slots]})
    df = spark.createDataFrame(pdf)
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    placed = blocks.with_position(df, ["site"], "slot", length=length)
    assert column(placed, "_pos") == list(range(150))
    got = column(series.rolling(df, ["site"], "slot", 7, {"m": ("x", "mean")}, min_periods=3), "m")
    want = pdf["x"].rolling(7, min_periods=3).mean()
    np.testing.assert_allclose([np.nan if v is None else v for v in got], want, atol=1e-12)


def test_trailing_across_block_edges(spark):
    df = frame(spark, [float(i) for i in range(60)])
    out = blocks.trailing(df, ["site"], "slot", {"s": (5, lambda w: F.sum("x").over(w)), "l": blocks.lagged("x")}, length=8)
    assert out.count() == 60
    assert column(out, "s") == list(pd.Series(range(60), dtype=float).rolling(5, min_periods=1).sum())
    assert column(out, "l") == [None] + [float(i) for i in range(59)]


def test_ninety_days_are_open_on_the_left(spark):
    dates = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 3, 31), dt.date(2020, 4, 1)]
    df = spark.createDataFrame([("a", d, 1.0) for d in dates], "site string, date date, x double")
    assert column(series.rolling_days(df, ["site"], "date", 90, {"n": ("x", "count")}), "n", "date") == [1, 2, 2, 2]


def test_eight_day_bins_start_at_first_day(spark):
    dates = [dt.date(2020, 1, d) for d in (5, 6, 7, 12, 13, 14, 20)]
    df = spark.createDataFrame([("a", d, 1.0) for d in dates], "site string, date date, x double")
    out = series.period_mean(df, ["site"], "date", ["x"], "x", "8D", 3)
    assert column(out, "date", "date") == [dt.date(2020, 1, 5), dt.date(2020, 1, 13)]


def test_deaccumulate_keeps_first_of_day(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 1), 5.0), ("a", dt.datetime(2020, 1, 1, 2), 7.0), ("a", dt.datetime(2020, 1, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, x double")
    assert column(series.deaccumulate(df, ["site"], "ts", ["x"]), "x", "ts") == [5.0, 2.0, 9.0]


def test_densify_covers_every_slot_once(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 9, 2.0), ("b", -2, 3.0), ("b", -2 + 1500, 4.0)], "site string, slot long, x double")
    out = blocks.densify(df, ["site"], "slot", length=8)
    counts = {r["site"]: (r["n"], r["k"]) for r in out.groupBy("site").agg(F.count("slot").alias("n"), F.count("x").alias("k")).collect()}
    assert counts == {"a": (7, 2), "b": (1501, 2)}


def test_densify_fixed_period_drops_rows_outside(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(9), 2.0)], "site string, date date, x double")
    out = series.dense_daily(df, ["site"], lo="2020-01-02", hi="2020-01-12")
    assert column(out, "x", "date") == [None] * 8 + [2.0] + [None] * 2


@pytest.mark.parametrize("parts", [2, 16, 256])
def test_quantiles_match_numpy(spark, parts):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 501)] + [("b", float(x)) for x in rng.integers(0, 3, 400)] + [("c", 5.0)] * 30 + [("d", 1e8 + float(x)) for x in rng.normal(0, 1e-3, 99)]
    df = spark.createDataFrame(rows + [("a", None), ("a", float("nan")), ("e", None), ("e", float("nan"))], "site string, x double")
    got = {r["site"]: r for r in blocks.group_quantiles(df, ["site"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, parts).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    for site, row in got.items():
        values = [x for s, x in rows if s == site]
        assert np.allclose([row["p10"], row["p50"], row["p99"]], np.quantile(values, [0.1, 0.5, 0.99]), rtol=1e-14, atol=1e-14)
    total = blocks.group_quantiles(df, [], "x", {"p50": 0.5}, parts).first()["p50"]
    assert total == pytest.approx(np.median([x for _, x in rows]))


def test_quantiles_with_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", x) for x in (-inf, 1.0, 2.0, 3.0, inf)] + [("b", inf), ("b", inf), ("c", -1.7e308), ("c", 1.7e308)], "site string, x double")
    got = {r["site"]: (r["low"], r["mid"]) for r in blocks.group_quantiles(df, ["site"], "x", {"low": 0.0, "mid": 0.5}, 4).collect()}
    assert got["a"] == (-inf, 2.0) and got["b"] == (inf, inf) and got["c"][0] == -1.7e308


def test_rolling_is_hidden_in_long_gaps(spark):
    rows = [("a", day(i), 1.0) for i in range(12)] + [("a", day(60 + i), 3.0) for i in range(12)]
    df = spark.createDataFrame(rows, "site string, date date, x double")
    out = {r["date"]: r["x_roll"] for r in series.rolling_masked(df, ["site"], "date", "x").collect()}
    assert out[day(8)] is None and out[day(9)] == 1.0
    assert out[day(31)] == 1.0 and out[day(32)] is None and out[day(71)] == 3.0


def test_combine_first_prefers_earlier_source(spark):
    a = spark.createDataFrame([("a", 1, None, 1.0)], "site string, d int, x double, y double")
    b = spark.createDataFrame([("a", 1, 5.0, 2.0), ("a", 2, 6.0, None)], "site string, d int, x double, y double")
    rows = series.combine_first(["site", "d"], a, b).orderBy("d").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(5.0, 1.0), (6.0, None)]


def test_gapfill_never_touches_measurements(spark):
    rng = random.Random(9)
    et = spark.createDataFrame([("a", day(i), rng.random() * 4) for i in range(0, 120, 7)], "site string, date date, ET double")
    met = spark.createDataFrame([("a", day(i), 2.0 + (i % 3)) for i in range(120)], "site string, date date, ETo double")
    out = series.gapfill_reference(et, met, ["site"])
    bad = out.where(F.col("ET").isNotNull() & ((F.col("ET") != F.col("ET_gapfilled")) | F.col("is_filled")))
    assert bad.count() == 0
    assert out.where("is_filled").count() > 0


def test_wet_fraction_counts_unknown_as_dry(spark):
    base = dt.datetime(2020, 1, 1)
    levels = [1.0] * 9 + [5.0]
    rows = [("a", base + dt.timedelta(hours=i), v) for i, v in enumerate(levels)]
    rows.append(("a", base + dt.timedelta(hours=40), 1.0))
    df = spark.createDataFrame(rows, "site string, ts timestamp, water_level_m double")
    out = series.tide_features(df, ["site"]).orderBy("ts").toPandas()
    gap = out[(out["ts"] > pd.Timestamp(base + dt.timedelta(hours=11))) & (out["ts"] < pd.Timestamp(base + dt.timedelta(hours=39)))]
    assert gap["water_level_m"].isna().any()
    assert out["inundation_frac_24h"].notna().all()


def test_stride_sample_is_even_and_capped(spark):
    df = frame(spark, [1.0] * 1000)
    kept = column(series.stride_sample(df, ["site"], "slot", 90), "slot")
    assert len(kept) == 90 and kept[:3] == [0, 11, 22]


def test_first_per_group_keeps_whole_row(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 5, "z")], "k string, n int, v string")
    rows = blocks.first_per_group(df, ["k"], [F.col("n")]).orderBy("k").collect()
    assert [(r["n"], r["v"]) for r in rows] == [(1, None), (5, "z")]


def test_dense_fill_equals_densify_then_interpolate(spark):
    rng = random.Random(6)
    rows = [(s, i, rng.random(), rng.random() if i % 3 else None) for s in "abc" for i in sorted(rng.sample(range(-40, 5000), 30))]
    df = spark.createDataFrame(rows, "site string, slot long, x double, z double")
    for lo, hi in ((None, None), (-2000, 3000)):
        one = series.fill_dense(df, ["site"], "slot", ["x", "z"], 700, age=True, lo=lo, hi=hi)
        two = series.interpolate(blocks.densify(df, ["site"], "slot", lo, hi), ["site"], "slot", ["x", "z"], 700, age=True)
        assert one.count() == two.count() and one.exceptAll(two.select(one.columns)).count() == 0
