"""Gates, closure, coverage, contracts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brackish.functions import energy, gates, names, spectral
from brackish.operators import checks, flux


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} double" for c in cols))


def test_closure_reverts_when_it_doubles(spark):
    schema = "LE double, H double, NETRAD double, G double"
    rows = [(100.0, 100.0, 800.0, 0.0), (100.0, 100.0, 300.0, None), (100.0, 100.0, 15.0, 0.0), (0.0, 50.0, 90.0, 0.0), (None, 1.0, 500.0, 0.0)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(energy.bowen_closed(*[F.col(c) for c in ("LE", "H", "NETRAD", "G")])).collect()]
    assert got == [100.0, 150.0, 100.0, 0.0, None]


@pytest.mark.parametrize("present,kept", [(38, False), (39, True)])
def test_coverage_boundary(spark, present, kept):
    start = dt.datetime(2020, 6, 1)
    rows = [("a", start + dt.timedelta(minutes=30 * i), 50.0 if i < present else None, 20.0, 100.0, 5.0, 20.0) for i in range(48)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, LE_qc double, H double, NETRAD double, G double, TA double")
    day = flux.daily_closed(flux.close_balance(df), ["site"], F.to_date("ts")).first()
    assert (day["ET_closed_mm"] is not None) is kept
    assert day["coverage"] == pytest.approx(present / 48)


def test_expected_slots_change_coverage(spark):
    rows = [("a", dt.datetime(2020, 6, 1, i), 50.0, 20.0, 100.0, 5.0, 20.0) for i in range(10)]
    df = flux.close_balance(spark.createDataFrame(rows, "site string, ts timestamp, LE_qc double, H double, NETRAD double, G double, TA double"))
    assert flux.daily_closed(df, ["site"], F.to_date("ts")).first()["ET_closed_mm"] is not None
    assert flux.daily_closed(df, ["site"], F.to_date("ts"), expected_slots=48).first()["ET_closed_mm"] is None


def test_unknown_never_condemns(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, 2, None), (1.0, 0, 0.05), (1.0, 1, 0.1)], "LE double, QC int, USTAR double")
    got = [r["LE_qc"] for r in flux.qc_gates(df).collect()]
    assert got == [1.0, None, None, 1.0]


def test_qa_bits(spark):
    df = spark.createDataFrame([(q,) for q in (0, 1, 2, 32, 63, None)], "qa int")
    assert [r[0] for r in df.select(gates.is_clear(F.col("qa"))).collect()] == [True, True, False, False, False, True]


def test_sentinel_and_nan_become_null(spark):
    df = spark.createDataFrame([(-9999.0,), (float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(gates.known(F.col("x"))).collect()] == [None, None, 1.5, None]


def test_variable_names():
    cols = ["LE_1_1_1", "LE_PI_F", "LE_SSITC_TEST", "LE_PI", "TA_2_1_1", "TA_1_1_1"]
    assert names.pick(cols, "LE") == "LE_PI"
    assert names.pick(cols, "TA") == "TA_1_1_1"
    assert names.pick([*cols, "LE"], "LE") == "LE"
    assert names.pick(cols, "H") is None
    assert names.pick(["LE_RANDUNC"], "LE") is None and names.pick_prefix(["LE_RANDUNC"], "LE") == "LE_RANDUNC"


def test_missing_required_column_leaves_nothing(spark):
    df = one(spark, a=1.0)
    assert checks.require_columns(df, ["a"]).count() == 1
    assert checks.require_columns(df, ["a", "b"]).count() == 0


def test_plausibility_raises(spark):
    df = spark.createDataFrame([("a", 295.0), ("a", 300.0), ("b", None)], "site string, LST_K double")
    checks.assert_plausible(df.where("site = 'a'"), ["site"], [checks.LST_MEDIAN, checks.LST_PRESENT])
    with pytest.raises(checks.ImplausibleData, match="usable LST"):
        checks.assert_plausible(df, ["site"], [checks.LST_PRESENT])


def test_fill_ta_without_column(spark):
    df = spark.createDataFrame([("a",)], "site string")
    assert flux.fill_ta(df, ["site"]).first()["TA"] == 25.0


def test_index_guards(spark):
    df = spark.createDataFrame([(0.01, 0.005), (-0.1, 0.5), (0.1, 0.4)], "red double, nir double")
    clipped = [r[0] for r in df.select(spectral.clipped_ratio(F.col("nir"), F.col("red"))).collect()]
    strict = [r[0] for r in df.select(spectral.strict_ratio(F.col("nir"), F.col("red"))).collect()]
    assert clipped[0] is None and clipped[1] == 1.0 and clipped[2] == pytest.approx(0.6)
    assert strict[0] is None and strict[1] is None and strict[2] == pytest.approx(0.6)


def halfhours(site, ta=lambda i: 20.0, le=100.0, **more):
    start = dt.datetime(2020, 6, 1)
    return [(site, start + dt.timedelta(minutes=30 * i), le, 100.0, 300.0, 0.0, ta(i), 0.5, 0) for i in range(48)]


HALFHOUR = "site string, ts timestamp, LE double, H double, NETRAD double, G double, TA double, USTAR double, QC int"


def test_missing_temperature_does_not_cost_the_day(spark):
    from brackish.plans.daily_et import daily_et

    rows = halfhours("a", lambda i: None if i % 4 == 0 else 20.0)
    day = daily_et(spark.createDataFrame(rows, HALFHOUR)).first()
    assert day["coverage"] == 1.0 and day["ET_closed_mm"] == pytest.approx(24 * 3600 * 150.0 / ((2.501 - 0.00237 * 20) * 1e6))


def test_every_site_gets_its_best_route(spark):
    from brackish.plans.daily_et import best_daily_et

    day = dt.date(2020, 6, 1)
    published = spark.createDataFrame([("a", day, 80.0, 70.0, 20.0, 60.0, 90.0)], "site string, date date, LE_closed double, LE_open double, TA_C double, LE_CORR_25 double, LE_CORR_75 double")
    hourly = spark.createDataFrame(halfhours("a") + halfhours("b"), HALFHOUR)
    raw = spark.createDataFrame(halfhours("b") + halfhours("c", le=90.0), HALFHOUR)
    got = {r["site"]: r for r in best_daily_et(published, hourly, raw).collect()}
    assert {s: r["CLOSURE"] for s, r in got.items()} == {"a": "ONEFlux_LE_CORR", "b": "FLUXNET_bowen_G0", "c": "BASE_bowen_ratio"}
    assert got["a"]["ET_lo_mm"] < got["a"]["ET_hi_mm"] and got["c"]["ET_closed_mm"] > got["c"]["ET_open_mm"] and got["b"]["ET_lo_mm"] is None
