"""Plan shapes that must hold at any size."""

import os
import re

import pytest
from pyspark.sql import functions as F

from brackish.functions.energy import clip
from brackish.operators import energy_supply, evaluate, flux, series
from brackish.plans.daily_et import daily_et, processing_report
from brackish.plans.views import Views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_table_is_one_shuffle_on_site_and_day(spark, tmp_path):
    path = str(tmp_path / "hh")
    Views(spark, FOLDER).flux_hh.drop("date").write.parquet(path)
    text = plan(daily_et(spark.read.parquet(path)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<site:string,ts:timestamp,LE:double,H:double" in text and "slot" not in text
    assert processing_report(spark.read.parquet(path)).count() == 5


def test_filters_and_columns_reach_the_scan(spark):
    et = Views(spark, FOLDER).table("orders").where("o_orderdate >= '1997-01-01'").select("o_custkey", "o_orderdate")
    text = plan(et)
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderdate\), GreaterThanOrEqual\(o_orderdate", text)
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_no_window_is_partitioned_by_site_alone_over_rows(spark):
    """Windows by site only appear over block summaries, that is above an aggregation by block."""
    v = Views(spark, FOLDER)
    text = plan(series.with_staleness(v.sat_daily, ["site"], "date", ["LST_K"]))
    for line in text.splitlines():
        if "Window [" in line and "_block" not in line:
            raise AssertionError(line)


def test_dense_rows_are_shuffled_once(spark):
    v = Views(spark, FOLDER)
    text = plan(series.with_staleness(v.sat_daily, ["site"], "date", ["LST_K"]))
    assert text.count("REPARTITION_BY_COL") == 1


def test_gates_stay_in_one_stage(spark):
    text = plan(flux.close_balance(flux.qc_gates(spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr(
        "o_totalprice LE", "o_totalprice H", "o_totalprice NETRAD", "o_totalprice G", "o_totalprice TA", "o_totalprice USTAR", "o_orderkey QC"))))
    assert "Exchange" not in text and "Python" not in text


def test_filters_do_not_multiply_expressions(spark):
    """Stages whose generated code grows too long are interpreted: bounds and scores must not repeat what they read."""
    rows = spark.range(10).selectExpr("id % 2 AS site", "double(id) AS ET", "100.0D + id AS NETRAD", "0.0D AS G", "double(id) AS TA_C")
    rows = energy_supply.energy_terms(rows).dropna(subset=["alpha"])
    oof = rows.withColumn("pred", evaluate.et_from_fraction(F.col("alpha") * 0.9, F.col("ET_eq"), 1.6))
    text = plan(evaluate.metrics(oof, ["site"], "ET"))
    assert text.count("EXP(") <= 10


def test_bounds_and_scores_keep_null(spark):
    rows = spark.createDataFrame([(0, -1.0, 1.0), (0, 0.5, 0.0), (0, 9.0, None), (0, None, 1.0), (0, float("nan"), 2.0), (1, None, 1.0)], "site int, v double, y double")
    rows = rows.withColumn("pred", clip(F.col("v"), 0, 2))
    assert [r["pred"] for r in rows.collect()] == [0.0, 0.5, 2.0, None, 2.0, None]
    (row,) = evaluate.metrics(rows, ["site"]).collect()
    assert (row["site"], row["n"], row["mae"], row["bias"]) == (0, 3, 0.5, pytest.approx(-0.5 / 3))
    assert evaluate.metrics(rows.where("site = 1")).count() == 0
