"""Half-hourly records to the daily ET table, its report and its balance ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators import flux

#: Columns of radiation components, from which net radiation is rebuilt where a site lacks it.
COMPONENTS = ("SW_IN_F", "SW_OUT", "LW_IN_F", "LW_OUT")


def prepared(halfhours: DataFrame, flag: str | None = "QC", keys: Sequence[str] = ("site",)) -> DataFrame:
    """Gates, missing temperature by the site's median, missing net radiation from its components, closure."""
    rows = flux.fill_ta(halfhours, keys)
    if set(COMPONENTS) <= set(rows.columns):
        rows = flux.rebuild_rn(rows, keys)
    return flux.close_balance(flux.qc_gates(rows, flag))


def daily_et(
    halfhours: DataFrame, min_coverage: float = flux.MIN_COVERAGE, flag: str | None = "QC", date: Column | None = None
) -> DataFrame:
    """Daily totals from half hours of one route: one shuffle on (site, date) besides the medians."""
    date = F.to_date("ts") if date is None else date
    day = flux.daily_closed(prepared(halfhours, flag), ["site"], date, min_coverage=min_coverage)
    return day.withColumn("CLOSURE", F.lit("BASE_bowen_ratio"))


def best_daily_et(
    published: DataFrame, halfhourly: DataFrame, raw: DataFrame, min_coverage: float = flux.MIN_COVERAGE, date: Column | None = None
) -> DataFrame:
    """Closed daily ET of every site by the best of three routes, with its band and the route's name.

    `published` has daily `LE_closed`, `LE_open`, `TA_C` and, where known, the published quartiles and random
    uncertainty; `halfhourly` and `raw` are half hours. Closed half hours become daily totals,
    raw files daily means converted with the day's mean temperature.
    """
    date = F.to_date("ts") if date is None else date
    closed = flux.daily_closed(prepared(halfhourly), ["site"], date, min_coverage=min_coverage)
    means = flux.daily_mean_closed(prepared(raw), ["site"], date, min_coverage=min_coverage)
    return flux.et_band(flux.choose_closure(["site"], published, closed, means))


def processing_report(halfhours: DataFrame, flag: str | None = "QC") -> DataFrame:
    """Attrition, balance ratio and warnings per site."""
    closed = prepared(halfhours, flag)
    return flux.qc_report(closed, ["site"]).join(flux.site_flags(closed, ["site"]), "site")
