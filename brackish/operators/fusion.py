"""Putting two sensors on one scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators import blocks, joins, series
from brackish.session import settle

MIN_PAIRS = 8
MIN_R = 0.3
MIN_SPREAD = 1e-3


def pair_corr(a: str, b: str) -> Column:
    """Correlation that is null for a constant side (`corr` raises there in ANSI mode)."""
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def calibrate(
    primary: DataFrame,
    secondary: DataFrame,
    keys: Sequence[str],
    a: str,
    b: str,
    date: str = "date",
    tolerance_days: int = 2,
) -> DataFrame:
    """Line from the secondary onto the primary sensor per site, from acquisitions a few days apart.

    `accepted` is false, and the line unusable, with fewer than eight points
    on either side or eight pairs, a constant secondary, or |r| below 0.3.
    """
    left = primary.where(F.col(a).isNotNull()).select(*keys, blocks.day_slot(date).alias("t"), a)
    right = secondary.where(F.col(b).isNotNull()).select(*keys, blocks.day_slot(date).alias("t"), b)
    pairs = joins.asof_nearest(left, right, keys, "t", tolerance_days, [b])
    # The regression functions skip rows without a partner, which still count as points of the left side.
    fit = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_nl"),
        F.count(b).alias("n_pairs"),
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        pair_corr(a, b).alias("r"),
        F.stddev_samp(b).alias("_sd"),
    )
    fit = fit.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), list(keys), "full")
    enough = (
        (F.col("_nl") >= MIN_PAIRS)
        & (F.col("_nr") >= MIN_PAIRS)
        & (F.col("n_pairs") >= MIN_PAIRS)
        & (F.col("_sd") > MIN_SPREAD)
        & (F.abs("r") >= MIN_R)
    )
    return fit.select(
        *keys,
        F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        "slope",
        "intercept",
        "r",
        F.coalesce(enough, F.lit(False)).alias("accepted"),
    )


def fuse(
    primary: DataFrame,
    secondary: DataFrame,
    lines: DataFrame,
    keys: Sequence[str],
    a: str,
    b: str,
    date: str = "date",
    name: str = "fused",
) -> DataFrame:
    """The primary sensor wins; the calibrated secondary fills its gaps; a rejected line fills nothing."""
    usable = settle(lines.where("accepted").select(*keys, "slope", "intercept"))
    both = primary.select(*keys, date, a).join(secondary.select(*keys, date, b), [*keys, date], "full")
    line = F.col("intercept") + F.col("slope") * F.col(b)
    return both.join(usable, list(keys), "left").select(*keys, date, a, b, F.coalesce(F.col(a), line).alias(name))


def fusion_gain(fused: DataFrame, keys: Sequence[str], a: str, name: str = "fused") -> DataFrame:
    """Optical days before and after fusion."""
    return fused.groupBy(*keys).agg(
        F.count(a).alias("primary_days"),
        F.count(name).alias("fused_days"),
        (F.count(name) - F.count(a)).alias("gained"),
    )


def thermal_daily(
    obs: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], limit: int = 16
) -> DataFrame:
    """Daily mean of an irregular thermal sensor, interpolated over short gaps, with its age."""
    day = obs.groupBy(*keys, F.to_date(ts).alias("date")).agg(*[F.avg(c).alias(c) for c in cols])
    return series.with_staleness(day, keys, "date", cols, limit)
