"""Contracts on columns, survival of rows through joins, and plausibility rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.gates import all_known
from brackish.operators import blocks


class ImplausibleData(ValueError):
    """A table that must not be written."""


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which every listed column is present."""
    return df.dropna(subset=list(cols))


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """As `require`, but a column the table lacks leaves no usable rows instead of passing."""
    if set(cols) - set(df.columns):
        return df.where(F.lit(False))
    return require(df, cols)


def survival_report(df: DataFrame, keys: Sequence[str], stages: dict[str, Sequence[str]]) -> DataFrame:
    """Rows left after each cumulative stage of required columns; `stages` maps a name to its columns."""
    needed: list[str] = []
    counts = []
    for name, cols in stages.items():
        needed += list(cols)
        missing = [c for c in needed if c not in df.columns]
        usable = F.lit(False) if missing else all_known(*[F.col(c) for c in needed])
        counts.append(F.count_if(usable).alias(name))
    return df.groupBy(*keys).agg(*counts)


@dataclass(frozen=True)
class Rule:
    """`stat` (median, max or count) of `col` must lie inside [lo, hi]; no values at all passes bounds."""

    name: str
    col: str
    stat: str
    lo: float
    hi: float


# Fixed limits of the physical plausibility checks.
LST_MEDIAN = Rule("median LST, K", "LST_K", "median", 240.0, 330.0)
LST_PRESENT = Rule("usable LST", "LST_K", "count", 1.0, float("inf"))
RN_PEAK = Rule("peak net radiation, W/m2", "NETRAD", "max", float("-inf"), 1400.0)
TA_MEDIAN = Rule("median air temperature, C", "TA_C", "median", -30.0, 40.0)


def plausibility(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per key and rule with the statistic and whether it holds."""
    cols = list(dict.fromkeys(r.col for r in rules))
    long = blocks.unpivot(df, keys, cols, "_col", "_value")
    by = [*keys, "_col"]
    stats = long.groupBy(*by).agg(F.max("_value").alias("max"), F.count("_value").cast("double").alias("count"))
    if any(r.stat == "median" for r in rules):
        stats = stats.join(blocks.group_quantiles(long, by, "_value", {"median": 0.5}), by, "left")
    rows = [
        F.when(
            F.col("_col") == r.col,
            F.struct(
                F.lit(r.name).alias("rule"),
                F.col(r.stat).alias("value"),
                F.coalesce(F.col(r.stat).between(r.lo, r.hi), F.lit(True)).alias("holds"),
            ),
        )
        for r in rules
    ]
    return (
        stats.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_r"))
        .select(*keys, "_r.rule", "_r.value", "_r.holds")
    )


def assert_plausible(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Return `df`, or raise naming up to twenty broken rules."""
    broken = plausibility(df, keys, rules).where(~F.col("holds")).limit(20).collect()
    if broken:
        raise ImplausibleData("; ".join(str(row.asDict()) for row in broken))
    return df
