"""From half-hourly fluxes to quality-controlled, energy-balance-closed daily ET."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions import energy, gates
from brackish.operators import blocks
from brackish.session import settle

MIN_COVERAGE = 0.80


def qc_gates(df: DataFrame, flag: str | None = "QC") -> DataFrame:
    """Apply the flag, turbulence and range gates to `LE`; the steps stay visible as columns."""
    flagged = gates.gate_flag(F.col("LE"), F.col(flag)) if flag else F.col("LE")
    return (
        df.withColumn("LE_flag", flagged)
        .withColumn("LE_ustar", gates.gate_min(F.col("LE_flag"), F.col("USTAR")))
        .withColumn("LE_qc", gates.gate_range(F.col("LE_ustar")))
    )


def qc_report(gated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many records pass each gate, in one aggregation."""
    raw, kept = F.count("LE"), F.count("LE_qc")
    return gated.groupBy(*keys).agg(
        raw.alias("n_raw"),
        F.count("LE_flag").alias("n_after_qc"),
        F.count("LE_ustar").alias("n_after_ustar"),
        kept.alias("n_final"),
        F.coalesce(F.try_divide(kept * 100.0, raw), F.lit(0.0)).alias("pct_kept"),
    )


def fill_ta(df: DataFrame, keys: Sequence[str], ta: str = "TA", default: float = 25.0) -> DataFrame:
    """Missing air temperature becomes the site's median; a constant where there is no column at all."""
    if ta not in df.columns:
        return df.withColumn(ta, F.lit(default))
    median = settle(blocks.group_quantiles(df, keys, ta, {"_median": 0.5}))
    return df.join(median, list(keys), "left").withColumn(ta, F.coalesce(ta, "_median")).drop("_median")


def rebuild_rn(
    df: DataFrame,
    keys: Sequence[str],
    rn: str = "NETRAD",
    parts: Sequence[str] = ("SW_IN_F", "SW_OUT", "LW_IN_F", "LW_OUT"),
) -> DataFrame:
    """Net radiation from its components where a site never measured it directly."""
    sites = settle(df.groupBy(*keys).agg((F.count(rn) == 0).alias("_absent")))
    built = energy.component_rn(*[F.col(p) for p in parts])
    out = df.join(sites, list(keys), "left")
    return (
        out.withColumn("RN_SOURCE", F.when(F.col("_absent") & built.isNotNull(), F.lit("components")))
        .withColumn(rn, F.when(F.col("_absent"), built).otherwise(F.col(rn)))
        .drop("_absent")
    )


def close_balance(df: DataFrame, le: str = "LE_qc") -> DataFrame:
    """Half-hourly closure: adds `LE_closed`, and the energy terms where the balance counts."""
    args = [F.col(le), F.col("H"), F.col("NETRAD"), F.col("G")]
    ok = energy.closure_ok(*args)
    return (
        df.withColumn("LE_closed", energy.bowen_closed(*args))
        .withColumn("_turb", F.when(ok, F.col("H") + F.col(le)))
        .withColumn("_avail", F.when(ok, energy.available(F.col("NETRAD"), F.col("G"))))
    )


def daily_closed(
    df: DataFrame,
    keys: Sequence[str],
    date: Column,
    le: str = "LE_qc",
    min_coverage: float = MIN_COVERAGE,
    expected_slots: int | None = None,
) -> DataFrame:
    """Daily ET totals from closed half hours; too thin a day has means but no totals.

    Coverage is taken over the rows present, or over `expected_slots`.
    """
    step = df.withColumn("_open", energy.le_to_et(F.col(le), F.col("TA"), energy.HALF_HOUR)).withColumn(
        "_closed", energy.le_to_et(F.col("LE_closed"), F.col("TA"), energy.HALF_HOUR)
    )
    slots = F.lit(expected_slots) if expected_slots else F.count(F.lit(1))
    day = step.groupBy(*keys, date.alias("date")).agg(
        F.sum("_closed").alias("_closed"),
        F.sum("_open").alias("_open"),
        F.avg("LE_closed").alias("LE_closed"),
        F.avg(le).alias("LE_open"),
        F.avg("NETRAD").alias("NETRAD"),
        F.avg("G").alias("G"),
        F.avg("TA").alias("TA_C"),
        (F.count("_closed") / slots).alias("coverage"),
        F.sum("_turb").alias("sum_turb"),
        F.sum("_avail").alias("sum_avail"),
    )
    enough = F.col("coverage") >= min_coverage
    return (
        day.withColumn("ET_closed_mm", F.when(enough, F.col("_closed")))
        .withColumn("ET_open_mm", F.when(enough, F.col("_open")))
        .drop("_closed", "_open")
    )


def daily_mean_closed(
    df: DataFrame, keys: Sequence[str], date: Column, le: str = "LE_qc", min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """The other daily route: mean closed LE of the day, converted with the day's mean temperature."""
    day = df.groupBy(*keys, date.alias("date")).agg(
        F.avg("LE_closed").alias("LE_closed"),
        F.avg(le).alias("LE_open"),
        F.avg("TA").alias("TA_C"),
        F.avg("NETRAD").alias("NETRAD"),
        F.avg("G").alias("G"),
        (F.count("LE_closed") / F.count(F.lit(1))).alias("coverage"),
    )
    enough = F.col("coverage") >= min_coverage
    return day.withColumn(
        "ET_closed_mm", F.when(enough, energy.le_to_et(F.col("LE_closed"), F.col("TA_C")))
    ).withColumn("ET_open_mm", F.when(enough, energy.le_to_et(F.col("LE_open"), F.col("TA_C"))))


def balance_ratio(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turbulent over available energy, summed where the balance counts."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum("_turb"), F.sum("_avail")).alias("EBR"))


def site_flags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Suspect balance, missing net radiation, and presence of a water-table record."""
    wtd = F.count("WTD") > 0 if "WTD" in df.columns else F.lit(False)
    ratio = F.try_divide(F.sum("_turb"), F.sum("_avail"))
    out = df.groupBy(*keys).agg(ratio.alias("EBR"), (F.count("NETRAD") > 0).alias("has_NETRAD"), wtd.alias("has_WTD"))
    return out.withColumn("suspect", F.coalesce((F.col("EBR") < 0.5) | (F.col("EBR") > 1.2), F.lit(False)))


def choose_closure(
    keys: Sequence[str], published: DataFrame, halfhourly: DataFrame, raw: DataFrame
) -> DataFrame:
    """Per site the best closed LE: published, else closed half hours, else the raw-file route.

    Each source has the keys, `date`, `LE_closed` and `LE_open`; the choice is
    made for a whole site, never day by day, and is named in `CLOSURE`.
    """
    labels = ("ONEFlux_LE_CORR", "FLUXNET_bowen_G0", "BASE_bowen_ratio")
    stacked = None
    for rank, source in enumerate((published, halfhourly, raw)):
        part = source.where(F.col("LE_closed").isNotNull()).withColumn("_rank", F.lit(rank))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    best = settle(stacked.groupBy(*keys).agg(F.min("_rank").alias("_best")))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_rank") + 1)
    return (
        stacked.join(best, list(keys))
        .where(F.col("_rank") == F.col("_best"))
        .withColumn("CLOSURE", label)
        .drop("_rank", "_best")
    )


def et_band(df: DataFrame, ta: str = "TA_C") -> DataFrame:
    """The published quartile and random-uncertainty columns as millimetres, null where absent."""
    names = {"LE_CORR_25": "ET_lo_mm", "LE_CORR_75": "ET_hi_mm", "LE_RANDUNC": "ET_randunc_mm"}
    return df.withColumns(
        {
            new: energy.le_to_et(F.col(old), F.col(ta)) if old in df.columns else F.lit(None).cast("double")
            for old, new in names.items()
        }
    )


def uplift(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """By how many percent closure raises mean ET."""
    ratio = F.try_divide(F.avg("ET_closed_mm"), F.avg("ET_open_mm"))
    return df.groupBy(*keys).agg(
        F.avg("ET_open_mm").alias("mean_open"),
        F.avg("ET_closed_mm").alias("mean_closed"),
        ((ratio - 1) * 100).alias("uplift_pct"),
    )


def et_summary(df: DataFrame, keys: Sequence[str], col: str = "ET_closed_mm", date: str = "date") -> DataFrame:
    """Days, quantiles, mean and first/last month of each site."""
    exact = blocks.group_quantiles(
        df, keys, col, {"median": 0.5, "p99": 0.99, "p10": 0.1, "p90": 0.9}
    )
    plain = (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(col).alias("n_days"),
            F.avg(col).alias("mean"),
            F.date_format(F.min(date), "yyyy-MM").alias("first_month"),
            F.date_format(F.max(date), "yyyy-MM").alias("last_month"),
        )
    )
    return plain.join(exact, list(keys))


def count_outliers(df: DataFrame, keys: Sequence[str], col: str = "ET_closed_mm") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(gates.outlier(F.col(col))).alias("n_outliers"))
