"""Daily and half-hourly series: resampling, gap filling, staleness, trailing statistics."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.functions.energy import LAMBDA_CONST, available, clip
from brackish.functions.meteorology import reference_fraction
from brackish.operators import blocks
from brackish.session import settle

_AGGS = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "std": F.stddev_samp,
    "count": F.count,
    "median": lambda c: F.percentile(c, 0.5),
}


def resample_daily(df: DataFrame, keys: Sequence[str], ts: str, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """`aggs` maps an output name to (column, mean|max|min|sum|std|count)."""
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        *[_AGGS[how](F.col(col)).alias(name) for name, (col, how) in aggs.items()]
    )


def daily_tide(df: DataFrame, site: str = "site", ts: str = "ts") -> DataFrame:
    """Daily tide features, the tidal range being the day's maximum less its minimum."""
    day = resample_daily(
        df,
        [site],
        ts,
        {
            "WL_mean_m": ("water_level_m", "mean"),
            "WL_max_m": ("water_level_m", "max"),
            "WL_min_m": ("water_level_m", "min"),
            "INUND_frac": ("inundation_frac_24h", "mean"),
            "WL_rate_std": ("wl_rate_m_per_hr", "std"),
        },
    )
    return day.withColumn("WL_range_m", F.col("WL_max_m") - F.col("WL_min_m"))


def _day_number(text: str | None) -> int | None:
    return None if text is None else (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days


def dense_daily(
    df: DataFrame, keys: Sequence[str], date: str = "date", lo: str | None = None, hi: str | None = None
) -> DataFrame:
    """Every date between the first and the last of each key, or of a fixed period."""
    slotted = df.withColumn("_slot", blocks.day_slot(date)).drop(date)
    full = blocks.densify(slotted, keys, "_slot", _day_number(lo), _day_number(hi))
    return full.withColumn(date, F.date_from_unix_date(F.col("_slot").cast("int"))).drop("_slot").select(
        *df.columns
    )


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    cols: Sequence[str],
    limit: int,
    mode: str = "prefix",
    age: bool = False,
) -> DataFrame:
    """Linear filling between known values on a dense axis; never before the first or after the last.

    `prefix` fills the first `limit` slots of every gap; `whole_gap` fills a
    gap completely or, when it is longer than `limit`, not at all. Adds
    `{c}_int` and, with `age`, `{c}_age`: slots since the last known value.
    """
    near = blocks.with_neighbours(df, keys, slot, cols)
    return near.select(*df.columns, *_lines(slot, cols, limit, mode, age))


def fill_dense(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    cols: Sequence[str],
    limit: int,
    mode: str = "prefix",
    age: bool = False,
    lo: int | None = None,
    hi: int | None = None,
) -> DataFrame:
    """`interpolate` for rows not yet on a dense axis: lays them on it and fills in the same pass."""
    near = blocks.dense_neighbours(df, keys, slot, cols, lo, hi)
    return near.select(*df.columns, *_lines(slot, cols, limit, mode, age))


def _lines(slot: str, cols: Sequence[str], limit: int, mode: str, age: bool) -> list[Column]:
    if mode not in ("prefix", "whole_gap"):
        raise ValueError(mode)
    out = []
    for c in cols:
        prev, nxt = F.col(f"{c}__prev"), F.col(f"{c}__next")
        since, gap = F.col(slot) - prev["s"], nxt["s"] - prev["s"]
        allowed = since <= limit if mode == "prefix" else gap - 1 <= limit
        line = prev["v"] + (nxt["v"] - prev["v"]) * since / gap
        out.append(F.when(F.col(c).isNotNull(), F.col(c)).when(allowed & (gap > 0), line).alias(f"{c}_int"))
        if age:
            out.append(since.alias(f"{c}_age"))
    return out


def with_staleness(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str], limit: int = 16) -> DataFrame:
    """Daily axis with `{c}_obs`, `{c}_int` and `{c}_age` for every variable, in one pass."""
    slotted = df.select(*keys, blocks.day_slot(date).alias("_slot"), *cols)
    filled = fill_dense(slotted, keys, "_slot", cols, limit, age=True)
    named = []
    for c in cols:
        named += [F.col(c).alias(f"{c}_obs"), F.col(f"{c}_int"), F.col(f"{c}_age")]
    return filled.select(*keys, F.date_from_unix_date(F.col("_slot").cast("int")).alias(date), *named)


def upsample_hourly(df: DataFrame, keys: Sequence[str], ts: str, col: str, limit: int = 3) -> DataFrame:
    """Hourly readings onto the half-hour grid, bridging at most `limit` empty slots."""
    readings = df.groupBy(*keys, blocks.step_slot(ts, 1800).alias("_slot")).agg(F.avg(col).alias(col))
    return fill_dense(readings, keys, "_slot", [col], limit).select(
        *keys, blocks.step_time(F.col("_slot"), 1800).alias(ts), F.col(f"{col}_int").alias(col)
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    n: int,
    aggs: dict[str, tuple[str, str]],
    min_periods: int = 1,
    dense: bool = False,
) -> DataFrame:
    """Trailing statistics over `n` rows; null until `min_periods` known values are inside.

    On a dense axis rows and slots agree; otherwise rows are numbered first,
    so that the window counts rows whatever the gaps.
    """

    def expr(col: str, how: str):
        return n, lambda w: F.when(F.count(col).over(w) >= min_periods, _AGGS[how](F.col(col)).over(w))

    outputs = {name: expr(col, how) for name, (col, how) in aggs.items()}
    if dense:
        return blocks.trailing(df, keys, slot, outputs)
    placed = blocks.with_position(df, keys, slot)
    return blocks.trailing(placed, keys, "_pos", outputs).drop("_pos")


def rolling_days(
    df: DataFrame, keys: Sequence[str], date: str, days: int, aggs: dict[str, tuple[str, str]]
) -> DataFrame:
    """Trailing statistics over a span of days, open on the left: the day `days` ago is outside."""
    outputs = {
        name: (days, lambda w, c=col, h=how: _AGGS[h](F.col(c)).over(w)) for name, (col, how) in aggs.items()
    }
    slotted = df.withColumn("_slot", blocks.day_slot(date))
    return blocks.trailing(slotted, keys, "_slot", outputs, by_range=True).drop("_slot")


def rolling_masked(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    col: str,
    n: int = 30,
    min_periods: int = 10,
    max_missing: int = 25,
) -> DataFrame:
    """Calendar rolling mean, hidden where `max_missing` or more of the last `n` days are missing."""
    slotted = df.select(*keys, blocks.day_slot(date).alias("_slot"), col)
    dense = blocks.densify(slotted, keys, "_slot")
    rolled = blocks.trailing(
        dense,
        keys,
        "_slot",
        {
            "_mean": (n, lambda w: F.avg(col).over(w)),
            "_known": (n, lambda w: F.count(col).over(w)),
            "_rows": (n, lambda w: F.count(F.lit(1)).over(w)),
        },
    )
    shown = (F.col("_known") >= min_periods) & (F.col("_rows") - F.col("_known") < max_missing)
    return rolled.select(
        *keys,
        F.date_from_unix_date(F.col("_slot").cast("int")).alias(date),
        col,
        F.when(shown, F.col("_mean")).alias(f"{col}_roll"),
    )


def tide_features(df: DataFrame, keys: Sequence[str], ts: str = "ts", col: str = "water_level_m") -> DataFrame:
    """Half-hourly level, rate of change, trailing means and maximum, and the inundated fraction.

    A level counts as inundating above the site's 90 % quantile; an unknown
    level counts as dry.
    """
    level = settle(upsample_hourly(df, keys, ts, col).withColumn("_slot", blocks.step_slot(ts, 1800)))
    q90 = settle(blocks.group_quantiles(level, keys, col, {"_q90": 0.9}))
    wet = F.when(F.col(col) > F.col("_q90"), 1.0).otherwise(0.0)
    level = level.join(q90, list(keys), "left").withColumn("_wet", wet)
    out = blocks.trailing(
        level,
        keys,
        "_slot",
        {
            "_last": blocks.lagged(col),
            "wl_mean_24h": (48, lambda w: F.avg(col).over(w)),
            "wl_max_24h": (48, lambda w: F.max(col).over(w)),
            "wl_mean_7d": (336, lambda w: F.avg(col).over(w)),
            "inundation_frac_24h": (48, lambda w: F.avg("_wet").over(w)),
        },
    )
    return out.select(
        *keys,
        ts,
        col,
        ((F.col(col) - F.col("_last")) * 2).alias("wl_rate_m_per_hr"),
        "wl_mean_24h",
        "wl_max_24h",
        "wl_mean_7d",
        "inundation_frac_24h",
    )


def deaccumulate(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Undo accumulation from midnight: difference within the day, the day's first value kept."""
    day = Window.partitionBy(*keys, F.to_date(ts)).orderBy(ts)
    return df.select(
        *[c for c in df.columns if c not in cols],
        *[F.coalesce(F.col(c) - F.lag(c).over(day), F.first(c).over(day)).alias(c) for c in cols],
    )


def period_mean(
    df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str], count: str, freq: str, need: int
) -> DataFrame:
    """Means per `8D` bin (counted from each key's first day) or `month`; bins below `need` are dropped."""
    if freq == "month":
        binned = df.withColumn("_bin", F.trunc(date, "month"))
    else:
        width = int(freq.rstrip("D"))
        start = settle(df.groupBy(*keys).agg(F.min(date).alias("_start")))
        offset = F.floor(F.date_diff(F.col(date), F.col("_start")) / width) * width
        binned = df.join(start, list(keys)).withColumn("_bin", F.date_add("_start", offset.cast("int")))
    means = binned.groupBy(*keys, F.col("_bin").alias(date)).agg(
        *[F.avg(c).alias(c) for c in cols], F.count(count).alias("_n")
    )
    return means.where(F.col("_n") >= need).drop("_n")


def monthly_grid(df: DataFrame, keys: Sequence[str], date: str, col: str, need: int = 10) -> DataFrame:
    """One row per key and year with a column per month; months with too few days stay null."""
    month = (
        df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month"))
        .agg(F.avg(col).alias("_mean"), F.count(col).alias("_n"))
        .withColumn("_mean", F.when(F.col("_n") >= need, F.col("_mean")))
    )
    return month.groupBy(*keys, "year").agg(
        *[F.max(F.when(F.col("month") == m, F.col("_mean"))).alias(f"m{m:02d}") for m in range(1, 13)]
    )


def combine_first(keys: Sequence[str], *sources: DataFrame) -> DataFrame:
    """Per key and column the first source's value, later sources filling what is missing.

    One union and one aggregation whatever the number of sources.
    """
    names = list(dict.fromkeys(c for s in sources for c in s.columns if c not in keys))
    stacked = None
    for rank, source in enumerate(sources):
        ranked = source.withColumn("_rank", F.lit(rank))
        stacked = ranked if stacked is None else stacked.unionByName(ranked, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in names]
    )


def collapse_timestamps(df: DataFrame, keys: Sequence[str], mean: Sequence[str], most: Sequence[str]) -> DataFrame:
    """Rows of one timestamp become one: means of the values, maximum of the valid fractions."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in mean], *[F.max(c).alias(c) for c in most])


def overpass_fraction(df: DataFrame, site: str = "site", ts: str = "ts", first: int = 15, end: int = 17) -> DataFrame:
    """Evaporative fraction in the satellite's overpass hours, per site and day."""
    hour = F.hour(ts)
    mean = (
        df.where((hour >= first) & (hour < end))
        .groupBy(site, F.to_date(ts).alias("date"))
        .agg(
            F.avg("LE").alias("LE_inst"),
            F.avg("NETRAD").alias("_rn"),
            F.avg(F.coalesce("G", F.lit(0.0))).alias("_g"),
        )
        .withColumn("avail", F.col("_rn") - F.col("_g"))
        .where("avail > 50")
    )
    return mean.select(site, "date", clip(F.col("LE_inst") / F.col("avail"), 0, 1.2).alias("EF"), "LE_inst", "avail")


def daytime_energy(df: DataFrame, site: str = "site", ts: str = "ts", least: float = 0.5) -> DataFrame:
    """The day's positive available energy as millimetres of water."""
    energy = F.greatest(F.coalesce(available(F.col("NETRAD"), F.col("G")), F.lit(0.0)), F.lit(0.0))
    day = df.groupBy(site, F.to_date(ts).alias("date")).agg(
        (F.sum(energy) * 1800.0 / LAMBDA_CONST).alias("Rd_day")
    )
    return day.where(F.col("Rd_day") > least)


def scaled_daily_et(df: DataFrame, site: str = "site", ts: str = "ts") -> DataFrame:
    """Overpass fraction times daytime energy."""
    joined = overpass_fraction(df, site, ts).join(daytime_energy(df, site, ts), [site, "date"])
    return joined.withColumn("ET_daily_from_EF", F.col("EF") * F.col("Rd_day"))


def gapfill_reference(
    et: DataFrame,
    met: DataFrame,
    keys: Sequence[str],
    date: str = "date",
    col: str = "ET",
    eto: str = "ETo",
    limit: int = 30,
    lo: str | None = None,
    hi: str | None = None,
) -> DataFrame:
    """Fill ET through its fraction of reference ET. Measured values are returned as they are.

    The filled series is a column of its own with a flag beside it, so that
    it cannot be mistaken for a measurement.
    """
    # The fraction exists on measured days only, so it is formed before the axis is laid out.
    measured = et.select(*keys, date, col).join(met.select(*keys, date, eto), [*keys, date], "left")
    sparse = measured.select(
        *keys,
        blocks.day_slot(date).alias("_slot"),
        col,
        clip(reference_fraction(F.col(col), F.col(eto)), 0, 2.0).alias("_ef"),
    )
    filled = fill_dense(sparse, keys, "_slot", ["_ef"], limit, lo=_day_number(lo), hi=_day_number(hi))
    filled = filled.withColumn(date, F.date_from_unix_date(F.col("_slot").cast("int"))).drop("_slot")
    # Sort-merge by hint: dense rows look as small to the planner as the sparse file behind them.
    filled = filled.join(met.select(*keys, date, eto).hint("merge"), [*keys, date], "left")
    estimate = F.col("_ef_int") * F.col(eto)
    flag = F.col(col).isNull() & estimate.isNotNull()
    return filled.select(
        *keys,
        date,
        col,
        eto,
        F.col("_ef_int").alias("EF"),
        flag.alias("is_filled"),
        F.coalesce(F.col(col), estimate).alias(f"{col}_gapfilled"),
    )


def gapfill_report(filled: DataFrame, keys: Sequence[str], col: str = "ET") -> DataFrame:
    """Measured, filled and still missing days with their shares."""
    days, got = F.count(F.lit(1)), F.count(col)
    added = F.count_if(F.col("is_filled"))
    return filled.groupBy(*keys).agg(
        days.alias("days"),
        got.alias("measured"),
        added.alias("filled"),
        F.count_if(F.col(f"{col}_gapfilled").isNull()).alias("still_missing"),
        (got * 100.0 / days).alias("pct_measured"),
        ((got + added) * 100.0 / days).alias("pct_after"),
        F.avg(col).alias("mean_measured"),
        F.avg(F.when(F.col("is_filled"), F.col(f"{col}_gapfilled"))).alias("mean_filled"),
    )


def overlap_counts(obs: DataFrame, filled: DataFrame, keys: Sequence[str], date: str = "date", col: str = "ET") -> DataFrame:
    """Days on which an observation meets measured, and filled, ET."""
    days = obs.select(*keys, date).distinct()
    return (
        days.join(filled.hint("merge"), [*keys, date])
        .groupBy(*keys)
        .agg(F.count(col).alias("with_measured"), F.count_if(F.col("is_filled")).alias("with_filled"))
    )


def stride_sample(df: DataFrame, keys: Sequence[str], slot: str, cap: int) -> DataFrame:
    """At most `cap` rows per key, evenly strided in order: a sampling operator, the cap is its purpose."""
    placed = blocks.with_position(df, keys, slot)
    size = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / cap))
    kept = placed.join(size, list(keys)).where(
        (F.pmod(F.col("_pos"), stride) == 0) & (F.col("_pos") / stride < cap)
    )
    return kept.drop("_pos", "_n")


def best_per_day(scenes: DataFrame, keys: Sequence[str], ts: str, score: str, tie: str) -> DataFrame:
    """The least cloudy scene of each day; an unknown cover counts as fully clouded."""
    dated = scenes.withColumn("date", F.to_date(ts)) if "date" not in scenes.columns else scenes
    cover = F.coalesce(F.col(score), F.lit(100.0))
    return blocks.first_per_group(dated, [*keys, "date"], [cover, F.col(tie)])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the first by `order`."""
    return blocks.first_per_group(df, keys, [order])
