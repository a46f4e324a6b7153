"""Site inventories, counts, pivots, splits and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.operators import blocks

# Fixed lists: US states and territories with a sea coast, and tidal land-cover classes.
COASTAL_STATES = (
    "AL", "AK", "CA", "CT", "DE", "FL", "GA", "HI", "LA", "ME", "MD", "MA", "MS", "NH", "NJ",
    "NY", "NC", "OR", "PA", "RI", "SC", "TX", "VA", "WA", "PR", "VI", "GU", "AS", "MP",
)
TIDAL_CLASSES = ("WET", "WAT")
BUFFERS_KM = (1, 5, 10, 25, 50, 100)
ACTIVE_SINCE = 2020


def site_flags(sites: DataFrame, states=COASTAL_STATES, classes=TIDAL_CLASSES) -> DataFrame:
    """Coastal state, tidal class, and still active (no end year, or a recent one)."""
    end = F.col("TOWER_END")
    active = end.isNull() | (end == "") | (end.rlike("^[0-9]+$") & (end.try_cast("int") >= ACTIVE_SINCE))
    return (
        sites.withColumn("COASTAL_STATE", F.coalesce(F.col("STATE").isin(*states), F.lit(False)))
        .withColumn("TIDAL_IGBP", F.coalesce(F.col("IGBP").isin(*classes), F.lit(False)))
        .withColumn("ACTIVE", active)
    )


def core_sites(flagged: DataFrame, max_km: float = 10.0) -> DataFrame:
    """Tidal sites of coastal states within `max_km`, nearest the sea first."""
    return flagged.where(
        (F.col("DIST_COAST_KM") <= max_km) & F.col("COASTAL_STATE") & F.col("TIDAL_IGBP")
    ).orderBy("DIST_COAST_KM", "SITE_ID")


def buffer_counts(flagged: DataFrame, buffers: Sequence[int] = BUFFERS_KM) -> DataFrame:
    """Coastal-state sites within each distance: all, tidal, tidal and active. One scan, one row out per buffer."""
    homes = F.array_compact(F.array(*[F.when(F.col("DIST_COAST_KM") <= km, F.lit(km)) for km in buffers]))
    found = (
        flagged.where("COASTAL_STATE")
        .withColumn("buffer_km", F.explode(homes))
        .groupBy("buffer_km")
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            F.count_if(F.col("TIDAL_IGBP")).alias("n_tidal"),
            F.count_if(F.col("TIDAL_IGBP") & F.col("ACTIVE")).alias("n_tidal_active"),
        )
    )
    spark = flagged.sparkSession
    every = spark.createDataFrame([(int(km),) for km in buffers], "buffer_km int")
    return every.join(found, "buffer_km", "left").fillna(0)


def category_counts(df: DataFrame, col: str, none: str = "(none)") -> DataFrame:
    """Most common categories first; an empty one is named."""
    label = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(none))
    return df.groupBy(label.alias(col)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Row by column counts with zeros; the column values are given, so that no extra pass finds them."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def pivot_values(df: DataFrame, row: str, column: str, value: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(value))


def box_stats(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Quartiles per group, lowest median first."""
    q = blocks.group_quantiles(df, keys, col, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.orderBy("median", *keys)


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int = 30) -> DataFrame:
    """Counts in equal bins over [lo, hi]; the upper edge belongs to the last bin."""
    index = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.where(F.col(col).between(lo, hi)).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def union_sites(frames: Sequence[DataFrame], keep: Sequence[str] | None = None) -> DataFrame:
    """Union of frames with differing columns, absent ones null, projected to a keep-list in its order."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[c for c in keep if c in out.columns]) if keep else out


def first_source(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Union of tables in which the first one holding a key provides its row."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return blocks.first_per_group(out, keys, [F.col("_rank")]).drop("_rank")


def stable_hash(*cols: Column, modulus: int = 1000) -> Column:
    """A repeatable pseudo-random number in [0, modulus) from integer columns, the same in any SQL engine.

    Fixed multipliers; every intermediate fits a 64-bit integer.
    """
    h = F.lit(7)
    for c in cols:
        h = F.pmod(h * 31 + F.pmod(c.cast("long"), F.lit(1000003)) * 7919, F.lit(1000003))
    return F.pmod(h * 104729, F.lit(1000003)) % modulus


def block_split(df: DataFrame, keys: Sequence[Column], train_share: float = 0.7) -> DataFrame:
    """Split by key so that no key is on both sides. The hash decides, no key list is gathered."""
    return df.withColumn("is_train", stable_hash(*keys) < int(train_share * 1000))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def members(df: DataFrame, col: str, values: Sequence, exclude: bool = False) -> DataFrame:
    inside = F.col(col).isin(*values)
    return df.where(~inside if exclude else inside)


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum and maximum of each column, one row per column, one scan."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    return stats.select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("_s")).select("_s.*")


def bin_counts_2d(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Counts in square bins of two variables."""
    return df.groupBy(
        F.floor(F.col(x) / width).alias("bin_x"), F.floor(F.col(y) / width).alias("bin_y")
    ).agg(F.count(F.lit(1)).alias("n"))
