"""Ordered operations that never put one key into one task.

A site may hold a third of all rows, so no window here is partitioned by the
site alone. Rows carry an integer `slot` along their axis (day number, half
hour number, ...), and windows run over blocks of slots:

* what reaches a bounded distance back (rolling frames, lags, as-of matches)
  copies the few rows next to a block edge into the neighbouring block;
* what reaches back without bound (last known value, running position) takes
  one summary row per block, scans those summaries, and joins the carry back.
  Summaries are smaller than the data by the block length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.session import settle

BLOCK = 1024
_BLOCK = "_block"


def block_of(slot: Column, length: int = BLOCK) -> Column:
    return F.floor(slot / F.lit(length))


def day_slot(date: Column | str) -> Column:
    return F.unix_date(F.col(date) if isinstance(date, str) else date).cast("long")


def step_slot(ts: Column | str, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts) / F.lit(seconds))


def step_time(slot: Column, seconds: int) -> Column:
    return F.timestamp_seconds(slot * seconds)


def densify(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    lo: int | None = None,
    hi: int | None = None,
    length: int = BLOCK,
    keep_block: bool = False,
) -> DataFrame:
    """One row per key and slot from the first to the last slot (or from `lo` to `hi`).

    `(keys, slot)` is unique in `df`. The calendar is laid out block by block
    and merged with the rows by one aggregation on that partitioning. With
    `keep_block` the block column stays, and with it the partitioning, so
    that `with_neighbours` needs no further shuffle of the dense rows.
    """
    values = [c for c in df.columns if c not in keys and c != slot]
    blocks = _calendar_blocks(df, keys, slot, lo, hi, length)
    first = F.greatest("_lo", F.col(_BLOCK) * length)
    last = F.least("_hi", (F.col(_BLOCK) + 1) * length - 1)
    calendar = blocks.select(*keys, F.col("_lo"), F.col("_hi"), F.explode(F.sequence(first, last)).alias(slot))
    calendar = calendar.select(*keys, slot, F.lit(True).alias("_on"))
    both = df.withColumn("_on", F.lit(False)).unionByName(calendar, allowMissingColumns=True)
    both = both.withColumn(_BLOCK, block_of(F.col(slot), length)).repartition(*keys, _BLOCK)
    merged = both.groupBy(*keys, _BLOCK, slot).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in values], F.max("_on").alias("_on")
    )
    return merged.where("_on").select(*keys, slot, *values, *([_BLOCK] if keep_block else []))


def _calendar_blocks(
    df: DataFrame, keys: Sequence[str], slot: str, lo: int | None, hi: int | None, length: int
) -> DataFrame:
    """The blocks each key's calendar touches, with its first and last slot."""
    span = df.groupBy(*keys).agg(
        F.min(slot).alias("_lo") if lo is None else F.lit(lo).cast("long").alias("_lo"),
        F.max(slot).alias("_hi") if hi is None else F.lit(hi).cast("long").alias("_hi"),
    )
    return span.withColumn(
        _BLOCK, F.explode(F.sequence(block_of(F.col("_lo"), length), block_of(F.col("_hi"), length)))
    )


def dense_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    cols: Sequence[str],
    lo: int | None = None,
    hi: int | None = None,
    length: int = BLOCK,
) -> DataFrame:
    """`densify` and `with_neighbours` in one: dense rows are made, shuffled and sorted once.

    Block summaries come from the sparse rows and one empty row per block,
    instead of from a second copy of the dense axis. The sparse rows serve
    four branches of the plan and are settled, so that what produces them
    runs once.
    """
    df = settle(df)
    dense = densify(df, keys, slot, lo, hi, length, keep_block=True)
    empty = _calendar_blocks(df, keys, slot, lo, hi, length).select(*keys, (F.col(_BLOCK) * length).alias(slot))
    sparse = df.select(*keys, slot, *cols)
    for bound, inside in ((lo, F.col(slot) >= F.lit(lo)), (hi, F.col(slot) <= F.lit(hi))):
        sparse = sparse.where(inside) if bound is not None else sparse
    return with_neighbours(dense, keys, slot, cols, length, sparse.unionByName(empty, allowMissingColumns=True))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    cols: Sequence[str],
    length: int = BLOCK,
    known: DataFrame | None = None,
) -> DataFrame:
    """Add `{c}__prev` and `{c}__next`: structs (s, v) of the nearest known value at or before/after.

    `known` may give the same known values more cheaply than `df`; the block
    summaries come from it, so it has at least one row in every block of `df`.
    """
    part = [*keys, _BLOCK]

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(slot).alias("s"), F.col(c).alias("v")))

    if known is None:
        known = df
    known = known.withColumn(_BLOCK, block_of(F.col(slot), length))
    if _BLOCK not in df.columns:
        df = df.withColumn(_BLOCK, block_of(F.col(slot), length))
    ends = []
    for c in cols:
        here = F.when(F.col(c).isNotNull(), F.col(slot))
        # Plain columns, not a maximum of structs: those would need a sorted aggregation.
        ends += [F.max(here).alias(f"_hs_{c}"), F.max_by(c, here).alias(f"_hv_{c}")]
        ends += [F.min(here).alias(f"_ls_{c}"), F.min_by(c, here).alias(f"_lv_{c}")]

    def end(side: str, c: str) -> Column:
        s = F.col(f"_{side}s_{c}")
        return F.when(s.isNotNull(), F.struct(s.alias("s"), F.col(f"_{side}v_{c}").alias("v")))

    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        known.groupBy(*part)
        .agg(*ends)
        .select(
            *part,
            *[F.last(end("h", c), ignorenulls=True).over(before).alias(f"_in_{c}") for c in cols],
            *[F.last(end("l", c), ignorenulls=True).over(after).alias(f"_out_{c}") for c in cols],
        )
    )
    up = Window.partitionBy(*part).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.desc(slot)).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(carry, part, "left")
    found = joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(at(c), ignorenulls=True).over(up), F.col(f"_in_{c}")).alias(f"{c}__prev")
            for c in cols
        ],
        *[
            F.coalesce(F.last(at(c), ignorenulls=True).over(down), F.col(f"_out_{c}")).alias(f"{c}__next")
            for c in cols
        ],
    )
    return found.drop(_BLOCK)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    tie: Sequence[str] = (),
    name: str = "_pos",
    length: int = BLOCK,
) -> DataFrame:
    """Add the 0-based rank of each row within its key, ordered by `slot` and then `tie`."""
    part = [*keys, _BLOCK]
    df = df.withColumn(_BLOCK, block_of(F.col(slot), length))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*part).orderBy(slot, *tie)
    ranked = df.join(offsets, part).withColumn(name, F.row_number().over(inside) - 1 + F.col("_before"))
    return ranked.drop(_BLOCK, "_before")


def spread_back(df: DataFrame, slot: str, reach: int, length: int) -> DataFrame:
    """Copy the rows less than `reach` slots before a block edge into the next block as well."""
    own = block_of(F.col(slot), length)
    late = F.col(slot) - own * length >= length - reach
    return df.withColumn(_BLOCK, F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    outputs: dict[str, tuple[int, Callable[[object], Column]]],
    by_range: bool = False,
    length: int | None = None,
) -> DataFrame:
    """Window expressions over the last slots, the current one included, all from one shuffle.

    `outputs` maps a new name to (number of slots, function of the window).
    With `by_range` a frame counts slots, otherwise rows, which is the same
    on a dense axis.
    """
    reach = max(n for n, _ in outputs.values())
    length = length or max(BLOCK, 4 * reach)
    spread = spread_back(df, slot, reach - 1, length)
    order = Window.partitionBy(*keys, _BLOCK).orderBy(slot)

    def frame(n: int):
        return order.rangeBetween(-(n - 1), 0) if by_range else order.rowsBetween(-(n - 1), 0)

    out = spread.select("*", *[build(frame(n)).alias(name) for name, (n, build) in outputs.items()])
    return out.where(F.col(_BLOCK) == block_of(F.col(slot), length)).drop(_BLOCK)


def lagged(col: str) -> tuple[int, Callable[[object], Column]]:
    """For `trailing`: the value one slot earlier on a dense axis."""
    return 2, lambda w: F.when(F.count(F.lit(1)).over(w) == 2, F.first(col).over(w))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float], parts: int = 256
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key, without gathering a key.

    A mergeable sketch proposes a few cut points for each key around every wanted rank; equal values are counted
    before the shuffle, and the counts of the stretches between cut points tell which stretches hold the wanted
    ranks. Only the values in those are ranked. The cut points only balance the work: ranks are exact wherever they lie, also
    for one repeated value or an infinite one. NaN counts as missing. The stretch of a value is its place among at most
    five cut points for each quantile, compared one by one in compiled code. Nothing runs while the plan is built.
    """
    if not keys:
        whole = df.withColumn("_whole", F.lit(1))
        return group_quantiles(whole, ["_whole"], col, probs, parts).drop("_whole")
    keys = list(keys)
    rows = df.select(*keys, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # cut points just below and above every wanted rank: a stretch that holds one is about 1/parts of the key's rows
    steps = sorted({min(max(p + d / parts, 0.0), 1.0) for p in probs.values() for d in (-0.5, 0.5)})
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", steps, 8 * parts).alias("_cuts"), F.count("_v").alias("_n"))

    def at(p: float) -> Column:
        return F.lit(p) * (F.col("_n") - 1)

    wanted = [end(at(p)).cast("long") for p in probs.values() for end in (F.floor, F.ceil)]
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    points = [F.col("_cuts")[i].alias(f"_p{i}") for i in range(len(steps))]
    place = reduce(lambda a, b: a + b, [F.when(F.col(f"_p{i}") < F.col("_v"), 1).otherwise(0) for i in range(len(steps))])
    placed = counted.join(cuts.select(*keys, "_n", *points), keys).select(*keys, "_v", "_c", "_n", place.alias("_part"))
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"), F.first("_n").alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_m").over(below), F.lit(0)))
    holds = reduce(lambda a, b: a | b, [(w >= F.col("_before")) & (w < F.col("_before") + F.col("_m")) for w in wanted])
    near = placed.join(sums.where(holds).select(*keys, "_part", "_before"), [*keys, "_part"])
    upto = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_before") + F.sum("_c").over(upto))

    def mine(rank: Column) -> Column:
        return (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))

    ends = []
    for name, p in probs.items():
        ends += [
            F.max(F.when(mine(end(at(p)).cast("long")), F.col("_v"))).alias(f"_{tag}_{name}")
            for tag, end in (("lo", F.floor), ("hi", F.ceil))
        ]
        ends.append(F.max(at(p) - F.floor(at(p))).alias(f"_f_{name}"))
    return (
        near.groupBy(*keys)
        .agg(*ends)
        .select(
            *keys,
            *[
                F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}"))
                .otherwise(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}"))
                .alias(n)
                for n in probs
            ],
        )
    )


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], var: str, value: str) -> DataFrame:
    """Wide to long, so that many columns share one pass of a keyed operator."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), var, value
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by `order`, by aggregation: copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)
