"""Tables on disk between steps: read, settle and connect."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.session import settle as _write

#: While a step is written: shuffle files end with the query, and whole texts cross to Python a few at a time.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}

#: For rows of some MB: a row group, which tasks hold whole when they write and when they read, ends after a few of them, and not after 100 at least.
LARGE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "4",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "4",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes, so that a task's memory does not follow Spark's batch size."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, under the settings above."""
    with _settings(df.sparkSession):
        return _write(df, **options)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in `edges`; component is the smallest id reachable.

    Alternates two rewritings until the edges stop changing: every id hands its
    larger neighbours to its smallest neighbour, then hands all its smaller
    neighbours to the smallest of them. The smallest neighbour is an aggregation,
    so a hub is combined before the shuffle; each round is settled. Rounds grow
    with the logarithm of the longest chain. Null ends and loops are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = settle(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = settle(small.where("u <> v").distinct())
        if (after := _state(now)) == state:
            break
        state = after
    ends = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return settle(ends.unionByName(roots).groupBy("id").agg(F.min("component").alias("component")))


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(x or 0 for x in row)
