"""Writers. Whether to write is decided before any job starts."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Through the file system the path names, so shared folders work as well as local ones."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def needs_write(spark: SparkSession, path: str, force: bool | None = None) -> bool:
    """False when the output is there already and neither `force` nor OVERWRITE=1 asks for it again."""
    if force is None:
        force = os.environ.get("OVERWRITE", "").lower() in ("1", "true", "yes")
    return force or not path_exists(spark, path)


def write_once(df: DataFrame, path: str, force: bool | None = None, by: Sequence[str] = ()) -> bool:
    """Write Parquet unless it exists; returns whether anything was written."""
    if not needs_write(df.sparkSession, path, force):
        return False
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)
    return True


def write_sites(df: DataFrame, path: str, site: str = "site") -> None:
    """One folder per site; adaptive rebalancing lets many tasks write a large site."""
    df.hint("rebalance", site).write.mode("overwrite").partitionBy(site).parquet(path)


def write_pixels(df: DataFrame, path: str, site: str = "site", date: str = "date") -> None:
    """Pixel table by site and date; only the partitions present in `df` are replaced."""
    rebalanced = df.hint("rebalance", site, date)
    rebalanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(site, date).parquet(path)


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Result table as parquet, csv (with header) or json."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_metadata(spark: SparkSession, record: dict, path: str) -> None:
    """A small JSON document."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
