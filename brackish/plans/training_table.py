"""Streams to modelling table: overpasses with measured ET, drivers, season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackish.functions.meteorology import day_features
from brackish.operators.checks import require


def training_table(
    overpasses: DataFrame,
    et: DataFrame,
    met: DataFrame,
    satellite: Sequence[str],
    drivers: Sequence[str],
    target: str = "ET",
    keys: Sequence[str] = ("site", "date"),
) -> DataFrame:
    """Complete rows of real overpass days that have measured ET; filled ET must not be passed here."""
    rows = (
        overpasses.select(*keys, *satellite)
        .join(et.where(F.col(target).isNotNull()).select(*keys, target), list(keys))
        .join(met.select(*keys, *drivers).hint("merge"), list(keys), "left")
    )
    season = {n: c for n, c in day_features(F.col("date")).items() if n != "DOY"}
    rows = rows.withColumns(season).withColumn("year", F.year("date"))
    return require(rows, [target, *satellite, *drivers])
