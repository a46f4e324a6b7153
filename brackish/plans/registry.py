"""The checked queries: a Spark callable per name, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `f(views) -> DataFrame` under `name`."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Views(spark, folder))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


# Averages of short decimals fall exactly between two rounded values, where
# engines differ; a fixed nudge far below the shown digits moves them off.
NUDGE = 3.7e-9


def r(value: Column | str, name: str | None = None, digits: int = 5) -> Column:
    """Rounded for comparison with the SQL twin, negative zero removed."""
    col = F.col(value) if isinstance(value, str) else value
    out = F.round(col + F.lit(NUDGE), digits) + F.lit(0.0)
    return out.alias(name or value) if name or isinstance(value, str) else out


def rsql(expr: str, name: str | None = None, digits: int = 5) -> str:
    return f"round(({expr}) + {NUDGE!r}, {digits}) + 0.0 AS {name or expr}"
