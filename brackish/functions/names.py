"""Choosing columns by qualified variable names. Works on the schema, reads no rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(columns: list[str], base: str) -> str | None:
    """The bare name, else the shortest qualified one (`_PI`, `_F`, numeric positions)."""
    if base in columns:
        return base
    qualified = re.compile(re.escape(base) + r"(_PI)?(_F)?(_\d+)*")
    return min((c for c in columns if qualified.fullmatch(c)), key=lambda c: (len(c), c), default=None)


def pick_prefix(columns: list[str], base: str) -> str | None:
    """Looser: any `base_...` name, shortest first, in file order among equals."""
    return min((c for c in columns if c == base or c.startswith(base + "_")), key=len, default=None)


def variable(df: DataFrame, base: str, chooser=pick) -> Column:
    """The chosen column as double, or a null column where the file has none."""
    name = chooser(df.columns, base)
    return (F.col(f"`{name}`") if name else F.lit(None)).cast("double").alias(base)


def first_col(df: DataFrame, *names: str) -> Column:
    """The first of `names` that exists; a choice between columns, not between values."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`").cast("double")
    return F.lit(None).cast("double")
