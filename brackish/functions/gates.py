"""Quality gates. An unknown flag or sensor value never condemns a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -9999.0
GOOD_FLAGS = (0, 1)
USTAR_MIN = 0.1
LE_RANGE = (-100.0, 800.0)
CLOUD_BITS = 0b111110
CLEAR_CLASSES = (4, 5, 6, 7)


def known(value: Column, missing: float = MISSING) -> Column:
    """Null for the missing-data sentinel and for NaN (Spark orders NaN above every number)."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (value != missing), value)


def gate_flag(value: Column, flag: Column, good=GOOD_FLAGS) -> Column:
    return F.when(flag.isNull() | flag.isin(*good), value)


def gate_min(value: Column, gauge: Column, least: float = USTAR_MIN) -> Column:
    return F.when(gauge.isNull() | (gauge >= least), value)


def gate_range(value: Column, lo: float = LE_RANGE[0], hi: float = LE_RANGE[1]) -> Column:
    return F.when(value.between(lo, hi), value)


def is_clear(qa: Column, bits: int = CLOUD_BITS) -> Column:
    """True where none of the cloud, cirrus, shadow or snow bits is set; unknown counts as fill (1)."""
    return F.coalesce(qa.cast("int"), F.lit(1)).bitwiseAND(F.lit(bits)) == 0


def is_clear_class(scene_class: Column, keep=CLEAR_CLASSES) -> Column:
    return F.coalesce(scene_class.isin(*keep), F.lit(False))


def mask(value: Column, keep: Column) -> Column:
    return F.when(keep, value)


def plausible_lst(lst: Column, lo: float = 200.0, hi: float = 340.0) -> Column:
    return F.when((lst > lo) & (lst < hi), lst)


def outlier(et: Column, lo: float = -0.5, hi: float = 12.0) -> Column:
    return (et < lo) | (et > hi)


def in_period(date: Column, first: str, last: str) -> Column:
    return date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def footprint_usable(ustar: Column, wind: Column, direction: Column, zm: Column, obukhov: Column) -> Column:
    stable = F.try_divide(zm, obukhov) > -15.5
    return (ustar > 0.1) & (wind > 0) & direction.between(0, 360) & stable


def all_known(*values: Column) -> Column:
    """One boolean: every listed value is present."""
    ok = F.lit(True)
    for value in values:
        ok = ok & value.isNotNull()
    return ok
