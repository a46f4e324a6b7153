"""Latent heat, evapotranspiration units and energy-balance closure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_HOUR = 1800.0
DAY = 86400.0
LAMBDA_CONST = 2.45e6
W2MM = DAY / LAMBDA_CONST
MAX_CLOSURE_RATIO = 2.0
CLOSURE_FLOOR = 20.0


def latent_heat(ta: Column) -> Column:
    """Latent heat of vaporisation in J/kg at `ta` degrees Celsius."""
    return (F.lit(2.501) - ta * 0.00237) * 1e6


def le_to_et(le: Column, ta: Column, seconds: float = DAY) -> Column:
    """W/m2 held for `seconds` to millimetres of water, temperature-dependent."""
    return F.try_divide(le * F.lit(seconds), latent_heat(ta))


def le_to_et_const(le: Column, seconds: float = DAY) -> Column:
    return le * F.lit(seconds / LAMBDA_CONST)


def available(rn: Column, g: Column) -> Column:
    """Net radiation less ground heat; an unmeasured ground heat counts as zero."""
    return rn - F.coalesce(g, F.lit(0.0))


def closure_ok(le: Column, h: Column, rn: Column, g: Column, floor: float = CLOSURE_FLOOR) -> Column:
    """True (never null) where the balance can be closed: daytime with upward fluxes."""
    return F.coalesce((available(rn, g) > floor) & (h + le > floor), F.lit(False))


def bowen_closed(le: Column, h: Column, rn: Column, g: Column) -> Column:
    """LE with its share of the residual; the measured LE where that would more than double it."""
    turb = h + le
    candidate = le + (available(rn, g) - turb) * F.try_divide(le, turb)
    ratio = F.abs(F.try_divide(candidate, le))
    return F.when(closure_ok(le, h, rn, g) & (ratio <= MAX_CLOSURE_RATIO), candidate).otherwise(le)


def component_rn(sw_in: Column, sw_out: Column, lw_in: Column, lw_out: Column) -> Column:
    return sw_in - sw_out + lw_in - lw_out


def clip(value: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds that keep null as null (`greatest` and `least` skip nulls).

    The value is written out twice at most: filters that are pushed below it repeat it as often, and a stage whose
    code grows too long is interpreted.
    """
    out = value
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(value.isNotNull(), out)
