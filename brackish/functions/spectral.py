"""Spectral indices in the regimes in use: clipped, nulled-out and unguarded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackish.functions.energy import clip

MIN_DENOMINATOR = 0.02


def _guarded(num: Column, den: Column, least: float = MIN_DENOMINATOR) -> Column:
    return F.when(den > least, F.try_divide(num, den))


def clipped_ratio(a: Column, b: Column) -> Column:
    """(a-b)/(a+b), null for a tiny denominator, clipped to one."""
    return clip(_guarded(a - b, a + b), -1, 1)


def savi(nir: Column, red: Column) -> Column:
    return clip(F.try_divide((nir - red) * 1.5, nir + red + 0.5), -1, 1.5)


def evi2(nir: Column, red: Column) -> Column:
    return clip(F.try_divide((nir - red) * 2.5, nir + red * 2.4 + 1.0), -1, 1.5)


def lai(savi_value: Column) -> Column:
    bounded = clip(savi_value, 0, 0.685)
    return clip(-F.ln((F.lit(0.69) - bounded) / 0.59) / 0.91, 0, 6)


def clipped_indices(red: Column, nir: Column, green: Column, swir: Column) -> dict[str, Column]:
    soil = savi(nir, red)
    return {
        "NDVI": clipped_ratio(nir, red),
        "SAVI": soil,
        "EVI2": evi2(nir, red),
        "NDWI": clipped_ratio(nir, swir),
        "MNDWI": clipped_ratio(green, swir),
        "LAI": lai(soil),
    }


def positive(band: Column) -> Column:
    """Reflectance at or below zero is not a measurement."""
    return F.when(band > 0, band)


def strict_ratio(a: Column, b: Column, limit: float = 1.0) -> Column:
    """(a-b)/(a+b) of positive bands; null beyond `limit` in size."""
    a, b = positive(a), positive(b)
    ratio = _guarded(a - b, a + b)
    return F.when(F.abs(ratio) <= limit, ratio)


def strict_indices(red: Column, nir: Column, green: Column, swir: Column) -> dict[str, Column]:
    r, n = positive(red), positive(nir)
    soil = _guarded((n - r) * 1.5, n + r + 0.5, 0.05)
    evi = _guarded((n - r) * 2.5, n + r * 2.4 + 1.0, 0.05)
    return {
        "NDVI": strict_ratio(nir, red),
        "MNDWI": strict_ratio(green, swir),
        "SAVI": F.when(F.abs(soil) <= 1.5, soil),
        "EVI2": F.when(F.abs(evi) <= 1.5, evi),
        "NDWI": strict_ratio(nir, swir),
    }


def sentinel_indices(b3: Column, b4: Column, b8: Column, b11: Column) -> dict[str, Column]:
    return {
        "NDVI_S2": strict_ratio(b8, b4),
        "MNDWI_S2": strict_ratio(b3, b11),
        "NDWI_S2": strict_ratio(b3, b8),
    }


def plain_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def open_water(mndwi: Column, ndvi: Column) -> Column:
    """Wet and not vegetated; unknown is not water."""
    return F.coalesce((mndwi > 0.0) & (ndvi < 0.10), F.lit(False))
