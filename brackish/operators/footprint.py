"""Flux-footprint climatology after the published two-dimensional parameterisation (Kljun et al. 2015)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.meteorology import KARMAN
from brackish.operators.pixels import normalise_weights

# Fixed parameters of the published scaled footprint.
A, B, C, D = 1.4524, -1.9914, 1.4622, 0.1359
AC, BC, CC = 2.17, 1.66, 20.0


def density(x: Column, y: Column, zm: Column, h: float, umean: Column, ustar: Column, sigmav: Column, obukhov: Column) -> Column:
    """Footprint density at `x` metres upwind and `y` metres across, zero downwind of the sensor."""
    profile = umean / ustar * KARMAN
    thin = 1 - zm / h
    xs = x / zm * thin / profile
    past = xs - D
    along = F.lit(A) * F.pow(past, F.lit(B)) * F.exp(F.lit(-C) / past)
    cross_integrated = along / zm * thin / profile
    unstable = F.when(obukhov <= 0, F.lit(0.8)).otherwise(F.lit(0.55))
    spread_scale = F.least(F.lit(1.0), F.abs(obukhov / zm) * 1e-5 + unstable)
    sigma = F.lit(AC) * F.sqrt(F.lit(BC) * xs * xs / (xs * CC + 1)) / spread_scale * zm * sigmav / ustar
    across = F.exp(-(y * y) / (sigma * sigma * 2)) / (sigma * 2.5066282746310002)
    return F.when(past > 0, cross_integrated * across).otherwise(F.lit(0.0))


def _reach(zm: Column, h: float, umean: Column, ustar: Column, sigmav: Column, obukhov: Column, far: float) -> tuple[Column, Column]:
    """(nearest upwind distance with any density, farthest distance across that counts at `far` metres upwind or less)."""
    profile = umean / ustar * KARMAN
    thin = 1 - zm / h
    near = zm / thin * profile * D
    xs = F.lit(far) / zm * thin / profile
    unstable = F.when(obukhov <= 0, F.lit(0.8)).otherwise(F.lit(0.55))
    spread_scale = F.least(F.lit(1.0), F.abs(obukhov / zm) * 1e-5 + unstable)
    sigma = F.lit(AC) * F.sqrt(F.lit(BC) * xs * xs / (xs * CC + 1)) / spread_scale * zm * sigmav / ustar
    return near, sigma * SIGMAS


#: Across the wind, a density this many standard deviations off the axis is less than 1e-16 of that on the axis.
SIGMAS = 8.7


def climatology(
    halfhours: DataFrame, keys: Sequence[str], zm: Column, domain: int = 600, step: int = 10, h: float = 1000.0
) -> DataFrame:
    """Mean footprint of all valid half hours on a square grid, weights normalised per site.

    `halfhours` has `ustar, sigmav, obukhov, wind_dir, umean`. A half hour yields only the cells of its upwind strip,
    whose bounds follow in closed form from its turbulence; elsewhere its density is zero to double precision. Cells are
    summed before the shuffle, so nothing larger than the grid per task is exchanged; no subsampling is
    needed to bound memory. Every cell of the grid is in the result.
    """
    n = domain // step
    axis = F.sequence(F.lit(-n), F.lit(n))
    rows = halfhours.withColumn("_zm", zm)
    near, wide = _reach(F.col("_zm"), h, F.col("umean"), F.col("ustar"), F.col("sigmav"), F.col("obukhov"), domain * 2**0.5)
    wd = F.radians("wind_dir")
    rows = rows.withColumns({"_sin": F.sin(wd), "_cos": F.cos(wd), "_near": near, "_wide": wide}).withColumn("ix", F.explode(axis))
    east = F.col("ix") * float(step)
    # for a column of cells: |east * cos - north * sin| <= wide and east * sin + north * cos >= near
    flat = F.abs("_sin") < 1e-6
    side = F.abs("_wide") / F.nullif(F.abs("_sin"), F.lit(0.0))
    middle = east * F.col("_cos") / F.nullif(F.col("_sin"), F.lit(0.0))
    ahead = (F.col("_near") - east * F.col("_sin")) / F.nullif(F.col("_cos"), F.lit(0.0))
    low = F.when(~flat, middle - side)
    high = F.when(~flat, middle + side)
    low = F.greatest(low, F.when(F.col("_cos") > 1e-6, ahead), F.lit(-float(domain)))
    high = F.least(high, F.when(F.col("_cos") < -1e-6, ahead), F.lit(float(domain)))
    first, last = F.greatest(F.floor(low / step).cast("int"), F.lit(-n)), F.least(F.ceil(high / step).cast("int"), F.lit(n))
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    cells = rows.withColumn("iy", F.explode(F.sequence("_first", "_last")))
    north = F.col("iy") * float(step)
    upwind, across = east * F.col("_sin") + north * F.col("_cos"), east * F.col("_cos") - north * F.col("_sin")
    f = density(upwind, across, F.col("_zm"), h, F.col("umean"), F.col("ustar"), F.col("sigmav"), F.col("obukhov"))
    sums = cells.groupBy(*keys, "ix", "iy").agg(F.sum(f).alias("_f"))
    counts = halfhours.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grid = counts.withColumn("ix", F.explode(axis)).withColumn("iy", F.explode(axis))
    mean = grid.join(sums, [*keys, "ix", "iy"], "left").select(*keys, "ix", "iy", (F.coalesce("_f", F.lit(0.0)) / F.col("_n")).alias("w"))
    out = normalise_weights(mean, keys, "w")
    return out.select(*keys, (F.col("ix") * step).alias("x"), (F.col("iy") * step).alias("y"), "w")
