"""Raster work on long pixel tables: one row per site, scene and pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.functions import gates, spectral
from brackish.operators import blocks
from brackish.operators.joins import KM_PER_DEGREE
from brackish.session import settle

BANDS = ("red", "nir", "green", "swir")


def clear_pixels(df: DataFrame, values: Sequence[str], qa: str = "qa") -> DataFrame:
    """Cloudy pixels keep their place with null values, so that they count in valid fractions."""
    keep = gates.is_clear(F.col(qa))
    return df.withColumns({c: gates.mask(F.col(c), keep) for c in values})


def with_indices(df: DataFrame, regime: str = "strict") -> DataFrame:
    """Per-pixel indices of the four bands, nulled out (`strict`) or clipped (`clip`)."""
    args = [F.col(b) for b in BANDS]
    made = spectral.strict_indices(*args) if regime == "strict" else spectral.clipped_indices(*args)
    return df.withColumns(made)


def _per_extent(
    df: DataFrame, keys: Sequence[str], distance: Column, sizes: Sequence[float], name: str, aggs: list[Column]
) -> DataFrame:
    """Aggregate within nested extents from one scan: each pixel goes to the sizes that hold it."""
    homes = F.array_compact(F.array(*[F.when(distance <= s[1], F.lit(s[0])) for s in sizes]))
    return df.withColumn(name, F.explode(homes)).groupBy(*keys, name).agg(*aggs)


def window_means(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    windows: Sequence[int] = (90, 250, 500),
    scale: Column | float = 1.0,
    reference: str = "LST",
    min_valid: float | None = None,
    primary: int | None = None,
) -> DataFrame:
    """Means over square windows around the origin with the share of valid pixels in each window.

    `scale` corrects projected distance (cosine of latitude on web-mercator
    grids). With `min_valid`, scenes whose valid share in the `primary`
    window is lower are dropped altogether.
    """
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    distance = F.greatest(F.abs("px_x"), F.abs("px_y")) * scale
    aggs = [F.avg(c).alias(c) for c in cols] + [
        (F.count(reference) / F.count(F.lit(1))).alias("valid_frac")
    ]
    out = _per_extent(df, keys, distance, [(w, w / 2.0) for w in windows], "window_m", aggs)
    if min_valid is None:
        return out
    scene = Window.partitionBy(*keys)
    main = F.max(F.when(F.col("window_m") == (primary or windows[0]), F.col("valid_frac"))).over(scene)
    return out.withColumn("_main", F.coalesce(main, F.lit(0.0))).where(F.col("_main") >= min_valid).drop("_main")


def radius_means(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    radii: Sequence[int] = (100, 250, 500, 1000, 2000),
    scale: Column | float = 1.0,
) -> DataFrame:
    """Means within concentric circles, in long form."""
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    distance = F.hypot("px_x", "px_y") * scale
    return _per_extent(df, keys, distance, [(r, float(r)) for r in radii], "radius_m", [F.avg(c).alias(c) for c in cols])


def ratio_of_means(means: DataFrame) -> DataFrame:
    """Indices of window-mean bands, without guards."""
    return means.withColumns(
        {
            "NDVI": spectral.plain_ratio(F.col("nir"), F.col("red")),
            "MNDWI": spectral.plain_ratio(F.col("green"), F.col("swir")),
        }
    )


def chip_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every band or index over the chip."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*aggs)


def gate_valid_fraction(df: DataFrame, keys: Sequence[str], col: str, least: float = 0.5) -> DataFrame:
    """Scenes with their share of valid pixels, those below `least` dropped."""
    share = F.count(col) / F.count(F.lit(1))
    return df.groupBy(*keys).agg(share.alias("valid_frac")).where(F.col("valid_frac") >= least)


def thermal_window_stats(df: DataFrame, keys: Sequence[str], lst: str = "LST", least: float = 0.5) -> DataFrame:
    """Mean and deviation of plausible temperatures where at least `least` of the window is plausible."""
    good = gates.plausible_lst(F.col(lst))
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(good).alias("LST_mean"),
            F.stddev_pop(good).alias("LST_sd"),
            (F.count(good) / F.count(F.lit(1))).alias("_share"),
        )
        .where((F.col("_share") >= least) & F.col("LST_mean").isNotNull())
        .drop("_share")
    )


def weighted_mean(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], weight: str = "fp_weight", rule: str = "drop"
) -> DataFrame:
    """Footprint-weighted means.

    `drop` leaves out pixels whose value is missing or whose weight is not
    positive; `zero` lets a missing value count as zero weight, column by
    column. Without any weight the mean is null.
    """
    if rule not in ("drop", "zero"):
        raise ValueError(rule)
    w = F.col(weight)
    usable = w.isNotNull() if rule == "zero" else w > 0
    aggs = []
    for c in cols:
        value = F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
        wc = F.when(usable & value.isNotNull(), w)
        aggs.append(F.when(F.sum(wc) > 0, F.sum(wc * value) / F.sum(wc)).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def keep_scenes(
    df: DataFrame,
    keys: Sequence[str],
    lst: str = "LST",
    weight: str = "fp_weight",
    least_finite: float = 0.3,
    least_pixels: int = 3,
) -> DataFrame:
    """Weighted pixels of the scenes that are clear enough and keep enough of them."""
    good = F.col(lst).isNotNull() & (F.col(weight) > 0)
    scenes = (
        df.groupBy(*keys)
        .agg((F.count(lst) / F.count(F.lit(1))).alias("_share"), F.count_if(good).alias("_n"))
        .where((F.col("_share") >= least_finite) & (F.col("_n") >= least_pixels))
        .select(*keys)
    )
    return df.where(good).join(scenes, list(keys), "left_semi")


def normalise_weights(df: DataFrame, keys: Sequence[str], weight: str = "w") -> DataFrame:
    """Weights that sum to one per key; missing ones count as zero, an all-zero key is left as it is."""
    total = settle(df.groupBy(*keys).agg(F.sum(weight).alias("_total")))
    w = F.coalesce(F.col(weight), F.lit(0.0))
    scaled = F.when(F.col("_total") > 0, w / F.col("_total")).otherwise(w)
    return df.join(total, list(keys), "left").withColumn(weight, scaled).drop("_total")


def source_area(
    df: DataFrame, keys: Sequence[str], weight: str = "w", shares=(0.5, 0.8), cell_m2: float = 100.0
) -> DataFrame:
    """For each share: the weight level enclosing it and the area above, in hectares.

    Cumulating from the largest weight is done in logarithmic weight bins
    with carried totals; equal weights are counted together first.
    """
    w = normalise_weights(df, keys, weight).where(F.col(weight) >= 0)
    counted = w.groupBy(*keys, F.col(weight).alias("_w")).agg(F.count(F.lit(1)).alias("_c"))
    tiny = F.greatest(F.col("_w"), F.lit(1e-300))
    counted = counted.withColumn("_bin", F.floor(-F.log2(tiny) * 64))
    totals = counted.groupBy(*keys, "_bin").agg(F.sum(F.col("_w") * F.col("_c")).alias("_t"), F.sum("_c").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_t0"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_m0"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_w")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(carry, [*keys, "_bin"]).select(
        *keys,
        "_w",
        (F.col("_t0") + F.sum(F.col("_w") * F.col("_c")).over(inside)).alias("_cum"),
        (F.col("_m0") + F.sum("_c").over(inside)).alias("_cells"),
    )
    aggs = []
    for s in shares:
        hit = F.col("_cum") >= s
        tag = f"{round(s * 100)}"
        aggs += [
            F.max(F.when(hit, F.col("_w"))).alias(f"level_{tag}"),
            (F.min(F.when(hit, F.col("_cells"))) * cell_m2 / 1e4).alias(f"area_{tag}_ha"),
        ]
    return ranked.groupBy(*keys).agg(*aggs)


def mosaic(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of the valid looks at each pixel on one date. `keys` name the pixel and the date."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def temporal_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Median over time per pixel. `keys` name the pixel; a stack is as long as its acquisitions."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in cols])


def pick_scene(
    scenes: DataFrame,
    regions: DataFrame,
    region: str = "region",
    tiers: Sequence[float] = (8.0, 15.0, 25.0),
) -> DataFrame:
    """The scene to map each region: lowest cloud tier first, then least cloudy, then smallest id.

    `scenes` has `scene, cloud, x_lo, x_hi, y_lo, y_hi, n_assets, region`
    (the regions its footprint was searched for); `regions` has the centre
    `cx, cy` and `need` assets.
    """
    tier = F.coalesce(*[F.when(F.col("cloud") < t, F.lit(i)) for i, t in enumerate(tiers)])
    fit = (
        scenes.join(regions, region)
        .where(F.col("cx").between(F.col("x_lo"), F.col("x_hi")) & F.col("cy").between(F.col("y_lo"), F.col("y_hi")))
        .where(F.col("n_assets") >= F.col("need"))
        .withColumn("tier", tier)
        .where(F.col("tier").isNotNull())
        .select(region, "scene", "cloud", "tier")
    )
    return blocks.first_per_group(fit, [region], [F.col("tier"), F.col("cloud"), F.col("scene")])


def region_summary(df: DataFrame, keys: Sequence[str], et: str = "et", water: str = "water") -> DataFrame:
    """Pixels inside, open water, valid and their ET. `df` holds the pixels inside each region."""
    wet = F.count_if(F.col(water))
    value = F.when(~F.col(water), F.col(et))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inside_px"),
        wet.alias("water_px"),
        F.count(value).alias("pixels"),
        F.avg(value).alias("mean_ET"),
        F.min(value).alias("min_ET"),
        F.max(value).alias("max_ET"),
        (wet * 100.0 / F.count(F.lit(1))).alias("water_pct"),
    )


def unmix(
    df: DataFrame,
    keys: Sequence[str],
    radius: float = 250.0,
    lst: str = "LST",
    mndwi: str = "MNDWI",
    water_above: float = 0.0,
    least: tuple[int, int, int] = (50, 10, 10),
) -> DataFrame:
    """Mean temperature of all, vegetated and water pixels around the tower, and what mixing costs."""
    near = (F.hypot("px_x", "px_y") <= radius) & F.col(lst).isNotNull()
    t = F.when(near, F.col(lst))
    veg = F.when(F.col(mndwi) <= water_above, t)
    wet = F.when(F.col(mndwi) > water_above, t)
    day = (
        df.groupBy(*keys)
        .agg(
            F.count(t).alias("n_all"),
            F.count(veg).alias("n_veg"),
            F.count(wet).alias("n_water"),
            F.avg(t).alias("LST_all"),
            F.avg(veg).alias("LST_veg"),
            F.avg(wet).alias("_wet"),
        )
        .where((F.col("n_all") >= least[0]) & (F.col("n_veg") >= least[1]))
    )
    return day.select(
        *keys,
        (F.col("n_water") / F.col("n_all")).alias("water_frac"),
        "LST_all",
        "LST_veg",
        F.when(F.col("n_water") >= least[2], F.col("_wet")).alias("LST_water"),
        (F.col("LST_veg") - F.col("LST_all")).alias("dT"),
    )


def unmix_summary(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("water_frac").alias("water_frac"),
        F.avg("dT").alias("dT_mean"),
        F.max(F.abs("dT")).alias("dT_max"),
        F.avg(F.col("LST_veg") - F.col("LST_water")).alias("veg_minus_water"),
    )


def add_coarse_residual(fine: DataFrame, cell: Sequence[str], coarse: str, pred: str, name: str) -> DataFrame:
    """Shift fine predictions so that they average to the coarse value of their cell."""
    mean = F.avg(pred).over(Window.partitionBy(*cell))
    return fine.withColumn(name, F.col(pred) + F.col(coarse) - mean)


def compare_scales(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], value: str, radii: Sequence[int]) -> DataFrame:
    """Fine and coarse mean within each radius and their mean absolute difference over scenes."""
    a = radius_means(fine, keys, [value], radii).withColumnRenamed(value, "_fine")
    b = radius_means(coarse, keys, [value], radii).withColumnRenamed(value, "_coarse")
    return (
        a.join(b, [*keys, "radius_m"])
        .groupBy("radius_m")
        .agg(
            F.avg("_fine").alias("mean_fine"),
            F.avg("_coarse").alias("mean_coarse"),
            F.avg(F.abs(F.col("_fine") - F.col("_coarse"))).alias("mean_abs_diff"),
        )
    )


def scale_sensitivity(means: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Median of each variable per window or radius (named in `keys`), in long form."""
    long = blocks.unpivot(means, keys, cols, "variable", "_v")
    return blocks.group_quantiles(long, [*keys, "variable"], "_v", {"median": 0.5})


def bounding_box(lat: Column, lon: Column, km: float) -> dict[str, Column]:
    """West, south, east and north edges `km` away from a point."""
    dlat, dlon = F.lit(km / KM_PER_DEGREE), F.lit(km) / (F.cos(F.radians(lat)) * KM_PER_DEGREE)
    return {"west": lon - dlon, "south": lat - dlat, "east": lon + dlon, "north": lat + dlat}


def availability(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Known values per key and stream."""
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
