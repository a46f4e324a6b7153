"""Landed files as DataFrames with one schema per kind, missing values as null."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackish.functions import meteorology as met
from brackish.functions.gates import known
from brackish.functions.names import first_col, pick
from brackish.operators.blocks import first_per_group

BASE_VARIABLES = ("LE", "H", "NETRAD", "G", "TA", "USTAR", "WTD", "LE_SSITC_TEST", "WD", "WS", "PA")
DAILY_COLUMNS = (
    "LE_F_MDS", "LE_CORR", "H_CORR", "NETRAD", "G_F_MDS", "TA_F",
    "LE_CORR_25", "LE_CORR_75", "LE_RANDUNC", "LE_F_MDS_QC",
    "SW_IN_F", "SW_OUT", "LW_IN_F", "LW_OUT",
)
HALFHOUR_COLUMNS = (
    "LE_F_MDS", "H_F_MDS", "NETRAD", "G_F_MDS", "TA_F", "USTAR", "WD", "WS_F", "PA_F",
    "SW_IN_F", "SW_OUT", "LW_IN_F", "LW_OUT",
)
HOURLY_COLUMNS = (
    "temperature_2m", "dewpoint_temperature_2m", "surface_solar_radiation_downwards_hourly",
    "u_component_of_wind_10m", "v_component_of_wind_10m", "total_precipitation_hourly",
    "skin_temperature", "volumetric_soil_water_layer_1", "potential_evaporation_hourly",
)
MET_NAMES = {
    "TA_C": "TA_ERA", "SRAD_Wm2": "SW_IN_ERA", "VPD_kPa": "VPD_ERA", "WS_ms": "WS_ERA", "P_mm": "P_ERA",
}
SITE_SCHEMA = (
    "SITE_ID string, SITE_NAME string, STATE string, IGBP string, COUNTRY string, TOWER_BEGAN string, "
    "TOWER_END string, URL_AMERIFLUX string, "
    "GRP_LOCATION struct<LOCATION_LAT: string, LOCATION_LONG: string, LOCATION_ELEV: string>, "
    "GRP_CLIM_AVG struct<CLIMATE_KOEPPEN: string, MAT: string, MAP: string>"
)
_SITE_PART = r"([A-Z]{2}-[A-Za-z0-9]{3})"


def minute_stamp(text: Column) -> Column:
    return F.try_to_timestamp(text.cast("string"), F.lit("yyyyMMddHHmm"))


def day_stamp(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text.cast("string"), F.lit("yyyyMMdd")))


def _by_header(
    spark: SparkSession, paths: str | Sequence[str], key: str, chosen: Callable[[list[str]], dict[str, str | None]]
) -> DataFrame:
    """Delimited files that differ in their columns; nothing runs while the plan is built.

    Spark's CSV reader takes the columns of one file for all. Here each file's header is the line in its first split that
    names the column `key`; the headers stay a table of one row a file, where `chosen` maps their names to output
    columns, and rows look their fields up by the positions of their own file. Files without `key` yield nothing. The site is
    in the name of the file or of its folder. Returns site, the key as text, and doubles.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), "value"
    )
    heads = lines.where((F.col("_start") == 0) & F.col("value").rlike(rf'(^|,)\s*"?{key}"?\s*(,|$)'))
    out = list(chosen([]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(1).to_pylist():
                names = [n.strip().strip('"') for n in line.split(",")]
                rows.append([names.index(key), *[names.index(n) if n else None for n in chosen(names).values()]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["_file", "_at"])

    heads = heads.groupBy("_file").agg(F.min("value").alias("value"))
    table = heads.mapInArrow(place, "_file string, _at array<int>")
    rows = lines.join(table, "_file").withColumn("_a", F.split("value", ","))

    def text(i: int) -> Column:
        return F.trim(F.get("_a", F.col("_at")[i]).cast("string"), F.lit('" \t\r'))

    parts = F.split("_file", "/")
    name, folder = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    site = F.when(name.rlike(_SITE_PART), F.regexp_extract(name, _SITE_PART, 1)).otherwise(F.regexp_extract(folder, _SITE_PART, 1))
    return rows.select(
        site.alias("site"),
        text(0).alias("_key"),
        *[known(text(i + 1).try_cast("double")).alias(c) for i, c in enumerate(out)],
    )


def _exact(columns: Sequence[str]) -> Callable[[list[str]], dict[str, str | None]]:
    return lambda names: {c: c if c in names else None for c in columns}


def read_flux_base(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw half-hourly files: preamble, qualified names differing per file, -9999 for missing."""
    rows = _by_header(spark, paths, "TIMESTAMP_START", lambda names: {v: pick(names, v) for v in BASE_VARIABLES})
    rows = rows.withColumn("ts", minute_stamp(F.col("_key"))).where(F.col("ts").isNotNull())
    return rows.select("site", "ts", *BASE_VARIABLES).withColumnRenamed("LE_SSITC_TEST", "QC")


def read_flux_daily(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Daily product files; columns a site lacks are null."""
    rows = _by_header(spark, paths, "TIMESTAMP", _exact(DAILY_COLUMNS)).withColumn("date", day_stamp(F.col("_key")))
    return rows.where(F.col("date").isNotNull()).select("site", "date", *DAILY_COLUMNS)


def read_flux_hh(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Half-hourly product files."""
    rows = _by_header(spark, paths, "TIMESTAMP_START", _exact(HALFHOUR_COLUMNS))
    rows = rows.withColumn("ts", minute_stamp(F.col("_key"))).where(F.col("ts").isNotNull())
    return rows.select("site", "ts", *HALFHOUR_COLUMNS)


def read_met_daily(spark: SparkSession, reanalysis: str | None, gridded: str | None = None) -> DataFrame:
    """Daily reanalysis CSV, or the gridded product renamed to the same columns. Pressure deficit in hPa."""
    cols = ["TA_ERA", "SW_IN_ERA", "VPD_ERA", "WS_ERA", "P_ERA"]
    if reanalysis:
        rows = _by_header(spark, reanalysis, "TIMESTAMP", _exact(cols)).withColumn("date", day_stamp(F.col("_key")))
        return rows.where(F.col("date").isNotNull()).select("site", "date", *cols)
    grid = spark.read.parquet(gridded).withColumnsRenamed(MET_NAMES)
    out = grid.select("site", "date", *[first_col(grid, c).alias(c) for c in cols])
    return out.withColumn("VPD_ERA", met.kpa_to_hpa(F.col("VPD_ERA")))


def met_by_site(*sources: DataFrame, site: str = "site") -> DataFrame:
    """Rows of the first source that has a site at all; sources have the same columns, best one first."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = ranked.groupBy(site).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [site, "_rank"], "left_semi").drop("_rank")


def gridded_met(raw: DataFrame) -> DataFrame:
    """Gridded daily extremes (kelvin, percent) to the meteorology in use."""
    tx, tn = met.kelvin_to_c(F.col("tmmx")), met.kelvin_to_c(F.col("tmmn"))
    rx, rn = F.col("rmax"), F.col("rmin")
    made = {
        "TA_C": (tx + tn) / 2,
        "VPD_kPa": met.vpd_daily(tx, tn, rx, rn),
        "RH_pct": met.rh_daily(tx, tn, rx, rn),
    }
    renamed = {"vs": "WS_ms", "srad": "SRAD_Wm2", "etr": "ETr_mm", "pet": "ETo_mm", "pr": "P_mm"}
    keep = [c for c in raw.columns if c not in {"tmmx", "tmmn", "rmax", "rmin", *renamed}]
    return raw.select(
        *keep, *[c.alias(n) for n, c in made.items()], *[first_col(raw, o).alias(n) for o, n in renamed.items()]
    )


def read_met_hourly(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Hourly reanalysis CSVs: files without dates and rows with bad ones are dropped, repeated hours kept once."""
    rows = _by_header(spark, paths, "date", _exact(HOURLY_COLUMNS))
    rows = rows.withColumn("ts", F.try_to_timestamp("_key")).where(F.col("ts").isNotNull())
    order = [F.struct(*HOURLY_COLUMNS)]  # of repeated hours the one with the least values, whatever the order of files
    return first_per_group(rows.select("site", "ts", *HOURLY_COLUMNS), ["site", "ts"], order)


def hourly_to_daily_met(hourly: DataFrame) -> DataFrame:
    """Hourly reanalysis to daily drivers; a site without any temperature yields no rows."""
    col = F.col
    t, dew = met.kelvin_to_c(col("temperature_2m")), met.kelvin_to_c(col("dewpoint_temperature_2m"))
    day = hourly.groupBy("site", F.to_date("ts").alias("date")).agg(
        F.avg(t).alias("TA_ERA"),
        F.avg(met.kpa_to_hpa(met.vpd_dew(t, dew))).alias("VPD_ERA"),
        F.avg(met.joule_hour_to_watt(col("surface_solar_radiation_downwards_hourly"))).alias("SW_IN_ERA"),
        F.avg(met.wind_speed(col("u_component_of_wind_10m"), col("v_component_of_wind_10m"))).alias("WS_ERA"),
        F.sum(met.metre_to_mm(col("total_precipitation_hourly"))).alias("P_ERA"),
        F.avg(met.kelvin_to_c(col("skin_temperature"))).alias("SKT_ERA"),
        F.avg(col("volumetric_soil_water_layer_1")).alias("SM_ERA"),
        F.sum(met.pet_to_mm(col("potential_evaporation_hourly"))).alias("PET_ERA"),
    )
    live = day.groupBy("site").agg(F.count("TA_ERA").alias("_n")).where("_n > 0").select("site")
    return day.join(live, "site", "left_semi")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_site_catalog(spark: SparkSession, path: str, country: str = "USA") -> DataFrame:
    """Nested site catalogue, flattened; sites without coordinates are left out."""
    raw = spark.read.schema(SITE_SCHEMA).json(path, multiLine=True)
    lat, lon = F.col("GRP_LOCATION.LOCATION_LAT").try_cast("double"), F.col("GRP_LOCATION.LOCATION_LONG").try_cast("double")
    blank = F.lit("")
    return raw.where((F.col("COUNTRY") == country) & (lat != 0) & (lon != 0)).select(
        "SITE_ID",
        *[F.coalesce(c, blank).alias(c) for c in ("SITE_NAME", "STATE", "IGBP")],
        lat.alias("LAT"),
        lon.alias("LON"),
        F.coalesce("GRP_LOCATION.LOCATION_ELEV", blank).alias("ELEV"),
        F.coalesce("GRP_CLIM_AVG.CLIMATE_KOEPPEN", blank).alias("KOEPPEN"),
        F.coalesce("GRP_CLIM_AVG.MAT", blank).alias("MAT"),
        F.coalesce("GRP_CLIM_AVG.MAP", blank).alias("MAP"),
        *[F.coalesce(c, blank).alias(c) for c in ("TOWER_BEGAN", "TOWER_END")],
        F.coalesce("URL_AMERIFLUX", blank).alias("URL"),
    )


def read_coastline(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """GeoJSON lines as vertices (part, i, lat, lon); parts outside (west, south, east, north) are dropped."""
    line = "array<array<double>>"
    kinds = {"LineString": f"struct<type: string, coordinates: {line}>", "MultiLineString": f"struct<type: string, coordinates: array<{line}>>"}

    def parts(kind: str) -> DataFrame:
        schema = f"features array<struct<geometry: {kinds[kind]}>>"
        raw = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
        geometry = raw.select(F.posexplode("features").alias("_f", "_g")).where(F.col("_g.geometry.type") == kind)
        shape = F.col("_g.geometry.coordinates")
        lines = F.array(shape) if kind == "LineString" else shape
        return geometry.select("_f", F.posexplode(lines).alias("_p", "_line")).where(F.size("_line") >= 2)

    both = parts("LineString").unionByName(parts("MultiLineString"))
    west, south, east, north = bbox

    def edge(i: int, best) -> Column:
        return best(F.transform("_line", lambda v: v[i]))

    near = both.where(
        (edge(0, F.array_max) >= west)
        & (edge(0, F.array_min) <= east)
        & (edge(1, F.array_max) >= south)
        & (edge(1, F.array_min) <= north)
    )
    return near.select(
        F.concat_ws("-", "_f", "_p").alias("part"), F.posexplode("_line").alias("i", "_v")
    ).select("part", "i", F.col("_v")[1].alias("lat"), F.col("_v")[0].alias("lon"))


def read_water_level(spark: SparkSession, paths: str | Sequence[str], gauge: str = "gauge") -> DataFrame:
    """Water-level payloads (`data: [{t, v}]`); unreadable levels become null, the gauge is in the name of the file or of a folder."""
    raw = spark.read.schema("data array<struct<t: string, v: string>>").json(
        paths if isinstance(paths, str) else list(paths), multiLine=True
    )
    raw = raw.select("data", F.input_file_name().alias("_path"))
    folder = F.regexp_extract_all("_path", F.lit(rf"{gauge}=([^/]+)/"), 1)
    name = F.coalesce(F.try_element_at(folder, F.lit(-1)), F.regexp_extract(F.element_at(F.split("_path", "/"), -1), r"^([^_.]+)", 1))
    rows = raw.select(name.alias(gauge), F.explode("data").alias("_d"))
    return rows.select(
        gauge, F.try_to_timestamp("_d.t").alias("ts"), F.col("_d.v").try_cast("double").alias("water_level_m")
    ).where(F.col("ts").isNotNull())


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV where the path is one or the Parquet copy cannot be read."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    try:
        return spark.read.parquet(path)
    except Exception:
        return spark.read.csv(path.removesuffix(".parquet") + ".csv", header=True, inferSchema=True)
