"""Queries on sources and sinks: rows are landed in the shared folder in the format of a source and read back."""

import uuid

from pyspark.sql import functions as F

from brackish.plans.registry import query, r, rsql
from brackish.session import work_folder
from brackish.sources import readers, sinks

SITE = "'US-S' || lpad(CAST(o_custkey % 64 AS VARCHAR), 2, '0')"
HALF_HOURS = f"""hh AS (SELECT {SITE} AS site, o_custkey % 2 AS kind, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 48) * INTERVAL 30 MINUTE AS ts,
    min(o_orderkey % 800) / 100.0 AS a, CAST(max(o_orderkey % 97) AS DOUBLE) AS b FROM orders GROUP BY 1, 2, 3)"""
DAYS = f"""dd AS (SELECT {SITE} AS site, o_custkey % 2 AS kind, CAST(o_orderdate AS DATE) AS date,
    min(o_orderkey % 800) / 100.0 AS a, CAST(max(o_orderkey % 97) AS DOUBLE) AS b FROM orders GROUP BY 1, 2, 3)"""
SITE_ROWS = f"SELECT {SITE} AS site, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1"


def rows_by(v, when, name):
    site = F.concat(F.lit("US-S"), F.lpad((F.col("o_custkey") % 64).cast("string"), 2, "0"))
    key = F.col("o_orderkey")
    grouped = v.table("orders").groupBy(site.alias("site"), (F.col("o_custkey") % 2).alias("kind"), when.alias(name))
    return grouped.agg((F.min(key % 800) / 100.0).alias("a"), F.max(key % 97).cast("double").alias("b"))


def half_hours(v):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 48 * 1800
    return rows_by(v, F.timestamp_seconds(seconds), "ts")


def days(v):
    return rows_by(v, F.col("o_orderdate").cast("date"), "date")


def new_folder(v):
    return f"{work_folder(v.spark)}/landed-{uuid.uuid4().hex}"


def land(v, *layouts):
    """Each layout as delimited files with a header of its own, one folder a site."""
    folder = new_folder(v)
    for i, rows in enumerate(layouts):
        rows.write.partitionBy("site").csv(f"{folder}/layout{i}", header=True)
    return [f"{folder}/layout{i}/*" for i in range(len(layouts))]


def gap(c):
    """Every fifth value missing, as landed files mark it."""
    return F.when(F.col(c) % 5 == 0, -9999.0).otherwise(F.col(c))


@query("s1_flux_base", f"WITH {HALF_HOURS} SELECT site, epoch(ts)::BIGINT AS seconds, {rsql('a', 'LE')}, CASE WHEN kind = 0 AND b % 5 <> 0 THEN b END AS H, CASE WHEN kind = 1 AND b % 5 <> 0 THEN b END AS WTD FROM hh")
def _(v):
    stamp = F.date_format("ts", "yyyyMMddHHmm")
    one = half_hours(v).where("kind = 0").select("site", stamp.alias("TIMESTAMP_START"), F.col("a").alias("LE_1_1_1"), gap("b").alias("H"))
    two = half_hours(v).where("kind = 1").select("site", gap("b").alias("WTD"), F.col("a").alias("LE_PI_F"), stamp.alias("TIMESTAMP_START"))
    out = readers.read_flux_base(v.spark, land(v, one, two))
    return out.select("site", F.unix_timestamp("ts").alias("seconds"), r("LE"), "H", "WTD")


@query("s2_flux_daily", f"WITH {DAYS} SELECT site, date, {rsql('a', 'LE_F_MDS')}, CASE WHEN kind = 0 AND b % 5 <> 0 THEN b END AS NETRAD, CASE WHEN kind = 1 THEN b END AS TA_F FROM dd")
def _(v):
    stamp = F.date_format("date", "yyyyMMdd")
    one = days(v).where("kind = 0").select("site", stamp.alias("TIMESTAMP"), F.col("a").alias("LE_F_MDS"), gap("b").alias("NETRAD"))
    two = days(v).where("kind = 1").select("site", F.col("b").alias("TA_F"), stamp.alias("TIMESTAMP"), F.lit("x").alias("OTHER"), F.col("a").alias("LE_F_MDS"))
    return readers.read_flux_daily(v.spark, land(v, one, two)).select("site", "date", r("LE_F_MDS"), "NETRAD", "TA_F")


@query("s3_flux_half_hourly", f"WITH {HALF_HOURS} SELECT site, epoch(ts)::BIGINT AS seconds, {rsql('a', 'LE_F_MDS')}, b AS H_F_MDS FROM hh")
def _(v):
    rows = half_hours(v).select("site", F.date_format("ts", "yyyyMMddHHmm").alias("TIMESTAMP_START"), F.col("b").alias("H_F_MDS"), F.col("a").alias("LE_F_MDS"))
    out = readers.read_flux_hh(v.spark, land(v, rows))
    return out.select("site", F.unix_timestamp("ts").alias("seconds"), r("LE_F_MDS"), "H_F_MDS")


@query("s4_met_by_site", f"WITH {DAYS} SELECT site, date, {rsql('CASE WHEN kind = 0 THEN a ELSE a + 1 END', 'TA_ERA')}, {rsql('CASE WHEN kind = 0 THEN b ELSE b * 10 END', 'VPD_ERA')} FROM dd")
def _(v):
    reanalysis = days(v).where("kind = 0").select("site", F.date_format("date", "yyyyMMdd").alias("TIMESTAMP"), F.col("a").alias("TA_ERA"), F.col("b").alias("VPD_ERA"))
    grid = new_folder(v)
    days(v).select("site", "date", (F.col("a") + 1).alias("TA_C"), F.col("b").alias("VPD_kPa")).write.parquet(grid)
    out = readers.met_by_site(readers.read_met_daily(v.spark, land(v, reanalysis)), readers.read_met_daily(v.spark, None, grid))
    return out.select("site", "date", r("TA_ERA"), r("VPD_ERA"))


@query("s5_met_hourly", f"WITH {HALF_HOURS} SELECT site, epoch(ts)::BIGINT AS seconds, {rsql('a', 'temperature_2m')} FROM hh")
def _(v):
    rows = half_hours(v).select("site", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("a").alias("temperature_2m"))
    bad = rows.withColumn("date", F.lit("nonsense"))
    out = readers.read_met_hourly(v.spark, land(v, rows.unionByName(bad), rows))  # repeated hours and rows without a date
    return out.select("site", F.unix_timestamp("ts").alias("seconds"), r("temperature_2m"))


def keyed(v):
    site = F.concat(F.lit("US-S"), F.lpad((F.col("o_custkey") % 64).cast("string"), 2, "0"))
    return v.table("orders").select(site.alias("site"), F.col("o_orderkey").alias("key"))


def counted(rows):
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query("s6_site_folders", SITE_ROWS)
def _(v):
    folder = new_folder(v)
    sinks.write_sites(keyed(v), folder)
    return counted(readers.read_sites(v.spark, folder))


@query("s9_water_level", "SELECT 'G' || CAST(o_custkey % 5 AS VARCHAR) AS gauge, count(*) AS n, count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END) AS levels, sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 800 END)::BIGINT AS total FROM orders GROUP BY 1")
def _(v):
    folder = new_folder(v)
    level = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_orderkey") % 800).cast("string"))
    reading = F.struct(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm").alias("t"), level.alias("v"))
    gauge = F.concat(F.lit("G"), (F.col("o_custkey") % 5).cast("string"))
    # a payload holds what one gauge sent in a month
    sent = v.table("orders").groupBy(gauge.alias("gauge"), F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(F.collect_list(reading).alias("data"))
    sent.repartition("gauge", "month").write.partitionBy("gauge", "month").json(folder)
    out = readers.read_water_level(v.spark, f"{folder}/*/*")
    return out.groupBy("gauge").agg(F.count(F.lit(1)).alias("n"), F.count("water_level_m").alias("levels"), F.sum("water_level_m").cast("long").alias("total"))


@query("s11_results", " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({SITE_ROWS})" for k in ("parquet", "csv", "json")))
def _(v):
    folder, out = new_folder(v), None
    for kind in ("parquet", "csv", "json"):
        sinks.write_result(keyed(v), f"{folder}/{kind}", kind)
        read = v.spark.read.schema("site string, key bigint")
        rows = read.csv(f"{folder}/csv", header=True) if kind == "csv" else read.format(kind).load(f"{folder}/{kind}")
        rows = counted(rows).select(F.lit(kind).alias("kind"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s12_write_once", f"SELECT true AS first, false AS again, true AS forced, * FROM ({SITE_ROWS})")
def _(v):
    folder = new_folder(v)
    done = [sinks.write_once(keyed(v).limit(0), folder, False), sinks.write_once(keyed(v), folder, False), sinks.write_once(keyed(v), folder, True)]
    return counted(v.spark.read.parquet(folder)).select(*[F.lit(d).alias(n) for d, n in zip(done, ("first", "again", "forced"))], "site", "n", "keys")


@query("s13_parquet_or_csv", SITE_ROWS)
def _(v):
    folder = new_folder(v)
    sinks.write_result(keyed(v), f"{folder}/table.csv", "csv")  # the Parquet copy is not there
    return counted(readers.read_any(v.spark, f"{folder}/table.parquet"))
