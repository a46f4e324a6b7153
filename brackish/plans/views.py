"""Stand-in views: the star-schema test tables seen as flux, satellite, tide and pixel records.

Every view exists twice with the same arithmetic, as a DataFrame and as a
common table expression for the SQL twin. Views use whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brackish.operators import blocks

# name -> (views it reads, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        "SELECT event_type AS site, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS slot, avg(value) AS v, "
        "min(event_id) AS k FROM events GROUP BY 1, 2",
    ),
    "flux_hh": (
        ("ev",),
        "SELECT g.site, g.slot, CAST(DATE '1970-01-01' + CAST(g.slot // 48 AS INTEGER) AS DATE) AS date, "
        "CAST((g.slot % 48) // 2 AS INTEGER) AS hour, "
        "2 * v AS LE, CAST(k % 97 AS DOUBLE) AS H, 3 * v + CASE WHEN k % 13 = 0 THEN 600.0 ELSE 0.0 END AS NETRAD, "
        "CASE WHEN k % 3 <> 0 THEN CAST(k % 11 AS DOUBLE) END AS G, CAST(10 + k % 20 AS DOUBLE) AS TA, "
        "CASE WHEN k % 7 <> 0 THEN (k % 50) / 100.0 END AS USTAR, CASE WHEN k % 5 <> 0 THEN k % 3 END AS QC "
        "FROM (SELECT site, unnest(generate_series(min(slot) // 48 * 48, max(slot) // 48 * 48 + 47)) AS slot "
        "FROM ev GROUP BY site) g LEFT JOIN ev USING (site, slot)",
    ),
    "gated": (
        ("flux_hh",),
        "SELECT *, CASE WHEN LE_ustar BETWEEN -100 AND 800 THEN LE_ustar END AS LE_qc FROM ("
        "SELECT *, CASE WHEN USTAR IS NULL OR USTAR >= 0.1 THEN LE_flag END AS LE_ustar FROM ("
        "SELECT *, CASE WHEN QC IS NULL OR QC IN (0, 1) THEN LE END AS LE_flag FROM flux_hh))",
    ),
    "balance": (
        ("gated",),
        "SELECT *, NETRAD - coalesce(G, 0) AS av, H + LE_qc AS tb, "
        "coalesce(NETRAD - coalesce(G, 0) > 20 AND H + LE_qc > 20, false) AS ok FROM gated",
    ),
    "closed": (
        ("balance",),
        "SELECT *, CASE WHEN ok AND abs(cand / nullif(LE_qc, 0)) <= 2 THEN cand ELSE LE_qc END AS LE_closed, "
        "(2.501 - 0.00237 * TA) * 1e6 AS lam FROM ("
        "SELECT *, LE_qc + (av - tb) * LE_qc / nullif(tb, 0) AS cand FROM balance)",
    ),
    "et_daily": (
        (),
        "SELECT 'S' || lpad(CAST(o_custkey % 64 AS VARCHAR), 2, '0') AS site, CAST(o_orderdate AS DATE) AS date, "
        "avg(o_orderkey % 800) / 100 AS ET FROM orders GROUP BY 1, 2",
    ),
    "et_dense": (
        ("et_daily",),
        "SELECT g.site, g.date, e.ET FROM (SELECT site, CAST(unnest(generate_series(min(date), max(date), "
        "INTERVAL 1 DAY)) AS DATE) AS date FROM et_daily GROUP BY site) g LEFT JOIN et_daily e USING (site, date)",
    ),
    "met_daily": (
        ("et_dense",),
        "SELECT site, date, 285.0 + q % 15 AS tmmx, 277.0 + q % 15 - q % 4 AS tmmn, 80.0 + q % 20 AS rmax, "
        "30.0 + q % 30 AS rmin, 1.0 + q % 6 AS vs, 100.0 + q % 200 AS srad, 2.0 + q % 6 AS etr, "
        "CAST(q % 6 AS DOUBLE) AS pet, CAST(q % 9 AS DOUBLE) AS pr FROM ("
        "SELECT site, date, dayofyear(date) + CAST(substr(site, 2) AS INTEGER) AS q FROM et_dense)",
    ),
    "sat_obs": (
        (),
        "SELECT 'S' || lpad(CAST(l_suppkey % 64 AS VARCHAR), 2, '0') AS site, CAST(l_shipdate AS DATE) AS date, "
        "l_orderkey, l_linenumber, 280 + l_quantity / 2 AS LST_K, l_discount * 8 AS NDVI, l_tax * 10 - 0.4 AS MNDWI "
        "FROM lineitem",
    ),
    "sat_daily": (
        ("sat_obs",),
        "SELECT site, date, avg(LST_K) AS LST_K, avg(NDVI) AS NDVI, avg(MNDWI) AS MNDWI FROM sat_obs GROUP BY 1, 2",
    ),
    "sat2_daily": (
        (),
        "SELECT 'S' || lpad(CAST(l_partkey % 64 AS VARCHAR), 2, '0') AS site, CAST(l_shipdate AS DATE) AS date, "
        "avg(0.1 + 0.9 * l_discount * 8 + (l_orderkey % 7) / 50.0) AS NDVI2 FROM lineitem GROUP BY 1, 2",
    ),
    "sat3_daily": (
        (),
        "SELECT 'S' || lpad(CAST(l_suppkey % 64 AS VARCHAR), 2, '0') AS site, CAST(l_shipdate AS DATE) AS date, "
        "avg(0.1 + 0.9 * l_discount * 8 + (l_orderkey % 7) / 50.0) AS NDVI2 FROM lineitem GROUP BY 1, 2",
    ),
    "samples": (
        (),
        "SELECT *, x1 + 10 * x4 + (l_orderkey % 7) / 10.0 AS x5, 0.05 * x1 + x2 + (l_orderkey % 100) / 100.0 AS y FROM ("
        "SELECT 'P' || CAST(l_suppkey % 13 AS VARCHAR) AS site, CAST(l_shipdate AS DATE) AS date, "
        "CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x1, "
        "l_extendedprice / 30000 AS x2, l_discount AS x3, l_tax AS x4 FROM lineitem)",
    ),
    "monthly": (
        ("samples",),
        "SELECT site, CAST(date_trunc('month', date) AS DATE) AS month, CAST(min(year) AS INTEGER) AS year, avg(x1) AS x1, "
        "avg(x2) AS x2, avg(x3) AS x3, avg(x4) AS x4, avg(y) AS y, count(*) AS n FROM samples GROUP BY 1, 2",
    ),
    "pixels": (
        (),
        "SELECT site, scene, date, pos, (pos % 8 - 3.5e0) * 30 AS px_x, (pos // 8 - 3.5e0) * 30 AS px_y, "
        "0.05 + abs(e) AS red, 0.25 + e AS nir, 0.08 + abs(e) / 2 AS green, 0.15 - e / 4 AS swir, 290 + 20 * e AS LST, "
        "(scene * 7 + pos) % 64 AS qa, (scene + pos) % 12 AS scl, (pos % 5) / 10.0 AS w FROM ("
        "SELECT 'L' || CAST(label AS VARCHAR) AS site, vec_id AS scene, "
        "CAST(DATE '2024-01-01' + CAST(vec_id % 60 AS INTEGER) AS DATE) AS date, "
        "CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)",
    ),
    "clear": (
        ("pixels",),
        "SELECT site, scene, date, pos, px_x, px_y, w, "
        + ", ".join(f"CASE WHEN qa & 62 = 0 THEN {c} END AS {c}" for c in ("red", "nir", "green", "swir", "LST"))
        + " FROM pixels",
    ),
    "strict": (
        ("clear",),
        "SELECT *, CASE WHEN abs(a) <= 1 THEN a END AS NDVI, CASE WHEN abs(b) <= 1 THEN b END AS MNDWI FROM ("
        "SELECT *, CASE WHEN n + r > 0.02 THEN (n - r) / (n + r) END AS a, "
        "CASE WHEN g + s > 0.02 THEN (g - s) / (g + s) END AS b FROM ("
        "SELECT *, CASE WHEN red > 0 THEN red END AS r, CASE WHEN nir > 0 THEN nir END AS n, "
        "CASE WHEN green > 0 THEN green END AS g, CASE WHEN swir > 0 THEN swir END AS s FROM clear))",
    ),
    "tide": (
        (),
        "SELECT event_type AS site, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hr, avg(value) / 100 AS level "
        "FROM events GROUP BY 1, 2",
    ),
    "tide_hh": (
        ("tide",),
        "SELECT site, slot, CASE WHEN lv IS NOT NULL THEN lv "
        "WHEN slot - ps <= 3 AND nv IS NOT NULL THEN pv + (nv - pv) * (slot - ps) / (ns - ps) END AS level FROM ("
        "SELECT site, slot, lv, last_value(lv IGNORE NULLS) OVER p AS pv, "
        "last_value(CASE WHEN lv IS NOT NULL THEN slot END IGNORE NULLS) OVER p AS ps, "
        "first_value(lv IGNORE NULLS) OVER f AS nv, "
        "first_value(CASE WHEN lv IS NOT NULL THEN slot END IGNORE NULLS) OVER f AS ns FROM ("
        "SELECT g.site, g.slot, t.level AS lv FROM (SELECT site, unnest(generate_series(min(hr) * 2, max(hr) * 2)) AS slot "
        "FROM tide GROUP BY site) g LEFT JOIN tide t ON t.site = g.site AND t.hr * 2 = g.slot) "
        "WINDOW p AS (PARTITION BY site ORDER BY slot ROWS UNBOUNDED PRECEDING), "
        "f AS (PARTITION BY site ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    ),
    "geo_sites": (
        (),
        "SELECT c_custkey AS site, 25 + (c_custkey * 37 % 2000) / 100.0 AS lat, "
        "-(70 + (c_custkey * 53 % 5000) / 100.0) AS lon, c_mktsegment AS seg, c_nationkey AS nk FROM customer",
    ),
    "gauges": (
        (),
        "SELECT s_suppkey AS gauge, 25.005 + (s_suppkey * 91 % 2000) / 100.0 AS glat, "
        "-(70.003 + (s_suppkey * 113 % 5000) / 100.0) AS glon, s_nationkey AS nk FROM supplier",
    ),
    "coast": (
        (),
        "SELECT CAST(n_nationkey AS BIGINT) AS i, -(70.0 + 2 * n_nationkey) AS lon, "
        "25.0 + n_nationkey * 7 % 20 AS lat FROM nation",
    ),
    "site_dist": (
        ("geo_sites", "coast"),
        "SELECT site, seg, nk, min(sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2))) AS km FROM ("
        "SELECT *, greatest(least(-(ax * dx + ay * dy) / CASE WHEN dx * dx + dy * dy = 0 THEN 1e-12 "
        "ELSE dx * dx + dy * dy END, 1), 0) AS t FROM ("
        "SELECT s.site, s.seg, s.nk, (a.lon - s.lon) * cos(radians(s.lat)) * radians(1) * 6371.0088 AS ax, "
        "(a.lat - s.lat) * radians(1) * 6371.0088 AS ay, (b.lon - a.lon) * cos(radians(s.lat)) * radians(1) * 6371.0088 AS dx, "
        "(b.lat - a.lat) * radians(1) * 6371.0088 AS dy "
        "FROM geo_sites s CROSS JOIN coast a JOIN coast b ON b.i = a.i + 1)) GROUP BY 1, 2, 3",
    ),
    "flagged": (
        ("site_dist",),
        "SELECT site AS SITE_ID, km AS DIST_COAST_KM, nk < 12 AS COASTAL_STATE, "
        "seg IN ('BUILDING', 'MACHINERY') AS TIDAL_IGBP, (nk % 3 = 0 OR 2010 + nk >= 2020) AS ACTIVE, seg AS IGBP FROM site_dist",
    ),
    "edges": (
        (),
        "SELECT CAST(n_regionkey AS BIGINT) AS region, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, "
        "coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ("
        "SELECT n_regionkey, n_nationkey, n_nationkey * 37 % 240 - 120e0 AS x, n_nationkey * 53 % 240 - 120e0 AS y FROM nation) "
        "WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)",
    ),
    "inside": (
        ("edges",),
        "SELECT region, pos FROM (SELECT (pos % 8 - 3.5e0) * 30 AS px_x, (pos // 8 - 3.5e0) * 30 AS px_y, pos "
        "FROM range(64) t(pos)) p CROSS JOIN edges GROUP BY region, pos HAVING "
        "sum(CASE WHEN (y1 > px_y) <> (y2 > px_y) AND px_x < (x2 - x1) * (px_y - y1) / nullif(y2 - y1, 0) + x1 "
        "THEN 1 ELSE 0 END) % 2 = 1",
    ),
}


def with_views(body: str) -> str:
    """Prefix the views a query names, in dependency order."""
    import re

    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for word in re.findall(r"[a-z_0-9]+", body):
        if word in CTES:
            add(word)
    if not order:
        return body
    views = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body.lstrip()[15:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {views},\n{body.lstrip()[5:]}"
    return f"WITH {views}\n{body}"


def site_code(key: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad((key % 64).cast("string"), 2, "0"))


class Views:
    """The views as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def flux_hh(self) -> DataFrame:
        seen = self.events.groupBy(F.col("event_type").alias("site"), blocks.step_slot("ts", 1800).alias("slot")).agg(
            F.avg("value").alias("v"), F.min("event_id").alias("k")
        )
        day = F.floor(F.col("slot") / 48) * 48
        edges = seen.groupBy("site").agg(F.min(day).alias("lo"), (F.max(day) + 47).alias("hi"))
        edges = edges.select("site", F.explode(F.array("lo", "hi")).alias("slot"))
        grid = blocks.densify(seen.unionByName(edges, allowMissingColumns=True), ["site"], "slot")
        k, v = F.col("k"), F.col("v")
        return grid.select(
            "site",
            "slot",
            blocks.step_time(F.col("slot"), 1800).alias("ts"),
            F.date_from_unix_date(F.floor(F.col("slot") / 48).cast("int")).alias("date"),
            F.floor(F.pmod(F.col("slot"), F.lit(48)) / 2).cast("int").alias("hour"),
            (v * 2).alias("LE"),
            (k % 97).cast("double").alias("H"),
            (v * 3 + F.when(k % 13 == 0, 600.0).otherwise(0.0)).alias("NETRAD"),
            F.when(k % 3 != 0, (k % 11).cast("double")).alias("G"),
            (k % 20 + 10).cast("double").alias("TA"),
            F.when(k % 7 != 0, k % 50 / 100.0).alias("USTAR"),
            F.when(k % 5 != 0, k % 3).alias("QC"),
        )

    @cached_property
    def et_daily(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy(site_code(F.col("o_custkey")).alias("site"), F.col("o_orderdate").cast("date").alias("date"))
            .agg((F.avg(F.col("o_orderkey") % 800) / 100).alias("ET"))
        )

    @cached_property
    def met_daily(self) -> DataFrame:
        from brackish.operators.series import dense_daily

        q = F.dayofyear("date") + F.substring("site", 2, 2).cast("int")
        days = dense_daily(self.et_daily, ["site"]).select("site", "date", q.alias("q"))
        return days.select(
            "site",
            "date",
            (F.lit(285.0) + F.col("q") % 15).alias("tmmx"),
            (F.lit(277.0) + F.col("q") % 15 - F.col("q") % 4).alias("tmmn"),
            (F.lit(80.0) + F.col("q") % 20).alias("rmax"),
            (F.lit(30.0) + F.col("q") % 30).alias("rmin"),
            (F.lit(1.0) + F.col("q") % 6).alias("vs"),
            (F.lit(100.0) + F.col("q") % 200).alias("srad"),
            (F.lit(2.0) + F.col("q") % 6).alias("etr"),
            (F.col("q") % 6).cast("double").alias("pet"),
            (F.col("q") % 9).cast("double").alias("pr"),
        )

    @cached_property
    def sat_obs(self) -> DataFrame:
        return self.table("lineitem").select(
            site_code(F.col("l_suppkey")).alias("site"),
            F.col("l_shipdate").cast("date").alias("date"),
            "l_orderkey",
            "l_linenumber",
            (F.col("l_quantity") / 2 + 280).alias("LST_K"),
            (F.col("l_discount") * 8).alias("NDVI"),
            (F.col("l_tax") * 10 - 0.4).alias("MNDWI"),
        )

    @cached_property
    def sat_daily(self) -> DataFrame:
        return self.sat_obs.groupBy("site", "date").agg(*[F.avg(c).alias(c) for c in ("LST_K", "NDVI", "MNDWI")])

    def _second_sensor(self, key: str) -> DataFrame:
        value = F.lit(0.1) + F.col("l_discount") * 8 * 0.9 + F.col("l_orderkey") % 7 / 50.0
        return (
            self.table("lineitem")
            .groupBy(site_code(F.col(key)).alias("site"), F.col("l_shipdate").cast("date").alias("date"))
            .agg(F.avg(value).alias("NDVI2"))
        )

    @cached_property
    def sat2_daily(self) -> DataFrame:
        return self._second_sensor("l_partkey")

    @cached_property
    def sat3_daily(self) -> DataFrame:
        return self._second_sensor("l_suppkey")

    @cached_property
    def samples(self) -> DataFrame:
        rows = self.table("lineitem").select(
            F.concat(F.lit("P"), (F.col("l_suppkey") % 13).cast("string")).alias("site"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.year("l_shipdate").alias("year"),
            "l_orderkey",
            "l_linenumber",
            F.col("l_quantity").cast("double").alias("x1"),
            (F.col("l_extendedprice") / 30000).alias("x2"),
            F.col("l_discount").alias("x3"),
            F.col("l_tax").alias("x4"),
        )
        return rows.withColumn("x5", F.col("x1") + F.col("x4") * 10 + F.col("l_orderkey") % 7 / 10.0).withColumn(
            "y", F.col("x1") * 0.05 + F.col("x2") + F.col("l_orderkey") % 100 / 100.0
        )

    @cached_property
    def monthly(self) -> DataFrame:
        return (
            self.samples.groupBy("site", F.trunc("date", "month").alias("month"))
            .agg(
                F.min("year").alias("year"),
                *[F.avg(c).alias(c) for c in ("x1", "x2", "x3", "x4", "y")],
                F.count(F.lit(1)).alias("n"),
            )
        )

    @cached_property
    def pixels(self) -> DataFrame:
        rows = self.table("embeddings").select(
            F.concat(F.lit("L"), F.col("label").cast("string")).alias("site"),
            F.col("vec_id").alias("scene"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 60).cast("int")).alias("date"),
            F.posexplode("embedding").alias("pos", "e"),
        )
        e, pos = F.col("e").cast("double"), F.col("pos").cast("long")
        return rows.select(
            "site",
            "scene",
            "date",
            pos.alias("pos"),
            ((pos % 8 - 3.5) * 30).alias("px_x"),
            ((F.floor(pos / 8) - 3.5) * 30).alias("px_y"),
            (F.abs(e) + 0.05).alias("red"),
            (e + 0.25).alias("nir"),
            (F.abs(e) / 2 + 0.08).alias("green"),
            (F.lit(0.15) - e / 4).alias("swir"),
            (e * 20 + 290).alias("LST"),
            ((F.col("scene") * 7 + pos) % 64).alias("qa"),
            ((F.col("scene") + pos) % 12).alias("scl"),
            (pos % 5 / 10.0).alias("w"),
        )

    @cached_property
    def clear(self) -> DataFrame:
        from brackish.operators.pixels import clear_pixels

        return clear_pixels(self.pixels, ["red", "nir", "green", "swir", "LST"])

    @cached_property
    def strict(self) -> DataFrame:
        from brackish.operators.pixels import with_indices

        return with_indices(self.clear)

    @cached_property
    def tide(self) -> DataFrame:
        hours = self.events.groupBy(F.col("event_type").alias("site"), blocks.step_slot("ts", 3600).alias("hr"))
        return hours.agg((F.avg("value") / 100).alias("level")).select(
            "site", "hr", blocks.step_time(F.col("hr"), 3600).alias("ts"), "level"
        )

    @cached_property
    def geo_sites(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("site"),
            (key * 37 % 2000 / 100.0 + 25).alias("lat"),
            (-(key * 53 % 5000 / 100.0 + 70)).alias("lon"),
            F.col("c_mktsegment").alias("seg"),
            F.col("c_nationkey").alias("nk"),
        )

    @cached_property
    def gauges(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("gauge"),
            (key * 91 % 2000 / 100.0 + 25.005).alias("glat"),
            (-(key * 113 % 5000 / 100.0 + 70.003)).alias("glon"),
            F.col("s_nationkey").alias("nk"),
        )

    @cached_property
    def coast(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            F.lit(1).alias("line"),
            key.cast("long").alias("i"),
            (-(key * 2 + 70)).cast("double").alias("lon"),
            (key * 7 % 20 + 25).cast("double").alias("lat"),
        )

    @cached_property
    def site_dist(self) -> DataFrame:
        from brackish.operators.joins import distance_to_lines_km, segments

        return distance_to_lines_km(self.geo_sites, segments(self.coast, ["line"], "i"), "lat", "lon")

    @cached_property
    def flagged(self) -> DataFrame:
        from brackish.operators.catalog import site_flags

        end = F.when(F.col("nk") % 3 == 0, "").otherwise((F.col("nk") + 2010).cast("string"))
        rows = self.site_dist.select(
            F.col("site").alias("SITE_ID"),
            F.col("dist_km").alias("DIST_COAST_KM"),
            F.col("nk").cast("string").alias("STATE"),
            F.col("seg").alias("IGBP"),
            end.alias("TOWER_END"),
        )
        return site_flags(rows, [str(i) for i in range(12)], ["BUILDING", "MACHINERY"])

    @cached_property
    def edges(self) -> DataFrame:
        key = F.col("n_nationkey")
        corners = self.table("nation").select(
            F.col("n_regionkey").cast("long").alias("region"),
            key,
            (key * 37 % 240 - 120).cast("double").alias("x1"),
            (key * 53 % 240 - 120).cast("double").alias("y1"),
        )
        ring = Window.partitionBy("region").orderBy("n_nationkey")
        return corners.select(
            "region",
            "x1",
            "y1",
            F.coalesce(F.lead("x1").over(ring), F.first("x1").over(ring)).alias("x2"),
            F.coalesce(F.lead("y1").over(ring), F.first("y1").over(ring)).alias("y2"),
        )
