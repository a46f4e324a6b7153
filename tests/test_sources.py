"""Readers on files written here, and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from brackish.sources import readers, sinks

UTC_HOUR = dt.datetime(2020, 1, 1, 0, 0)


def test_base_files_with_different_names(spark, tmp_path):
    a, b = tmp_path / "AMF_US-Aaa_BASE_HH_1.csv", tmp_path / "AMF_US-Bbb_BASE_HH_1.csv"
    a.write_text("# Site: US-Aaa\n# Version: 1\nTIMESTAMP_START,TIMESTAMP_END,LE_1_1_1,LE_SSITC_TEST,H\n202001010000,202001010030,-9999,0,5\n202001010030,202001010100,12.5,2,-9999\n")
    b.write_text("# Site: US-Bbb\n# Version: 1\nTIMESTAMP_START,LE_PI_F,WTD,TA_2_1_1\n202001010000,7,-0.2,21\n")
    rows = readers.read_flux_base(spark, [str(a), str(b)]).orderBy("site", "ts").collect()
    assert [(r["site"], r["ts"], r["LE"], r["H"], r["QC"], r["WTD"], r["TA"]) for r in rows] == [
        ("US-Aaa", UTC_HOUR, None, 5.0, 0.0, None, None),
        ("US-Aaa", UTC_HOUR + dt.timedelta(minutes=30), 12.5, None, 2.0, None, None),
        ("US-Bbb", UTC_HOUR, 7.0, None, None, -0.2, 21.0),
    ]


def test_daily_and_halfhourly_products(spark, tmp_path):
    d = tmp_path / "AMF_US-Ccc_FLUXMET_DD.csv"
    d.write_text("TIMESTAMP,LE_F_MDS,LE_CORR,TA_F,EXTRA\n20200101,50,-9999,20,x\n20200102,60,70,21,y\n")
    rows = readers.read_flux_daily(spark, str(d)).orderBy("date").collect()
    assert [(r["site"], r["date"], r["LE_CORR"], r["NETRAD"]) for r in rows] == [("US-Ccc", dt.date(2020, 1, 1), None, None), ("US-Ccc", dt.date(2020, 1, 2), 70.0, None)]
    e = tmp_path / "AMF_US-Cdd_FLUXMET_DD.csv"
    e.write_text('"TIMESTAMP","NETRAD","LE_F_MDS"\n20200101,100,5\n')
    both = {r["site"]: r for r in readers.read_flux_daily(spark, [str(d), str(e)]).where("date = '2020-01-01'").collect()}
    assert (both["US-Ccc"]["LE_F_MDS"], both["US-Cdd"]["LE_F_MDS"], both["US-Cdd"]["NETRAD"]) == (50.0, 5.0, 100.0)
    h = tmp_path / "AMF_US-Ccc_FLUXMET_HH.csv"
    h.write_text("TIMESTAMP_START,LE_F_MDS,H_F_MDS\n202001010030,1,2\n")
    assert readers.read_flux_hh(spark, str(h)).first()["ts"] == dt.datetime(2020, 1, 1, 0, 30)


def test_daily_met_from_either_source(spark, tmp_path):
    e = tmp_path / "US-Ddd_ERA.csv"
    e.write_text("TIMESTAMP,TA_ERA,VPD_ERA\n20200101,20,5\n")
    assert readers.read_met_daily(spark, str(e)).first()["VPD_ERA"] == 5.0
    grid = spark.createDataFrame([("a", dt.date(2020, 1, 1), 20.0, 0.5)], "site string, date date, TA_C double, VPD_kPa double")
    grid.write.parquet(str(tmp_path / "grid"))
    row = readers.read_met_daily(spark, None, str(tmp_path / "grid")).first()
    assert (row["TA_ERA"], row["VPD_ERA"], row["WS_ERA"]) == (20.0, 5.0, None)


def test_hourly_met_bad_dates_duplicates_and_dead_sites(spark, tmp_path):
    f = tmp_path / "met_US-Eee_2020.csv"
    f.write_text("date,temperature_2m,dewpoint_temperature_2m,total_precipitation_hourly\n2020-01-01 00:00:00,293.15,283.15,0.001\n2020-01-01 00:00:00,293.15,283.15,0.001\nnonsense,1,1,1\n2020-01-01 01:00:00,295.15,,0.002\n")
    g = tmp_path / "met_US-Fff_2020.csv"
    g.write_text("date,temperature_2m,dewpoint_temperature_2m,total_precipitation_hourly\n2020-01-01 00:00:00,,,0.001\n")
    hourly = readers.read_met_hourly(spark, [str(f), str(g)])
    assert hourly.count() == 3
    day = readers.hourly_to_daily_met(hourly).collect()
    assert len(day) == 1 and day[0]["TA_ERA"] == pytest.approx(21.0) and day[0]["P_ERA"] == pytest.approx(3.0) and day[0]["WS_ERA"] is None
    other = tmp_path / "met_US-Ggg.csv"
    other.write_text("when,x\n1,2\n")
    assert readers.read_met_hourly(spark, str(other)).count() == 0


def test_site_catalog_null_safe(spark, tmp_path):
    path = tmp_path / "sites.json"
    path.write_text(json.dumps([
        {"SITE_ID": "US-A", "COUNTRY": "USA", "STATE": "FL", "GRP_LOCATION": {"LOCATION_LAT": "25.5", "LOCATION_LONG": "-80.5"}, "TOWER_END": "2019"},
        {"SITE_ID": "US-B", "COUNTRY": "USA", "GRP_LOCATION": None},
        {"SITE_ID": "CA-C", "COUNTRY": "Canada", "GRP_LOCATION": {"LOCATION_LAT": "50", "LOCATION_LONG": "-100"}},
    ]))
    rows = readers.read_site_catalog(spark, str(path)).collect()
    assert [(r["SITE_ID"], r["LAT"], r["KOEPPEN"], r["TOWER_END"]) for r in rows] == [("US-A", 25.5, "", "2019")]


def test_coastline_parts(spark, tmp_path):
    path = tmp_path / "coast.geojson"
    feature = lambda kind, xy: {"type": "Feature", "geometry": {"type": kind, "coordinates": xy}}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature("LineString", [[-80.0, 25.0], [-81.0, 26.0], [-82.0, 26.5]]),
        feature("MultiLineString", [[[-70.0, 40.0], [-71.0, 41.0]], [[-80.5, 25.5]], [[10.0, 10.0], [11.0, 11.0]]]),
        feature("Point", [1.0, 2.0]),
    ]}))
    rows = readers.read_coastline(spark, str(path), (-90.0, 20.0, -65.0, 45.0)).orderBy("part", "i").collect()
    assert [(r["i"], r["lat"], r["lon"]) for r in rows] == [(0, 25.0, -80.0), (1, 26.0, -81.0), (2, 26.5, -82.0), (0, 40.0, -70.0), (1, 41.0, -71.0)]


def test_water_level(spark, tmp_path):
    path = tmp_path / "8720001_2020.json"
    path.write_text(json.dumps({"data": [{"t": "2020-01-01 00:00", "v": "0.5"}, {"t": "2020-01-01 01:00", "v": ""}]}))
    rows = readers.read_water_level(spark, str(path)).orderBy("ts").collect()
    assert [(r["gauge"], r["ts"], r["water_level_m"]) for r in rows] == [("8720001", UTC_HOUR, 0.5), ("8720001", UTC_HOUR + dt.timedelta(hours=1), None)]


def test_csv_fallback(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert readers.read_any(spark, str(tmp_path / "t.csv")).first()["b"] == 2
    assert readers.read_any(spark, str(tmp_path / "t.parquet")).first()["a"] == 1


def test_write_once_and_force(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("OVERWRITE", raising=False)
    path, df = str(tmp_path / "out"), spark.range(3)
    assert sinks.write_once(df, path)
    assert not sinks.write_once(spark.range(5), path) and spark.read.parquet(path).count() == 3
    assert sinks.write_once(spark.range(5), path, force=True) and spark.read.parquet(path).count() == 5
    monkeypatch.setenv("OVERWRITE", "1")
    assert sinks.needs_write(spark, path)


def test_pixel_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "px")
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 2), 2.0)]
    sinks.write_pixels(spark.createDataFrame(rows, "site string, date date, x double"), path)
    sinks.write_pixels(spark.createDataFrame([("a", dt.date(2020, 1, 2), 9.0)], "site string, date date, x double"), path)
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1.0, 9.0]


def test_other_sinks(spark, tmp_path):
    df = spark.range(2).withColumn("site", F.lit("a"))
    for kind in ("csv", "json", "parquet"):
        sinks.write_result(df, str(tmp_path / kind), kind)
    assert readers.read_any(spark, str(tmp_path / "parquet")).count() == 2
    sinks.write_sites(df, str(tmp_path / "sites"))
    assert readers.read_sites(spark, str(tmp_path / "sites")).where("site = 'a'").count() == 2
    sinks.write_metadata(spark, {"n": 1}, str(tmp_path / "meta"))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first()[0]) == {"n": 1}
