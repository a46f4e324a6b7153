"""As-of, nearest, line-distance and polygon joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brackish.operators import footprint, fusion, joins, pixels
from brackish.operators.joins import EARTH_KM


def test_asof_tie_goes_to_the_earlier(spark):
    left = spark.createDataFrame([("a", 5), ("a", 11)], "site string, t long")
    right = spark.createDataFrame([("a", 4, 40.0), ("a", 6, 60.0), ("a", 8, 80.0)], "site string, t long, v double")
    out = joins.asof_nearest(left, right, ["site"], "t", 2, ["v"]).orderBy("t").collect()
    assert [(r["v"], r["t_match"]) for r in out] == [(40.0, 4), (None, None)]


def test_asof_brute_force_across_blocks(spark):
    rng = random.Random(4)
    left = [(s, t) for s in "ab" for t in rng.sample(range(-500, 2000), 300)]
    right = [(s, t, float(t * 10)) for s in "ab" for t in rng.sample(range(-500, 2000), 250)]
    out = joins.asof_nearest(
        spark.createDataFrame(left, "site string, t long"), spark.createDataFrame(right, "site string, t long, v double"), ["site"], "t", 3, ["v"]
    )
    got = {(r["site"], r["t"]): r["t_match"] for r in out.collect()}
    assert len(got) == len(left)
    twice = spark.createDataFrame(left + left, "site string, t long")
    again = joins.asof_nearest(twice, spark.createDataFrame(right, "site string, t long, v double"), ["site"], "t", 3, ["v"])
    assert again.count() == 2 * len(left) and again.distinct().exceptAll(out.select(again.columns)).count() == 0
    for s, t in left:
        near = [(abs(u - t), u) for z, u, _ in right if z == s and abs(u - t) <= 3]
        assert got[s, t] == (min(near)[1] if near else None)


def great_circle(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(h))


def test_nearest_place_everywhere_on_earth(spark):
    rng = random.Random(8)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)] + [(500, 10.0, 179.99), (501, 89.9, 0.0), (502, 10.0, 179.99)]
    cluster = [(i, 20 + rng.gauss(0, 0.01), 30 + rng.gauss(0, 0.01)) for i in range(60)]
    gauges = cluster + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(15)] + [(200, 10.0, -179.99), (201, 89.9, 180.0)]
    out = joins.nearest_place(
        spark.createDataFrame(spots, "site int, lat double, lon double"), spark.createDataFrame(gauges, "g int, gla double, glo double"), "lat", "lon", "g", "gla", "glo"
    ).collect()
    assert len(out) == len(spots)
    for r in out:
        best = min(great_circle((r["lat"], r["lon"]), (a, b)) for _, a, b in gauges)
        assert r["dist_km"] == pytest.approx(best, abs=1e-6)


def test_distance_to_lines_at_all_latitudes(spark):
    rng = random.Random(2)
    lines = [("l%d" % j, i, rng.uniform(-85, 85), rng.uniform(-170, 170)) for j in range(3) for i in range(4)]
    points = [(i, rng.uniform(-84, 84), rng.uniform(-170, 170)) for i in range(60)]
    pieces = joins.segments(spark.createDataFrame(lines, "line string, i int, lat double, lon double"), ["line"], "i")
    out = joins.distance_to_lines_km(spark.createDataFrame(points, "site int, lat double, lon double"), pieces, "lat", "lon").collect()
    k = math.pi / 180 * EARTH_KM

    def away(p, a, b):
        c = math.cos(math.radians(p[0]))
        ax, ay, bx, by = (a[1] - p[1]) * c * k, (a[0] - p[0]) * k, (b[1] - p[1]) * c * k, (b[0] - p[0]) * k
        dx, dy = bx - ax, by - ay
        t = min(1, max(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy or 1e-12)))
        return math.hypot(ax + t * dx, ay + t * dy)

    segs = [(lines[n][2:], lines[n + 1][2:]) for n in range(len(lines) - 1) if lines[n][0] == lines[n + 1][0]]
    for r in out:
        assert r["dist_km"] == pytest.approx(min(away((r["lat"], r["lon"]), *s) for s in segs), rel=1e-9)


def test_polygon_with_hole_shape(spark):
    ring = [(0, 0), (200, 0), (200, 200), (100, 100), (0, 200)]
    edges = [(1, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1])]
    spots = [(x + 0.5, y + 0.5) for x in range(-20, 240, 13) for y in range(-20, 240, 13)]
    out = joins.in_rings(
        spark.createDataFrame(spots, "px double, py double"), spark.createDataFrame(edges, "region int, x1 double, y1 double, x2 double, y2 double"), "region", "px", "py", row=7.0
    )
    got = {(r["px"], r["py"]) for r in out.collect()}

    def inside(x, y):
        odd = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                odd = not odd
        return odd

    assert got == {s for s in spots if inside(*s)}


def test_bilinear_is_exact_on_a_plane_and_zero_outside(spark):
    nodes = [("a", float(i * 10), float(j * 10), i + 10.0 * j) for i in range(3) for j in range(3)]
    spots = [("a", 0.0, 0.0), ("a", 5.0, 7.5), ("a", 20.0, 20.0), ("a", 20.1, 5.0), ("a", -0.1, 5.0), ("b", 5.0, 5.0)]
    out = joins.bilinear(
        spark.createDataFrame(spots, "site string, u double, v double"), spark.createDataFrame(nodes, "site string, x double, y double, w double"), ["site"], "u", "v", 10.0
    ).collect()
    got = {(r["site"], r["u"], r["v"]): r["fp_weight"] for r in out}
    assert got["a", 5.0, 7.5] == pytest.approx(8.0) and got["a", 20.0, 20.0] == 22.0 and got["a", 0.0, 0.0] == 0.0
    assert got["a", 20.1, 5.0] == 0 and got["a", -0.1, 5.0] == 0 and got["b", 5.0, 5.0] == 0


def test_calibration_rejects_weak_lines(spark):
    import datetime as dt

    rng = random.Random(1)
    rows = []
    for i in range(40):
        d, x = dt.date(2020, 1, 1) + dt.timedelta(days=3 * i), rng.random()
        rows += [("good", d, 0.1 + 0.9 * x, x), ("noise", d, rng.random(), rng.random()), ("flat", d, x, 0.5)]
        if i < 7:
            rows.append(("short", d, x, x))
    df = spark.createDataFrame(rows, "site string, date date, a double, b double")
    lines = fusion.calibrate(df.select("site", "date", "a"), df.select("site", "date", "b"), ["site"], "a", "b")
    got = {r["site"]: r for r in lines.collect()}
    assert got["good"]["accepted"] and got["good"]["slope"] == pytest.approx(0.9)
    assert not got["flat"]["accepted"] and not got["short"]["accepted"]
    assert got["noise"]["accepted"] == (abs(got["noise"]["r"]) >= 0.3)
    fused = fusion.fuse(df.select("site", "date", "a").where("day(date) > 15"), df.select("site", "date", "b"), lines, ["site"], "a", "b")
    assert fused.where("site = 'flat' AND a IS NULL AND fused IS NOT NULL").count() == 0
    assert fused.where("site = 'good' AND fused IS NULL").count() == 0


def test_weight_rules_and_empty_weight(spark):
    rows = [("a", 1.0, 2.0), ("a", None, 5.0), ("a", 3.0, 2.0), ("b", 1.0, 0.0), ("c", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "site string, x double, w double")
    for rule in ("drop", "zero"):
        got = {r["site"]: r["x"] for r in pixels.weighted_mean(df, ["site"], ["x"], "w", rule).collect()}
        assert got == {"a": 2.0, "b": None, "c": None}


def test_source_area_counts_ties_together(spark):
    rows = [("a", 4.0)] + [("a", 1.0)] * 6
    out = pixels.source_area(spark.createDataFrame(rows, "site string, w double"), ["site"], cell_m2=1e4).first()
    assert (out["area_50_ha"], out["area_80_ha"]) == (7.0, 7.0)
    assert out["level_50"] == pytest.approx(0.1)


def test_footprint_sums_to_one_and_lies_upwind(spark):
    rows = [("a", 0.4, 0.5, -100.0, 0.0, 3.0)] * 3
    df = spark.createDataFrame(rows, "site string, ustar double, sigmav double, obukhov double, wind_dir double, umean double")
    out = footprint.climatology(df, ["site"], F.lit(4.0), 200, 10)
    assert out.agg(F.sum("w")).first()[0] == pytest.approx(1.0)
    assert out.where("y < 0 AND w > 0").count() == 0


def test_asof_without_tolerance_matches_equal_times(spark):
    left = spark.createDataFrame([("a", 5), ("a", 6), ("a", None), ("b", 5)], "site string, t long")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 7, 70.0)], "site string, t long, v double")
    got = sorted((r["site"], r["t"] or -1, r["v"]) for r in joins.asof_nearest(left, right, ["site"], "t", 0, ["v"]).collect())
    assert got == [("a", -1, None), ("a", 5, 50.0), ("a", 6, None), ("b", 5, None)]


def test_equal_coordinates_of_two_zones_stay_apart(spark):
    ring = [(0, 0), (100, 0), (100, 100), (0, 100)]
    edges = [("z1", 1, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1])]
    pixels_ = spark.createDataFrame([("z1", "A", 50.0, 50.0), ("z2", "B", 50.0, 50.0)], "zone string, site string, px double, py double")
    out = joins.in_rings(pixels_, spark.createDataFrame(edges, "zone string, region int, x1 double, y1 double, x2 double, y2 double"), "region", "px", "py", keys=["zone"])
    assert [r["site"] for r in out.collect()] == ["A"]


def test_footprint_equals_the_full_product(spark):
    """Only the upwind strips are laid out; the sum is that of every half hour over every cell."""
    import math
    import random

    rng = random.Random(2)
    rows = [("a", rng.uniform(0.1, 0.6), rng.uniform(0.2, 0.9), rng.choice([-80.0, 300.0]), wd, rng.uniform(1, 5)) for wd in (0.0, 90.0, 180.0, 270.0, 360.0, 45.0, *[rng.uniform(0, 360) for _ in range(9)])]
    df = spark.createDataFrame(rows, "site string, ustar double, sigmav double, obukhov double, wind_dir double, umean double")
    got = {(r["x"], r["y"]): r["w"] for r in footprint.climatology(df, ["site"], F.lit(4.0), 300, 20).collect()}
    assert len(got) == 31 * 31

    def density(x, y, ustar, sigmav, obukhov, umean, zm=4.0, h=1000.0):
        profile, thin = umean / ustar * 0.4, 1 - zm / h
        xs = x / zm * thin / profile
        if xs <= footprint.D:
            return 0.0
        along = footprint.A * (xs - footprint.D) ** footprint.B * math.exp(-footprint.C / (xs - footprint.D)) / zm * thin / profile
        ps = min(1.0, abs(obukhov / zm) * 1e-5 + (0.8 if obukhov <= 0 else 0.55))
        sigma = footprint.AC * math.sqrt(footprint.BC * xs * xs / (1 + footprint.CC * xs)) / ps * zm * sigmav / ustar
        return along * math.exp(-y * y / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))

    full = {}
    for x, y in got:
        for _, ustar, sigmav, obukhov, wd, umean in rows:
            s, c = math.sin(math.radians(wd)), math.cos(math.radians(wd))
            full[x, y] = full.get((x, y), 0.0) + density(x * s + y * c, x * c - y * s, ustar, sigmav, obukhov, umean)
    total = sum(full.values())
    assert all(abs(got[k] - v / total) < 1e-13 for k, v in full.items())
