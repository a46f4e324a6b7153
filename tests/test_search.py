"""Nearest places, segments and polygons on hard layouts: clusters, poles, one long row of vertices."""

import math

import numpy as np
import pytest

from brackish.operators import joins


def arc(la, lo, lb, lp):
    a, b = math.radians(la), math.radians(lb)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * joins.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def flat(la, lo, lb, lp, scale=joins.KM_PER_DEGREE):
    return math.hypot((lb - la) * scale, (lp - lo) * scale * math.cos(math.radians(la)))


def places(rng, n):
    """A tight cluster with most targets, copies, and a few far away ones."""
    cluster = [(50 + rng.normal(0, 0.002), 8 + rng.normal(0, 0.002)) for _ in range(n)]
    return cluster + [cluster[0]] * 20 + [(89.9, 10.0), (-89.99, -170.0), (0.0, 179.99), (10.0, -60.0)]


@pytest.mark.parametrize("distance,dist", [("haversine", arc), ("local", flat)])
def test_nearest_place_of_a_cluster(spark, monkeypatch, distance, dist):
    rng = np.random.default_rng(5)
    targets = places(rng, 1500)
    points = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for _ in range(80)]
    points += [(50 + float(rng.normal(0, 0.01)), 8 + float(rng.normal(0, 0.01))) for _ in range(80)] + [(89.99, -170.0), (-90.0, 0.0), (0.0, -179.99)]
    counts = []
    write = joins.settle
    monkeypatch.setattr(joins, "settle", lambda df: (lambda out: (counts.append((set(out.columns), out.count())), out)[1])(write(df)))
    got = joins.nearest_place(
        spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, la double, lo double"),
        spark.createDataFrame([(f"t{i:05d}", *map(float, t)) for i, t in enumerate(targets)], "t string, tla double, tlo double"),
        "la", "lo", "t", "tla", "tlo", distance=distance,
    ).collect()
    assert len(got) == len(points)
    for r in got:
        best = min(dist(r.la, r.lo, *t) for t in targets)
        assert r.dist_km == pytest.approx(best, rel=1e-9, abs=1e-6)
        assert dist(r.la, r.lo, *targets[int(r.t[1:])]) == pytest.approx(best, rel=1e-9, abs=1e-6)
    filed = [n for c, n in counts if c == {"_o", "_cell", "_up"}]
    looked = [n for c, n in counts if c == {"_pid", "_u", "_cell", "_n"}]
    assert filed[0] <= 16 * (len(targets) - 20)  # once a level
    assert sum(looked) < 60 * len(points)  # cells, not targets


def to_segment(la, lo, y1, x1, y2, x2):
    k = math.pi / 180 * joins.EARTH_KM
    c = math.cos(math.radians(la))
    ax, ay, bx, by = (x1 - lo) * c * k, (y1 - la) * k, (x2 - lo) * c * k, (y2 - la) * k
    dx, dy = bx - ax, by - ay
    t = min(1, max(0, -(ax * dx + ay * dy) / ((dx * dx + dy * dy) or 1e-12)))
    return math.hypot(ax + t * dx, ay + t * dy)


def test_nearest_segment_at_all_latitudes(spark):
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(0, 0.003, (800, 2)), axis=0) + [55, 12]  # one crowded coast
    pieces = [(*walk[i], *walk[i + 1]) for i in range(799)]
    pieces += [(10.0, -100.0, 30.0, -40.0), (-60.0, 100.0, -60.0, 170.0), (80.0, 0.0, 89.0, 5.0), (5.0, 5.0, 5.0, 5.0)]
    points = [(float(la), float(lo)) for la in (-90, -89.9, -60, -1, 0, 33, 55, 70, 89, 89.99, 90) for lo in rng.uniform(-180, 180, 8)]
    points += [(55 + float(rng.normal(0, 0.1)), 12 + float(rng.normal(0, 0.1))) for _ in range(40)]
    got = joins.distance_to_lines_km(
        spark.createDataFrame(points, "la double, lo double"),
        spark.createDataFrame([tuple(map(float, p)) for p in pieces], "lat1 double, lon1 double, lat2 double, lon2 double"),
        "la", "lo",
    ).collect()
    assert len(got) == len(points)
    for r in got:
        assert r.dist_km == pytest.approx(min(to_segment(r.la, r.lo, *p) for p in pieces), rel=1e-7, abs=1e-6)


def inside(x, y, edges):
    odd = False
    for x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def ring(points):
    return [(*points[i], *points[(i + 1) % len(points)]) for i in range(len(points))]


def test_polygons_by_parity_of_cells(spark):
    rng = np.random.default_rng(7)
    rings = {
        1: ring([(0.0, 0.0), (3000.0, 0.0), (3000.0, 600.0), (0.0, 600.0)]),  # wider than cells, on round numbers
        2: ring([(float(900 * math.cos(a) * r + 500), float(900 * math.sin(a) * r + 300)) for a, r in zip(np.linspace(0, 2 * math.pi, 200, endpoint=False), rng.uniform(0.2, 1, 200))]),
        3: ring([(-4000.0, -3000.0), (6000.0, 4000.0), (6000.0, -3000.0)]),
    }
    rings[1] += ring([(990.0, 90.0), (1980.0, 90.0), (1980.0, 480.0), (990.0, 480.0)])  # a hole
    edges = [(k, *map(float, e)) for k, r in rings.items() for e in r]
    pixels = [(float(x), float(y)) for x in range(-300, 3300, 90) for y in range(-90, 700, 30)]
    pixels += [(float(x), float(y)) for x, y in rng.uniform(-1000, 4000, (1500, 2)).round(1)]
    pixels = [(i, *p) for i, p in enumerate(pixels)]
    got = joins.in_rings(
        spark.createDataFrame(pixels, "id int, px double, py double"), spark.createDataFrame(edges, "region int, x1 double, y1 double, x2 double, y2 double"), "region", "px", "py"
    )
    want = {(i, k) for i, x, y in pixels for k, r in rings.items() if inside(x, y, r)}
    assert {(r.id, r.region) for r in got.collect()} == want


def test_a_coast_in_one_row_of_pixels(spark):
    n = 20_000
    upper = [(10.0 * i, 10.0 + 8 * math.sin(i)) for i in range(n)]
    coast = ring([*upper, (10.0 * n, -400.0), (0.0, -400.0)])
    pixels = [(i, 37.0 * i, 12.0 + (i % 7) - 3) for i in range(5000)]
    out = joins.in_rings(
        spark.createDataFrame(pixels, "id int, px double, py double"), spark.createDataFrame([(1, *map(float, e)) for e in coast], "region int, x1 double, y1 double, x2 double, y2 double"), "region", "px", "py"
    )
    got = {r.id for r in out.collect()}

    def below(x, y):
        i = int(x // 10)
        (x1, y1), (x2, y2) = upper[i], upper[i + 1]
        return y < y1 + (y2 - y1) * (x - x1) / (x2 - x1)

    assert got == {i for i, x, y in pixels if below(x, y)}
