"""Nearest rows by pivots against brute force, and how little they compare."""

import numpy as np
import pytest

from brackish import session
from brackish.operators import evaluate, models, neighbours
from brackish.operators.evaluate import Scheme

X = ["a", "b"]


def frame(spark, x, y, fold, scope=None):
    rows = [(i, int(0 if scope is None else scope[i]), int(fold[i]), float(y[i]), *map(float, x[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "_row long, _scope int, _fold int, _y double, a double, b double").repartition(4)


def brute(x, y, fold, scope, k):
    out = {}
    for i in range(len(x)):
        use = (scope == scope[i]) & (fold != fold[i])
        d = np.sqrt(((x[use] - x[i]) ** 2).sum(1))
        order = np.lexsort((y[use], d))[:k]
        out[i] = list(zip(d[order].round(6), y[use][order]))
    return out


@pytest.mark.parametrize("cell,piece", [(20, 8192), (7, 16), (10_000, 50)])
def test_nearest_of_all_folds(spark, cell, piece):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 50, (6, 2))
    x = (centers[rng.integers(0, 6, 400)] + rng.normal(0, 0.5, (400, 2))).round(3)
    x = np.vstack([x, np.repeat(x[:1], 60, axis=0), [[1e6, -1e6]]])  # copies and a row far off
    n = len(x)
    y, fold, scope = np.arange(n).astype(float), rng.integers(0, 5, n), rng.integers(0, 2, n)
    fold = fold + 5 * scope
    table = frame(spark, x, y, fold, scope)
    got = neighbours.nearest(table, table, X, 5, cell=cell, piece=piece).collect()
    want = brute(x, y, fold, scope, 5)
    assert {r["_row"]: [(round(z.d, 6), z.y) for z in r["_near"]] for r in got} == want


def test_too_few_or_no_rows(spark):
    known = frame(spark, np.array([[0.0, 0.0], [1.0, 1.0]]), [1.0, 2.0], [0, 0])
    asked = frame(spark, np.array([[0.2, 0.0]]), [0.0], [1])
    (row,) = neighbours.nearest(known, asked, X, 5).collect()
    assert [z.y for z in row["_near"]] == [1.0, 2.0]
    assert neighbours.nearest(known.limit(0), asked, X, 5).count() == 0
    assert neighbours.nearest(known, asked.limit(0), X, 5).count() == 0


def test_few_pairs_are_compared():
    """Well below all pairs, on clustered rows too."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (4000, 2)), rng.normal(200, 0.01, (4000, 2))])
    pivots = x[rng.choice(len(x), 80, replace=False)]
    cells = neighbours.Cells({0: pivots})
    d = cells.distances(0, x)
    home = d.argmin(1)
    cells.count[0] = np.bincount(home, minlength=80)
    cells.radius[0] = np.array([d[home == c, c].max() for c in range(80)])
    q = x[::40]
    kth = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 10]
    assert neighbours.compared(cells, 0, 1, q, 10, kth) < 0.06 * len(q) * len(x)


def test_folds_of_schemes(spark):
    rng = np.random.default_rng(3)
    n = 300
    rows = [(i, f"S{i % 4}", 1990 + i % 5, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(n)]
    table = spark.createDataFrame(rows, "id long, site string, year int, a double, b double, y double")
    schemes = [evaluate.leave_site(), Scheme("leave_year", ("site", "year"), ("site",), 5, 15)]
    oof = models.cross_validate_knn(table, X, "y", schemes, 3).toPandas()
    x = np.array([r[3:5] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    y = np.array([r[5] for r in rows])
    site, year = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert len(oof) == 2 * n
    for r in oof.itertuples():
        use = site != r.site if r.scheme == "leave_site" else (site == r.site) & (year != r.year)
        d = np.sqrt(((z[use] - z[r.id]) ** 2).sum(1))
        best = np.argsort(d)[:3]
        assert r.pred == pytest.approx((y[use][best] / d[best]).sum() / (1 / d[best]).sum())


def test_boxes_within_a_cell():
    """Few of the pairs of one cell are compared, with all folds, copies and a row far off; a fold may hold all near rows."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (6000, 2)), np.repeat([[0.5, 0.5]], 40, axis=0), [[1e7, -1e7]]])
    n = len(x)
    y, fold = rng.permutation(n).astype(float), np.where(x[:, 0] > 1, 3, rng.integers(0, 3, n))
    best, pairs = neighbours.search(x, y, fold, x, fold, np.full(n, np.inf), 5)
    assert pairs < 0.15 * n * n
    for i in [*range(0, n, 97), n - 2, n - 1]:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[fold == fold[i]] = np.inf
        order = np.lexsort((y, d))[:5]
        assert (best.imag[i] == y[order]).all() and best.real[i] == pytest.approx(d[order])


def test_near_points_far_from_the_origin():
    """Bounds of cells must not lose the distances of near points to cancellation."""
    cells = neighbours.Cells({0: np.array([[1e6, 1e6], [0.0, 0.0]])})
    assert cells.distances(0, np.array([[1e6, 1e6 + 1e-4]]))[0, 0] == pytest.approx(1e-4, rel=1e-4)


def test_equal_questions_are_asked_once(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]], 40, axis=0)
    y, fold = np.arange(120.0), np.arange(120) % 2
    table = frame(spark, x, y, fold)
    assert neighbours.nearest_of_points(table, table, X, 3).count() == 6
    got = {r["_row"]: [(z.d, z.y) for z in r["_near"]] for r in neighbours.nearest(table, table, X, 3).collect()}
    assert got == brute(x, y, fold, np.zeros(120), 3)


def test_searches_leave_only_their_predictions(spark, tmp_path, monkeypatch):
    """Known rows, cells and neighbours of a search are removed before the next; its shuffle files end with it."""
    import os

    rng = np.random.default_rng(8)
    rows = [(i, f"s{i % 3}", i % 4, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, site string, fold int, a double, b double, y double")
    schemes = [Scheme("by_fold", ("fold",)), Scheme("by_site", ("site",))]
    monkeypatch.setattr(session, "durable_folder", lambda _: f"{tmp_path}")
    with session.job(spark) as folder:
        oof = models.cross_validate_knn(df, ["a", "b"], "y", schemes, 3)
        assert len(os.listdir(folder)) == 1 + len(schemes)  # the rows and a table of predictions a scheme
        assert sorted(os.listdir(tmp_path)) == [os.path.basename(folder)]
        assert oof.count() == 2 * len(rows)
    assert os.listdir(tmp_path) == []
