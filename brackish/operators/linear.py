"""Linear models on sufficient statistics.

One aggregation gives, for every fold, the counts, means and co-moments of
all features. Everything else - ordinary, ridge, elastic-net and partial
least squares fits of any feature subset with any fold left out, information
criteria, variance inflation - follows from these small tables: the training
set of a fold is the total less the fold's own moments. Only predictions and
their scores read the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackish.operators.evaluate import Scheme
from brackish.session import settle


@dataclass(frozen=True)
class LinearModel:
    """`kind` is ols, ridge, elastic or pls; inputs are standardised on the training rows."""

    name: str
    features: tuple[str, ...]
    kind: str = "ridge"
    alpha: float = 0.0
    l1_ratio: float = 0.3
    components: int = 5


@dataclass
class Grams:
    """Per key combination: count, means, and co-moments around those means (`sxx`, `sxy`, `syy`)."""

    table: DataFrame
    features: list[str]
    target: str
    keys: list[str]


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def fold_grams(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> Grams:
    """One row of moments per key combination, from complete rows.

    Means and covariances are Spark's own aggregates, which merge partial results around their means:
    neither the order of rows nor a large offset in one key touches the digits of another.
    """
    cols = [*features, target]
    rows = df.dropna(subset=cols).select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    n = F.count(F.lit(1))
    table = rows.groupBy(*keys).agg(
        n.alias("n"),
        F.array(*[F.avg(f) for f in features]).alias("mx"),
        F.avg(target).alias("my"),
        F.array(*[n * F.covar_pop(features[i], features[j]) for i, j in _pairs(len(features))]).alias("sxx"),
        F.array(*[n * F.covar_pop(f, target) for f in features]).alias("sxy"),
        (n * F.covar_pop(target, target)).alias("syy"),
    )
    return Grams(settle(table), list(features), target, list(keys))


def _merged(parts: DataFrame, by: Sequence[str], p: int) -> DataFrame:
    """Moments of the parts of each group together: their own co-moments and those of their means."""
    by = list(by)
    n, whole = F.col("n"), F.sum("n")
    centre = parts.groupBy(*by).agg(
        F.array(*[F.sum(n * F.col("mx")[i]) / whole for i in range(p)]).alias("_cx"), (F.sum(n * F.col("my")) / whole).alias("_cy")
    )
    dx = [F.col("mx")[i] - F.col("_cx")[i] for i in range(p)]
    dy = F.col("my") - F.col("_cy")

    def together(own: Column, a: Column, b: Column) -> Column:
        return F.sum(own) + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / whole

    return (
        parts.join(centre, by)
        .groupBy(*by)
        .agg(
            whole.alias("n"),
            F.array(*[F.first(F.col("_cx")[i]) + F.sum(n * dx[i]) / whole for i in range(p)]).alias("mx"),
            (F.first("_cy") + F.sum(n * dy) / whole).alias("my"),
            F.array(*[together(F.col("sxx")[k], dx[i], dx[j]) for k, (i, j) in enumerate(_pairs(p))]).alias("sxx"),
            F.array(*[together(F.col("sxy")[i], dx[i], dy) for i in range(p)]).alias("sxy"),
            together(F.col("syy"), dy, dy).alias("syy"),
        )
    )


def training_sums(grams: Grams, scheme: Scheme) -> DataFrame:
    """For every fold kept by the scheme, the moments over its training rows: the total less the fold."""
    p = len(grams.features)
    own = grams.table
    if set(scheme.fold) != set(grams.keys):
        own = _merged(own.withColumn("_all", F.lit(1)), ["_all", *scheme.fold], p).drop("_all")
    own = own.withColumn("_all", F.lit(1))
    scope = ["_all", *scheme.scope]
    names = ("n", "mx", "my", "sxx", "sxy", "syy")
    total = _merged(own, scope, p).select(*scope, *[F.col(c).alias(f"_{c}") for c in names])
    both = own.join(total, scope).withColumn("n_test", F.col("n")).withColumn("n_train", F.col("_n") - F.col("n"))
    kept = both.where((F.col("n_test") >= scheme.min_test) & (F.col("n_train") >= max(scheme.min_train, 1)))
    ex = [F.col("mx")[i] - F.col("_mx")[i] for i in range(p)]
    ey = F.col("my") - F.col("_my")
    apart = F.col("n") * F.col("_n") / F.col("n_train")
    less = F.col("n") / F.col("n_train")
    return kept.select(
        *scheme.fold,
        "n_test",
        F.col("n_train").alias("n"),
        F.array(*[F.col("_mx")[i] - ex[i] * less for i in range(p)]).alias("mx"),
        (F.col("_my") - ey * less).alias("my"),
        F.array(*[F.col("_sxx")[k] - F.col("sxx")[k] - apart * ex[i] * ex[j] for k, (i, j) in enumerate(_pairs(p))]).alias("sxx"),
        F.array(*[F.col("_sxy")[i] - F.col("sxy")[i] - apart * ex[i] * ey for i in range(p)]).alias("sxy"),
        (F.col("_syy") - F.col("syy") - apart * ey * ey).alias("syy"),
    )


def unpack(n: float, mx, sxx, sxy, my: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, covariance (population), covariance with the target and mean of the target."""
    mx, p = np.asarray(mx, float), len(mx)
    full = np.zeros((p, p))
    full[np.tril_indices(p)] = sxx
    full = full + np.tril(full, -1).T
    return mx, full / n, np.asarray(sxy, float) / n, my


def _elastic(r: np.ndarray, c: np.ndarray, alpha: float, l1: float) -> np.ndarray:
    """Coordinate descent on a correlation matrix."""
    b = np.zeros(len(c))
    for _ in range(5000):
        biggest = 0.0
        for j in range(len(c)):
            rho = c[j] - r[j] @ b + r[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (r[j, j] + alpha * (1 - l1))
            biggest, b[j] = max(biggest, abs(new - b[j])), new
        if biggest < 1e-10:
            break
    return b


def _pls(r: np.ndarray, c: np.ndarray, components: int) -> np.ndarray:
    """Partial least squares for one target from cross products alone."""
    rotations, loadings, b, left = [], [], np.zeros(len(c)), c.copy()
    for _ in range(min(components, len(c))):
        size = np.linalg.norm(left)
        if size < 1e-12:
            break
        w = left / size
        rotation = w - sum((load @ w) * rot for load, rot in zip(loadings, rotations))
        spread = rotation @ r @ rotation
        if spread < 1e-12:
            break
        load, q = r @ rotation / spread, left @ rotation / spread
        b, left = b + q * rotation, left - load * q * spread
        rotations.append(rotation)
        loadings.append(load)
    return b


def solve(model: LinearModel, features: Sequence[str], n: float, mx, sxx, sxy, my: float) -> tuple[np.ndarray, float]:
    """Coefficients over all `features` (zero outside the model's) and intercept."""
    mean, cov, cxy, ybar = unpack(n, mx, sxx, sxy, my)
    use = np.array([features.index(f) for f in model.features])
    sd = np.sqrt(np.clip(np.diag(cov)[use], 0, None))
    sd[sd == 0] = 1.0
    r, c = cov[np.ix_(use, use)] / np.outer(sd, sd), cxy[use] / sd
    if model.kind == "elastic":
        b = _elastic(r, c, model.alpha, model.l1_ratio)
    elif model.kind == "pls":
        b = _pls(r, c, model.components)
    elif model.kind == "ridge" and model.alpha > 0:
        b = np.linalg.solve(r + np.eye(len(use)) * (model.alpha / n), c)
    else:
        b = np.linalg.lstsq(r, c, rcond=1e-12)[0]
    beta = np.zeros(len(features))
    beta[use] = b / sd
    return beta, float(ybar - beta @ mean)


def fit_folds(sums: DataFrame, keys: Sequence[str], features: Sequence[str], models: Sequence[LinearModel]) -> DataFrame:
    """Solve every model on every row of sums, in the tasks that hold them."""
    features, models, keys = list(features), list(models), list(keys)
    schema = T.StructType(
        [sums.schema[k] for k in keys]
        + [
            T.StructField("model", T.StringType()),
            T.StructField("beta", T.ArrayType(T.DoubleType())),
            T.StructField("intercept", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for m in models:
                    beta, intercept = solve(m, features, row["n"], row["mx"], row["sxx"], row["sxy"], row["my"])
                    out.append([*[row[k] for k in keys], m.name, beta.tolist(), intercept])
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return sums.select(*keys, "n", "mx", "sxx", "sxy", "my").mapInPandas(run, schema)


def apply_fits(
    df: DataFrame, fits: DataFrame, grams: Grams, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Complete rows with the prediction of every model whose fit carries their key, in column `pred`.

    With `how="left"` all rows stay, unpredictable ones with a null.
    """
    linear = F.col("intercept")
    for i, f in enumerate(grams.features):
        linear = linear + F.col("beta")[i] * F.col(f)
    rows = df if how == "left" else df.dropna(subset=grams.features)
    if not keys:
        rows, fits, keys = rows.withColumn("_all", F.lit(1)), fits.withColumn("_all", F.lit(1)), ["_all"]
    return rows.join(settle(fits), list(keys), how).withColumn("pred", linear).drop("beta", "intercept", "_all")


def cross_validate(
    df: DataFrame, features: Sequence[str], target: str, scheme: Scheme, models: Sequence[LinearModel]
) -> DataFrame:
    """Held-out predictions of all models: two passes over the rows, however many folds and models."""
    rows = df.dropna(subset=[*features, target])
    grams = fold_grams(rows, features, target, scheme.fold)
    fits = fit_folds(training_sums(grams, scheme), scheme.fold, features, models)
    return apply_fits(rows, fits, grams, scheme.fold).withColumn("scheme", F.lit(scheme.name))


def fit_by_key(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], models: Sequence[LinearModel]
) -> tuple[DataFrame, Grams]:
    """One fit per key (or one over everything), on rows that have the target."""
    grams = fold_grams(df, features, target, keys)
    return fit_folds(grams.table, keys, features, models), grams


def coefficients(fits: DataFrame, grams: Grams, keys: Sequence[str] = ()) -> DataFrame:
    """Fits in the units of the data: one row per model and feature, and the intercept as `(intercept)`."""
    names = F.array(*[F.lit(f) for f in grams.features])
    rows = F.concat(
        F.arrays_zip(names.alias("feature"), F.col("beta").alias("value")),
        F.array(F.struct(F.lit("(intercept)").alias("feature"), F.col("intercept").alias("value"))),
    )
    return fits.select(*keys, "model", F.explode(rows).alias("_r")).select(*keys, "model", "_r.feature", "_r.value")
