"""Cross-validation schemes and pooled scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackish.functions.energy import clip
from brackish.functions.gates import in_period
from brackish.operators.catalog import stable_hash
from brackish.session import settle


@dataclass(frozen=True)
class Scheme:
    """Rows equal in `fold` are held out together; training rows agree with them in `scope` only.

    An empty scope means that every other row trains. Folds with fewer than
    `min_test` or `min_train` rows are skipped.
    """

    name: str
    fold: tuple[str, ...]
    scope: tuple[str, ...] = ()
    min_test: int = 1
    min_train: int = 1


def kfold(df: DataFrame, ids: Sequence[Column], k: int = 10) -> tuple[DataFrame, Scheme]:
    """Repeatable pseudo-random folds from a hash of integer row identifiers."""
    return df.withColumn("fold", stable_hash(*ids, modulus=k)), Scheme("kfold", ("fold",))


def leave_year(min_test: int = 5, min_train: int = 15) -> Scheme:
    """Each year of a site, predicted from the site's other years."""
    return Scheme("leave_year", ("site", "year"), ("site",), min_test, min_train)


def leave_site(min_test: int = 5) -> Scheme:
    return Scheme("leave_site", ("site",), (), min_test)


def month_blocks(df: DataFrame, date: str, k: int = 5, site: str = "site") -> tuple[DataFrame, Scheme]:
    """Within-site folds made of whole months, of even size; sites with fewer than `k` months are left out.

    The months of a site are dealt by size, the largest first, each into the fold that has the fewest rows by then; of equal months
    the earlier comes first, of equal folds the lower number. The months of one site are a short list, dealt in one expression.
    """
    month = df.withColumn("_month", F.trunc(date, "month"))
    sizes = month.groupBy(site, "_month").agg(F.count(F.lit(1)).alias("_n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_month")))
    lists = sizes.groupBy(site).agg(order.alias("_months")).where(F.size("_months") >= k)
    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("full"), F.array().cast("array<struct<_month: date, fold: int>>").alias("dealt"))

    def deal(state: Column, item: Column) -> Column:
        into = F.array_position(state["full"], F.array_min(state["full"])).cast("int") - 1
        full = F.transform(state["full"], lambda n, i: F.when(i == into, n - item["m"]).otherwise(n))
        return F.struct(full.alias("full"), F.array_append(state["dealt"], F.struct(item["_month"].alias("_month"), into.alias("fold"))).alias("dealt"))

    dealt = lists.select(site, F.explode(F.aggregate("_months", empty, deal)["dealt"]).alias("_d"))
    folds = dealt.select(site, F.col("_d._month").alias("_month"), F.col("_d.fold").alias("month_fold"))
    out = month.join(settle(folds), [site, "_month"]).drop("_month")
    return out, Scheme("month_blocks", (site, "month_fold"), (site,))


def fixed_split(
    df: DataFrame,
    train_sites: Sequence[str],
    test_sites: Sequence[str],
    train_period: tuple[str, str],
    test_period: tuple[str, str],
    date: str = "date",
    site: str = "site",
) -> DataFrame:
    """Rows of the training sites and years, and of the test sites and years, marked by `is_train`."""
    train = F.col(site).isin(*train_sites) & in_period(F.col(date), *train_period)
    test = F.col(site).isin(*test_sites) & in_period(F.col(date), *test_period)
    return df.where(train | test).withColumn("is_train", train)


def metrics(oof: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred", min_n: int = 1) -> DataFrame:
    """Scores pooled over all held-out rows: the total spread is taken around their common mean."""
    # no filter on predictions: it would be pushed below them and repeat their expressions
    both = oof.select(*by, (F.col(pred) - F.col(y)).alias("_err"), F.col(y).alias("_y"))
    err = F.col("_err")
    n = F.count(err)
    out = both.groupBy(*by).agg(
        n.alias("n"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(F.when(err.isNotNull(), F.col("_y"))) * n)).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err).alias("bias"),
    )
    return out.where(F.col("n") >= max(min_n, 1 if by else 0))


def line_of_fit(oof: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Slope and intercept of predictions on observations."""
    return oof.groupBy(*by).agg(F.regr_slope(pred, y).alias("slope"), F.regr_intercept(pred, y).alias("intercept"))


def train_mean(split: DataFrame, y: str) -> DataFrame:
    """Baseline: test rows predicted by the training mean."""
    mean = split.where("is_train").agg(F.avg(y)).first()[0]
    return split.where(~F.col("is_train")).withColumn("pred", F.lit(mean).cast("double"))


def direct(split: DataFrame, predictor: str) -> DataFrame:
    """Baseline: test rows predicted by a column as it is, e.g. reference ET."""
    return split.where(~F.col("is_train")).withColumn("pred", F.col(predictor))


def identical_rows(df: DataFrame, *feature_sets: Sequence[str]) -> DataFrame:
    """Rows complete for every compared model."""
    return df.dropna(subset=list(dict.fromkeys(c for s in feature_sets for c in s)))


def observed_only(df: DataFrame, ages: Sequence[str]) -> DataFrame:
    """Rows whose satellite values were all seen on the day itself."""
    for age in ages:
        df = df.where(F.col(age) == 0)
    return df


def et_from_fraction(pred: Column, energy: Column, hi: float = 1.2) -> Column:
    """ET from a predicted ratio to some energy term (fraction 0-1.2, coefficient 0-1.6)."""
    return clip(pred, 0, hi) * energy


def et_from_crop_coefficient(pred: Column, eto: Column, floor: float = 0.3) -> Column:
    return pred * clip(eto, floor)
