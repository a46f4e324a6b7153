"""Temperature downscaling that conserves the coarse observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackish.operators import linear
from brackish.operators.pixels import add_coarse_residual


def downscale(
    fine: DataFrame, keys: Sequence[str], cell: Sequence[str], lst: str, predictors: Sequence[str], alpha: float = 0.0
) -> DataFrame:
    """Learn coarse temperature from cell-mean predictors per `keys`, predict fine pixels, restore the cell mean.

    `fine` carries on every pixel its fine predictors, the temperature of its
    coarse cell in `lst`, and the cell's identity `cell`. Adds `pred`, and
    `sharp`, which averages to `lst` over the pixels of each cell.
    """
    complete = fine.dropna(subset=[lst, *predictors])
    coarse = complete.groupBy(*keys, *cell).agg(F.avg(lst).alias(lst), *[F.avg(p).alias(p) for p in predictors])
    kind = "ridge" if alpha > 0 else "ols"
    fits, grams = linear.fit_by_key(
        coarse, predictors, lst, keys, [linear.LinearModel("downscale", tuple(predictors), kind, alpha)]
    )
    predicted = linear.apply_fits(complete, fits, grams, keys).drop("model")
    return add_coarse_residual(predicted, [*keys, *cell], lst, "pred", "sharp")


def coarsen(df: DataFrame, keys: Sequence[str], x: str, y: str, size: float, cols: Sequence[str]) -> DataFrame:
    """Attach the coarse cell of each pixel and, in `{c}_coarse`, the cell means."""
    cells = df.withColumn("cell_x", F.floor(F.col(x) / size)).withColumn("cell_y", F.floor(F.col(y) / size))
    w = Window.partitionBy(*keys, "cell_x", "cell_y")
    return cells.withColumns({f"{c}_coarse": F.avg(c).over(w) for c in cols})
