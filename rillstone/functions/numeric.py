"""Column helpers for missing values, truth and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantize(x: Column, digits: int = 6) -> Column:
    """Rounds by floor, the same in every engine, so that sums of doubles compare equal.

    The step lies a little off the half: means of decimals often end in 5, and there the last
    bit of a sum would decide.
    """
    scale = 10.0**digits
    return F.floor(x * scale + 0.50013).cast("double") / scale


def ordered_mean(x: str, *order: str) -> Column:
    """An aggregate: the mean of a group's doubles, summed one after another by ``order``, null for none.

    ``avg`` adds what tasks have summed, so its last bit, and with it a comparison with a bound that
    the mean meets exactly, depends on the partitions. The group's rows are held by one task.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(*order, F.col(x).cast("double").alias("_x")))))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["_x"]), F.size(rows).cast("double"))


def truth(x: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(x.cast("boolean"), F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float or double column; NaN would compare greater than all numbers."""
    fix = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in fix else F.col(c) for c in df.columns))


def is_close(x: Column, y: Column, rtol: float = 1e-4, atol: float = 1e-4) -> Column:
    return F.abs(x - y) <= atol + rtol * F.abs(y)


def positive_finite(x: Column) -> Column:
    """x where it is positive and finite, else null."""
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)
