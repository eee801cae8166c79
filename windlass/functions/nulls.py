"""Numbers at operator boundaries: NULL stands for anything that is not finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as a double; NaN, infinities and what is no number become NULL."""
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def share_where(condition: Column) -> Column:
    """The share of a group's rows that meet the condition; NULL counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
