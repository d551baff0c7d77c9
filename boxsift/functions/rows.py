"""Values that an expression works out once a row, and rows kept by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of the named values. They are a lambda's variable, so no rewrite of the plan can repeat their work."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def kept(rows: DataFrame, test: Column) -> DataFrame:
    """The rows of which test is true. A filter moves below the projections that make its columns and repeats their work, an
    outer generator stays above them."""
    return rows.select("*", F.explode_outer(F.when(test, F.array(F.lit(1)))).alias("_kept")).where("_kept IS NOT NULL").drop("_kept")
