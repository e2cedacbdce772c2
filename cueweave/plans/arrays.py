"""Turning arrays into rows, and naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keep: list[str], array: Column, pos: str, value: str) -> DataFrame:
    """``keep`` columns plus position and element of each entry of ``array``.

    The outer form with a filter behind it: for the inner form the optimizer
    adds a "not empty" filter below the generator, which would evaluate the
    whole array expression a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Inside lambdas nothing shares common subexpressions, and an optimizer that
    merges projections may put a column's expression into a lambda, to be
    computed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
