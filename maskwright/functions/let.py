"""A name for a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Common parts of expressions are not shared within lambdas or branches; a lambda's argument is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """A column's value, computed only where the column is made.

    A filter on a column is moved beneath the projection that makes it, and then computes the column
    a second time; that holds as well for the filter that ``explode`` brings along. It is not moved
    where the column depends on the partition's number, as this one does in form.
    """
    return F.when(F.spark_partition_id() >= 0, value)
