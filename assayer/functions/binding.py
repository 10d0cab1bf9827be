"""Evaluating a costly expression once when several expressions need its value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Repeating a parser call in several branches repeats its work inside lambdas
    and conditionals, where Spark does not share common subexpressions.
    """
    return F.transform(F.array(value), lambda bound: use(bound))[0]
