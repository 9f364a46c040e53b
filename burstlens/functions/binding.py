"""Compute a value once per row and use it several times in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    Without it every mention repeats the whole expression, and filters pushed
    below a projection multiply that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
