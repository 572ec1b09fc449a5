"""Evaluate an expression once and use its value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A plain expression that mentions its input in a condition and in both branches has it computed
    again for each, and chains of such expressions multiply; a lambda variable holds the value.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)
