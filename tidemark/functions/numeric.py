"""Null- and ANSI-safe numeric expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """``a / b`` with null where ``b`` is zero (ANSI mode would raise)."""
    return as_col(a) / F.nullif(as_col(b), F.lit(0.0))


def pct_of(new: str | Column, old: str | Column) -> Column:
    """Relative change ``(new - old) / old``."""
    return safe_div(as_col(new) - as_col(old), old)


def nan_to_null(c: str | Column) -> Column:
    """Spark ranks NaN above every number; keep it out of min, max and sums."""
    return F.when(~F.isnan(as_col(c)), as_col(c))


def full_window(agg: Callable[[Column], Column], c: str | Column, w: WindowSpec, n: int) -> Column:
    """``agg(c)`` over ``w``, null until the frame holds ``n`` non-null values."""
    x = as_col(c)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def is_infinite(c: str | Column) -> Column:
    return F.abs(as_col(c)) == F.lit(float("inf"))

