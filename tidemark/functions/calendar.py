"""Calendar expressions on a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_col


def calendar_parts(date: str | Column) -> dict[str, Column]:
    """Year, month, day, weekday (Monday is 1), day of year and quarter."""
    d = as_col(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "weekday": F.weekday(d) + 1,
        "day_of_year": F.dayofyear(d),
        "quarter": F.quarter(d),
    }


def cyclical_parts(date: str | Column) -> dict[str, Column]:
    """Month (period 12) and day of year (period 365) on the unit circle."""
    d = as_col(date)
    month = F.month(d) * F.lit(2 * math.pi / 12)
    doy = F.dayofyear(d) * F.lit(2 * math.pi / 365)
    return {
        "month_sin": F.sin(month),
        "month_cos": F.cos(month),
        "day_of_year_sin": F.sin(doy),
        "day_of_year_cos": F.cos(doy),
    }


def calendar_flag_parts(date: str | Column) -> dict[str, Column]:
    d = as_col(date)
    return {
        "is_weekend": F.weekday(d) >= 5,
        "is_q1": F.quarter(d) == 1,
        "is_december": F.month(d) == 12,
    }


def month_start(text: str | Column) -> Column:
    """``YYYY-MM`` or ``YYYY-MM-DD`` text to the first day of that month."""
    return F.trunc(F.to_date(F.concat(F.substring(as_col(text), 1, 7), F.lit("-01"))), "month")
