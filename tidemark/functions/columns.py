"""Column selection from the schema (driver metadata only)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)

# Name parts that mark a price-like or a sentiment column.
PRICE_WORDS = ("rate", "price", "exchange")
SENTIMENT_WORDS = ("sentiment",)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), floats_only: bool = False) -> list[str]:
    """Columns of 32/64-bit number type, in schema order, without ``exclude``."""
    kinds = FLOATS if floats_only else NUMBERS
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in skip]


def columns_named(df: DataFrame, words: Iterable[str], floats_only: bool = True,
                  exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns whose lower-cased name holds one of ``words``."""
    return [c for c in numeric_columns(df, exclude, floats_only) if any(w in c.lower() for w in words)]
