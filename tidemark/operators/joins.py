"""Joins on series keys, where a null key is a key like any other (as it is in a grouping)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the key columns of ``left`` are kept."""
    if not keys:
        # all rows are one series: an equi-join on a constant, which inner and outer joins handle alike
        one = F.lit(0).alias("__one")
        return left.select("*", one).join(right.select("*", one), "__one", how).drop("__one")
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())
