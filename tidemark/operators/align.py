"""Put several source frames on one (series, date) grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_same_key


def prefix_columns(df: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """Rename every column outside ``keys`` to ``{source}_{name}``."""
    return df.select(*keys, *[F.col(c).alias(f"{source}_{c}") for c in df.columns if c not in keys])


def align_sources(frames: Mapping[str, DataFrame], *, keys: Sequence[str] = ("series", "date"),
                  how: str = "max", by: str | None = None) -> DataFrame:
    """Full outer alignment of all sources on ``keys``, one row per key.

    The frames are stacked and grouped once, so N sources cost one shuffle with map-side
    combine instead of N - 1 joins, and no (series, date) ever multiplies rows. Where a
    source has several rows for a key they reduce by ``how``: ``avg`` (numbers only, others
    by max), ``max``, or ``last``: per column the newest non-null value by ``by``, a column
    such as the ingest time that every source has and that is left out of the result. Rows equal in ``by``
    give the largest value and a null ``by`` is the oldest, so the result does not depend on row order.
    """
    if (how == "last") != (by is not None):
        raise ValueError("'by' names the order of how='last', and only of that")
    kept = [*keys, by] if by else list(keys)
    wide = [prefix_columns(df, s, kept) for s, df in frames.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)
    values = [f for f in stacked.schema if f.name not in kept]
    out = []
    for f in values:
        number = f.dataType.typeName() in ("double", "float", "long", "integer", "short")
        if how == "last":
            newest = F.max(F.when(F.col(f.name).isNotNull(), F.struct(F.col(by), F.col(f.name))))
            out.append(newest[f.name].alias(f.name))
        else:
            out.append((F.avg(f.name) if how == "avg" and number else F.max(f.name)).alias(f.name))
    return stacked.groupBy(*keys).agg(*out)


def align_fanout(many: tuple[str, DataFrame], others: Mapping[str, DataFrame], *,
                 keys: Sequence[str] = ("series", "date"), how: str = "avg", by: str | None = None) -> DataFrame:
    """Full outer alignment that keeps every row of one source, e.g. several news items a day.

    The other sources are first reduced to one row per key (``how`` and ``by`` as in ``align_sources``), so the output has as many rows
    as ``many`` plus the keys only the others have. It is a left join plus those keys, as
    AQE can split a hot key in a left join but not in a full outer one.
    """
    name, df = many
    keys = list(keys)
    rest = align_sources(others, keys=keys, how=how, by=by)
    mine = prefix_columns(df, name, keys)
    only = join_same_key(rest, mine.select(*keys).distinct(), keys, "left_anti")
    return join_same_key(mine, rest, keys, "left").unionByName(only, allowMissingColumns=True)
