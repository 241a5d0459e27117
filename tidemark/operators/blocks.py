"""Hot series: keep every window group bounded without changing any result.

A window over ``partitionBy(series).orderBy(date)`` runs one series in one task. That is
bounded when the frame holds one row per series and day (the calendar bounds it), and
unbounded otherwise. Operators in this package therefore look for a block column:

* ``one_per_day(df)`` marks a frame that was just grouped by (series, day).
* ``split_series(df, ...)`` counts rows per series and, where a series is larger than
  ``rows``, cuts it into consecutive blocks of exactly that many rows. Each block also receives the
  ``lookback`` rows before it (and ``ahead`` rows after it) as halo rows, so a frame that
  reaches at most that far gives the same value as on the whole series. ``merge_blocks``
  drops the halo again.
* an operator given an unmarked frame splits it, runs, and merges.

Positions are exact: rows are sorted into range partitions of (series, order, hash of the row), each row gets
its number in its partition, and the counts of the partitions before are added. The hash parts rows
that are tied in the order, so a burst of one instant is cut like any other run of rows, and the
position breaks ties the same way in every block.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.sources.workdir import stage

BLOCK = "__block"
HALO = "__halo"
POSITION = "__position"
_PART, _ROW, _TIE = "__part", "__row", "__tie"
_CARRY = "__carry"

# Rows one window group may hold before its series is split.
MAX_ROWS = 1_000_000
# Rows per series and range partition that may be broadcast (about 50 bytes each); beyond it the join shuffles.
MAX_BROADCAST_PARTS = 100_000


def as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def series_window(key: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*as_list(key)).orderBy(*as_list(order))


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    """Current row and the ``n - 1`` before it."""
    return w.rowsBetween(-(n - 1), 0)


def _numbered(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All rows, written once in order, with their range partition and their number in it."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    ranged = df.withColumn(_TIE, F.xxhash64(*plain))
    by = [*key, *order, _TIE]
    ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by).drop(_TIE)
    return stage(ranged.select("*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_ROW)))


def split_series(df: DataFrame, *, key: str | Sequence[str], order: str | Sequence[str], lookback: int,
                 ahead: int = 0, rows: int | None = None) -> DataFrame:
    """Cut series above ``rows`` (default ``MAX_ROWS``) into blocks with ``lookback`` halo rows.

    Starts three jobs: a count per series, the write of the ordered rows, and a count per series and range
    partition. When no series is above ``rows`` only the first runs, and the frame comes back with a constant
    block and no other change. Rows that are equal in all columns and tied stay in one range partition.
    """
    keys, orders = as_list(key), as_list(order)
    rows = MAX_ROWS if rows is None else rows
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= rows:
        return one_per_day(df)
    placed = _numbered(df, keys, orders)
    parts = placed.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("n"), F.min(_ROW).alias("first"))
    w = Window.partitionBy(*keys)
    before = F.sum("n").over(w.orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    big = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(_PART).alias("__p"),
                       (before - F.col("first")).alias("__offset"), F.sum("n").over(w).alias("__total")).where(F.col("__total") > rows)
    small = big.limit(MAX_BROADCAST_PARTS + 1).count() <= MAX_BROADCAST_PARTS
    on = F.col(_PART) == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    position = F.col(_ROW) + F.coalesce("__offset", F.lit(0).cast("bigint"))
    joined = placed.join(F.broadcast(big) if small else big, on, "left").withColumn(POSITION, position)
    split = F.col("__total").isNotNull()
    own = F.when(split, F.floor(F.col(POSITION) / rows)).otherwise(F.lit(0).cast("bigint"))
    lowest = F.floor(F.greatest(F.lit(0).cast("bigint"), F.col(POSITION) - ahead) / rows)
    highest = F.floor(F.least(F.col(POSITION) + lookback, F.col("__total") - 1) / rows)
    feeds = F.when(split, F.sequence(lowest, highest)).otherwise(F.array(F.lit(0).cast("bigint")))
    exploded = joined.select(*df.columns, POSITION, own.alias("__own"), F.explode(feeds).alias(BLOCK))
    return exploded.select(*df.columns, POSITION, BLOCK, (F.col(BLOCK) != F.col("__own")).alias(HALO))


def one_per_day(df: DataFrame) -> DataFrame:
    """Mark a frame whose series cannot be large: one row per (series, day)."""
    return df.withColumn(BLOCK, F.lit(0).cast("bigint"))


def merge_blocks(df: DataFrame) -> DataFrame:
    """Drop halo rows and the block columns."""
    out = df.where(~F.col(HALO)) if HALO in df.columns else df
    return out.drop(BLOCK, HALO, POSITION)


def block_key(df: DataFrame, key: str | Sequence[str]) -> list[str]:
    keys = as_list(key)
    return keys + [BLOCK] if BLOCK in df.columns and BLOCK not in keys else keys


def windowed(lookback: Callable[[dict], int], ahead: Callable[[dict], int] = lambda a: 0):
    """Make ``fn(df, ..., key=, order=)`` safe for hot series (see the module text)."""

    def wrap(fn):
        sig = inspect.signature(fn)

        @functools.wraps(fn)
        def run(df: DataFrame, *args, **kwargs):
            bound = sig.bind(df, *args, **kwargs)
            bound.apply_defaults()
            call = bound.arguments
            call["key"], call["order"] = as_list(call["key"]), as_list(call["order"])
            marked = BLOCK in df.columns
            if not marked:
                call["df"] = split_series(df, key=call["key"], order=call["order"], lookback=lookback(call),
                                          ahead=ahead(call))
            call["key"] = block_key(call["df"], call["key"])
            if POSITION in call["df"].columns and POSITION not in call["order"]:
                call["order"] = [*call["order"], POSITION]  # the same order of ties in every block
            out = fn(*bound.args, **bound.kwargs)
            return out if marked else merge_blocks(out)

        return run

    return wrap


def with_carry(df: DataFrame, cols: Sequence[str], key: Sequence[str], *, per_block: Callable[[str], Column],
               over_blocks: Callable[[str], Column]) -> DataFrame:
    """On a split frame, add one row per block that carries what came before it.

    ``per_block`` reduces a column within a block and ``over_blocks`` the results of all
    earlier blocks of the series. The carry row has ``__carry`` set and sorts first in
    ``carry_window``, so unbounded frames pick it up without a join, and the frame is still
    shuffled once. Filter it out with ``without_carry``.
    """
    base = [k for k in key if k != BLOCK]
    ends = df.where(~F.col(HALO)).groupBy(*base, BLOCK).agg(*[per_block(c).alias(c) for c in cols])
    w = Window.partitionBy(*base).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*base, BLOCK, *[over_blocks(c).over(w).alias(c) for c in cols],
                          F.lit(True).alias(HALO), F.lit(True).alias(_CARRY))
    return df.withColumn(_CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)


def carry_window(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(F.desc(_CARRY), *order)


def without_carry(df: DataFrame) -> DataFrame:
    return df.where(~F.col(_CARRY)).drop(_CARRY)


def last_value_carry(order: Sequence[str]) -> dict:
    """Carry the last non-null value."""
    at = F.struct(*order)
    return {"per_block": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)),
            "over_blocks": lambda c: F.last(c, ignorenulls=True)}


def sum_carry() -> dict:
    """Carry the running total."""
    return {"per_block": F.sum, "over_blocks": F.sum}
