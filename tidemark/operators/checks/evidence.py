"""Evidence for check rows: the first few dates, gaps and values that made a check fail.

Every list is cut before it is collected, by running counts over one row per day or by ranks that
Spark also applies ahead of the shuffle, so a source with a third of all rows sends a few values a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import series_window


def mark_days(days: DataFrame, date: str, k: int, *, key: Sequence[str]) -> DataFrame:
    """Add ``gap``, and ``__twice`` and ``__hole`` where a day is among the first ``k`` to show a repeated date or a gap.

    ``days`` has one row per (key, date) and the number of rows ``n`` of that date. ``gap`` is the number of days
    since the date before; a hole is written as its first and last missing day, "2025-01-02..2025-01-05". A null date is neither.
    """
    w = series_window(key, date)
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.datediff(date, F.lag(date).over(w))
    twice = F.when((F.col("n") > 1) & F.col(date).isNotNull(), F.col(date).cast("string"))
    before = days.select("*", gap.alias("gap"), F.lag(date).over(w).alias("__before"), twice.alias("__twice"))
    hole = F.when(F.col("gap") > 1, F.concat(F.date_add("__before", 1).cast("string"), F.lit(".."), F.date_sub(date, 1).cast("string")))
    counted = before.withColumn("__hole", hole).select(
        *days.columns, "gap", *[F.when(F.count(c).over(until) <= k, F.col(c)).alias(c) for c in ("__twice", "__hole")])
    return counted


def listed(c: str) -> Column:
    """The marked texts of a group in ascending order, joined by commas; null if there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit(""))


def first_values(flagged: DataFrame, lists: Sequence[tuple[str, Column, Column, int]]) -> DataFrame:
    """Per source, one text column per (name, condition, order, k): the first ``k`` values that meet the condition, in that order.

    ``flagged`` has at most one row per (source, value). Ties in the order go by value, and nulls in the order come last.
    """
    entries = F.array(*[F.when(on, F.struct(F.lit(name).alias("list"), order.cast("double").alias("at"))) for name, on, order, _ in lists])
    rows = flagged.select("source", "value", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e")).select("source", "value", "e.*")
    w = Window.partitionBy("source", "list").orderBy(F.asc_nulls_last("at"), F.asc("value"))
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k for *_, k in lists))

    def texts(name: str, k: int) -> Column:
        kept = F.collect_list(F.when((F.col("list") == name) & (F.col("rank") <= k), F.struct("rank", "value")))
        return F.nullif(F.array_join(F.transform(F.array_sort(kept), lambda x: x["value"].cast("string")), ","), F.lit("")).alias(name)

    return top.groupBy("source").agg(*[texts(name, k) for name, _, _, k in lists])
