"""Exponentially weighted means with adjusted weights, in constant work per row.

With ``g = 1 - 2 / (span + 1)`` the mean at row t is
``sum(g^(t-i) * x_i) / sum(g^(t-i))`` over the rows i <= t that hold a value.
Rows are cut into runs of M with ``g^M < 1e-17``: a running sum inside the run, scaled by
``g^-r`` for the r-th row, plus the total of the run before. Terms further back are below
double precision, so M rows of lookback are enough for any row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import series_window, windowed


def decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def run_length(span: float) -> int:
    """Rows after which a weight is below 1e-17."""
    g = decay(span)
    return 1 if g <= 0 else max(2, math.ceil(math.log(1e-17) / math.log(g)))


def _groups(specs: Mapping[str, tuple[str, float]]) -> list[tuple[int, dict]]:
    """Specs that can share one run length without overflowing ``g^-M``."""
    m = max(run_length(s) for _, s in specs.values())
    steepest = min(decay(s) for _, s in specs.values())
    if steepest > 0 and m * -math.log(steepest) < 600:
        return [(m, dict(specs))]
    return [(run_length(s), {out: (c, s)}) for out, (c, s) in specs.items()]


def ewm_columns(df: DataFrame, specs: Mapping[str, tuple[str, float]], key: Sequence[str],
                order: Sequence[str]) -> DataFrame:
    """Add one column per ``{out: (col, span)}``; the frame must already be block-safe."""
    flat = {out: c for out, (c, s) in specs.items() if s <= 1}
    df = df.select("*", *[F.col(c).cast("double").alias(o) for o, c in flat.items()])
    specs = {o: v for o, v in specs.items() if o not in flat}
    if not specs:
        return df
    keep = [*df.columns, *specs]
    w = series_window(key, order)
    for m, group in _groups(specs):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = df.select("*", (F.row_number().over(w) - 1).alias("__rn"))
        rows = rows.select("*", F.floor(F.col("__rn") / m).alias("__run"), (F.col("__rn") % m).alias("__r"))
        wr = Window.partitionBy(*key, "__run").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
        sums = []
        for out, (c, s) in group.items():
            grow = F.pow(F.lit(1.0 / decay(s)), F.col("__r"))
            sums.append(F.sum(F.coalesce(F.col(c) * grow, F.lit(0.0))).over(wr).alias(f"__p_{out}"))
            sums.append(F.sum(F.when(F.col(c).isNotNull(), grow).otherwise(0.0)).over(wr).alias(f"__q_{out}"))
        rows = rows.select("*", *sums)
        carried = []
        for out, (_, s) in group.items():
            scale = decay(s) ** (m - 1)
            for part in ("p", "q"):
                whole = F.when(F.col("__r") == m - 1, F.col(f"__{part}_{out}") * F.lit(scale))
                carried.append(F.coalesce(F.last(whole, ignorenulls=True).over(before), F.lit(0.0))
                               .alias(f"__c{part}_{out}"))
        rows = rows.select("*", *carried)
        done = []
        for out, (c, s) in group.items():
            g = F.lit(decay(s))
            top = F.col(f"__p_{out}") + g * F.col(f"__cp_{out}")
            weight = F.col(f"__q_{out}") + g * F.col(f"__cq_{out}")
            done.append(F.when(F.col(c).isNotNull(), top / weight).alias(out))
        df = rows.select(*df.columns, *done)
    return df.select(*keep)


@windowed(lambda a: 2 * run_length(a["span"]))
def ewm_mean(df: DataFrame, cols: Sequence[str], span: float, *, key, order) -> DataFrame:
    """``{c}_ewm_{span}``: adjusted exponential mean; a null row gives null, weights use row offsets."""
    return ewm_columns(df, {f"{c}_ewm_{span:g}": (c, span) for c in cols}, key, order)
