"""One window pass for many features.

Features register the lags and rolling aggregates they need by name; equal ones are shared
(a rolling count guards four statistics, a 10-row lag serves momentum and rate of change).
``run`` evaluates all of them in one Window node and then projects the features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import last_rows, series_window

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}


class WindowStage:
    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str]):
        self.df = df
        self.window = series_window(key, order)
        self._shared: dict[str, Column] = {}
        self._out: dict[str, Column] = {}

    def _share(self, name: str, make) -> Column:
        if name not in self._shared:
            self._shared[name] = make().alias(name)
        return F.col(name)

    def lag(self, c: str, n: int) -> Column:
        """The value ``n`` rows earlier."""
        return self._share(f"__lag_{n}_{c}", lambda: F.lag(c, n).over(self.window))

    def full(self, stat: str, c: str, n: int) -> Column:
        """Rolling ``stat`` of the last ``n`` rows, null until they hold ``n`` non-null values."""
        frame = last_rows(self.window, n)
        count = self._share(f"__count_{n}_{c}", lambda: F.count(c).over(frame))
        return F.when(count == n, self._share(f"__{stat}_{n}_{c}", lambda: STATS[stat](c).over(frame)))

    def add(self, name: str, feature: Column) -> None:
        self._out[name] = feature

    def run(self) -> DataFrame:
        if not self._out:
            return self.df
        return self.df.select("*", *self._shared.values()).select(
            *self.df.columns, *[c.alias(n) for n, c in self._out.items()])
