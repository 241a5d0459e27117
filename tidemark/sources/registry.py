"""Named sources: fields, required fields, expected ranges, and reader functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# JSON fields of each source, with their types.
SOURCE_FIELDS: Mapping[str, str] = {
    "cbn_rates": "buying_rate DOUBLE, selling_rate DOUBLE, central_rate DOUBLE, official_rate DOUBLE, "
                 "parallel_rate DOUBLE",
    "worldbank_reserves": "reserves_usd DOUBLE",
    "dmo_debt": "total_debt DOUBLE, external_debt DOUBLE, domestic_debt DOUBLE, debt_servicing DOUBLE",
    "eia_brent": "price_usd DOUBLE",
    "news_sentiment": "sentiment_score DOUBLE, sentiment_label STRING, relevance_score DOUBLE",
}

# Fields that must be present in every recent row of a source.
REQUIRED_FIELDS: Mapping[str, tuple[str, ...]] = {
    "cbn_rates": ("date", "currency", "official_rate"),
    "worldbank_reserves": ("date", "reserves_usd"),
    "dmo_debt": ("date", "total_debt", "external_debt", "domestic_debt"),
    "eia_brent": ("date", "price_usd"),
    "news_sentiment": ("date", "title", "sentiment_score"),
}

# Fields that tell the observations of one day apart.
ITEM_FIELDS: Mapping[str, tuple[str, ...]] = {"cbn_rates": ("currency",), "news_sentiment": ("title",)}

# Expected range of the numbers of each source.
EXPECTED_RANGES: Mapping[str, tuple[float, float]] = {
    "cbn_rates": (100.0, 2000.0),
    "eia_brent": (20.0, 200.0),
    "worldbank_reserves": (1e9, 1e12),
    "dmo_debt": (1e12, 1e15),
    "news_sentiment": (-1.0, 1.0),
}

Reader = Callable[..., DataFrame]


@dataclass
class Registry:
    """Readers by source name. A reader returns a frame with a ``date`` and maybe a ``series`` column.

    It takes (spark, path), or (spark, path, start, end) if it can leave out other dates while reading.

    ``items`` names, for a source with several observations a day, the fields that tell them
    apart. A source that has none keeps the newest row of each (series, date).
    """

    readers: dict[str, Reader] = field(default_factory=dict)
    items: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ITEM_FIELDS))

    def add(self, name: str, reader: Reader, item: tuple[str, ...] | None = None) -> "Registry":
        self.readers[name] = reader
        if item is not None:
            self.items[name] = item
        return self

    def fetch(self, spark: SparkSession, name: str, path: str, start: date | str, end: date | str) -> DataFrame:
        """Rows of one source with ``start <= date <= end``; an unknown name is an error."""
        if name not in self.readers:
            raise ValueError(f"unknown source {name!r}; known: {sorted(self.readers)}")
        reader = self.readers[name]
        ranged = {"start", "end"} <= set(inspect.signature(reader).parameters)
        rows = reader(spark, path, start=start, end=end) if ranged else reader(spark, path)
        return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
