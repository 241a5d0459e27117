"""JSON documents in the five layouts of the sources, exploded to one row per observation.

A document is one JSON text: a line of a JSON-lines file, a whole file (``wholetext``), or a
string column. Arrays are exploded on executors; nothing is parsed on the driver. A whole file is one
value in one task, so large feeds are kept as JSON lines (``json_lines_reader``), which Spark splits.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_start


@dataclass(frozen=True)
class Layout:
    """Where the records sit in a document, their type, and how ``date`` is read."""

    schema: str
    records: str
    date: str
    monthly: bool = False
    pairs: tuple[str, ...] = ()


# Document layouts of the five sources.
LAYOUTS: Mapping[str, Layout] = {
    "cbn_rates": Layout(
        "data STRUCT<exchange_rates: ARRAY<STRUCT<date: STRING, currency: STRING, buying_rate: DOUBLE, "
        "selling_rate: DOUBLE, central_rate: DOUBLE, official_rate: DOUBLE, parallel_rate: DOUBLE>>>",
        "data.exchange_rates", "date"),
    "worldbank_reserves": Layout(
        "data ARRAY<STRUCT<date: STRING, reserves_usd: DOUBLE>>", "data", "date", monthly=True),
    "dmo_debt": Layout(
        "data STRUCT<monthly_debt_data: ARRAY<STRUCT<date: STRING, total_debt: DOUBLE, external_debt: DOUBLE, "
        "domestic_debt: DOUBLE, debt_servicing: DOUBLE>>>", "data.monthly_debt_data", "date", monthly=True),
    "eia_brent": Layout(
        "response STRUCT<data: STRUCT<series: ARRAY<STRUCT<data: ARRAY<ARRAY<STRING>>>>>>",
        "response.data.series[0].data", "date", pairs=("date", "price_usd")),
    "news_sentiment": Layout(
        "articles ARRAY<STRUCT<publishedAt: STRING, title: STRING, sentiment_score: DOUBLE, "
        "sentiment_label: STRING, relevance_score: DOUBLE>>", "articles", "publishedAt"),
}


def _date(text: Column, monthly: bool) -> Column:
    return month_start(text) if monthly else F.to_date(F.substring(text, 1, 10))


def explode_documents(df: DataFrame, text: str, layout: Layout, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record of every document in column ``text``, with a DATE ``date`` first."""
    doc = df.select(*keep, F.from_json(F.col(text), layout.schema).alias("doc"))
    return _observations(doc.select(*keep, F.explode(F.expr(f"doc.{layout.records}")).alias("rec")), layout, keep)


def explode_records(df: DataFrame, text: str, layout: Layout, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text in column ``text``, each a single record of ``layout`` without the document around it."""
    whole = df.sparkSession.createDataFrame([], layout.schema).select(F.expr(f"{layout.records}").alias("r"))
    record = whole.schema["r"].dataType.elementType
    rows = df.select(*keep, F.from_json(F.col(text), record).alias("rec")).where(F.col("rec").isNotNull())
    return _observations(rows, layout, keep)


def _observations(rows: DataFrame, layout: Layout, keep: tuple[str, ...]) -> DataFrame:
    if layout.pairs:
        day, number = layout.pairs
        return rows.select(*keep, _date(F.get("rec", 0), layout.monthly).alias(day),
                           F.get("rec", 1).try_cast("double").alias(number))
    names = [f.name for f in rows.schema["rec"].dataType if f.name != layout.date]
    return rows.select(*keep, _date(F.col(f"rec.{layout.date}"), layout.monthly).alias("date"),
                       *[F.col(f"rec.{n}").alias(n) for n in names])


def json_reader(layout: Layout):
    """Reader for a file or folder of JSON documents, one document per file, each read by one task."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        return explode_documents(spark.read.text(path, wholetext=True), "value", layout)

    return read


def json_lines_reader(layout: Layout, records: bool = False):
    """Reader for a file or folder of JSON lines; a large file is split over many tasks.

    A line is a document of ``layout``, or with ``records`` a single record of it. Blank and broken lines give no row.
    Below a folder of partitions ``day=YYYY-MM-DD`` the range given by the registry leaves out the folders of other days
    (of other months for a monthly layout) before any line is read; a folder's day is that of its records.
    """

    def read(spark: SparkSession, path: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
        lines = spark.read.text(path)
        if "day" in lines.columns and start is not None and end is not None:
            low = F.to_date(F.lit(str(start)))
            low = F.trunc(low, "month").cast("date") if layout.monthly else low
            high = F.to_date(F.lit(str(end)))
            lines = lines.where(F.col("day").cast("date").between(low, F.last_day(high) if layout.monthly else high))
        return (explode_records if records else explode_documents)(lines, "value", layout)

    return read
