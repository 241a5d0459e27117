"""Feature vectors as a map column: pack, write, read back; prediction and model tables; reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import FEATURES, MODELS, PREDICTIONS


def pack_features(df: DataFrame, cols: Sequence[str], version: str = "1.0.0",
                  quality_score: float | Column = 1.0) -> DataFrame:
    """One vector per (series, date) with the non-null ``cols``; flags count as 0 and 1."""
    names = F.array(*[F.lit(c) for c in cols])
    values = F.array(*[F.col(c).cast("double") for c in cols])
    score = F.lit(quality_score) if not isinstance(quality_score, Column) else quality_score
    packed = df.select(
        "series", "date",
        F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull()).alias("feature_vector"))
    return packed.select(
        "series", "date", "feature_vector", F.lit(version).alias("feature_version"),
        F.size("feature_vector").alias("feature_count"),
        (F.size("feature_vector") == len(cols)).alias("is_complete"), score.cast("double").alias("quality_score"))


def vector_keys(store: DataFrame) -> list[str]:
    """Feature names in the store: bounded by the feature spec, so safe to collect."""
    keys = store.select(F.explode(F.map_keys("feature_vector")).alias("k")).distinct()
    return sorted(r["k"] for r in keys.collect())


def latest_features(store: DataFrame, n_days: int = 30, *, as_of: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Vectors of the ``n_days`` up to ``as_of`` as columns (union of keys), newest first."""
    end = F.to_date(F.lit(as_of))
    recent = store.where(F.col("date").between(F.date_sub(end, n_days), end))
    names = list(keys) if keys is not None else vector_keys(recent)
    return recent.select("series", "date", *[F.try_element_at("feature_vector", F.lit(k)).alias(k) for k in names]
                         ).orderBy(F.desc("date"), "series")


def _write(df: DataFrame, schema: T.StructType, path: str, by: Sequence[str], mode: str, order: Sequence[str]) -> None:
    """Rows of a file are in ``order``, so a reader of a few dates skips row groups by their statistics; no shuffle is added."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).sortWithinPartitions(*by, *order)
    typed.write.mode(mode).partitionBy(*by).parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "append") -> None:
    _write(df, FEATURES, path, ("feature_version",), mode, ("date", "series"))


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    _write(df, PREDICTIONS, path, ("horizon",), mode, ("prediction_date", "series"))


def write_models(df: DataFrame, path: str, mode: str = "append") -> None:
    _write(df, MODELS, path, ("horizon",), mode, ("training_date",))


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """One prediction per (series, date, horizon): the highest model version.

    Versions are compared by the numbers in them, in order (1.10.0 is above 1.9.0), then as text.
    """
    from tidemark.sources.raw_store import latest_wins

    numbers = F.transform(F.regexp_extract_all("model_version", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    return latest_wins(predictions.withColumn("__version", numbers), key=("series", "prediction_date", "horizon"),
                       newest="__version", tiebreak=("model_version", "model_name")).drop("__version")


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)
