"""Masking of sensitive fields and the keyword rule for message intent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import as_col

# A key that holds one of these words is masked.
SENSITIVE_WORDS = ("password", "secret", "token", "key", "credential", "authorization",
                   "cookie", "session", "api_key")
MASK = "***"

# First matching intent wins; horizon applies to forecasts only.
INTENT_WORDS: Mapping[str, Sequence[str]] = {
    "forecast": ("forecast", "prediction"),
    "explain": ("why", "explain"),
    "help": ("help",),
}
HORIZON_WORDS: Mapping[str, int] = {"week": 5, "tomorrow": 1}


def _is_sensitive(name: str, words: Sequence[str]) -> bool:
    return any(w in name.lower() for w in words)


def _mask_field(c: Column, dtype: T.DataType, words: Sequence[str]) -> Column:
    """Mask inside nested structs, arrays and maps.

    A map entry with a sensitive key keeps its key; its value is the mask if values are
    strings and null otherwise, as a map's values share one type.
    """
    if isinstance(dtype, T.StructType):
        return F.struct(*[
            (F.lit(MASK) if _is_sensitive(f.name, words) else _mask_field(c[f.name], f.dataType, words)).alias(f.name)
            for f in dtype
        ])
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _mask_field(x, dtype.elementType, words))
    if isinstance(dtype, T.MapType):
        hit = "(?i)" + "|".join(words)
        mask = F.lit(MASK if isinstance(dtype.valueType, T.StringType) else None).cast(dtype.valueType)
        return F.transform_values(c, lambda k, v: F.when(k.cast("string").rlike(hit), mask)
                                  .otherwise(_mask_field(v, dtype.valueType, words)))
    return c


def mask_sensitive(df: DataFrame, words: Sequence[str] = SENSITIVE_WORDS) -> DataFrame:
    """Replace the value of every column, struct field or map key named like a secret."""
    return df.select(*[
        (F.lit(MASK) if _is_sensitive(f.name, words) else _mask_field(F.col(f"`{f.name}`"), f.dataType, words))
        .alias(f.name)
        for f in df.schema
    ])


def _any_word(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def message_intent(df: DataFrame, text_col: str, intents: Mapping[str, Sequence[str]] = INTENT_WORDS,
                   horizons: Mapping[str, int] = HORIZON_WORDS) -> DataFrame:
    """Add ``intent`` and, for forecasts, ``horizon`` (default 1) by keyword."""
    text = F.lower(as_col(text_col))
    intent = F.lit("other")
    for name in reversed(list(intents)):
        intent = F.when(_any_word(text, intents[name]), F.lit(name)).otherwise(intent)
    horizon = F.lit(1)
    for word in reversed(list(horizons)):
        horizon = F.when(text.contains(word), F.lit(horizons[word])).otherwise(horizon)
    return (df.withColumn("intent", intent)
              .withColumn("horizon", F.when(F.col("intent") == "forecast", horizon)))
