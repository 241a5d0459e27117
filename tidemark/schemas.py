"""Declared schemas of the tables the package reads and writes."""

from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("data", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

CHECK = T.StructType([
    T.StructField("check_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])

FEATURES = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("feature_vector", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("feature_version", T.StringType()),
    T.StructField("feature_count", T.IntegerType()),
    T.StructField("is_complete", T.BooleanType()),
    T.StructField("quality_score", T.DoubleType()),
])

PREDICTIONS = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("prediction_date", T.DateType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("point_forecast", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("features_used", T.ArrayType(T.StringType())),
    T.StructField("model_version", T.StringType()),
])

MODELS = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("accuracy_score", T.DoubleType()),
    T.StructField("training_date", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
])

METRIC_EVENTS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])
