"""Cases that a plain reading of the data gets wrong."""

from tidemark.functions.text import mask_sensitive
from tidemark.operators.align import align_fanout
from tidemark.operators.forecast import champion_model
from tidemark.operators.joins import join_same_key
from tidemark.sources.feature_store import latest_predictions


def test_versions_are_numbers(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1, v, "m", float(i)) for i, v in enumerate(["1.10.0", "1.9.0", "1.2"])],
                               "series string, prediction_date string, horizon int, model_version string, model_name string, x double")
    assert latest_predictions(df).first()["model_version"] == "1.10.0"


def test_nan_is_no_champion(spark):
    df = spark.createDataFrame([(1, float("nan"), "2024-01-02", "bad", "1"), (1, 0.5, "2024-01-01", "good", "1")],
                               "horizon int, accuracy_score double, training_date string, model_name string, model_version string")
    assert champion_model(df, "2024-01-03").first()["model_name"] == "good"


def test_secrets_inside_arrays_and_maps(spark):
    df = spark.sql("select array(named_struct('password', 'x', 'a', 1)) as l, map('token', 7, 'n', 8) as m, map('a', named_struct('secret', 'x')) as s")
    r = mask_sensitive(df).first()
    assert r["l"][0]["password"] == "***" and r["l"][0]["a"] == 1
    assert r["m"] == {"token": None, "n": 8} and r["s"]["a"]["secret"] == "***"


def test_null_series_is_one_row(spark):
    many = spark.createDataFrame([(None, "2024-01-01", 1.0)], "series string, date string, x double")
    other = spark.createDataFrame([(None, "2024-01-01", 2.0)], "series string, date string, y double")
    assert align_fanout(("a", many), {"b": other}).count() == 1


def test_empty_key(spark):
    one = spark.range(3).toDF("a")
    assert join_same_key(one, spark.range(1).toDF("b"), []).count() == 3
    assert join_same_key(one, spark.range(0).toDF("b"), [], "left").count() == 3
