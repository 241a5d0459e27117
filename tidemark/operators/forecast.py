"""Batch forecasts, attributions, labels, splits and model selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import HALO, block_key, merge_blocks, one_per_day, series_window, windowed
from tidemark.operators.joins import join_same_key
from tidemark.operators.profile import ADDERS, SENDERS
from tidemark.sources.workdir import stage

HORIZONS = (1, 2, 3, 4, 5)


def naive_forecast(df: DataFrame, value: str, horizons: Sequence[int] = HORIZONS, *, key: Sequence[str], order: str,
                   drift: float = 0.5, margin: float = 0.02, noise: float = 0.0, seed: int = 42,
                   model_version: str = "drift-1.0") -> DataFrame:
    """Latest value plus ``drift`` per day ahead, with a relative interval; optional uniform noise."""
    last = df.where(F.col(value).isNotNull()).groupBy(*key).agg(
        F.max(order).alias("prediction_date"), F.max_by(value, order).alias("latest"))
    rows = last.select(*key, "prediction_date", "latest",
                       F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    point = F.col("latest") + F.col("horizon") * F.lit(drift)
    if noise:
        point = point + (F.rand(seed) * 2 - 1) * noise
    rows = rows.withColumn("point", point)
    return rows.select(*key, "prediction_date", "horizon", F.round("point", 2).alias("point_forecast"),
                       F.round(F.col("point") * (1 - margin), 2).alias("lower_bound"),
                       F.round(F.col("point") * (1 + margin), 2).alias("upper_bound"),
                       F.lit(0.8).alias("confidence"), F.lit(model_version).alias("model_version"))


def forecast_requests(requests: DataFrame, horizon: str = "horizon", lo: int = 1, hi: int = 5) -> DataFrame:
    """Mark each request as valid or rejected by its horizon."""
    ok = F.coalesce(F.col(horizon).between(lo, hi), F.lit(False))
    return requests.withColumns({"is_valid": ok, "error": F.when(~ok, F.lit(f"horizon must be {lo} to {hi}"))})


def top_contributions(df: DataFrame, coefs: Mapping[str, float], k: int = 10, *, key: Sequence[str],
                      order: str) -> DataFrame:
    """The ``k`` largest ``coef * (x - series mean)`` per row, with sign."""
    names = list(coefs)
    means = df.groupBy(*key).agg(*[F.avg(c).alias(f"__m_{c}") for c in names])
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"__m_{c}")) * F.lit(float(coefs[c]))).alias("contribution"))
        for c in names])).alias("r")
    long = join_same_key(df, means, list(key)).select(*key, order, parts).select(*key, order, "r.*").where(
        F.col("contribution").isNotNull())
    # Groups are one row's features, so they are as small as the feature list.
    w = Window.partitionBy(*key, order).orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("direction", F.when(F.col("contribution") < 0, "negative").otherwise("positive"))


@windowed(lambda a: 0, ahead=lambda a: max(a["horizons"]))
def horizon_labels(df: DataFrame, col: str, horizons: Sequence[int] = HORIZONS, *, key, order) -> DataFrame:
    """``{col}_t_plus_{h}``: the value ``h`` rows later in the series."""
    w = series_window(key, order)
    return df.select("*", *[F.lead(col, h).over(w).alias(f"{col}_t_plus_{h}") for h in horizons])


def temporal_split(df: DataFrame, val: float = 0.2, test: float = 0.1, *, key: Sequence[str], order: str) -> DataFrame:
    """``split``: oldest rows train, then val, newest test, per series by relative rank of ``order``.

    Ranks come from row counts per (series, day) joined back, so the window holds one row
    per day whatever the number of rows.
    """
    days = one_per_day(df.groupBy(*key, order).agg(F.count(F.lit(1)).alias("__n")))
    by = block_key(days, key)
    before = F.sum("__n").over(series_window(by, order)) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy(*by))
    rank = F.coalesce(before / F.nullif(total - 1, F.lit(0)), F.lit(0.0))
    split = F.when(rank < 1 - val - test, "train").when(rank < 1 - test, "val").otherwise("test")
    cuts = days.select(*key, order, split.alias("split"))
    return join_same_key(df, cuts, [*key, order])


def champion_model(models: DataFrame, as_of: str, stale_hours: float = 48.0, metric: str = "accuracy_score") -> DataFrame:
    """Best model per horizon (ties: newest, then name) and whether its training is stale. NaN counts as no score."""
    best = models.withColumn(metric, F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))).groupBy("horizon").agg(
        F.max(F.struct(metric, "training_date", "model_name", "model_version")).alias("m")).select("horizon", "m.*")
    hours = (F.unix_micros(F.to_timestamp(F.lit(as_of))) -
             F.unix_micros(F.col("training_date").cast("timestamp"))) / F.lit(3.6e9)
    return best.withColumns({"hours_old": hours, "is_stale": hours > stale_hours})


@windowed(lambda a: 0, ahead=lambda a: max(a["horizons"]))
def _regression_rows(df: DataFrame, features: Sequence[str], label: str, horizons: Sequence[int], train: Column, test: Column, *,
                     key, order) -> DataFrame:
    """Features ``x0``..., labels ``y0``... and the two row conditions, under names of their own."""
    w = series_window(key, order)
    return df.select(*[c for c in ("__block", HALO) if c in df.columns], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                     *[F.lead(F.col(label).cast("double"), h).over(w).alias(f"y{i}") for i, h in enumerate(horizons)],
                     *[F.coalesce(c, F.lit(False)).alias(n) for n, c in (("train", train), ("test", test))])


def horizon_regression(df: DataFrame, features: Sequence[str], label: str, horizons: Sequence[int] = HORIZONS, *,
                       key: Sequence[str], order: str, train: Column | None = None, test: Column | None = None,
                       l2: float = 0.0) -> DataFrame:
    """One linear model per horizon, fitted on the rows of ``train`` and scored on those of ``test`` (both all rows by default).

    One pass: each task adds up count, means and co-moments of (features, label) per horizon and part, two levels of merges
    bring them together, and every horizon is solved and scored from its own matrices. Nothing is collected, and what is
    shuffled is bounded by ``SENT_BYTES``, whatever the rows. A row counts for a horizon if its features and
    that label are finite. Labels are the values ``h`` rows later in the whole series, so a condition does not cut them.

    Columns: horizon, rows, test_rows, train_rmse, rmse, r2 (the last two of the test rows, null without any; r2 also where the
    label does not vary), intercept, ``coef_{feature}``. Without training rows the fitted values are null. A constant
    feature has coefficient 0, and among collinear ones the smallest standardised coefficients are taken. ``l2`` adds a ridge penalty on
    standardised coefficients. As errors come from moments, an RMSE below about 1e-7 of the label's spread is not resolved.
    """
    everything = F.lit(True)
    rows = _regression_rows(df, features, label, horizons, everything if train is None else train, everything if test is None else test,
                            key=key, order=order)
    rows = merge_blocks(rows)
    fits = _solved(_horizon_moments(rows, len(features), len(horizons)), len(features), l2)
    # One row per horizon, so the broadcast is as small as the declared list.
    asked = df.sparkSession.createDataFrame(list(enumerate(horizons)), "at int, horizon int")
    out = asked.join(F.broadcast(fits), "at", "left")
    count = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("rows", "test_rows")]
    return out.select("horizon", *count, "train_rmse", "rmse", "r2", "intercept", *[F.get("coef", i).alias(f"coef_{n}") for i, n in enumerate(features)])


# Bytes of matrices that all tasks together may send; a small table has far fewer tasks than this allows.
SENT_BYTES = 1 << 35
_MOMENTS = "at int, test boolean, adder int, moments binary"


def _pooled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together. Row 0 holds the count, row 1 the means, the others the co-moments."""
    n, d = a[0, 0] + b[0, 0], b[1] - a[1]
    out = a + b
    out[1] = a[1] + d * (b[0, 0] / n)
    out[2:] += np.outer(d, d) * (a[0, 0] * b[0, 0] / n)
    return out


def _merge_rows(batches: Iterator[pa.RecordBatch], width: int, keys: Callable[[int, bool, int], tuple]) -> dict[tuple, np.ndarray]:
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for at, test, adder, binary in zip(*[batch[c].to_pylist() for c in ("at", "test", "adder")], batch["moments"], strict=True):
            one, k = np.frombuffer(binary.as_buffer()).reshape(width + 2, width), keys(at, test, adder)
            total[k] = _pooled(total[k], one) if k in total else one
    return total


def _moment_batch(at: int, test: bool, adder: int, moments: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("at", pa.int32()), ("test", pa.bool_()), ("adder", pa.int32()), ("moments", pa.binary())])
    return pa.RecordBatch.from_pylist([{"at": at, "test": test, "adder": adder, "moments": moments.tobytes()}], schema=schema)


def _horizon_moments(rows: DataFrame, k: int, many: int) -> DataFrame:
    """(at, test, adder, moments): features and label of each horizon and part, added up in ``ADDERS`` groups of tasks."""
    width = k + 1
    step = max(1, (1 << 21) // (k + many))
    senders = max(SENDERS, SENT_BYTES // (2 * many * 8 * (width + 2) * width))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                piece = batch.slice(begin, step)
                z = np.column_stack([piece[i].to_numpy(zero_copy_only=False) for i in range(k + many)]).astype(float)
                fine = np.isfinite(z)
                whole = fine[:, :k].all(axis=1)
                for name in ("train", "test"):
                    wanted = whole & piece[name].to_numpy(zero_copy_only=False)
                    for h in range(many):
                        mine = wanted & fine[:, k + h]
                        n = int(mine.sum())
                        if not n:
                            continue
                        v = np.column_stack([z[mine, :k], z[mine, k + h]])
                        mean = v.mean(axis=0)
                        v -= mean
                        one = np.vstack([np.full(width, float(n)), mean, v.T @ v])
                        at = h, name == "test"
                        total[at] = _pooled(total[at], one) if at in total else one
        adder = TaskContext.get().partitionId() % ADDERS
        for (h, test), one in total.items():
            yield _moment_batch(h, test, adder, one)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, test, adder), one in _merge_rows(batches, width, lambda *key: key).items():
            yield _moment_batch(at, test, adder, one)

    ordered = rows.select(*[f"x{i}" for i in range(k)], *[f"y{h}" for h in range(many)], "train", "test")
    return ordered.coalesce(senders).mapInArrow(gather, _MOMENTS).repartition("at", "test", "adder").mapInArrow(add, _MOMENTS)


def _solved(moments: DataFrame, k: int, l2: float) -> DataFrame:
    """(at, rows, test_rows, train_rmse, rmse, r2, intercept, coef) of each horizon that has rows."""
    width = k + 1
    schema = pa.schema([("at", pa.int32()), ("rows", pa.int64()), ("test_rows", pa.int64()), *[(c, pa.float64()) for c in
                        ("train_rmse", "rmse", "r2", "intercept")], ("coef", pa.list_(pa.float64()))])

    def error(m: np.ndarray, intercept: float, coef: np.ndarray) -> float:
        """Mean squared error of a model on the rows of ``m``."""
        edge = np.append(-coef, 1.0)
        return max(0.0, edge @ (m[2:] / m[0, 0]) @ edge) + (edge @ m[1] - intercept) ** 2

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _merge_rows(batches, width, lambda at, test, adder: (at, test))
        for at in {at for at, _ in total}:
            fit, held = total.get((at, False)), total.get((at, True))
            row = {c: None for c in schema.names} | {"at": at, "rows": 0 if fit is None else int(fit[0, 0]), "test_rows": 0 if held is None else int(held[0, 0])}
            if fit is not None:
                cov = fit[2:] / fit[0, 0]
                spread = np.sqrt(np.diag(cov)[:k])
                varies = spread > 1e-14 * np.abs(fit[1, :k])
                unit = np.where(varies, spread, 1.0)
                x = np.where(np.outer(varies, varies), cov[:k, :k] / np.outer(unit, unit), 0.0)
                coef = np.linalg.pinv(x + l2 * np.diag(varies.astype(float)), rcond=1e-12, hermitian=True) @ np.where(varies, cov[:k, k] / unit, 0.0) / unit
                intercept = float(fit[1, k] - fit[1, :k] @ coef)
                row |= {"train_rmse": error(fit, intercept, coef) ** 0.5, "intercept": intercept, "coef": coef.tolist()}
                if held is not None:
                    mse, var = error(held, intercept, coef), held[width + 1, k] / held[0, 0]
                    row |= {"rmse": mse ** 0.5, "r2": 1 - mse / var if var > 0 else None}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return moments.repartition("at").mapInArrow(solve, "at int, rows long, test_rows long, train_rmse double, rmse double, r2 double, "
                                                       "intercept double, coef array<double>")


def horizon_boosting(df: DataFrame, features: Sequence[str], label: str, horizons: Sequence[int] = HORIZONS, *,
                     key: Sequence[str], order: str, train: Column | None = None, test: Column | None = None,
                     trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """Boosted regression trees per horizon (``pyspark.ml``), for labels that are not linear: horizon, rows, test_rows, rmse, r2.

    Conditions, labels and scores are those of ``horizon_regression``. The labelled rows are written once, as every tree reads
    them; a horizon without training rows has null scores.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    everything = F.lit(True)
    rows = stage(merge_blocks(_regression_rows(df, features, label, horizons, everything if train is None else train,
                                               everything if test is None else test, key=key, order=order)))
    names = [f"x{i}" for i in range(len(features))]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    out = None
    for i, h in enumerate(horizons):
        def finite(c: str) -> Column:
            return F.coalesce(F.abs(c) < float("inf"), F.lit(False))

        mine = rows.where(reduce(lambda a, b: a & b, [finite(c) for c in (*names, f"y{i}")]))
        data = assembler.transform(mine).select("features", F.col(f"y{i}").alias("label"), "train", "test")
        fitted = data.where("train").agg(F.count(F.lit(1)).alias("rows"))
        known = fitted.first()["rows"]
        guess = data.where("test").withColumn("prediction", F.lit(None).cast("double"))
        if known:
            model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(data.where("train"))
            guess = model.transform(data.where("test"))
        off = F.avg(F.pow(F.col("label") - F.col("prediction"), 2))
        one = guess.agg(F.count(F.lit(1)).alias("test_rows"), F.sqrt(off).alias("rmse"),
                        (1 - off / F.nullif(F.var_pop("label"), F.lit(0.0))).alias("r2"))
        one = one.select(F.lit(h).alias("horizon"), F.lit(known).cast("bigint").alias("rows"), "test_rows", "rmse", "r2")
        out = one if out is None else out.unionByName(one)
    return out
