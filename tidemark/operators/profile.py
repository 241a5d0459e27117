"""Column and table profiles. Wide frames are scanned once: one ``agg``, then a small unpivot."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import nan_to_null, safe_div
from tidemark.operators.quantiles import exact_quantiles


def per_column(df: DataFrame, cols: Sequence[str], facts: Mapping[str, object], *,
               key: Sequence[str] = ()) -> DataFrame:
    """One row per column (and key): ``facts`` maps a name to ``fn(column name) -> aggregate``."""
    one = df.groupBy(*key).agg(*[
        F.struct(*[fn(c).alias(n) for n, fn in facts.items()]).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s"))
                               for i, c in enumerate(cols)])).alias("r")
    return one.select(*key, rows).select(*key, "r.column", *[F.col(f"r.s.{n}").alias(n) for n in facts])


def melt_numbers(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., column, value) as double, NaN as null."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c).cast("double")).alias("value"))
                               for c in cols])).alias("r")
    return df.select(*keep, rows).select(*keep, "r.column", "r.value")


def _num(c: str) -> Column:
    return nan_to_null(F.col(c).cast("double"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``null_count``, ``total_count`` and ``null_ratio`` per column."""
    cols = list(cols or df.columns)
    out = per_column(df, cols, {"null_count": lambda c: F.count_if(F.col(c).isNull()),
                                "total_count": lambda c: F.count(F.lit(1))})
    return out.withColumn("null_ratio", safe_div("null_count", "total_count"))


def completeness_score(df: DataFrame) -> DataFrame:
    """``1 - null cells / cells`` of the whole table."""
    cells = df.agg(F.count(F.lit(1)).alias("rows"),
                   sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("null_cells"))
    width = len(df.columns)
    return cells.select("rows", "null_cells",
                        F.when(F.col("rows") == 0, 0.0)
                        .otherwise(1 - safe_div("null_cells", F.col("rows") * width)).alias("completeness"))


def _row_key(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Grouping columns that tell rows apart without moving long texts.

    A text longer than a digest is replaced by its SHA-256; its length stays beside it, so a
    short text never equals a digest.
    """
    out = []
    for i, c in enumerate(cols):
        if isinstance(df.schema[c].dataType, T.StringType):
            size = F.octet_length(c)
            out += [size.alias(f"__n{i}"), F.when(size > 64, F.sha2(c, 256)).otherwise(F.col(c)).alias(f"__c{i}")]
        else:
            out.append(F.col(c).alias(f"__c{i}"))
    return out


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, and rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*_row_key(df, list(cols or df.columns))).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(cols or df.columns)).dropDuplicates()


def numeric_profile(df: DataFrame, cols: Sequence[str], *, key: Sequence[str] = ()) -> DataFrame:
    """Count, nulls, mean, sample std, min, max per column."""
    return per_column(df, cols, {
        "count": lambda c: F.count(_num(c)),
        "null_count": lambda c: F.count_if(F.col(c).isNull()),
        "mean": lambda c: F.avg(_num(c)),
        "std": lambda c: F.stddev_samp(_num(c)),
        "min": lambda c: F.min(_num(c)),
        "max": lambda c: F.max(_num(c)),
    }, key=key)


def iqr_fences(df: DataFrame, cols: Sequence[str], *, key: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Quartiles and ``q1 - k*iqr``, ``q3 + k*iqr`` per column (and key)."""
    q = exact_quantiles(melt_numbers(df, cols, key), "value", (0.25, 0.75), group=[*key, "column"],
                        names=("q1", "q3"), few_groups=not key)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*key, "column", "n", "q1", "q3", (F.col("q1") - k * iqr).alias("lower"),
                    (F.col("q3") + k * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Fences plus ``outliers``: values outside them, per column."""
    fences = iqr_fences(df, cols, k=k)
    # One row per column name: the table's width bounds the broadcast.
    hit = melt_numbers(df, cols).where(F.col("value").isNotNull()).join(F.broadcast(fences), "column")
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return hit.groupBy("column", "n", "q1", "q3", "lower", "upper").agg(F.count_if(out).alias("outliers"))


def skewness_profile(df: DataFrame, cols: Sequence[str], *, key: Sequence[str] = ()) -> DataFrame:
    """Population skewness per column; null for a constant column."""
    return per_column(df, cols, {"count": lambda c: F.count(_num(c)),
                                 "skewness": lambda c: F.skewness(_num(c))}, key=key)


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``is_constant`` (null counts as a value) and ``all_null`` from min, max and counts, no distinct."""
    out = per_column(df, cols, {
        "rows": lambda c: F.count(F.lit(1)),
        "null_count": lambda c: F.count_if(F.col(c).isNull()),
        "lo": lambda c: F.min(_num(c)),
        "hi": lambda c: F.max(_num(c)),
    })
    all_null = (F.col("null_count") == F.col("rows")) & (F.col("rows") > 0)
    same = (F.col("null_count") == 0) & (F.col("lo") == F.col("hi"))
    return out.select("column", "rows", "null_count", all_null.alias("all_null"),
                      (all_null | F.coalesce(same, F.lit(False))).alias("is_constant"))


def _as_text(df: DataFrame, c: str) -> Column:
    """A value's text: equal exactly for equal values of the column."""
    if df.schema[c].dataType.typeName() in ("float", "double"):
        return (F.col(c) + F.lit(0.0)).cast("string")  # zeros of both signs are one value
    if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return F.col(c).cast("string")


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``distinct_count`` per column, null as a value of its own.

    Exact counts take two levels: equal (column, value) pairs first, which combines before the shuffle and parts a
    column over all tasks, then pairs per column; texts beyond 64 bytes travel as their SHA-256, marked as such. With ``exact=False`` one
    pass keeps a HyperLogLog sketch of 4,096 registers per column and task; the estimate is within 5 % (three standard errors).
    """
    cols = list(cols or df.columns)
    if not exact:
        sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(_as_text(df, c), F.lit(12)))
        return per_column(df, cols, {"distinct_count": lambda c: F.coalesce(sketch(c), F.lit(0).cast("bigint")) + F.bool_or(F.col(c).isNull()).cast("bigint")}
                          ).select("column", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"))
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in cols])).alias("r")).select("r.*")
    long = F.octet_length("value") > 64
    pairs = pairs.select("column", long.alias("long"), F.when(long, F.sha2("value", 256)).otherwise(F.col("value")).alias("value")).distinct()
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    # One row per column; a column of an empty frame has no pair.
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select("column", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Values by row and column; null, NaN and infinity as NaN."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
    return np.where(np.isfinite(x), x, np.nan)


def _column_ranges(rows: DataFrame, k: int) -> DataFrame:
    """(i, n, mean, lo, hi) of the finite values of each column and task; a column without any gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, low, high = np.zeros(k), np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = _matrix(batch.slice(at, step))
                n = np.isfinite(x).sum(axis=0)
                total = np.maximum(count + n, 1)
                mean = mean * (count / total) + np.nansum(x / total, axis=0)
                count += n
                low, high = np.fmin(low, np.fmin.reduce(x, axis=0)), np.fmax(high, np.fmax.reduce(x, axis=0))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at].astype(np.int64)), *[pa.array(v[at]) for v in (mean, low, high)]], names=["i", "n", "mean", "lo", "hi"])

    step = max(1, (1 << 22) // k)
    return rows.mapInArrow(run, "i long, n long, mean double, lo double, hi double")


# Sums of a pair of columns over the rows where both have a value.
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
# Up to this many columns the moments of a task are a few kilobytes; beyond, sums travel as square blocks of columns.
NARROW = 32
BLOCK = 128
# Tasks that may send blocks, and groups that add them up before the last sum.
SENDERS = 512
ADDERS = 16


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count, mean and second moment of column i, and co-moment, over the rows where columns i and j have values.

    Values are taken relative to one of them near the mean; columns beyond 2^300 are scaled by a power of two,
    whose exponents come second.
    """
    has = np.isfinite(x)
    values = np.where(has, x, 0.0)
    power = np.frexp(np.abs(values).max(axis=0, initial=0.0))[1]
    power = np.where(np.abs(power) > 300, power, 0)
    values = np.ldexp(values, -power)
    m = has.astype(float)
    far = np.where(has, np.abs(values - values.sum(axis=0) / np.maximum(m.sum(axis=0), 1)), np.inf)
    shift = values[far.argmin(axis=0), np.arange(x.shape[1])] if len(x) else np.zeros(x.shape[1])
    values = np.where(has, values - shift, 0.0)
    n, s, q, c = m.T @ m, values.T @ m, (values * values).T @ m, values.T @ values
    some = np.maximum(n, 1)
    return np.stack([n, shift[:, None] + s / some, np.maximum(0, q - s * s / some), c - s * s.T / some]), power


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The moments of two sets of rows together."""
    # a column of zeros only has no exponent to say
    power = np.where(np.abs(a[1]) > np.abs(b[1]), a[1], b[1])
    (n1, mean1, m1, c1), (n2, mean2, m2, c2) = (_rescaled(*one, power) for one in (a, b))
    n = n1 + n2
    share, weight, d = n2 / np.maximum(n, 1), n1 * n2 / np.maximum(n, 1), np.where((n1 > 0) & (n2 > 0), mean2 - mean1, 0.0)
    return np.stack([n, np.where(n1 > 0, mean1 + d * share, mean2), m1 + m2 + weight * d * d, c1 + c2 + weight * d * d.T]), power


def _rescaled(moments: np.ndarray, power: np.ndarray, to: np.ndarray) -> np.ndarray:
    if (power == to).all():
        return moments
    by = power - to
    return np.stack([moments[0], np.ldexp(moments[1], by[:, None]), np.ldexp(moments[2], 2 * by[:, None]), np.ldexp(moments[3], by[:, None] + by)])


def _narrow_pairs(rows: DataFrame, cols: Sequence[str]) -> list[tuple[str, str, float | None]]:
    """All pairs from one scan: each task sends the moments of its rows, and the driver merges those of at most SENDERS tasks."""
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            one = _moments(_matrix(batch))
            total = one if total is None else _merged(total, one)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"moments": [total[0].tobytes()], "power": [total[1].astype(np.int64).tobytes()]})

    total = None
    for r in rows.coalesce(SENDERS).mapInArrow(run, "moments binary, power binary").collect():
        one = np.frombuffer(r["moments"]).reshape(4, k, k), np.frombuffer(r["power"], np.int64)
        total = one if total is None else _merged(total, one)
    if total is None:
        return [(cols[i], cols[j], None) for i in range(k) for j in range(i + 1, k)]
    n, mean, m, c = total[0]
    varies = m > 1e-28 * n * mean * mean
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip(c / np.sqrt(m) / np.sqrt(m.T), -1.0, 1.0)
    return [(cols[i], cols[j], float(r[i, j]) if n[i, j] > 1 and varies[i, j] and varies[j, i] else None) for i in range(k) for j in range(i + 1, k)]


def _block_sums(rows: DataFrame, k: int, low: int, high: int, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(bi, bj, part, sums): one row per task and pair of column blocks with low <= BLOCK * bi < high and bi <= bj.

    A task adds its rows up as products of matrices; ``sums`` holds the six matrices of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows = np.zeros((6, high - low, k - low)), False
        for batch in batches:
            any_rows = any_rows or batch.num_rows > 0
            for at in range(0, batch.num_rows, step):
                x = _matrix(batch.slice(at, step))[:, low:]
                has = np.isfinite(x)
                x = np.where(has, (x - shift[low:]) / scale[low:], 0.0)
                m, xx = has.astype(float), x * x
                left = slice(0, high - low)
                for out, p, q in zip(sums, (m, x, m, xx, m, x), (m, m, x, m, xx, x), strict=True):
                    out += p[:, left].T @ q
        if not any_rows:
            return
        part = TaskContext.get().partitionId() % ADDERS
        for i in range(low, high, BLOCK):
            for j in range(i, k, BLOCK):
                block = sums[:, i - low : min(i + BLOCK, high) - low, j - low : j - low + BLOCK]
                yield pa.RecordBatch.from_pylist([{"bi": i // BLOCK, "bj": j // BLOCK, "part": part, "sums": block.tobytes()}], schema=schema)

    schema = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
    step = max(1, (1 << 22) // k)
    return rows.mapInArrow(run, "bi int, bj int, part int, sums binary")


def _added(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks with equal keys added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, sums in zip(*[batch[c].to_pylist() for c in keys], batch["sums"], strict=True):
                one = np.frombuffer(sums.as_buffer())
                total[tuple(key)] = total[tuple(key)] + one if tuple(key) in total else one
        for key, sums in total.items():
            yield pa.RecordBatch.from_pylist([{**dict(zip(keys, key, strict=True)), "sums": sums.tobytes()}], schema=schema)

    schema = pa.schema([*[(c, pa.int32()) for c in keys], ("sums", pa.binary())])
    # A task holds the blocks of its keys: some of the fixed number of blocks, whatever the rows.
    return blocks.repartition(*keys).mapInArrow(run, ", ".join(f"{c} int" for c in keys) + ", sums binary")


def _pair_rows(blocks: DataFrame, k: int) -> DataFrame:
    """(i, j, sums...) for i < j, from whole blocks; a block without sums has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, sums in zip(batch["bi"].to_pylist(), batch["bj"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                high, wide = min(BLOCK, k - bi * BLOCK), min(BLOCK, k - bj * BLOCK)
                x = np.zeros((6, high, wide)) if sums is None else np.frombuffer(sums).reshape(6, high, wide)
                i, j = np.nonzero(np.arange(bi * BLOCK, bi * BLOCK + high)[:, None] < np.arange(bj * BLOCK, bj * BLOCK + wide))
                yield pa.RecordBatch.from_arrays([pa.array(i + bi * BLOCK), pa.array(j + bj * BLOCK), *[pa.array(m[i, j]) for m in x]], names=["i", "j", *_SUMS])

    return blocks.mapInArrow(run, "i long, j long, " + ", ".join(f"{s} double" for s in _SUMS))


def correlation_pairs(df: DataFrame, cols: Sequence[str], width: int = 1024, narrow: int = NARROW) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair; null when a side is constant.

    Infinite values count as missing, as NaN does. Up to ``narrow`` columns take one scan, and the driver
    merges one row of moments per task. Wider
    frames are scanned for their columns' means (one row a column to the driver), then, once per ``width``
    columns, at most ``SENDERS`` tasks add up matrices of sums, relative to the mean, and send one binary row per block of
    columns; ``ADDERS`` groups and then one per block add those up, and pairs become rows at the very end. What is shuffled
    grows with the columns, not with the rows or the splits. There, a side that varies on the rows of
    a pair by less than 1e-13 of its squared distance from the mean counts as constant.
    """
    k, spark = len(cols), df.sparkSession
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    if k <= narrow:
        return spark.createDataFrame(_narrow_pairs(rows, cols), "feature1 string, feature2 string, correlation double")
    # One row per column: the table's width bounds what is collected.
    facts = _column_ranges(rows, k).groupBy("i").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
                                                     F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    mean, lo, hi = (np.full(k, np.nan) for _ in range(3))
    for f in facts:
        mean[f["i"]], lo[f["i"]], hi[f["i"]] = f["mean"], f["lo"], f["hi"]
    shift = np.where(np.isfinite(mean), mean, 0.0)
    far = np.fmax(np.abs(hi / 2 - shift / 2), np.abs(lo / 2 - shift / 2)) * 2
    scale = np.where(np.isfinite(far) & (far > 0), far, 1.0)
    # Pairs of an empty frame are kept too, with a null: every pair of blocks is there once without sums.
    many = -(-k // BLOCK)
    width = max(BLOCK, width // BLOCK * BLOCK)
    named = spark.createDataFrame([(i, j, None) for i in range(many) for j in range(i, many)], "bi int, bj int, sums binary")
    blocks = None
    for low in range(0, k, width):
        one = _block_sums(rows.coalesce(SENDERS), k, low, min(k, low + width), shift, scale)
        blocks = one if blocks is None else blocks.unionByName(one)
    added = _added(_added(blocks, "bi", "bj", "part"), "bi", "bj")
    per = _pair_rows(named.select("bi", "bj").join(added, ["bi", "bj"], "left"), k)
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = (F.when(F.col(f"s{s}{s}") - F.col(f"s{s}") ** 2 / n > 1e-13 * F.col(f"s{s}{s}"), F.col(f"s{s}{s}") - F.col(f"s{s}") ** 2 / n)
              for s in ("x", "y"))
    r = F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx) / F.sqrt(vy))
    # One row per column: the table's width bounds the broadcast.
    names = spark.createDataFrame(list(enumerate(cols)), "at long, name string")
    out = per.select("i", "j", F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias("correlation"))
    for at, name in (("i", "feature1"), ("j", "feature2")):
        out = out.join(F.broadcast(names.select(F.col("at").alias(at), F.col("name").alias(name))), at)
    return out.select("feature1", "feature2", "correlation")


def count_per_source(raw: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Rows of each source; a null source is a group of its own."""
    return raw.groupBy(*by).agg(F.count(F.lit(1)).alias("records"))


def latest_per_source(raw: DataFrame, by: Sequence[str] = ("source",), only: Sequence[str] | None = None) -> DataFrame:
    """Newest date and newest ingest of each source, or of the sources in ``only`` (a filter that reaches the scan)."""
    rows = raw if only is None else raw.where(F.col("source").isin(*only))
    return rows.groupBy(*by).agg(F.max("date").alias("latest_date"), F.max("ingested_at").alias("latest_ingest"))


def source_coverage(raw: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Rows, first and last date of each source."""
    return raw.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.min("date").alias("earliest"), F.max("date").alias("latest"))


def duplicate_keys(raw: DataFrame, key: Sequence[str] = ("source", "date")) -> DataFrame:
    """Keys that several rows share, with the number of rows. Counts combine before the shuffle, so a hot key sends one row a task."""
    return count_per_source(raw, key).where(F.col("records") > 1)


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``n`` rows per (column, category); null is a category."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category"))
                               for c in cols])).alias("r")
    return df.select(rows).groupBy("r.column", "r.category").agg(F.count(F.lit(1)).alias("n"))


def category_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct categories, largest and smallest group, and the two warning flags."""
    per = category_counts(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.max("n").alias("max_count"), F.min("n").alias("min_count"))
    return per.withColumns({
        "high_cardinality": F.col("unique_values") > F.col("rows") * 0.5,
        "imbalanced": (F.col("unique_values") > 1) & (F.col("max_count") > F.col("min_count") * 10),
    })


def category_top(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent categories per column, ties by name. Spark cuts to k before the shuffle."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("category"))
    ranked = category_counts(df, cols).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def sparse_columns(df: DataFrame, limit: float = 0.3) -> DataFrame:
    return null_profile(df).where(F.col("null_ratio") > limit)


def drop_sparse_columns(df: DataFrame, limit: float = 0.3, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns with more than ``limit`` nulls. Runs one aggregate; its result is one row per column."""
    gone = {r["column"] for r in sparse_columns(df, limit).collect()} - set(keep)
    return df.drop(*gone)


# Feature families by name part, first match wins.
FAMILIES = {"lag": ("lag",), "rolling": ("rolling",), "technical": ("rsi", "macd", "bb_"),
            "sentiment": ("sentiment",)}


def feature_families(vectors: DataFrame, name: str = "feature") -> DataFrame:
    """Distinct feature names and values per family, from a long feature table."""
    family = F.lit("base")
    for f in reversed(list(FAMILIES)):
        hit = F.lit(False)
        for part in FAMILIES[f]:
            hit = hit | F.col(name).contains(part)
        family = F.when(hit, F.lit(f)).otherwise(family)
    per = vectors.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("features"), F.sum("n").alias("values"))
