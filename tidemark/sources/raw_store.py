"""The raw table ``(source, series, date, data, ingested_at)``: scan, normalise, upsert, ingest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import join_same_key
from tidemark.schemas import RAW
from tidemark.sources.registry import ITEM_FIELDS, SOURCE_FIELDS, Registry
from tidemark.sources.workdir import stage

KEY = ("source", "series", "date")
PARTITIONS = ("source", "part")
# Partitions of one batch that become literal filters, and sources whose partition ranges do beyond that.
MAX_PARTS = 1000
MAX_SOURCES = 1000


def range_scan(raw: DataFrame, start: date | str, end: date | str,
               sources: Sequence[str] | None = None) -> DataFrame:
    """Rows dated ``start`` to ``end`` inclusive; both filters reach the Parquet reader."""
    out = raw.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.where(F.col("source").isin(*sources)) if sources else out


def normalise_raw(df: DataFrame, source: str | Column, ingested_at: Column | None = None,
                  series: str | Column | None = None) -> DataFrame:
    """Pack every row of a source frame into the raw layout, all columns as JSON text.

    Without ``series`` the frame's own column of that name is taken, and ``all`` if it has none.
    """
    src = F.lit(source) if isinstance(source, str) else source
    if series is None:
        series = F.coalesce(F.col("series").cast("string"), F.lit("all")) if "series" in df.columns else "all"
    ser = F.lit(series) if isinstance(series, str) else series
    return df.select(src.alias("source"), ser.alias("series"), F.col("date"),
                     F.to_json(F.struct("*")).alias("data"),
                     (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"))


def latest_wins(df: DataFrame, key: Sequence[str] = KEY, newest: str = "ingested_at",
                tiebreak: Sequence[str] = ("data",)) -> DataFrame:
    """One row per key, the newest. An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in (*key, newest, *tiebreak)]
    top = F.max(F.struct(newest, *tiebreak, *rest)).alias("__top")
    return df.groupBy(*key).agg(top).select(
        *[F.col(c) if c in key else F.col(f"__top.{c}").alias(c) for c in df.columns])


def extract_fields(raw: DataFrame, fields: Mapping[str, str] = SOURCE_FIELDS) -> dict[str, DataFrame]:
    """Typed frame per source: (series, date, fields...). A missing field is null."""
    out = {}
    for source, ddl in fields.items():
        mine = raw.where(F.col("source") == source)
        out[source] = mine.select("series", "date", F.from_json("data", ddl).alias("d")).select("series", "date", "d.*")
    return out


def extract_wide(raw: DataFrame, fields: Mapping[str, str] = SOURCE_FIELDS, how: str = "max") -> DataFrame:
    """All sources on one (series, date) grid as ``{source}_{field}``: one scan, one shuffle.

    Each row is parsed with its own source's fields and contributes only those columns;
    grouping by (series, date) then aligns the sources. Several rows per key reduce by
    ``how``: ``avg`` (numbers only, others by max) or ``max``. Numbers aggregate by hash;
    text would force a sort of all rows, so text fields are grouped apart, from the rows of
    their sources only, and joined on the same partitioning. A row without a date is no
    observation and is left out; one without a series belongs to the series ``all``.
    """
    parsed = [[part.split() for part in ddl.split(",")] for ddl in fields.values()]
    rows = raw.where(F.col("source").isin(*fields) & F.col("date").isNotNull()).select(
        "source", F.coalesce("series", F.lit("all")).alias("series"), "date", *[
        # Parsed once per row as a struct; the aggregates below only read its fields.
        F.when(F.col("source") == source, F.from_json("data", ddl)).alias(f"__doc{i}")
        for i, (source, ddl) in enumerate(fields.items())])
    numbers, texts, owners, names = [], [], [], []
    for i, source in enumerate(fields):
        for field, kind in parsed[i]:
            text = kind.upper() == "STRING"
            agg = F.avg if how == "avg" and kind.upper() == "DOUBLE" else F.max
            (texts if text else numbers).append(agg(F.col(f"__doc{i}.{field}")).alias(f"{source}_{field}"))
            names.append(f"{source}_{field}")
            owners += [source] if text else []
    # The count keeps days that have rows but no number.
    wide = rows.groupBy("series", "date").agg(F.count(F.lit(1)).alias("__rows"), *numbers)
    if texts:
        words = rows.where(F.col("source").isin(*owners)).groupBy("series", "date").agg(*texts)
        wide = wide.join(words, ["series", "date"], "left")
    return wide.select("series", "date", *names)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def _part(day: Column, grain: str) -> Column:
    """First day of the storage period of ``day``; ``grain`` is day, week, month, quarter or year."""
    return day if grain == "day" else F.trunc(day, grain)


def _item(items: Mapping[str, Sequence[str]]) -> Column:
    """What tells the observations of one key apart: the payload fields named for the source.

    A row that lacks one of them is an observation of its own, told by its whole payload.
    """
    out = F.lit(None).cast("string")
    for source, names in items.items():
        values = [F.get_json_object("data", f"$.{n}") for n in names]
        known = reduce(and_, [v.isNotNull() for v in values])
        out = F.when(F.col("source") == source, F.when(known, F.to_json(F.array(*values))).otherwise(F.col("data"))).otherwise(out)
    return out


def _touched(new: DataFrame) -> Column | None:
    """Literal filter for the partitions of ``new``: each of them while they are few, a range per source beyond, else none."""
    parts = new.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n")).limit(MAX_PARTS + 1).collect()
    if len(parts) <= MAX_PARTS:
        by_source: dict[str | None, list[date | None]] = {}
        for r in parts:
            by_source.setdefault(r["source"], []).append(r["part"])
        here = [F.col("source").eqNullSafe(F.lit(s)) & (F.col("part").isin([p for p in days if p is not None]) |
                                                        (F.col("part").isNull() if None in days else F.lit(False))) for s, days in by_source.items()]
        return reduce(or_, here, F.lit(False))
    ranges = new.groupBy("source").agg(F.min("part").alias("lo"), F.max("part").alias("hi"),
                                       F.count_if(F.col("part").isNull()).alias("undated")).limit(MAX_SOURCES + 1).collect()
    if len(ranges) > MAX_SOURCES:
        return None
    here = [(F.col("source").eqNullSafe(F.lit(r["source"]))) &
            ((F.col("part").between(F.lit(r["lo"]), F.lit(r["hi"])) if r["lo"] else F.lit(False)) |
             (F.col("part").isNull() if r["undated"] else F.lit(False))) for r in ranges]
    return reduce(or_, here, F.lit(False))


def upsert_raw(new: DataFrame, path: str, grain: str = "month", items: Mapping[str, Sequence[str]] | None = None,
               stored: Observation | None = None) -> None:
    """Merge ``new`` into the Parquet table at ``path``; newest row per key wins.

    A source with several observations a day (news, rates of several currencies) names in
    ``items`` the payload fields that tell them apart; by default those of ``registry.ITEM_FIELDS``. What tells a row
    apart is stored with it as ``item`` and always belongs to the key, so stored rows keep their
    own whatever a later caller passes. ``stored`` observes ``rows``, the number of
    rows of ``new`` that are in the table afterwards.

    The table is partitioned by source and storage period, and only the partitions that
    ``new`` touches are read and rewritten (dynamic partition overwrite: files are staged,
    then swapped in at commit). Running the same batch again leaves the same rows, so a
    retried batch is harmless. Choose ``grain`` once per table so that a period of one
    source is a few files. The rebalance hint lets AQE split a hot (source, period) over
    several files and merge small ones.
    """
    spark = new.sparkSession
    cols = [*RAW.fieldNames(), "item", "part"]
    item = _item(ITEM_FIELDS if items is None else items)
    new = new.withColumns({"part": _part(F.col("date"), grain), "item": F.coalesce("item", item) if "item" in new.columns else item}).select(*cols)
    if _exists(spark, path):
        new = stage(new)  # evaluated once: for the touched partitions, and for the merge
        here = _touched(new)
        table = _table(spark, path).select(*cols)
        table = table if here is None else table.where(here)
        old = join_same_key(table, new.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")
        new = old.select(*cols, F.lit(False).alias("__new")).unionByName(new.withColumn("__new", F.lit(True)))
    else:
        new = new.withColumn("__new", F.lit(True))
    kept = latest_wins(new, (*KEY, "item"))
    if stored is not None:
        kept = kept.observe(stored, F.count_if("__new").alias("rows"))
    (kept.select(*cols).hint("rebalance", *PARTITIONS).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path))


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*RAW, T.StructField("item", T.StringType()), T.StructField("part", T.DateType())])).parquet(path)


def read_raw(spark: SparkSession, path: str, start: date | str | None = None, end: date | str | None = None,
             grain: str = "month") -> DataFrame:
    """The raw table, or its rows dated ``start`` to ``end``: other periods are not listed or read."""
    df = _table(spark, path)
    if start is not None and end is not None:
        lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
        df = df.where(F.col("part").between(_part(lo, grain), hi) & F.col("date").between(lo, hi))
    return df.select(*RAW.fieldNames())


def ingest_source(spark: SparkSession, registry: Registry, name: str, path: str, target: str, start: date | str,
                  end: date | str, ingested_at: Column | None = None, grain: str = "month") -> tuple[int, int]:
    """Fetch, normalise and upsert one source; returns the rows fetched and the rows stored.

    Fewer are stored if several rows share a key; ``Registry.add`` takes the fields that tell
    the observations of one day apart.
    """
    rows = stage(normalise_raw(registry.fetch(spark, name, path, start, end), name, ingested_at))
    fetched = rows.count()
    if not fetched:
        return 0, 0
    stored = Observation("stored")
    item = registry.items.get(name)
    upsert_raw(rows, target, grain, {name: item} if item else {}, stored)
    return fetched, stored.get["rows"]


def ingest_all(spark: SparkSession, registry: Registry, path: str, target: str, start: date | str,
               end: date | str, ingested_at: Column | None = None, grain: str = "month", workers: int = 4) -> DataFrame:
    """Ingest every source, up to ``workers`` at a time; one that fails is reported and the rest go on.

    A source writes partitions of its own only, so their jobs do not meet. Each runs in a scheduler pool of its
    name, which shares the cluster fairly where ``spark.scheduler.mode`` is FAIR, so a small feed does not wait
    for a large one. Returns (source, records_ingested, records_stored, error), one row per registered source.
    """

    def one(name: str) -> tuple[str, int, int, str | None]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return (name, *ingest_source(spark, registry, name, path, target, start, end, ingested_at, grain), None)
        except Exception as e:
            return name, 0, 0, str(e).split("\n")[0]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(one), name) for name in registry.readers]
        done = [w.result() for w in waiting]
    return spark.createDataFrame(done, "source STRING, records_ingested BIGINT, records_stored BIGINT, error STRING")


def ingest_recent(spark: SparkSession, registry: Registry, path: str, target: str, as_of: date | str, days: int = 7,
                  ingested_at: Column | None = None, grain: str = "month") -> DataFrame:
    """The scheduled run: ingest again what is dated in the ``days`` days up to ``as_of``.

    Late rows and corrections of that time are merged; rows that have not changed stay one row, and only the
    partitions of those days are read and rewritten.
    """
    end = date.fromisoformat(str(as_of)[:10])
    return ingest_all(spark, registry, path, target, end - timedelta(days=days), end, ingested_at, grain)


def recent_rows(raw: DataFrame, as_of: str, days: int = 7, limit: int | None = 100,
                tiebreak: Sequence[str] = ("date", "data")) -> DataFrame:
    """The newest ``limit`` rows (None: all, without a rank) per source ingested in the last ``days`` days before ``as_of``.

    The rank filter is applied before the shuffle as well, so a hot source sends at most
    ``limit`` rows per task.
    """
    w = Window.partitionBy("source").orderBy(F.desc("ingested_at"), *[F.desc(c) for c in tiebreak])
    cut = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    recent = raw.where(F.col("ingested_at") >= cut)
    return recent if limit is None else recent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
