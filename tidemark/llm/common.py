"""What the operators of this package share: row keys, Arrow batches, staged frames, ranks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.workdir import stage

staged = stage
LAST = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs, whatever else the table has.

    ``_doc`` and ``_text`` identify a document: its id (a null id counts as larger than any
    other) and a hash of its text. Rows that agree on both are copies with equal results.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"),
    )


def rest(docs: DataFrame) -> Column:
    """All columns but doc_id and text, in one struct."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    return (F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1).alias("none"))).alias("_rest")


def unpack_rest(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of the documents again, in their order."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in order])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` units each; a larger row stands alone."""
    begin, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if i >= begin:
        yield begin, i + 1


def squeeze(texts: list[bytes | None]) -> pa.Array:
    """Texts compressed for a shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    return pa.array([None if t is None else z.compress(t) for t in texts], pa.binary())


def unsqueeze(column: pa.Array) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if t is None else z.decompress(t) for t in column.to_pylist()]


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """Documents keyed by (_doc, _text) with the text compressed as ``_z``."""
    names = ["doc_id", "_doc", "_text", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pa.compute.binary_length(batch["text"])), 8 << 20):
                part = batch.slice(a, b - a)
                texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], squeeze(texts)], names=[*names, "_z"])

    source = documents(docs, *more)
    schema = T.StructType([*[source.schema[c] for c in names], T.StructField("_z", T.BinaryType())])
    return source.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a stream sorted by ``key``, never cutting a key in two."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            values = table[key].to_numpy()
            cut = int((values != values[-1]).sum())
            if cut:
                yield table.slice(0, cut)
            held, count = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def running(df: DataFrame, group: list[Column], order: list[Column], size: Column | None = None, rows: int = 20_000) -> DataFrame:
    """Add ``_before`` (sum of ``size`` of the earlier rows of the group) and ``_rank`` (their number).

    The order is a hash of ``order``, then ``order`` itself. A group is cut by that hash into
    parts of about ``rows`` rows, so a hot group is summed by many tasks; only the parts' sums
    are added up per group. Repeated rows stand in any order, with equal consequences.
    """
    from pyspark.sql import Window as W

    size = F.lit(1) if size is None else size
    names = [f"_g{i}" for i in range(len(group))]
    base = df.select("*", *[g.alias(n) for g, n in zip(group, names, strict=True)], size.cast("long").alias("_size"),
                     F.xxhash64(*order).alias("_hash"))
    counts = base.groupBy(*names).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows)).cast("long").alias("_parts"))
    cut = base.join(counts.select(*[F.col(n).alias(f"{n}c") for n in names], "_parts"),
                    on=[F.col(n).eqNullSafe(F.col(f"{n}c")) for n in names], how="left").drop(*[f"{n}c" for n in names])
    width = F.lit(float(1 << 32)) / F.col("_parts")
    cut = cut.withColumn("_part", F.least(F.floor((F.shiftright("_hash", 32) + F.lit(1 << 31)) / width), F.col("_parts") - 1).cast("long"))
    sums = cut.groupBy(*names, "_part").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"))
    earlier = W.partitionBy(*names).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(n).alias(f"{n}s") for n in names], F.col("_part").alias("_parts_"),
                       F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    both = cut.join(sums, on=[*[F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names], F.col("_part") == F.col("_parts_")], how="left")
    inner = W.partitionBy(*names, "_part").orderBy("_hash", *order)
    out = both.withColumns({
        "_before": F.col("_sum0") + F.coalesce(F.sum("_size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_rank": F.col("_n0") + F.row_number().over(inner) - 1,
    })
    return out.drop(*names, *[f"{n}s" for n in names], "_size", "_hash", "_parts", "_part", "_parts_", "_sum0", "_n0")
