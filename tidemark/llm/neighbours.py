"""Nearest neighbours with randomly rotated one-bit codes.

A vector less the centre is rotated at random; its code is one bit per dimension, with two
correction scalars: its length, and the inner product of code and direction. The inner product
with a query is estimated from packed bits and scalars, with an error bound that holds with a
chosen confidence. A vector whose nearest possible distance is beyond a query's k-th farthest
possible one is left out. Inner products of the rest, a matrix at a time, leave out those that are
farther than the k-th by more than rounding can explain; what is left is ranked by exact distance.

Queries and candidates are cut into blocks of bounded size, and each pair of blocks is one group.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 8_192
#: Half-width of the error bound in standard deviations.
CONFIDENCE = 4.0


@lru_cache(maxsize=4)
def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, length and code-direction inner product of each vector."""
    turned = (x - centre) @ rotation(x.shape[1]).T
    length = np.sqrt((turned * turned).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = np.where(length > 0, np.abs(turned).sum(axis=1) / (length * np.sqrt(x.shape[1])), 1.0)
    return np.packbits(turned > 0, axis=1), length, fit


def squared_bounds(bits: np.ndarray, length: np.ndarray, fit: np.ndarray, query: np.ndarray, centre: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, queries by vectors."""
    d = query.shape[1]
    turned = (query - centre) @ rotation(d).T
    own = np.sqrt((turned * turned).sum(axis=1))
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    product = (turned.astype(np.float32) @ signs.T) / np.sqrt(d) / fit
    spread = confidence * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, d - 1))
    middle = length**2 + own[:, None] ** 2 - 2 * length * product
    # single precision in the product is covered by a thousandth of the scale
    error = 2 * length * own[:, None] * (spread + 1e-3) + 1e-9
    return middle - error, middle + error


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed dimension by dimension in double precision."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        x = a[:, j] - b[:, j]
        total += x * x
    return np.sqrt(total)


def contenders(q: np.ndarray, c: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the kept pairs that may be among the k nearest of their query.

    Squared distances from inner products differ from those of ``exact`` by rounding alone; a pair
    leaves only if it is farther than the k-th whatever the rounding was. Where numbers overflow, all pairs stay.
    """
    columns = np.flatnonzero(keep.any(axis=0))
    near, kept = c[columns], keep[:, columns]
    with np.errstate(over="ignore", invalid="ignore"):
        scale = (q * q).sum(axis=1)[:, None] + (near * near).sum(axis=1)
        error = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps * scale
        low = scale - 2 * (q @ near.T) - error
        if len(columns) > k:
            limit = np.partition(np.where(kept, low + 2 * error, np.inf), k - 1, axis=1)[:, k - 1]
            kept &= ~(low > limit[:, None])
    row, col = np.nonzero(kept)
    return row, columns[col]


def block_search(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, codes: tuple, centre: np.ndarray, k: int, confidence: float):
    """Row numbers of queries and candidates and their distances: each query's k nearest of the block."""
    out = []
    for s in range(0, len(q), 256):
        part = q[s : s + 256]
        low, high = squared_bounds(*codes, part, centre, confidence)
        own = q_id[s : s + 256, None] == c_id[None, :]
        low[own], high[own] = np.inf, np.inf
        limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(part), np.inf)
        row, col = contenders(part, c, (low <= limit[:, None]) & ~own, k)
        d = np.concatenate([exact(part[row[i : i + 100_000]], c[col[i : i + 100_000]]) for i in range(0, len(row), 100_000)] or [np.zeros(0)])
        order = np.lexsort((c_id[col], d, row))
        row, col, d = row[order], col[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + s, col[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, d) of the vectors that take part, repeated rows once."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("d")).dropDuplicates(["vec_id", "v"])


def search(vectors: DataFrame, k: int = 10, every: int = 100, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but
    those with the query's id. Vectors that are null, empty, zero or hold a null or non-finite
    component, and rows with a null id, take no part; vectors are compared within their
    dimension. Repeated rows count once; different vectors with one id stay apart. Extra columns
    are ignored; an empty table gives an empty result.
    """
    rows = staged(valid(vectors))
    # the centre is a mean over all rows: one number per dimension
    parts = rows.select("d", F.posexplode("v").alias("i", "x")).groupBy("d", "i").agg(F.avg("x").alias("x"))
    centres = {r["d"]: [x["x"] for x in sorted(r["c"], key=lambda x: x["i"])] for r in parts.groupBy("d").agg(F.collect_list(F.struct("i", "x")).alias("c")).collect()}
    query = (F.col("vec_id") % every) == 0
    n = rows.agg(F.count("*").alias("all"), F.count_if(query).alias("queries")).first()
    many_q, many_c = max(1, -(-n["queries"] // query_block)), max(1, -(-n["all"] // candidate_block))

    def blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<bigint>")))

    def matrix(table: pa.Table) -> np.ndarray:
        return np.array(table["v"].combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)

    def group(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        q, c, centre = matrix(left), matrix(right), np.array(centres[key[0].as_py()])
        q_id, c_id = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        row, col, d = block_search(q_id, q, c_id, c, encode(c, centre), centre, k, confidence)
        return pa.table([pa.array(q_id[row]), left["query"].combine_chunks().take(pa.array(row)), pa.array(c_id[col]), pa.array(d)], names=names)

    left = blocks(rows.filter(query).withColumn("query", F.xxhash64("vec_id", "v")), "qb", many_q, "cb", many_c).groupBy("d", "qb", "cb")
    right = blocks(rows, "cb", many_c, "qb", many_q).select("vec_id", "v", "d", "qb", "cb").groupBy("d", "qb", "cb")
    found = left.cogroup(right).applyInArrow(group, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
