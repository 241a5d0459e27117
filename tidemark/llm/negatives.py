"""Hard negatives from a geometric near-neighbour access tree.

A node's rows are dealt to the nearest of a few split points, far apart from each other; that is a multiway
cut by hyperplanes. For every split point and every child the node stores the range of distances from
the point to the child's rows, and for every child the range of squared lengths.

An inner product s of an anchor a with a row x means the distance |a|^2 + |x|^2 - 2s, squared. So a window of
scores is an annulus around the anchor, and a child is left out if its range of distances to any split
point does not meet what the anchor's own distance to that point and the annulus allow. Leaves that are
left are scored exactly. A first look at the anchor's own leaf narrows the window to what can still
come first, so the result is that of a full search.

The tree is built and searched level by level: a level is one table, rows and anchors meet their nodes
in groups of bounded size, and nothing of the size of the data is held by the driver or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Split points of a node, rows they are chosen from, and rows a leaf should have at most.
POINTS, SAMPLE, LEAF = 16, 1_024, 1_024
LEVELS = 14
#: Rows and anchors of one group.
ROWS, ANCHORS = 8_192, 2_048
FACTS = "struct<child: bigint, leaf: boolean, at: int, low_norm: double, high_norm: double, low: array<double>, high: array<double>>"


def moved_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``label`` becomes (label + 1) % ``labels`` where vec_id is divisible by ``every``."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v) with v = floor(scale * x) per component, computed in double precision.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
    rows equal in all three count once.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(x) > 0)
    known = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    v = F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long"))
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).dropDuplicates()


def _norm() -> Column:
    return F.aggregate(F.transform("v", lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda a, b: a + b)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.asarray(table["v"].combine_chunks().flatten()).reshape(table.num_rows, -1)


def _arrays(table: pa.Table, column: str) -> np.ndarray:
    return np.asarray(table[column].combine_chunks().flatten()).reshape(table.num_rows, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    largest = float(max(np.abs(a).max(initial=0), 1)) * float(max(np.abs(b).max(initial=0), 1)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)))


def split_points(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` different rows, each the farthest from those before."""
    rows = np.unique(rows, axis=0)
    chosen = [0]
    near = distances(rows[:1], rows)[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(rows[chosen[-1:]], rows)[0])
    return rows[chosen]


def classes(rows: DataFrame, most: int) -> DataFrame:
    """Rows equal in vector and label as one, with their ``most`` smallest ids.

    No list of ``most`` rows in order of (score, id) can hold more of them. The rank is cut before the shuffle too.
    """
    order = W.partitionBy("v", "label").orderBy("vec_id")
    few = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    one = few.groupBy("v", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return one.select("v", "label", "ids", F.size("v").alias("d"), _norm().alias("norm"), F.xxhash64("v", "label").alias("class"))


@dataclass
class Tree:
    """``nodes``: (d, node, points, facts of the children); ``rows``: the classes with their leaf."""

    nodes: DataFrame
    rows: DataFrame


def build(rows: DataFrame, points: int = POINTS, sample: int = SAMPLE, leaf: int = LEAF) -> Tree:
    """The tree over classes (v, label, ids, d, norm, class); every row is in one leaf.

    Split points come from the ``sample`` rows of a node that are first by hash; all rows are dealt to them.
    A node whose sample is one single vector is not split, nor is one below ``LEVELS`` levels: its rows
    form a larger leaf, which is searched in parts.
    """
    spark = rows.sparkSession
    columns = ["v", "label", "ids", "d", "norm", "class"]
    rows = staged(rows.select(*columns))
    sizes = staged(rows.groupBy("d").agg(F.count("*").alias("n")).select("d", F.lit(0).cast("long").alias("node"), "n", (F.col("n") <= leaf).alias("leaf")))
    current = rows.join(sizes, "d")
    settled = current.filter("leaf").select(*columns, "node")
    current = current.filter(~F.col("leaf")).select(*columns, "node", "n")
    nodes = spark.createDataFrame([], f"d int, node bigint, points array<bigint>, facts array<{FACTS}>")

    def choose(table: pa.Table) -> pa.Table:
        found = split_points(_matrix(table), points)
        return pa.table({"d": table["d"].slice(0, 1), "node": table["node"].slice(0, 1), "points": pa.array([found.ravel()], pa.list_(pa.int64()))})

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        centres = _arrays(right, "points").reshape(-1, left["d"][0].as_py())
        dist = distances(_matrix(left), centres)
        child = left["node"].to_numpy() * points + 1 + dist.argmin(axis=1)
        offsets = np.arange(0, dist.size + 1, dist.shape[1])
        return left.select([*columns, "node", "n"]).append_column("child", pa.array(child)).append_column(
            "dist", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(dist.ravel())))

    empty = pa.table({"v": pa.array([], pa.list_(pa.int64())), "label": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "d": pa.array([], pa.int32()),
                      "norm": pa.array([], pa.float64()), "class": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
                      "child": pa.array([], pa.int64()), "dist": pa.array([], pa.list_(pa.float64()))})

    for level in range(LEVELS):
        if not sizes.filter(~F.col("leaf")).limit(1).count():
            break
        first = W.partitionBy("d", "node").orderBy("class")
        few = current.select("d", "node", "v", "class").withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= sample)
        chosen = staged(few.select("d", "node", "v").groupBy("d", "node").applyInArrow(choose, "d int, node bigint, points array<bigint>"))
        # a large node is dealt in many groups, each with a copy of the node's points
        many = F.ceil(F.col("n") / ROWS).cast("long")
        copies = chosen.join(sizes.select("d", "node", "n"), ["d", "node"]).select(
            "d", "node", "points", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("chunk"))
        left = current.withColumn("chunk", F.pmod(F.col("class"), many)).groupBy("d", "node", "chunk")
        schema = "v array<bigint>, label bigint, ids array<bigint>, d int, norm double, class bigint, node bigint, n bigint, child bigint, dist array<double>"
        dealt = staged(left.cogroup(copies.groupBy("d", "node", "chunk")).applyInArrow(deal, schema))
        ranges = [f(F.get("dist", F.lit(i))).alias(f"{name}{i}") for i in range(points) for name, f in (("low", F.min), ("high", F.max))]
        stats = dealt.groupBy("d", "node", "n", "child").agg(F.count("*").alias("m"), F.min("norm").alias("low_norm"), F.max("norm").alias("high_norm"), *ranges)
        # a child as large as its node was not split at all
        is_leaf = (F.col("m") <= leaf) | (F.col("m") == F.col("n")) | F.lit(level == LEVELS - 1)
        at = (F.col("child") - F.col("node") * points - 1).cast("int")
        stats = staged(stats.select("d", "node", "child", "m", is_leaf.alias("leaf"), at.alias("at"), "low_norm", "high_norm",
                                    F.array(*[F.col(f"low{i}") for i in range(points)]).alias("low"), F.array(*[F.col(f"high{i}") for i in range(points)]).alias("high")))
        facts = stats.groupBy("d", "node").agg(F.sort_array(F.collect_list(F.struct("child", "leaf", "at", "low_norm", "high_norm", "low", "high"))).alias("facts"))
        nodes = nodes.unionByName(chosen.join(facts, ["d", "node"]).select("d", "node", "points", F.col("facts").cast(f"array<{FACTS}>").alias("facts")))
        sizes = stats.select("d", F.col("child").alias("node"), F.col("m").alias("n"), "leaf")
        placed = dealt.select(*columns, F.col("child").alias("node")).join(sizes, ["d", "node"])
        settled = settled.unionByName(placed.filter("leaf").select(*columns, "node"))
        current = staged(placed.filter(~F.col("leaf")).select(*columns, "node", "n"))
    return Tree(staged(nodes), staged(settled))


def surviving(anchors: np.ndarray, low: np.ndarray, high: np.ndarray, points: np.ndarray, facts: list[dict]) -> np.ndarray:
    """Which anchors (rows) have to visit which children (columns).

    ``low`` and ``high`` are windows of scores, some per anchor, empty where low > high.
    """
    own = (anchors.astype(float) ** 2).sum(axis=1)
    wanted, low, high = low <= high, low.astype(float), high.astype(float)
    dist = distances(anchors, points)
    out = np.zeros((len(anchors), len(facts)), bool)
    for j, f in enumerate(facts):
        near, far = np.array(f["low"][: len(points)], float), np.array(f["high"][: len(points)], float)
        slack = 1e-6 * (own + f["high_norm"] + 1.0)
        for w in range(low.shape[1]):
            # the annulus in which rows of this child with a score of the window lie
            outer = np.sqrt(np.maximum(0.0, own + f["high_norm"] - 2 * low[:, w] + slack))
            outer = np.where(own + f["high_norm"] - 2 * low[:, w] + slack < 0, -1.0, outer)
            inner = np.sqrt(np.maximum(0.0, own + f["low_norm"] - 2 * high[:, w] - slack))
            give = np.sqrt(slack)[:, None]
            meets = (dist - far <= outer[:, None] + give) & (near - dist <= outer[:, None] + give) & (dist + far >= inner[:, None] - give)
            out[:, j] |= meets.all(axis=1) & (outer >= 0) & wanted[:, w]
    return out


def visits(tree: Tree, items: DataFrame) -> DataFrame:
    """(item, d, node): the leaves that each item has to visit.

    Items are (item, d, v, low, high, ...) with arrays of windows.
    """
    roots = tree.nodes.filter("node = 0").select("d", F.lit(False).alias("leaf"))
    start = staged(items.select("item", "d").join(roots, "d", "left").select("item", "d", F.lit(0).cast("long").alias("node"), F.coalesce("leaf", F.lit(True)).alias("leaf")))
    found, frontier = start.filter("leaf"), start.filter(~F.col("leaf"))

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"item": pa.array([], pa.int64()), "d": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "leaf": pa.array([], pa.bool_())})
        if not left.num_rows or not right.num_rows:
            return none
        d, facts = left["d"][0].as_py(), right["facts"][0].as_py()
        points = _arrays(right, "points").reshape(-1, d)
        item, child = np.nonzero(surviving(_matrix(left), _arrays(left, "low"), _arrays(left, "high"), points, facts))
        node, leaf = np.array([f["child"] for f in facts], np.int64), np.array([f["leaf"] for f in facts], bool)
        return pa.table({"item": left["item"].to_numpy()[item], "d": pa.array(np.full(len(item), d), pa.int32()), "node": node[child], "leaf": leaf[child]})

    for _ in range(LEVELS):
        if not frontier.limit(1).count():
            break
        counts = staged(frontier.groupBy("d", "node").agg(F.ceil(F.count("*") / ANCHORS).cast("long").alias("many")))
        here = frontier.select("item", "d", "node").join(counts, ["d", "node"]).join(items.select("item", "v", "low", "high"), "item")
        left = here.select("item", "d", "node", "v", "low", "high", F.pmod(F.xxhash64("item"), F.col("many")).alias("chunk")).groupBy("d", "node", "chunk")
        copies = counts.select("d", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("chunk"))
        right = tree.nodes.join(copies, ["d", "node"]).select("d", "node", "chunk", "points", "facts")
        after = staged(left.cogroup(right.groupBy("d", "node", "chunk")).applyInArrow(step, "item bigint, d int, node bigint, leaf boolean"))
        found, frontier = found.unionByName(after.filter("leaf")), after.filter(~F.col("leaf"))
    return found.select("item", "d", "node")


def first_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, begin: np.ndarray, many: np.ndarray, skip: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and scores: each row's first ``k`` allowed ids by (score descending, id); classes hold several ids."""
    n = scores.shape[1]
    if n > k + 1:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        least = np.partition(masked, n - k - 1, axis=1)[:, n - k - 1]  # one more than k, as one class may hold the row itself alone
        allowed = allowed & (scores >= least[:, None])
    row, col = np.nonzero(allowed)
    times = many[col]
    row, score = np.repeat(row, times), np.repeat(scores[row, col], times)
    ends = np.cumsum(times)
    found = ids[np.repeat(begin[col] - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)]
    if skip is not None:
        keep = found != skip[row]
        row, score, found = row[keep], score[keep], found[keep]
    order = np.lexsort((found, -score, row))
    row, score, found = row[order], score[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], found[keep], score[keep]


def evaluate(tree: Tree, items: DataFrame, where: DataFrame, k: int, same: bool) -> DataFrame:
    """(item, slot, rank, vec_id, score): the first ``k`` rows per item and window in the leaves ``where`` says.

    Rows have the item's label and another id (``same``), or another label. A leaf with many rows or many
    visitors is scored in several groups; each sends its own first ``k``.
    """
    counts = where.groupBy("d", "node").agg(F.ceil(F.count("*") / ANCHORS).cast("long").alias("chunks"))
    leaves = tree.rows.groupBy("d", "node").agg(F.ceil(F.count("*") / ROWS).cast("long").alias("parts"))
    cut = staged(counts.join(leaves, ["d", "node"]))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = where.join(cut, ["d", "node"]).join(items.select("item", "anchor_id", "label", "v", "low", "high"), "item").withColumn(
        "chunk", F.pmod(F.xxhash64("item"), F.col("chunks"))).withColumn("part", spread("parts"))
    right = tree.rows.join(cut, ["d", "node"]).withColumn("part", F.pmod(F.col("class"), F.col("parts"))).withColumn("chunk", spread("chunks"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            a, x = _matrix(left), _matrix(right)
            lists = right["ids"].combine_chunks()
            many = lists.value_lengths().to_numpy().astype(np.int64)
            ids, begin = np.asarray(lists.flatten()), np.cumsum(many) - many
            labels, item = right["label"].to_numpy(), left["item"].to_numpy()
            low, high = _arrays(left, "low"), _arrays(left, "high")
            for s in range(0, len(a), 256):
                e = min(s + 256, len(a))
                scores = products(a[s:e], x)
                mine = left["label"].to_numpy()[s:e, None] == labels
                skip = left["anchor_id"].to_numpy()[s:e] if same else None
                for w in range(low.shape[1]):
                    allowed = (mine if same else ~mine) & (scores >= low[s:e, w, None]) & (scores <= high[s:e, w, None])
                    row, found, value = first_of(scores, allowed, ids, begin, many, skip, k)
                    parts.append(pa.table({"item": item[s:e][row], "slot": pa.array(np.full(len(row), w), pa.int32()), "vec_id": found, "score": value}))
        none = {"item": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        return pa.concat_tables(parts) if parts else pa.table(none)

    keys = ["d", "node", "chunk", "part"]
    found = left.groupBy(*keys).cogroup(right.select(*keys, "v", "label", "ids").groupBy(*keys)).applyInArrow(score, "item bigint, slot int, vec_id bigint, score bigint")
    order = W.partitionBy("item", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         points: int = POINTS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (vec_id, label, v) of integers.

    Scores are inner products, higher ones first, ties to the smaller vec_id. Anchors are the rows whose vec_id is divisible by
    ``every``; an anchor's positives are its first ``positives`` rows of its label with another id; a positive's negatives are the
    first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Vectors are
    compared within their dimension. Rows equal in all columns should come once (``quantised`` sees to it); different rows
    with one id stay apart. An anchor without positives, or a positive without a score in the window, gives no row, and
    an empty table an empty result. Scores have to fit 64 bits.
    """
    rows = staged(rows.select("vec_id", "label", "v"))
    tree = build(classes(rows, max(positives, negatives) + 1), points, sample, leaf)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(
        F.xxhash64("vec_id", "label", "v").alias("item"), F.col("vec_id").alias("anchor_id"), "label", "v", F.size("v").alias("d"), F.xxhash64("v", "label").alias("class"))
    anchors = staged(anchors)
    home = staged(anchors.select("item", "class", "d").join(tree.rows.select("class", "d", "node"), ["class", "d"]).select("item", "d", "node"))
    least, most = F.lit(-(2**63) + 1).cast("long"), F.lit(2**63 - 1).cast("long")

    def narrowed(found: DataFrame, k: int) -> DataFrame:
        """The score that the k-th row already has, per item and window."""
        return found.filter(F.col("rank") == k).select("item", "slot", F.col("score").alias("bound"))

    wide = anchors.select("*", F.array(least).alias("low"), F.array(most).alias("high"))
    bound = narrowed(evaluate(tree, wide, home, positives, True), positives).select("item", "bound")
    near = staged(anchors.join(bound, "item", "left").select("item", "anchor_id", "label", "v", "d", F.array(F.coalesce("bound", least)).alias("low"), F.array(most).alias("high")))
    best = staged(evaluate(tree, near, visits(tree, near), positives, True).select(
        "item", (F.col("rank") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    percent = lambda p: F.col("positive_score").cast("decimal(20,0)") * F.lit(p).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    lo, hi = F.ceil(percent(low)).cast("long"), F.floor(percent(high)).cast("long")
    window = best.select("item", "slot", lo.alias("lo"), hi.alias("hi"))

    def with_windows(windows: DataFrame) -> DataFrame:
        """Items with their windows side by side; a slot without positive has an empty one."""
        at = lambda c, s, other: F.coalesce(F.max(F.when(F.col("slot") == s, F.col(c))), other)
        sides = windows.groupBy("item").agg(F.array(*[at("lo", s, F.lit(1).cast("long")) for s in range(positives)]).alias("low"),
                                            F.array(*[at("hi", s, F.lit(0).cast("long")) for s in range(positives)]).alias("high"))
        return staged(anchors.select("item", "anchor_id", "label", "v", "d").join(sides, "item"))

    first = with_windows(window)
    bound = narrowed(evaluate(tree, first, home.join(first.select("item"), "item"), negatives, False), negatives)
    later = with_windows(window.join(bound, ["item", "slot"], "left").select("item", "slot", F.greatest("lo", F.coalesce("bound", "lo")).alias("lo"), "hi"))
    found = evaluate(tree, later, visits(tree, later), negatives, False)
    out = found.select("item", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["item", "slot"])
    return out.join(anchors.select("item", "anchor_id"), "item").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * x.v[i])) AS BIGINT) AS score
  FROM v a JOIN v x ON len(a.v) = len(x.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
