"""Quantiles without holding a group in one task: exact ones in a bounded number of passes, and estimates.

``percentile`` keeps every distinct value of a group in one buffer. Here a group is narrowed
first. A KLL sketch of a group's values brackets every wanted rank between two of the values; the
next pass counts exactly what lies below, between and above, keeps what holds a rank, and sketches
that again, or counts its values one by one once they are at most ``SMALL``. A pass leaves about a
hundredth of the values, whatever they are, because only their order matters: up to 10^7 values of a group
take two passes, 10^13 take five. A sketch that misses costs a pass and never changes a result. Every
pass is a grouped aggregate with map-side combine; groups that are small from the start need no sketch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.workdir import stage

# Size of a sketch, the rank error that it rarely exceeds on either side, and the quantiles read from it.
SKETCH = 2000
ERROR = 0.004
GRID = 1000
BRACKETS = "array<struct<a: double, b: double>>"
# Values of one group that a single task may sort.
SMALL = 100_000
# Cells in progress (a few per group) that are kept on the driver and broadcast.
MAX_NODES = 50_000


def _same(a: str, b: str, names: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in names]


def _inside(base: DataFrame, nodes: DataFrame, group: list[str], *more: str) -> DataFrame:
    """(group, before, lo, hi, more..., v): values of ``base`` inside a node of their group."""
    on = _same("b", "n", group) + [F.col("b.v") >= F.col("n.lo"), F.col("b.v") <= F.col("n.hi")]
    return base.alias("b").join(nodes.alias("n"), on).select(
        *[F.col(f"b.{g}").alias(g) for g in group], "n.before", "n.lo", "n.hi", *[f"n.{m}" for m in more], "b.v")


def _holding(counts: DataFrame, nodes: DataFrame, group: list[str], *by: str) -> DataFrame:
    """Counted cells of the nodes whose cumulative position range holds a wanted rank."""
    w = Window.partitionBy(*group, "before").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("c").over(w)
    cells = counts.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    wanted = cells.alias("b").join(nodes.alias("n"), _same("b", "n", [*group, "before"])).select("b.*", "n.n", "n.ranks")
    mine = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("end")))
    return wanted.withColumn("ranks", mine).where(F.size("ranks") > 0)


def _grid(v: str = "v") -> Column:
    """Estimated quantiles 0, 1/GRID, ..., 1 of the values."""
    # one literal that folds into an array: a thousand literals would take a second to plan
    ranks = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, F.lit(SKETCH)), ranks)


def _brackets(grid: str, ranks: str, start: Column, c: str) -> Column:
    """Two values around each rank, from the estimated quantiles of the ``c`` values that begin at position ``start``."""
    at = lambda r: (r - start + 0.5) / F.col(c)
    low = lambda r: F.greatest(F.lit(0), F.floor((at(r) - ERROR) * GRID)).cast("int")
    high = lambda r: F.least(F.lit(GRID), F.ceil((at(r) + ERROR) * GRID)).cast("int")
    return F.transform(ranks, lambda r: F.struct(F.get(grid, low(r)).alias("a"), F.get(grid, high(r)).alias("b")))


def _pass(base: DataFrame, nodes: DataFrame, group: list[str], most: int, limit: int, by_value: bool) -> DataFrame:
    """From nodes to the cells between their brackets that hold a rank.

    The cell number rises at every bracket value, which has a cell to itself. Inside a bracket, and in
    nodes of up to ``limit`` values, cells are single values (``by_value``) or get brackets of their own.
    A node without brackets is one cell.
    """
    ends = [(f"__a{i}", f"__b{i}") for i in range(most)]
    flat = nodes.select("*", *[F.get("brackets", F.lit(i))[e].alias(n) for i, pair in enumerate(ends) for e, n in zip("ab", pair)],
                        ((F.col("c") <= limit) | F.col("brackets").isNull()).alias("__all"))
    # a comparison with a bracket that is not there is null and counts as not passed
    passed = lambda x: F.coalesce((F.col("v") > F.col(x)).cast("int"), F.lit(0)) + F.coalesce((F.col("v") >= F.col(x)).cast("int"), F.lit(0))
    cell = reduce(add, [passed(x) for pair in ends for x in pair])
    inside = reduce(or_, [F.coalesce((F.col("v") > F.col(a)) & (F.col("v") < F.col(b)), F.lit(False)) for a, b in ends], F.col("__all"))
    rows = _inside(base, flat, group, "__all", *[x for pair in ends for x in pair]).select(
        *group, "before", cell.alias("cell"), F.when(inside, F.col("v")).alias("x"), "v")
    facts = [F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    if by_value:
        held = _holding(rows.groupBy(*group, "before", "cell", "x").agg(*facts), nodes, group, "cell", "x")
        brackets = F.lit(None).cast(BRACKETS)
    else:
        held = _holding(rows.groupBy(*group, "before", "cell").agg(*facts, F.when(F.count("x") > 0, _grid("x")).alias("grid")), nodes, group, "cell")
        brackets = F.when(F.col("grid").isNotNull(), _brackets("grid", "ranks", F.col("start"), "c"))
    return held.select(*group, "n", "c", "lo", "hi", F.col("start").alias("before"), "ranks", brackets.alias("brackets"))


def _settle(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, bool]:
    """Cells of one value; the others, if there are any; and whether these can be counted by value.

    Up to ``MAX_NODES`` cells come to the driver and go back as a broadcast; more are written to the shared
    folder and join by shuffle.
    """
    few = lambda c, brackets: c if c <= limit else 2 * (ERROR + 1 / GRID) * c * len(brackets) if brackets else limit + 1
    rows = nodes.limit(MAX_NODES + 1).collect()
    if len(rows) <= MAX_NODES:
        done, left = ([r for r in rows if (r["lo"] < r["hi"]) == more] for more in (False, True))
        local = lambda part: nodes.sparkSession.createDataFrame(part, nodes.schema)
        return local(done), F.broadcast(local(left)) if left else None, max((few(r["c"], r["brackets"]) for r in left), default=0) <= limit
    nodes = stage(nodes)
    left = nodes.where("lo < hi")
    expected = F.when(F.col("c") <= limit, F.col("c")).when(F.col("brackets").isNotNull(), 2 * (ERROR + 1 / GRID) * F.col("c") * F.size("brackets")).otherwise(limit + 1)
    most = left.agg(F.max(expected)).first()[0]
    return nodes.where("NOT lo < hi"), None if most is None else left, (most or 0) <= limit


def _values(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    # zeros of both signs are one value
    return df.select(*group, (F.col(value).cast("double") + F.lit(0.0)).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _names(probs: Sequence[float], names: Sequence[str] | None) -> list[str]:
    return list(names or ["q" + f"{p:g}".replace(".", "_") for p in probs])


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, group: Sequence[str], names: Sequence[str] | None = None,
                     k: int = SKETCH) -> DataFrame:
    """Estimated quantiles per group in one pass: ``n`` plus one column per probability, each a value of the group.

    The rank of an estimate is off by less than about 2.3 / k^0.9 of ``n`` (0.3 % for 2000) with 99 % confidence.
    """
    sketch = F.kll_sketch_agg_double("v", F.lit(k)).alias("s")
    per = _values(df, value, group).groupBy(*group).agg(F.count("v").alias("n"), sketch).where("n > 0")
    return per.select(*group, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias(x) for p, x in zip(probs, _names(probs, names))])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, group: Sequence[str],
                    names: Sequence[str] | None = None, small: int | None = None, method: str = "cont",
                    few_groups: bool = False) -> DataFrame:
    """Exact quantiles per group: ``n`` plus one column per probability.

    ``method`` is "cont" (linear interpolation between two values) or "disc" (the first value whose
    share of rows up to it reaches the probability). Nulls and NaN are left out. ``few_groups`` says that groups
    are few, so the first pass may sketch them all. If more than one pass has to follow, the values are
    written once to the shared folder for them.
    """
    if method not in ("cont", "disc"):
        raise ValueError(f"unknown method {method!r}")
    group = list(group)
    limit = SMALL if small is None else small
    names = _names(probs, names)
    base = _values(df, value, group)
    if method == "disc":
        at = {p: F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("n") * F.lit(float(p))) - 1) for p in probs}
        ranks = F.array_distinct(F.array(*at.values()))
    else:
        at = {p: (F.col("n") - 1) * F.lit(float(p)) for p in probs}
        ranks = F.array_distinct(F.concat(*[
            F.array(F.floor(h), F.least(F.floor(h) + 1, F.col("n") - 1)) for h in at.values()]))
    first = [_grid().alias("grid")] if few_groups else []
    spread = base.groupBy(*group).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *first).where("n > 0")
    spread = spread.withColumn("ranks", ranks)
    done, left, by_value = _settle(spread.select(
        *group, "n", F.col("n").alias("c"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), "ranks",
        (_brackets("grid", "ranks", F.lit(0), "n") if few_groups else F.lit(None).cast(BRACKETS)).alias("brackets")), limit)
    staged = False
    while left is not None:
        if not (by_value or staged):
            base, staged = stage(base), True
        more, left, by_value = _settle(_pass(base, left, group, 2 * len(probs), limit, by_value), limit)
        done = done.unionByName(more)
    found = done.select(*group, "n", F.col("lo").alias("v"), F.explode("ranks").alias("rank"))
    picks = []
    for i, p in enumerate(probs):
        low = F.floor(at[p])
        picks.append(F.max(F.when(F.col("rank") == low, F.col("v"))).alias(f"__lo{i}"))
        picks.append(F.max(F.when(F.col("rank") == F.least(low + 1, F.col("n") - 1), F.col("v"))).alias(f"__hi{i}"))
    per = found.groupBy(*group, "n").agg(*picks)
    if method == "disc":
        return per.select(*group, "n", *[F.col(f"__lo{i}").alias(name) for i, name in enumerate(names)])
    return per.select(*group, "n", *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at[p] - F.floor(at[p]))).alias(name)
        for i, (p, name) in enumerate(zip(probs, names))])
