"""Mixing sources to target weights along a low-discrepancy schedule.

A source's documents are shuffled by a hash, laid end to end and cut into blocks of ``block`` words,
the last one shorter; its r-th slot takes block r, and starts over when they are used up. It gets
as many slots as its target takes, and the last is cut where the target is reached. Slot i's point
is the fractional part of i times the golden ratio; the cumulative slots of the sources map it to
a source, so every stretch of the schedule holds each source in proportion. What a source gets
too many goes to those that got too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, rest, running, staged, unpack_rest

GOLDEN = 0.6180339887498949
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Source sizes (source, source_size) -> their targets.

    ``share`` of all words is dealt out by weight (in the order of source, null last); a target
    stops at ``most`` times its source's size, and the rest is dealt out anew to the others. The
    stop levels are found in one pass: sources fill up in the order of capacity per weight, so a
    running sum over them tells who is full. One row per source is held here, no document.
    """
    numbered = sizes.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    one = numbered.withColumns({"_w": weight, "_cap": cap}).withColumn("_fill", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_fill", "_n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    one = one.withColumns({
        "_left": total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_weights": F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)),
    }).withColumn("_level", F.col("_left") / F.col("_weights"))
    # the first source that does not fill up sets the level for itself and all after it
    level = F.min(F.when(F.col("_level") < F.col("_fill"), F.struct("_fill", "_n", "_level"))).over(W.partitionBy())["_level"]
    return one.select("source", "source_size", F.coalesce(F.least(level * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def schedule(goals: DataFrame, chunk: int = 4096) -> DataFrame:
    """Slots (slot, source, rank): each source (source, slots) has its number of slots, with ranks from 0.

    Slots are made in chunks; a source's rank is its count in earlier chunks plus its place in
    the chunk, so no window holds more than a chunk, or one row per chunk and source. Points
    miss a source's number by a few slots; these few are dealt anew.
    """
    spans = goals.withColumn("_to", F.sum("slots").over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    spans = spans.select("source", "slots", (F.col("_to") - F.col("slots")).alias("_from"), "_to").filter("slots > 0")
    total = goals.agg(F.sum("slots")).first()[0] or 0
    slots = goals.sparkSession.range(total).select(
        F.col("id").alias("slot"), F.least(F.floor((F.col("id") * F.lit(GOLDEN) + F.lit(0.5)) % 1.0 * F.lit(float(total))), F.lit(total - 1)).alias("_point"))
    placed = slots.join(F.broadcast(spans), (F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to"))).select(
        "slot", "source", "slots", F.floor(F.col("slot") / chunk).alias("_chunk"))
    counts = placed.groupBy("_chunk", "source").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("_chunk").alias("_c"), F.col("source").alias("_s"), "_before")
    inner = F.row_number().over(W.partitionBy("_chunk", "source").orderBy("slot")) - 1
    both = placed.withColumn("_in", inner).join(before, (F.col("_chunk") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_s")))
    ranked = staged(both.select("slot", "source", (F.col("_before") + F.col("_in")).alias("rank"), "slots"))
    # a few rows per source, as many of the one as of the other
    over = ranked.filter("rank >= slots").select("slot", F.row_number().over(W.orderBy("slot")).alias("_n"))
    got = ranked.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_got"))
    short = (spans.join(got, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < slots")
             .select("source", F.explode(F.sequence(F.col("_got"), F.col("slots") - 1)).alias("rank")))
    short = short.withColumn("_m", F.row_number().over(W.orderBy(F.xxhash64("source", "rank"), "source", "rank")))
    anew = over.join(short, F.col("_n") == F.col("_m")).select("slot", "source", "rank")
    return ranked.filter("rank < slots").select("slot", "source", "rank").unionByName(anew)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """The schedule's pieces and the documents' facts.

    Pieces (slot, turn, place, _doc, _text, start, length): slot's block, in order of place, is
    made of these words of these documents, taken for the turn-th time (from 0). Facts (doc_id, _doc, _text, source, size, source_size,
    target): one row per document. Blocks hold exactly ``block`` words; a source's last words
    that fill no block make a shorter one. Each source is taken to its target, rounded to a word.
    No block is taken more than ``most`` times, so no document exceeds ``most`` times its size. A null text has size 0, a null source is the last
    source, rows without words appear in no piece. Reruns agree: order and slots depend on
    hashes of ids and texts and on counts alone. Copies of a row share their pieces evenly. An empty
    table gives no pieces.
    """
    base = staged(documents(docs, F.col("source").cast("string").alias("source")).withColumn("size", n_words()).select("doc_id", "_doc", "_text", "source", "size"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a source's words to take, in full turns of its blocks and a part of one
    words = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(most)))).cast("long")
    goals = targets(sizes, weights, share, most).withColumn("words", words).withColumn("number", F.ceil(F.col("source_size") / block))
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    goals = staged(goals.withColumn("slots", (turns * F.col("number") + F.ceil((F.col("words") - turns * F.col("source_size")) / block)).cast("long")))
    g = goals.select(F.col("source").alias("_s"), "source_size", "target", "words", "number")
    facts = base.join(F.broadcast(g.drop("words", "number")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    laid = running(base.filter("size > 0"), [F.col("source")], [F.col("_doc"), F.col("_text")], F.col("size"))
    laid = laid.select("_doc", "_text", "source", "size", "_before")
    blocks = laid.select("*", F.explode(F.sequence(F.floor(F.col("_before") / block), F.floor((F.col("_before") + F.col("size") - 1) / block))).alias("_block"))
    start = F.greatest(F.lit(0), F.col("_block") * block - F.col("_before"))
    end = F.least(F.col("size"), (F.col("_block") + 1) * block - F.col("_before"))
    pieces = blocks.select(F.col("source").alias("_s"), "_block", F.col("_before").alias("place"), "_doc", "_text", start.alias("start"), (end - start).alias("length"))
    used = (schedule(goals).join(F.broadcast(g), F.col("source").eqNullSafe(F.col("_s")))
            .withColumns({"_want": F.col("rank") % F.col("number"), "turn": F.floor(F.col("rank") / F.col("number"))})
            .select("slot", F.col("source").alias("_q"), "_want", "turn", (F.col("words") - F.col("turn") * F.col("source_size")).alias("_end")))
    out = used.join(pieces, F.col("_q").eqNullSafe(F.col("_s")) & (F.col("_want") == F.col("_block")))
    # the last slot ends where the source has its words
    out = out.withColumn("length", F.least(F.col("length"), F.col("_end") - F.col("place") - F.col("start"))).filter("length > 0")
    return out.select("slot", "turn", "place", "_doc", "_text", "start", "length"), facts


def taken(pieces: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts with ``taken``, the words the mix takes of each document, repeats counted; copies of a row share them."""
    got = (pieces.select("_doc", "_text", "length", F.lit(0).alias("row")).unionByName(facts.select("_doc", "_text", F.lit(0).alias("length"), F.lit(1).alias("row")))
           .groupBy(F.col("_doc").alias("d"), F.col("_text").alias("t")).agg(F.floor(F.sum("length") / F.sum("row")).alias("_all")))
    return facts.join(got, (F.col("_doc") == F.col("d")) & (F.col("_text") == F.col("t")), "left").select(
        "doc_id", "_doc", "_text", "source", "size", "source_size", "target", F.coalesce("_all", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 64) -> DataFrame:
    """The mix as documents, with all their columns: one row for each time a document is taken.

    A document that is taken whole keeps its text; where a source's slots end inside one, the
    words taken are joined by one space.
    """
    pieces, _ = mix(docs, weights, share, most, block)
    spans = pieces.groupBy(F.col("_doc").alias("_d"), F.col("_text").alias("_t"), "turn").agg(
        F.min("start").alias("_from"), F.max(F.col("start") + F.col("length")).alias("_to"))
    both = documents(docs, rest(docs)).join(spans, (F.col("_doc") == F.col("_d")) & (F.col("_text") == F.col("_t")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("_from").cast("int") + 1, (F.col("_to") - F.col("_from")).cast("int")), " ")
    text = F.when((F.col("_from") == 0) & (F.col("_to") == n_words()), F.col("text")).otherwise(part)
    return unpack_rest(both.withColumn("text", text), docs.columns)
