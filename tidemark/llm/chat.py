"""Multi-party perspective rotation: a dialogue rendered once for each of its participants.

DataFrame functions only. In each rendering the chosen speaker is the assistant, the others are
named users, and the mask marks the speaker's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged

TURNS = 64
MOST = 256
FIRST = -(1 << 63)


def _header(own: Column, role: Column) -> Column:
    return F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _pieces(rows: DataFrame, most: int) -> DataFrame | None:
    """(c, part, turn, role, digest, _piece) of the rows of parts above ``most`` rows; None if no part is.

    Rows are counted per (turn, role, first digits of the digest), the counts of a part are summed up in order, and a
    row's place in its small group is added.
    """
    full = rows.groupBy("c", "part").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("c", "part")
    if full.isEmpty():
        return None
    group = ["c", "part", "turn", "role", "_digits"]
    crowded = rows.join(full, ["c", "part"]).withColumn("_digits", F.substring("digest", 1, 4))
    counts = crowded.groupBy(*group).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("c", "part").orderBy("turn", "role", "_digits").rowsBetween(W.unboundedPreceding, -1)
    places = counts.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy(*group).orderBy("digest")) - 1
    return crowded.join(places, group).select("c", "part", "turn", "role", "digest", F.floor(place / most).cast("long").alias("_piece"))


def _with_piece(rows: DataFrame, pieces: DataFrame | None) -> DataFrame:
    if pieces is None:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    found = rows.join(pieces, ["c", "part", "turn", "role", "digest"], "left")
    return found.select(*rows.columns, F.coalesce("_piece", F.lit(0)).cast("long").alias("piece"))


def _places(rows: DataFrame) -> DataFrame:
    """(c, part, piece, speaker, start): every rendering, and the characters of its dialogue before it."""
    by = ["c", "part", "piece"]
    other = F.length(_header(F.lit(False), F.col("role")))
    own = F.length(_header(F.lit(True), F.col("role")))
    sizes = rows.groupBy(*by, "role").agg(F.sum(other + F.col("size") + 1).alias("_size"), F.sum(own - other).alias("_own"))
    pieces = sizes.groupBy(*by).agg(F.sum("_size").alias("_size"))
    grid = pieces.join(sizes.select("c", F.col("role").alias("speaker")).distinct(), "c")
    grid = grid.join(sizes.select(*by, F.col("role").alias("speaker"), "_own"), [*by, "speaker"], "left")
    earlier = W.partitionBy("c", "speaker").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    start = F.sum(F.col("_size") + F.coalesce("_own", F.lit(0))).over(earlier)
    return grid.select(*by, "speaker", F.coalesce(start, F.lit(0)).cast("long").alias("start"))


def rotate(turns: DataFrame, span: int = TURNS, most: int = MOST) -> DataFrame:
    """One row per conversation, speaker and piece: where it stands in the dialogue, its text, mask, and counts.

    Columns: conv_id, speaker, part, piece, start, n_turns, n_own, dialogue, mask. A dialogue is its pieces, one after the
    other in the order of (part, piece); ``start`` is the number of characters before a piece, so pieces are joined without
    reading the others. ``mask`` lists the character ranges of the speaker's words in the piece ("from-to", separated by
    commas), which training counts; "" if there are none. A part holds the turns numbered from part * ``span`` on, and is cut
    after every ``most`` rows, which needs turns that share a number. Participants are all roles of the whole
    conversation, so every piece has a rendering for each. Turns are ordered by number, then role, then MD5 of the text and the text
    itself, so that turns which share number and role are placed by many tasks; repeated rows are one turn. A null role is named "unknown", a null text
    is empty, a null turn is in part -1 before all that have a number there, and null conv_ids form one
    conversation. Extra columns are ignored; an empty table gives an empty result.
    """
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # "c" is never null, so plain equalities serve joins and groups alike.
    base = base.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.md5("text").alias("digest"),
                       F.when(F.col("turn") == FIRST, F.lit(-1)).otherwise(F.floor(F.col("turn") / span)).cast("long").alias("part"))
    # What places the turns needs no texts: their digests and lengths are written once and read by every step.
    rows = staged(base.select("c", "part", "turn", "role", "digest", F.length("text").alias("size")).distinct())
    pieces = _pieces(rows, most)
    each = _with_piece(base.distinct(), pieces).join(_places(_with_piece(rows, pieces)), ["c", "part", "piece"])
    listed = each.groupBy("c", "part", "piece", "speaker", "start", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "text"))).alias("t"))

    def segment(x: Column) -> Column:
        own = x["role"] == F.col("speaker")
        return F.struct(own.alias("own"), F.length(_header(own, x["role"])).alias("head"), F.length(x["text"]).alias("size"),
                        F.concat(_header(own, x["role"]), x["text"], F.lit("\n")).alias("s"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        here = F.concat(begin.cast("string"), F.lit("-"), (begin + x["size"]).cast("string"))
        return F.struct((begin + x["size"] + 1).alias("at"), F.when(x["own"], F.concat(acc["mask"], F.array(here))).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"))
    out = listed.withColumn("g", F.transform("t", segment))
    return out.select(
        "conv_id", "speaker", "part", "piece", "start", F.size("g").cast("long").alias("n_turns"), F.size(F.filter("g", lambda x: x["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("g", lambda x: x["s"]), "").alias("dialogue"), F.array_join(F.aggregate("g", start, add)["mask"], ",").alias("mask"))


SQL = f"""
WITH b AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / {TURNS}.0) AS BIGINT), -1) AS part FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM b
), p AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, md5(text), text) - 1) // {MOST} AS piece FROM b
), e AS (
  SELECT p.*, s.speaker, p.role = s.speaker AS own,
         CASE WHEN p.role = s.speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || p.role || '|>' || chr(10) END AS head
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn NULLS FIRST, role, md5(text), text)
         - length(text) - 1 AS begin FROM e
), r AS (
  SELECT conv_id, speaker, part, piece, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text), text) AS dialogue,
       coalesce(string_agg(CAST(CAST(begin AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, md5(text), text) FILTER (own), '') AS mask
  FROM o GROUP BY conv_id, speaker, part, piece
)
SELECT conv_id, speaker, part, CAST(piece AS BIGINT) AS piece,
       CAST(coalesce(sum(length(dialogue)) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       n_turns, n_own, dialogue, mask FROM r
"""
