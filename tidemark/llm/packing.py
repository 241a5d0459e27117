"""Best-fit packing of token pieces into sequences by bin completion.

Only lengths matter for the packing, so it is planned on the count of pieces of each length: at
most ``size`` numbers, whatever the input. A sequence is begun with the longest piece left and
completed by a set of lengths; completions that another one dominates are left out. The search
branches over completions, the fullest first, with best-fit decreasing as the first incumbent,
and cuts where the waste so far admits no better plan. A completion is applied to as many
sequences at once as the counts allow. The plan is a list of patterns with multiplicities; pieces
are numbered within their length by all tasks and take their places in it.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, running, slices, staged
from .encoder import Encoder

SIZE = 1024
END = 2


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, _doc, _text, piece, start, length, ids_crc32[, ids]) of each document's ids and ``end``.

    Longer documents are cut into pieces of ``size``; the first one may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)  # of this task only: a reused worker does not hold its words on
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 3 << 20):
                part = batch.slice(a, b - a)
                ids, ends = encoder.encode_flat(part["text"], end)
                begin = np.append(0, ends[:-1])
                n = ends - begin
                many = -(-n // size)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = (n - (many - 1) * size)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * size)
                length = np.where(piece == 0, first, size)
                place = begin[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(place.tolist(), (place + length).tolist(), strict=True)]
                at = pa.array(row)
                columns = [part["doc_id"].take(at), part["_doc"].take(at), part["_text"].take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "_doc", "_text", "piece", "start", "length", "ids_crc32"]
                if with_ids:  # pieces lie end to end in the ids
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(place, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, _doc long, _text long, piece int, start long, length long, ids_crc32 long"
    return documents(docs).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def completions(lengths: list[int], room: int, most: int, counts: dict[int, int]) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` by pieces of these lengths (longest first), fullest first.

    A filling is dominated if a longer piece left over would fit in place of one of its pieces;
    then the same sequence could be fuller. At most ``most`` are returned.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = [0]

    def grow(i: int, left: int, chosen: tuple[int, ...]) -> None:
        steps[0] += 1
        if steps[0] > 50 * most or len(found) > 4 * most:
            return
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if i == len(lengths):
            found.append((left, chosen))
            return
        x = lengths[i]
        used = chosen.count(x)
        if used < counts[x]:
            grow(i, left - x, (*chosen, x))
        # without x: only if what follows can still use the room that x would have taken
        if i + 1 < len(lengths) and left:
            grow(i + 1, left, chosen)

    grow(0, room, ())
    kept = []
    for left, chosen in sorted(set(found), key=lambda f: (f[0], [-x for x in f[1]])):
        if any(counts[y] > chosen.count(y) for y in lengths for x in chosen if x < y <= x + left):
            continue
        kept.append(chosen)
        if len(kept) == most:
            break
    return kept or [()]


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: patterns and how many sequences each."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = next((r for r in range(x, size + 1) if open_.get(r)), None)
            if room is None:
                k = size // x
                full, over = divmod(n, k)
                if full:
                    rest = open_.setdefault(size - k * x, {})
                    rest[(x,) * k] = rest.get((x,) * k, 0) + full
                if over:
                    rest = open_.setdefault(size - over * x, {})
                    rest[(x,) * over] = rest.get((x,) * over, 0) + 1
                break
            pattern, many = open_[room].popitem()
            k = min(room // x, n)
            take = min(many, n // k)
            if many > take:
                open_[room][pattern] = many - take
            new = open_.setdefault(room - k * x, {})
            new[pattern + (x,) * k] = new.get(pattern + (x,) * k, 0) + take
            n -= take * k
    return [(p, m) for patterns in open_.values() for p, m in patterns.items()]


def plan(counts: dict[int, int], size: int = SIZE, nodes: int = 3_000, branch: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, number of such sequences) for all pieces.

    Branch and bound: the incumbent is best-fit decreasing; a branch is cut if its sequences and
    the room that the rest needs at least reach the incumbent. ``nodes`` bounds the search.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, size)
    goal = [sum(m for _, m in best)]
    least = -(-sum(x * n for x, n in counts.items()) // size)
    result = [best]
    left = [nodes]

    def search(rest: dict[int, int], tokens: int, used: int, chosen: list[tuple[tuple[int, ...], int]]) -> None:
        if left[0] <= 0 or goal[0] <= least or used + -(-tokens // size) >= goal[0]:
            return
        if not rest:
            goal[0], result[0] = used, list(chosen)
            return
        left[0] -= 1
        longest = max(rest)
        after = dict(rest)
        after[longest] -= 1
        lengths = sorted((x for x, n in after.items() if n and x <= size - longest), reverse=True)
        for fill in completions(lengths, size - longest, branch, after):
            pattern = (longest, *fill)
            times = min(rest[x] // pattern.count(x) for x in set(pattern))
            new = {x: n - times * pattern.count(x) for x, n in rest.items()}
            search({x: n for x, n in new.items() if n}, tokens - times * sum(pattern), used + times, [*chosen, (pattern, times)])

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    search(dict(counts), sum(x * n for x, n in counts.items()), 0, [])
    return result[0]


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, _doc, _text, piece, start, length, ...).

    Full pieces are sequences of their own. The plan's intervals (of ranks within one length) are
    at most a few thousand rows, bounded by ``size`` and not by the data.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = plan(counts, size)
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in sorted(patterns, reverse=True):
        offset = 0
        for x in pattern:
            rows.append((x, taken.get(x, 0), taken.get(x, 0) + times, base, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        base += times
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for r in rows:
        by_length.setdefault(r[0], []).append(r)
    tables = {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in by_length.items()}
    numbered = running(pieces, [F.col("length")], [F.col("_doc"), F.col("_text"), F.col("piece")]).drop("_before")
    names = numbered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                _, low, _, first, place = tables[x]
                i = np.searchsorted(low, rank[rows], side="right") - 1
                sequence[rows] = first[i] + rank[rows] - low[i]
                offset[rows] = place[i]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*numbered.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(run, schema).drop("_rank")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """All documents as pieces placed in as few sequences of at most ``size`` tokens as found.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` on demand.
    A null text is an empty document (the end id alone). Repeated rows are packed each on their
    own. An empty table gives an empty result. Other columns are ignored.
    """
    out = place(staged(token_pieces(docs, tokenizer, size, end, with_ids)), size)
    return out.drop("_doc", "_text")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces with ids, in the order of their offsets."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
