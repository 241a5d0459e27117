"""Substring dedup over bytes with a hash-compared suffix sort.

Suffixes are grouped by anchors as in ``repeats``; a group's suffixes start at its anchor, to the
right, and end before it, to the left (reversed). Both kinds are sorted by mergesort in which two
suffixes are compared through prefix polynomial hashes: a binary search finds their common
extension, and the next byte decides. Equal extensions are verified byte by byte, so a collision
of hashes changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import repeats
from .common import rest, unsqueeze
from .rolling import BYTE, Prefix, anchored_runs

WINDOW = 200
#: Runs of one anchor that are sorted together: about 2 MB of text.
HEAVY = 5_000
GRAM = 24


class Suffixes:
    """Byte strings of one group or several, compared by hashes of their prefixes."""

    def __init__(self, texts: list[bytes]):
        self.text = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.hashes = Prefix(BYTE[self.text])
        self.most = int(self.size.max()) if len(texts) else 0

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j, by binary search on hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        bi, bj = self.begin[i], self.begin[j]
        for _ in range(max(1, self.most.bit_length())):
            middle = (low + high + 1) >> 1
            same = self.hashes.range(bi, bi + middle) == self.hashes.range(bj, bj + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j; a prefix sorts first, equal strings by number."""
        c = self.common(i, j)
        end_i, end_j = c >= self.size[i], c >= self.size[j]
        a = np.where(end_i, -1, self.text[np.minimum(self.begin[i] + c, len(self.text) - 1)].astype(np.int64))
        b = np.where(end_j, -1, self.text[np.minimum(self.begin[j] + c, len(self.text) - 1)].astype(np.int64))
        return (a < b) | ((a == b) & (i < j))

    def verified(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours, checked byte by byte."""
        c = self.common(i, j)
        begins = np.cumsum(c) - c
        k = np.arange(int(c.sum())) - np.repeat(begins, c)
        wrong = self.text[np.repeat(self.begin[i], c) + k] != self.text[np.repeat(self.begin[j], c) + k]
        if wrong.any():
            pair = np.repeat(np.arange(len(c)), c)[wrong]
            first = np.full(len(c), np.iinfo(np.int64).max)
            np.minimum.at(first, pair, k[wrong])
            c = np.minimum(c, first)
        return c


def merge_sort(s: Suffixes, group: np.ndarray) -> np.ndarray:
    """Numbers of the strings in order within each group (groups stand in order already).

    All groups are merged at once, level by level: an element's place in a merged run is its
    place in its own half plus its rank in the other, found by binary search.
    """
    n = len(group)
    order = np.arange(n)
    begin = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - begin
    width = 1
    while n and width < int(size.max()):
        place = np.arange(n) - begin
        block = place // (2 * width) * (2 * width)
        left = place - block < width
        low = begin + np.where(left, np.minimum(block + width, size), block)
        high = begin + np.where(left, np.minimum(block + 2 * width, size), np.minimum(block + width, size))
        other = low.copy()
        while (busy := np.flatnonzero(low < high)).size:
            middle = (low[busy] + high[busy]) >> 1
            before = s.less(order[middle], order[busy])
            low[busy] = np.where(before, middle + 1, low[busy])
            high[busy] = np.where(before, high[busy], middle)
        own = place - block - np.where(left, 0, width)
        new = begin + block + own + (low - other)
        merged = np.empty(n, np.int64)
        merged[new] = order
        order = merged
        width *= 2
    return order


def _classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Class of each string: neighbours in the order that share ``least`` bytes are together."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(common < least)))
    return out


def scheme(window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> repeats.Scheme:
    def runs(texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        parts = []
        # a text too long for one pass goes in overlapping pieces; each window is in one of them
        text, most, step = b"".join(texts), 4 << 20, (4 << 20) - window + 1
        for at in range(0, max(1, len(text) - window + 1), step):
            a = np.frombuffer(text[at : at + most], np.uint8)
            owner = np.searchsorted(begins, np.arange(at, at + len(a)), side="right") - 1 if len(texts) > 1 else np.zeros(len(a), np.int64)
            found = anchored_runs(BYTE[a], owner, window, gram)
            row = owner[found["start"]]
            found["start"] = found["start"] + at - begins[row]
            parts.append((found, row))
        if len(parts) == 1:
            return parts[0]
        return {k: np.concatenate([p[0][k] for p in parts]) for k in parts[0][0]}, np.concatenate([p[1] for p in parts])

    def contexts(text: bytes, where):
        return [(offset, text[s : s + n - 1 + window]) for s, n, offset in where]

    def units(context: bytes) -> np.ndarray:
        return BYTE[np.frombuffer(context, np.uint8)]

    def solve(table: pa.Table) -> list[np.ndarray]:
        anchor, n, offset, seen = (table[c].to_numpy() for c in ("anchor", "n", "offset", "seen"))
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        texts = table["context"].to_pylist()
        sides = []
        for strings in ([t[o:] for t, o in zip(texts, offset.tolist(), strict=True)], [t[:o][::-1] for t, o in zip(texts, offset.tolist(), strict=True)]):
            s = Suffixes(strings)
            order = merge_sort(s, group)
            shared = s.verified(order[:-1], order[1:])
            shared[group[order[1:]] != group[order[:-1]]] = -1
            sides.append((order, shared))
        marks = [np.zeros(k, bool) for k in n.tolist()]
        for o in range(int(offset.max()) + 1):
            # windows that start o bytes before the anchor
            rows = np.flatnonzero((offset >= o) & (offset - o < n))
            if len(rows) < 2:
                continue
            key = _classes(*sides[0], window - o)[rows] * (len(n) + 1) + _classes(*sides[1], o)[rows]
            _, which = np.unique(key, return_inverse=True)
            for r in rows[np.bincount(which, seen[rows])[which] > 1].tolist():
                marks[r][offset[r] - o] = True
        return marks

    return repeats.Scheme(window, gram, "anywhere", runs, contexts, units, solve, batch=1 << 20, heavy=heavy)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """Remove each byte covered by a string of ``window`` bytes that also starts anywhere else.

    One row per document: its other columns as ``_rest``, ``doc_id``, ``kept`` (the remaining
    bytes), ``n_bytes``, ``n_removed`` and ``spans`` (start and end of each removed run).
    Strings are judged on the input, within documents and across them, and never cross
    documents. A null text counts as empty, a repeated row as one more document. Texts shorter
    than the window stay; an empty table gives an empty result.
    """
    marks = repeats.repeated_windows(docs, scheme(window, gram, heavy))
    source = docs.select("doc_id", "text", rest(docs))
    both = repeats.with_marks(source, marks, "_rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                kept, size, gone, spans = [], [], [], []
                for text, marks in zip(unsqueeze(part["_z"]), part["marks"].to_pylist(), strict=True):
                    text = text or b""
                    edges: list[list[int]] = []
                    if marks:
                        out = repeats.removed_units(len(text), marks, window)
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                        kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                    else:
                        kept.append(text)
                    size.append(len(text))
                    gone.append(len(text) - len(kept[-1]))
                    spans.append([{"start": s, "end": e} for s, e in edges])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["_rest"], pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "_rest", "kept", "n_bytes", "n_removed", "spans"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), source.schema["_rest"], T.StructField("kept", T.BinaryType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    return both.mapInArrow(run, schema)
