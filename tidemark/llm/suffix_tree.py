"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes are split by a prefix of variable length (up to the end of their window's anchor) into
groups that fit in memory, see ``repeats``. In each group the suffixes are sorted by their words;
neighbours' common prefixes give the tree's internal nodes, and the nodes of at least ``window``
words are the repeats: a suffix below one starts a repeated window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import repeats
from .common import rest, unpack_rest, unsqueeze
from .rolling import anchored_runs, word_bounds, word_hashes

WINDOW = 50
GRAM = 8


def deep_nodes(suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes (rows of word ids) and cut them into the tree's nodes of that depth.

    Returns the sorted order and, for each place in it, the number of its node. Two neighbours
    share a node if their common prefix has ``depth`` words.
    """
    rows = np.ascontiguousarray(suffixes[:, :depth].astype(">u4"))
    order = np.argsort(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), kind="stable")
    ranked = rows[order]
    differs = (ranked[1:] != ranked[:-1])
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    return order, np.concatenate(([0], np.cumsum(common < depth)))


def scheme(window: int = WINDOW, gram: int = GRAM, heavy: int = 400) -> repeats.Scheme:
    def runs(texts: list[bytes]):
        a = np.frombuffer(b"\n".join(texts), np.uint8)
        values, start = word_hashes(a)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        owner = np.searchsorted(begins, start, side="right") - 1
        found = anchored_runs(values, owner, window, gram)
        row = owner[found["start"]]
        found["start"] = found["start"] - np.searchsorted(owner, row)
        return found, row

    def contexts(text: bytes, where):
        a = np.frombuffer(text, np.uint8)
        start, end = word_bounds(a)
        out = []
        for s, n, offset in where:
            last = s + n - 1 + window
            out.append((offset, b" ".join(text[x:y] for x, y in zip(start[s:last].tolist(), end[s:last].tolist(), strict=True))))
        return out

    def units(context: bytes) -> np.ndarray:
        return word_hashes(np.frombuffer(context, np.uint8))[0]

    def solve(table: pa.Table) -> list[np.ndarray]:
        ids: dict[bytes, int] = {}
        anchor, doc, n = (table[c].to_numpy() for c in ("anchor", "doc", "n"))
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        pieces, docs, groups = [], [], []
        for i, context in enumerate(table["context"].to_pylist()):
            w = np.array([ids.setdefault(x, len(ids)) for x in context.split()], np.uint32)
            pieces.append(np.lib.stride_tricks.sliding_window_view(w, window))
            docs.append(np.full(len(pieces[-1]), doc[i]))
            groups.append(np.full(len(pieces[-1]), group[i], np.uint32))
        keyed = np.concatenate([np.concatenate(groups)[:, None], np.concatenate(pieces)], axis=1)
        owner = np.concatenate(docs)
        order, node = deep_nodes(keyed, window + 1)
        least = np.full(node[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, owner[order])
        mark = np.zeros(len(owner), bool)
        mark[order] = owner[order] > least[node]
        return np.split(mark, np.cumsum(n)[:-1])

    return repeats.Scheme(window, gram, "earlier", runs, contexts, units, solve, heavy=heavy)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = 400) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller id.

    One row per document: all its columns, with ``text`` made of the kept words joined by one
    space, and ``_n_words``, ``_n_removed``. Windows are judged on the input. Words are runs of
    bytes that are no ASCII white space. A null text has no words and stays null. A null id
    counts as larger than any other. Rows with one id never remove each other's words; a
    repeated row gets the same result twice. Texts shorter than the window stay. An empty table
    gives an empty result. Other columns pass through, whatever their names.
    """
    marks = repeats.repeated_windows(docs, scheme(window, gram, heavy))
    source = docs.select("doc_id", "text", rest(docs))
    both = repeats.with_marks(source, marks, "_rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                kept, total, gone = [], [], []
                for text, marks in zip(unsqueeze(part["_z"]), part["marks"].to_pylist(), strict=True):
                    w = text.split() if text else []
                    if marks:
                        out = repeats.removed_units(len(w), marks, window)
                        left = [x for x, r in zip(w, out.tolist(), strict=True) if not r]
                    else:
                        left = w
                    kept.append(None if text is None else b" ".join(left).decode("utf-8", "replace"))
                    total.append(len(w))
                    gone.append(len(w) - len(left))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(kept, pa.string()), part["_rest"], pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                                 names=["doc_id", "text", "_rest", "_n_words", "_n_removed"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), source.schema["_rest"],
                           T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())])
    out = both.mapInArrow(run, schema)
    return out


def restored(out: DataFrame, columns: list[str]) -> DataFrame:
    """The result with the columns that the documents had."""
    return unpack_rest(out, columns)
