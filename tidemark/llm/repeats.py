"""Finding repeated windows of fixed length across a corpus, by anchored runs of suffixes.

Every window of ``window`` units (words or bytes) is the head of one suffix. The head's part up to
and including its anchor is a prefix of variable length; windows are split by it into groups that
are solved on their own, as equal windows have equal prefixes. Runs of neighbouring windows with
one anchor travel together:

1. each document emits one small row per run (about one per ``window``/2 units): the anchor's and
   the run's hash (64 bits each);
2. anchors seen once leave; a run whose whole extent is repeated is settled by the two hashes
   (128 bits together);
3. only where one anchor has *different* runs are texts compared: one copy of each run is fetched
   with its neighbourhood, sorted to its anchor's group, and solved there by ``scheme.solve``;
4. an anchor with more than ``heavy`` different runs is split further, by the whole window, into
   single classes that Spark aggregates with a map-side combine, so no group grows with the data;
5. the marks of a document come back to it and it is rewritten.

``rule`` says what counts: ``earlier`` marks a window that also starts in a document with a
smaller id, ``anywhere`` one that starts at any other place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, packed, slices, staged, unsqueeze, whole_groups
from .rolling import Prefix, U, covered, mix

#: One row per distinct run, with its text; what ``solve`` gets, sorted by (anchor, extent).
CONTEXT = "anchor long, extent long, doc long, seen long, n int, offset int, left int, context binary"
SOLVED = "anchor long, extent long, bits binary"
SECOND = U(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Scheme:
    window: int
    gram: int
    rule: str
    #: texts -> (runs by name, row of each run)
    runs: Callable
    #: (text, [(start, n, offset)]) -> [(left, context)]: what lies around each run
    contexts: Callable
    #: context -> hashable units, as an integer array
    units: Callable
    #: table of CONTEXT with whole anchors -> list of bool arrays, the windows to mark
    solve: Callable
    batch: int = 1 << 20
    heavy: int = 400


def _runs(docs: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(texts)), scheme.batch):
                found, row = scheme.runs([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts.slice(a, b - a)])
                if len(row):
                    at = (found["start"] << 24) | (found["count"] << 12) | found["offset"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found["anchor"].view(np.int64)), pa.array(found["extent"].view(np.int64)),
                         batch["_doc"].slice(a, b - a).take(pa.array(row)), batch["_text"].slice(a, b - a).take(pa.array(row)), pa.array(at)],
                        names=["anchor", "extent", "doc", "text_id", "at"])

    return documents(docs).mapInArrow(run, "anchor long, extent long, doc long, text_id long, at long")


def _fetch(docs: DataFrame, spots: DataFrame, scheme: Scheme) -> DataFrame:
    """The text around each run of ``spots``; one copy of each document is enough."""
    wanted = spots.groupBy("doc", "text_id").agg(F.collect_list(F.struct("anchor", "extent", "at", "seen")).alias("spots"))
    texts = packed(docs)
    both = texts.join(wanted, (texts["_doc"] == wanted["doc"]) & (texts["_text"] == wanted["text_id"])).select("doc", "spots", "_z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                spots = part["spots"].to_pylist()[0]
                at = np.array([s["at"] for s in spots], np.int64)
                where = list(zip((at >> 24).tolist(), ((at >> 12) & 4095).tolist(), (at & 4095).tolist(), strict=True))
                around = scheme.contexts(unsqueeze(part["_z"])[0], where)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["anchor"] for s in spots], pa.int64()), pa.array([s["extent"] for s in spots], pa.int64()),
                     pa.array([part["doc"][0].as_py()] * len(spots), pa.int64()), pa.array([s["seen"] for s in spots], pa.int64()),
                     pa.array([w[1] for w in where], pa.int32()), pa.array([w[2] for w in where], pa.int32()),
                     pa.array([x[0] for x in around], pa.int32()), pa.array([x[1] for x in around], pa.binary())],
                    names=["anchor", "extent", "doc", "seen", "n", "offset", "left", "context"])

    return both.mapInArrow(run, CONTEXT)


def _solved(contexts: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "anchor", 4_000):
            # a document given twice is fetched twice: one context for each run is enough
            new = np.ones(table.num_rows, bool)
            a, e = table["anchor"].to_numpy(), table["extent"].to_numpy()
            new[1:] = (a[1:] != a[:-1]) | (e[1:] != e[:-1])
            table = table.filter(pa.array(new)).combine_chunks()
            marks = scheme.solve(table)
            hit = np.flatnonzero([m.any() for m in marks])
            if len(hit):
                yield pa.RecordBatch.from_arrays([table["anchor"].combine_chunks().take(pa.array(hit)), table["extent"].combine_chunks().take(pa.array(hit)),
                                                  pa.array([np.packbits(marks[i]).tobytes() for i in hit], pa.binary())], names=["anchor", "extent", "bits"])

    return contexts.repartition("anchor").sortWithinPartitions("anchor", "extent").mapInArrow(run, SOLVED)


def window_hashes(values: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window; the second's units are scrambled anew, so that it is no image of the first."""
    return Prefix(values).range(start, start + window), Prefix(mix(values ^ SECOND)).range(start, start + window)


def _by_window(contexts: DataFrame, scheme: Scheme) -> DataFrame:
    """Heavy anchors: each window is a class of its own, found by its anchor and two 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = scheme.units(row["context"])
                start = row["left"] - row["offset"] + np.arange(row["n"])
                one, two = window_hashes(values, start, scheme.window)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, row["anchor"])), pa.array(np.full(n, row["extent"])),
                     pa.array(np.full(n, row["doc"])), pa.array(np.full(n, row["seen"])), pa.array(np.arange(n, dtype=np.int32))],
                    names=["one", "two", "anchor", "extent", "doc", "seen", "i"])

    rows = contexts.dropDuplicates(["anchor", "extent"]).mapInArrow(run, "one long, two long, anchor long, extent long, doc long, seen long, i int")
    classes = rows.groupBy("anchor", "one", "two").agg(F.min("doc").alias("least"), F.sum("seen").alias("all"))
    test = F.col("doc") > F.col("least") if scheme.rule == "earlier" else F.col("all") > 1
    hits = rows.join(classes.filter("all > 1"), ["anchor", "one", "two"]).filter(test)

    listed = hits.groupBy("anchor", "extent").agg(F.collect_set("i").alias("places"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch["places"].to_pylist():
                mask = np.zeros(scheme.window, bool)
                mask[places] = True
                out.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([batch["anchor"], batch["extent"], pa.array(out, pa.binary())], names=["anchor", "extent", "bits"])

    return listed.mapInArrow(flags, SOLVED)


def repeated_windows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (doc, text_id, at, bits): runs with windows to mark; null bits mark the whole run."""
    runs = _runs(docs, scheme)
    anchors = runs.groupBy("anchor").agg(
        F.count("*").alias("c"), F.min("extent").alias("e0"), F.max("extent").alias("e1"), F.min("doc").alias("d0"), F.max("doc").alias("d1"))
    seen = anchors.filter("d0 < d1" if scheme.rule == "earlier" else "c > 1").select("anchor", (F.col("e0") < F.col("e1")).alias("mixed"), "d0")
    live = staged(runs.join(seen, "anchor"))
    whole = live.filter("not mixed" + (" and doc > d0" if scheme.rule == "earlier" else "")).select("doc", "text_id", "at", F.lit(None).cast("binary").alias("bits"))

    mixed = live.filter("mixed")
    kinds = staged(mixed.groupBy("anchor", "extent").agg(F.min(F.struct("doc", "text_id", "at")).alias("first"), F.count("*").alias("seen"))
                   .select("anchor", "extent", "first.doc", "first.text_id", "first.at", "seen"))
    many = kinds.groupBy("anchor").agg(F.count("*").alias("k"))
    spots = kinds.join(many.filter("k > 1"), "anchor")
    contexts = staged(_fetch(docs, spots.select("doc", "text_id", "anchor", "extent", "at", "seen"), scheme).join(many, "anchor"))
    light, heavy = contexts.filter(F.col("k") <= scheme.heavy).drop("k"), contexts.filter(F.col("k") > scheme.heavy).drop("k")
    found = _solved(light, scheme).unionByName(_by_window(heavy, scheme))
    facts = kinds.join(found, ["anchor", "extent"], "left").select("anchor", "extent", F.col("doc").alias("first"), "seen", "bits")
    full = F.col("doc") > F.col("first") if scheme.rule == "earlier" else F.col("seen") > 1
    part = (mixed.join(facts, ["anchor", "extent"]).filter(full | F.col("bits").isNotNull())
            .select("doc", "text_id", "at", F.when(~full, F.col("bits")).alias("bits")))
    return whole.unionByName(part)


def with_marks(docs: DataFrame, marks: DataFrame, *more: str) -> DataFrame:
    """Each document (text compressed as ``_z``) with its list of marks, null if it has none."""
    lists = marks.groupBy("doc", "text_id").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    texts = packed(docs, *more)
    return texts.join(lists, (texts["_doc"] == lists["doc"]) & (texts["_text"] == lists["text_id"]), "left").select("doc_id", *more, "_z", "marks")


def removed_units(n: int, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which of a document's n units the marked windows cover."""
    starts = []
    for m in marks or ():
        at = m["at"]
        start, count = at >> 24, (at >> 12) & 4095
        places = np.arange(count) if m["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8))[:count])
        starts.append(start + places)
    return covered(n, np.concatenate(starts), window) if starts else np.zeros(n, bool)
