"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``t`` coordinates. In round i every shingle is thrown into one of t bins (for i < t
a random bin, later bin i - t) and a bin keeps the least value of the first round that reached it,
so every coordinate is filled after at most 2t rounds, and the share of equal coordinates is
concentrated about the Jaccard similarity as for t independent samples. Bands of coordinates
give candidate buckets; candidates are verified on their full shingle sets.

Equal sets form one class and travel once. Buckets that hold the same classes count once. A
bucket's classes are linked to its hub first. A bucket that is still in several components is
then counted out exactly, in blocks of bounded size, and gives only links that join components.
So no group's pairs are listed, and no link between different texts is lost. Components are
found by hooking and pointer jumping over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, rest, slices, squeeze, staged, unpack_rest, unsqueeze, whole_groups
from .rolling import BASE, MAX, U, mix, powers, word_hashes

BANDS = 32
#: Shingles, and documents, of a block that is compared at once.
BLOCK, MEMBERS = 400_000, 2_500
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-5


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words, one of all of them."""
    w = word_hashes(np.frombuffer(text.lower(), np.uint8))[0]
    if not len(w):
        return w
    k = min(size, len(w))
    total = np.zeros(len(w) - k + 1, U)
    for j, p in enumerate(powers(k).tolist()):
        total += mix(w[j : len(w) - k + 1 + j]) * U(p)
    return np.unique(mix(total ^ U(k)))


def rows_per_band(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    r = 1
    while (1 - threshold ** (r + 1)) ** bands <= miss:
        r += 1
    return r


@lru_cache(maxsize=4)
def _salts(t: int) -> np.ndarray:
    return mix((np.arange(2 * t, dtype=U) + U(1)) * U(BASE))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a set that is not empty."""
    out = np.full(t, MAX)
    salts = _salts(t)
    done = 0
    while done < 2 * t:
        step = int(max(1, min(2 * t - done, 2 * t // len(items), (t - done) if done < t else 2 * t)))
        h = mix(items[None, :] ^ salts[done : done + step, None])
        i = np.arange(done, done + step)[:, None]
        place = (h >> U(40)) % U(t) if done < t else np.broadcast_to((i - t).astype(U), h.shape)
        np.minimum.at(out, place.ravel().astype(np.int64), ((i.astype(U) << U(40)) | (h & U(0xFFFFFFFFFF))).ravel())
        done += step
        if (out < MAX).all():
            break
    return out


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = mix(sketch(items, bands * rows)).reshape(bands, rows)
    return mix((s * powers(rows)[None, :]).sum(axis=1, dtype=U) + _salts(bands)[:bands])


def _prints(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: the number of shingles, a 128-bit name of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, names, keys = [], [], []
            for text in batch["text"]:
                items = shingles((text.as_py() or "").encode("utf-8", "surrogatepass"), size)
                counts.append(len(items))
                if len(items):
                    one, two = (items * powers(len(items))).sum(dtype=U), mix(items ^ U(BASE)).sum(dtype=U)
                    names.append(np.array([one, two], U).tobytes().hex().upper())
                    keys.append(band_keys(items, bands, rows).view(np.int64).tolist())
                else:
                    names.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["_doc"], batch["_text"], pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "_doc", "_text", "n", "set", "keys"])

    return documents(docs).mapInArrow(run, "doc_id long, _doc long, _text long, n long, set string, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar enough."""
    one, two = texts.select(F.col("node").alias("a"), F.col("_z").alias("za")), texts.select(F.col("node").alias("b"), F.col("_z").alias("zb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                left, right, keep = unsqueeze(part["za"]), unsqueeze(part["zb"]), []
                known: dict[bytes, np.ndarray] = {}

                def items(text: bytes) -> np.ndarray:
                    if text not in known:
                        known[text] = shingles(text, size)  # noqa: B023
                    return known[text]  # noqa: B023

                for x, y in zip(left, right, strict=True):
                    x, y = items(x), items(y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a string, b string")


def group_links(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) that connect what the similar pairs of the sets connect, pairs of one label aside.

    Intersections are exact counts: a shingle of many sets adds a column of a dense product, one
    of few sets adds its pairs.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    items, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    often = np.bincount(column, minlength=len(items))
    both = np.zeros((m, m), np.float32)
    dense = np.flatnonzero(often > 32)
    place = np.full(len(items), -1)
    place[dense] = np.arange(len(dense))
    at = place[column]
    for c in range(0, len(dense), 2048):
        use = (at >= c) & (at < c + 2048)
        one = np.zeros((m, min(2048, len(dense) - c)), np.float32)
        one[row[use], at[use] - c] = 1
        both += one @ one.T
    use = (often[column] > 1) & (often[column] <= 32)
    order = np.argsort(column[use], kind="stable")
    r, c = row[use][order], column[use][order]
    for step in range(1, 32):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        np.add.at(both, (r[same], r[same + step]), 1)
        np.add.at(both, (r[same + step], r[same]), 1)
    hit = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (label[:, None] != label[None, :])
    root = np.arange(m)
    while True:
        low = np.minimum(root, np.where(hit, root[None, :], m).min(axis=1))
        low = low[low]
        if (low == root).all():
            return [(i, int(k)) for i, k in enumerate(root) if i != k]
        root = low


def _block_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within the buckets that hub links left in several components, found by exact counts.

    A bucket too large for memory is cut into blocks, and each pair of its blocks is one group:
    what a task holds is bounded by the block.
    """
    own = F.pmod(F.xxhash64("h"), F.col("cuts")).cast("int")
    pairs = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    keyed = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "node", "label")
    rows = keyed.join(texts, "node").repartition("part").sortWithinPartitions("part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part", 500):
            part = table["part"].to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                group = table.slice(begin, end - begin)
                labels = group["label"].to_pylist()
                numbers = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                if len(numbers) < 2:
                    continue
                found = group_links([shingles(t, size) for t in unsqueeze(group["_z"])], np.array([numbers[x] for x in labels]), percent)
                if found:
                    nodes = group["node"].to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found]), pa.array([nodes[j] for _, j in found])], names=["a", "b"])

    return rows.mapInArrow(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the least node of its component.

    Each pass hooks the larger label of a link under the smallest it meets and follows two
    pointers, so long chains shorten by a constant factor a pass.
    """
    labels = staged(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node")))
    edges = staged(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not edges.isEmpty():
        up = edges.groupBy("hi").agg(F.min("lo").alias("lo"))
        for _ in range(2):
            over = up.select(F.col("hi").alias("lo"), F.col("lo").alias("over"))
            up = staged(up.join(over, "lo", "left").select("hi", F.coalesce("over", "lo").alias("lo")))
        to = lambda c: up.select(F.col("hi").alias(c), F.col("lo").alias(f"{c}_up"))
        labels = staged(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_up", "label").alias("label")))
        moved = (edges.join(to("hi"), "hi", "left").join(to("lo"), "lo", "left")
                 .select(F.coalesce("hi_up", "hi").alias("x"), F.coalesce("lo_up", "lo").alias("y")).filter("x <> y"))
        edges = staged(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and kept (doc_id = component_id).

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``size``-word shingles (A-Z lower-cased, words split at ASCII white space). A null or
    wordless text has an empty set and is linked with nothing; its component is its own id. A
    null id counts as larger than any other and stays null as a component; of several rows with
    one id, all are kept or none. Extra columns are ignored; ``_doc`` and ``_text`` name the row,
    and ``_first`` marks the one document of its component (and its identical rows).
    """
    rows = rows_per_band(percent / 100, bands)
    prints = staged(_prints(docs, size, bands, rows))
    least = F.lpad(F.hex(F.expr("_doc ^ -9223372036854775808")), 16, "0")
    classes = staged(prints.filter("n > 0").groupBy("set").agg(F.min(F.struct("_doc", "_text", "n", "keys")).alias("r"))
                     .select("set", "r.*").withColumn("node", F.concat(least, F.col("set"))))
    # buckets of two classes or more; those with the same classes count once
    marks = classes.select(F.explode("keys").alias("key"), F.xxhash64("node").alias("h"))
    sizes = marks.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("h").alias("s1"), F.bit_xor(F.xxhash64("h")).alias("s2")).filter("m > 1")
    once = sizes.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    named = classes.select(F.xxhash64("node").alias("h"), "node", "n")
    members = staged(marks.join(once, "key").join(named, "h").select("key", "h", "node", "n"))
    hubs = staged(members.groupBy("key").agg(F.max(F.struct("h", "node", "n")).alias("hub")).select("key", "hub.node", "hub.n"))
    texts = staged(_texts(docs, classes.join(members.select("node").distinct(), "node", "left_semi")))

    alike = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    hub = hubs.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = members.select("key", F.col("node").alias("a"), F.col("n").alias("na")).join(hub, "key").filter((F.col("a") != F.col("b")) & alike)
    links = staged(_verified(pairs.select("a", "b").distinct(), texts, size, percent))
    labels = components(links)

    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m"), F.sum("n").alias("all")).filter("l0 < l1 and m > 2")
    cuts = mixed.select("key", F.ceil(F.greatest(F.col("all") / block, F.col("m") / MEMBERS)).cast("int").alias("cuts"))
    more = staged(_block_links(known.join(cuts, "key"), texts, size, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    found = classes.join(labels, "node", "left").select(
        "set", F.coalesce("label", "node").alias("label"), F.when(F.coalesce("label", "node") == F.col("node"), F.struct("_doc", "_text")).alias("one"))
    ids = found.select("set", "one", F.expr("cast(conv(substr(label, 1, 16), 16, -10) as long) ^ -9223372036854775808").alias("component"))
    out = prints.drop("keys").join(ids, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("_doc")).otherwise(F.col("component"))
    return out.select("doc_id", "_doc", "_text", F.col("n").alias("n_shingles"), component.alias("_component"),
                      (F.col("set").isNull() | F.coalesce(F.col("one") == F.struct("_doc", "_text"), F.lit(False))).alias("_first")).select(
        "doc_id", "_doc", "_text", "_first", "n_shingles", F.when(F.col("_component") < F.lit((1 << 63) - 1), F.col("_component")).alias("component_id"),
        (F.col("_doc") == F.col("_component")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, once."""
    first = near_duplicates(docs, size, percent, bands).filter("_first").select(F.col("_doc").alias("_d"), F.col("_text").alias("_t")).distinct()
    keyed = documents(docs, rest(docs)).join(first, (F.col("_doc") == F.col("_d")) & (F.col("_text") == F.col("_t")))
    return unpack_rest(keyed.dropDuplicates(["_doc", "_text"]), docs.columns)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, compressed text) of one document of each class."""
    source = documents(docs).join(wanted.select("_doc", "_text", "node"), ["_doc", "_text"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 8 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["node"], squeeze([t.encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()])], names=["node", "_z"])

    return source.mapInArrow(run, "node string, _z binary").dropDuplicates(["node"])
