"""Quality rules: divergence of a document's histograms from language references.

A language's reference is the mean character-class histogram and the mean histogram of its most
common short words, over all its documents that pass the base rules; each document weighs the
same. A document is compared with every language by Jensen-Shannon distance and is kept if the
nearest one is near enough in both. Documents under the length guards are not judged by it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, rest, slices, staged
from .rolling import U, mix, word_bounds, word_hashes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MIN_CHARS = 200
CLASS_DISTANCE = 0.22
WORD_DISTANCE = 0.45
COMMON = 40
SHORT = 4
TRIM = b".,;:!?\"'()"

# character classes: lower case, upper case, digit, white space, sentence marks, other ASCII, other letters
CLASSES = np.full(256, 7, np.int64)  # 7: continuation bytes, which count for nothing
CLASSES[:128] = 5
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[list(b".,;:!?\"'()-")] = 4
CLASSES[192:] = 6
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (root of the divergence in bits, 0 to 1) of the rows of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], gram: int = 3) -> dict[str, np.ndarray]:
    """The base counts and the character-class counts of each text."""
    n = len(texts)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    a = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = word_bounds(a)
    owner = np.searchsorted(begin, start, side="right") - 1
    points = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[a])))
    last = begin + size - 1
    which = np.repeat(np.arange(n), size)[: len(a)]
    if len(a):
        classes = np.bincount(which * 8 + CLASSES[a], minlength=8 * n).reshape(n, 8)[:, :7].copy()
    else:
        classes = np.zeros((n, 7), np.int64)
    classes[: n - 1, 3] -= 1  # the line end that joins two texts
    repeat = np.zeros(n, np.int64)
    if len(start) >= gram:
        w, _ = word_hashes(a)
        g = mix(owner[: len(w) - gram + 1].astype(U))
        for j in range(gram):
            g = mix(g ^ w[j : len(w) - gram + 1 + j])
        inside = np.flatnonzero(owner[: len(w) - gram + 1] == owner[gram - 1 :])
        if len(inside):
            _, inverse, count = np.unique(g[inside], return_inverse=True, return_counts=True)
            again = inside[count[inverse] > 1]
            hit = np.zeros(len(w), bool)
            for j in range(gram):
                hit[again + j] = True
            repeat = np.bincount(owner[hit], minlength=n)
    return {"n_words": np.bincount(owner, minlength=n), "word_chars": np.bincount(owner, (points[end] - points[start]), minlength=n).astype(np.int64),
            "n_symbols": symbols[last] - symbols[begin], "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
            "n_repeat_words": repeat, "classes": classes}


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def short_words(text: bytes) -> Counter:
    """Counts of words of at most ``SHORT`` characters, lower case, without marks around them."""
    trimmed = (w.strip(TRIM) for w in text.decode("utf-8", "replace").lower().encode().split())
    return Counter(w for w in trimmed if 0 < len(w) <= 2 * SHORT and len(w.decode("utf-8", "replace")) <= SHORT)


def references(docs: DataFrame, common: int = COMMON) -> list[dict]:
    """One reference per language: bounded by the number of languages, computed over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 1 << 20):
                langs = batch["lang"].slice(a, b - a).to_pylist()
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].slice(a, b - a).to_pylist()]
                m = measure(texts)
                good = ~base_failed(m)
                sums: dict[tuple[str, bytes], float] = Counter()
                for lang in {x for x, g in zip(langs, good, strict=True) if g and x is not None}:
                    rows = np.flatnonzero(good & np.array([x == lang for x in langs]))
                    shares = m["classes"][rows] / np.maximum(1, m["classes"][rows].sum(axis=1, keepdims=True))
                    for k, v in enumerate(shares.sum(axis=0).tolist()):
                        sums[lang, b"\0%d" % k] += v
                    sums[lang, b"\0n"] += len(rows)
                    for i in rows.tolist():
                        for w, c in short_words(texts[i]).items():
                            sums[lang, w] += c / int(m["n_words"][i])
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.binary()), pa.array(list(sums.values()), pa.float64())],
                                                     names=["lang", "item", "share"])

    # sums of doubles depend on their order: rounded, so that reruns agree
    items = staged(documents(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, item binary, share double")
                   .groupBy("lang", "item").agg(F.round(F.sum("share"), 6).alias("share")))
    classes = items.filter(F.substring("item", 1, 1) == F.lit(b"\0"))
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("share"), "item"))
    top = items.filter(F.substring("item", 1, 1) != F.lit(b"\0")).withColumn("_r", order).filter(F.col("_r") <= common).drop("_r")
    out: dict[str, dict] = {}
    for r in classes.unionByName(top).collect():
        one = out.setdefault(r["lang"], {"lang": r["lang"], "classes": [0.0] * 7, "words": {}, "n": 1.0})
        item = bytes(r["item"])
        if item == b"\0n":
            one["n"] = r["share"]
        elif item[:1] == b"\0":
            one["classes"][int(item[1:])] = r["share"]
        else:
            one["words"][item.decode()] = r["share"]
    for one in out.values():
        one["classes"] = [x / one["n"] for x in one["classes"]]
        one["words"] = {w: x / one["n"] for w, x in sorted(one["words"].items())}
    return [out[k] for k in sorted(out)]


def distances(texts: list[bytes], m: dict[str, np.ndarray], refs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distance to the nearest reference, by character classes and by common words."""
    near_class, near_word = np.ones(len(texts)), np.ones(len(texts))
    p = m["classes"] / np.maximum(1, m["classes"].sum(axis=1, keepdims=True))
    tables = [(list(r["words"]), np.array([*r["words"].values(), max(0.0, 1 - sum(r["words"].values()))])) for r in refs]
    for r in refs:
        near_class = np.minimum(near_class, jensen_shannon(p, np.array(r["classes"])))
    for i, text in enumerate(texts):
        n = int(m["n_words"][i])
        if n >= MIN_WORDS:
            c = short_words(text)
            for names, q in tables:
                own = np.array([c.get(w.encode(), 0) for w in names] + [0.0]) / n
                own[-1] = max(0.0, 1 - own.sum())
                near_word[i] = min(near_word[i], jensen_shannon(own, q))
    return near_class, near_word


def quality(docs: DataFrame, class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE, common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, text, ``_rest`` (its other columns), the base counts, distances and verdict.

    A null or empty text has no words and fails the base rules. Without any labelled document
    there are no references, and the verdict is that of the base rules. Null languages give no
    reference but are judged as others. Repeated rows are judged alike; an empty table gives
    an empty result.
    """
    refs = json.dumps(references(docs, common))
    source = docs.select("doc_id", "text", rest(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(refs)
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 1 << 20):
                part = batch.slice(a, b - a)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]
                m = measure(texts)
                failed = base_failed(m)
                one, two = distances(texts, m, known)
                short = (m["n_words"] < MIN_WORDS) | (m["classes"].sum(axis=1) < MIN_CHARS)
                kept = ~failed & (short | (not known) | ((one <= class_distance) & (two <= word_distance)))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text"], part["_rest"], *[pa.array(m[c].astype(np.int64)) for c in names], pa.array(failed), pa.array(one), pa.array(two), pa.array(kept)],
                    names=["doc_id", "text", "_rest", *names, "base_failed", "class_distance", "word_distance", "kept"])

    typed = source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_rest")
    extra = [(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    extra += [("base_failed", T.BooleanType()), ("class_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("kept", T.BooleanType())]
    return typed.mapInArrow(run, T.StructType([*typed.schema, *[T.StructField(n, t) for n, t in extra]]))
