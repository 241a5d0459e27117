"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over hashed words. A later model
also gets the earlier categories' probabilities; in training these are out-of-fold predictions,
so it sees what it will see in use. Models are fitted on a bounded sample of labelled rows; every
document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices
from .rolling import U, word_hashes

SAMPLE = 6_000
BUCKETS = 1 << 18
FOLDS = 3
RARE = 3
# letters fold to lower case; what is no letter, digit or part of another character parts words
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct words of each text."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    values, start = word_hashes(_FOLD[np.frombuffer(b"\n".join(texts), np.uint8)])
    owner = np.searchsorted(begin, start, side="right") - 1
    both = np.unique(owner * BUCKETS + (values % U(BUCKETS)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Logistic regression over sparse binary features and a few dense ones."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def predict(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(row, self.weights[col], minlength=len(dense)) + dense @ self.dense + self.bias)


def fit(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, steps: int = 200, penalty: float = 2e-3, rate: float = 0.1) -> Linear:
    """Adam on the whole sample; both classes weigh the same."""
    n = len(y)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n
    theta = np.zeros(width + dense.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(row, theta[col], minlength=n) + dense @ theta[width:-1] + theta[-1]
        g = (sigmoid(z) - y) * weight
        grad = np.concatenate([np.bincount(col, g[row], minlength=width), dense.T @ g, [g.sum()]])
        grad[:-1] += penalty * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Linear(theta[:width], theta[width:-1], float(theta[-1]))


@dataclass
class Chain:
    categories: list[str]
    #: bucket -> column of the models, -1 for words too rare to learn from
    columns: np.ndarray
    models: list[Linear]

    def predict(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        col = self.columns[bucket]
        row, col = row[col >= 0], col[col >= 0]
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(row, col, out)])
        return out


def fit_chain(row: np.ndarray, bucket: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: list[str], folds: int = FOLDS) -> Chain:
    n = len(labels)
    often = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= RARE)
    columns = np.full(BUCKETS, -1, np.int64)
    columns[often] = np.arange(len(often))
    col = columns[bucket]
    row, col = row[col >= 0], col[col >= 0]
    fed, models = np.zeros((n, 0)), []
    for k in range(len(categories)):
        models.append(fit(row, col, fed, labels[:, k], len(often)))
        held = np.zeros(n)
        for f in range(folds):
            test = fold == f
            use = ~test[row]
            ids = np.cumsum(~test) - 1
            if (~test).any() and test.any():
                part = fit(ids[row[use]], col[use], fed[~test], labels[~test, k], len(often))
                held[test] = part.predict(row, col, fed)[test]
        fed = np.column_stack([fed, held])
    return Chain(categories, columns, models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain | None:
    """The chain from at most ``sample`` labelled documents, drawn by a hash of their ids."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("_id"), *[F.expr(e).cast("double").alias(f"_y{i}") for i, e in enumerate(categories.values())]).dropna().dropDuplicates(["_id"])
    n = wanted.count()
    if not n:
        return None
    cut = F.lit(int(min(1.0, 1.5 * sample / n) * ((1 << 53) - 1)))
    drawn = wanted.filter(F.shiftrightunsigned(F.xxhash64("_id"), 11) <= cut).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = documents(docs).join(drawn, F.col("doc_id") == F.col("_id")).select("_id", *[f"_y{i}" for i in range(len(categories))], "text")
    names = [f"_y{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = features([(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()])
            each = np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch["_id"], *[batch[c] for c in names], pa.array([x.tobytes() for x in each[: batch.num_rows]], pa.binary())], names=["_id", *names, "words"])

    got = rows.mapInArrow(run, ", ".join(["_id long", *[f"{c} double" for c in names], "words binary"])).toPandas().sort_values("_id", kind="stable")
    if not len(got):
        return None
    words = [np.frombuffer(w, np.int32) for w in got["words"]]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    fold = ((got["_id"].to_numpy().astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % FOLDS
    return fit_chain(row, np.concatenate(words).astype(np.int64), got[names].to_numpy(), fold, list(categories))


def score(docs: DataFrame, chain: Chain | None, categories: list[str], threshold: float = 0.5) -> DataFrame:
    """doc_id and, for each category, its probability ``p_<name>`` and whether it reaches the threshold.

    A null or empty text has no words and gets the models' base rates. Without a chain (no
    labelled row) all probabilities are null and no category is set. Repeated rows are scored
    alike; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 2 << 20):
                part = batch.slice(a, b - a)
                columns = [part["doc_id"]]
                if model is not None:
                    p = model.predict(*features([(t or "").encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]), part.num_rows)
                for i in range(len(categories)):
                    columns.append(pa.nulls(part.num_rows, pa.float64()) if model is None else pa.array(p[:, i]))
                    columns.append(pa.array(np.zeros(part.num_rows, bool) if model is None else p[:, i] >= threshold))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[x for c in categories for x in (f"p_{c}", c)]])

    return documents(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in categories))


