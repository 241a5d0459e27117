"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built over a bounded sample of its labelled texts. A text
is parsed by each automaton into the longest phrases that occur in the sample, each beginning
where the last one ended; the language that needs the fewest bits wins. A phrase costs the log of
the sample's length, and a character that the sample does not hold costs the log of the longest
sample's length besides, so a short sample is not cheap. Whatever is between letters counts as one
character. Whole texts are parsed, in segments of 256 characters, so
that a batch of segments walks all automata in step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE = 30_000
SEGMENT = 256
LETTERS = 60
_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state, by symbol, of the automaton of all substrings."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


def joined(codes: np.ndarray) -> np.ndarray:
    """Codes with one 0 for each run of them."""
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))] if len(codes) else codes


class Automaton:
    """A language's automaton, as next state * 2 + new phrase.

    The most frequent letters of the sample have columns in a dense table (state * width +
    column); its other letters are looked up among sorted keys (state * symbols + symbol).
    """

    def __init__(self, text: np.ndarray, symbols: int, letters: int):
        moves = suffix_automaton(text.tolist())
        counts = np.bincount(text, minlength=symbols)
        counts[0] = 0
        dense = [0, *sorted(np.argsort(-counts, kind="stable")[: min(letters, np.count_nonzero(counts))].tolist())]
        self.rare, self.unseen, self.padding = len(dense), len(dense) + 1, len(dense) + 2
        self.width, self.symbols = len(dense) + 3, symbols
        self.column = np.full(symbols, self.unseen, np.int16)
        self.column[counts > 0] = self.rare
        self.column[dense] = np.arange(len(dense))
        self.column[-1] = self.padding
        column, states = self.column.tolist(), len(moves)
        back = np.array([moves[0].get(c, 0) * 2 + 1 for c in [*dense, 0, 0, 0]], np.int32)
        back[self.rare], back[self.unseen], back[self.padding] = 1, 1, 0
        table = np.tile(back, (states, 1))
        keys, to = [], []
        for s, own in enumerate(moves):
            for c, q in own.items():
                if column[c] < self.rare:
                    table[s, column[c]] = q * 2
                else:
                    keys.append(s * symbols + c)
                    to.append(q * 2)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]
        self.restart = np.zeros(symbols, np.int32)  # of a rare letter: from the first state, as a new phrase
        for c, q in moves[0].items():
            self.restart[c] = q * 2 + 1
        self.table = table.ravel()
        self.bits = float(np.log2(max(2, len(text))))

    def parse(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, and characters that the sample does not hold, of each row of symbols."""
        local = self.column[grid]
        rare = (local == self.rare).any(axis=0)
        columns = np.ascontiguousarray(local.T.astype(np.int64))
        state, n = np.zeros(len(grid), np.int64), np.ones(len(grid), np.int64)
        for j, column in enumerate(columns):
            move = self.table[state * self.width + column]
            if rare[j]:
                at = np.flatnonzero(column == self.rare)
                symbol = grid[at, j].astype(np.int64)
                key = state[at] * self.symbols + symbol
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                move[at] = np.where(self.keys[i] == key, self.to[i], self.restart[symbol])
            n += move & 1
            state = (move >> 1).astype(np.int64)
        return n, (local == self.unseen).sum(axis=1)


class Parser:
    """Automata of all languages over the letters of all samples.

    Symbols: 0 is whatever is no letter; then come the letters; then any other letter, which no
    sample holds; then padding.
    """

    def __init__(self, samples: dict[str, list[str]], letters: int = LETTERS):
        self.letters = np.array(sorted({ord(c) for texts in samples.values() for t in texts for c in t.lower() if _LETTER.match(c)}), np.uint32)
        self.symbols = len(self.letters) + 3
        self.langs = sorted(samples)
        self.automata = [Automaton(joined(np.concatenate([np.append(self.encode(t), 0) for t in samples[lang]])), self.symbols, letters) for lang in self.langs]
        self.escape = max(a.bits for a in self.automata)

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32)
        at = np.searchsorted(self.letters, codes)
        hit = self.letters[np.minimum(at, len(self.letters) - 1)] == codes if len(self.letters) else np.zeros(len(codes), bool)
        other = ~hit & ((codes > 127) | ((codes >= 97) & (codes <= 122)))
        if other.any():
            kinds = {c: bool(_LETTER.match(chr(c))) for c in np.unique(codes[other]).tolist()}
            other[other] = [kinds[c] for c in codes[other].tolist()]
        return joined(np.where(hit, at + 1, np.where(other, len(self.letters) + 1, 0)).astype(np.int32))

    def cost(self, texts: list[str]) -> np.ndarray:
        """Bits a character of each text in each language."""
        codes = [self.encode(t) for t in texts]
        size = np.array([len(c) for c in codes])
        parts = -(-size // SEGMENT)
        grid = np.full((int(parts.sum()), SEGMENT), self.symbols - 1, np.int32)
        row = 0
        for c, k in zip(codes, parts.tolist(), strict=True):
            if k:
                grid[row : row + k].reshape(-1)[: len(c)] = c
            row += k
        owner = np.repeat(np.arange(len(texts)), parts)
        bits = np.zeros((len(texts), len(self.langs)))
        for k, a in enumerate(self.automata):
            n, unseen = a.parse(grid)
            bits[:, k] = np.bincount(owner, n * a.bits + unseen * self.escape, minlength=len(texts))
        return bits / np.maximum(1, size)[:, None]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Parser | None:
    """Automata from at most ``sample`` characters of each language's labelled, not held-out documents.

    Different texts are drawn in the order of a hash, each once however many copies there are;
    those of up to a tenth of the sample come first, then pieces of that length from all over the
    longer ones, until the sample is full or the language used up. The draw is found by sums per
    power of two of the hash, so about twice the sample is fetched, and nothing only if there is no text.
    """
    base = docs.select(held_out().alias("_held"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    base = base.filter(~F.col("_held") & F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    piece = max(1, sample // 10)
    long = F.length("text") > piece
    cut = F.when(long, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).otherwise(F.array("text"))
    units = base.select("lang", long.alias("long"), F.explode(cut).alias("text"))
    units = units.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)).withColumn("level", F.floor(F.log2(F.col("h") + 1.0)).cast("int"))
    sizes = units.select("lang", "long", "level", "h", F.length("text").alias("n")).distinct().groupBy("lang", "long", "level").agg(F.sum("n").alias("n")).collect()
    if not sizes:
        return None
    total, upto = Counter(), {}
    for r in sorted(sizes, key=lambda r: (r["lang"], r["long"], r["level"])):
        if total[r["lang"]] < sample:
            upto[r["lang"], r["long"]] = r["level"]
            total[r["lang"]] += r["n"]
    drawn = docs.sparkSession.createDataFrame([(*k, v) for k, v in upto.items()], "lang string, long boolean, upto int")
    texts = units.join(F.broadcast(drawn), ["lang", "long"]).filter("level <= upto").select("lang", "long", "h", "text").distinct().collect()
    samples: dict[str, list[str]] = {}
    total = Counter()
    for r in sorted(texts, key=lambda r: (r["lang"], r["long"], r["h"], r["text"])):
        if total[r["lang"]] < sample:
            samples.setdefault(r["lang"], []).append(r["text"][: sample - total[r["lang"]]])
            total[r["lang"]] += len(samples[r["lang"]][-1])
    return Parser(samples)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The score is one minus the winner's bits over the runner-up's (1 with one language, 0 for
    ``und``). A null text or one without letters is ``und``, and so is every text if no document
    is labelled. Ties go to the smaller name. Repeated rows are judged alike; an empty table gives
    an empty result. A null doc_id counts as an empty text for the fold.
    """
    parser = train(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for a, b in slices(((t.as_py() or 0) for t in pc.binary_length(batch["text"])), 2 << 20):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part["text"].to_pylist()]
                known = np.array([p is not None and _LETTER.search(t) is not None for t in texts])
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                if known.any():
                    bits = p.cost(texts)
                    best = bits.argmin(axis=1)
                    ranked = np.sort(bits, axis=1)
                    margin = 1 - ranked[:, 0] / ranked[:, 1] if bits.shape[1] > 1 else np.ones(len(texts))
                    for i in np.flatnonzero(known).tolist():
                        langs[i] = p.langs[best[i]]
                    scores = np.where(known, np.clip(margin, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
