"""Token ids of many texts at once, by the tokenizers library.

A text may be cut before a single space between two characters that are no white space: a token
never spans such a place. So a batch is cut into words by Arrow, every distinct word is looked up
(or encoded) once, and the ids are put together by numpy gathers over a bank of known words.
Texts with other white space around spaces are cut by a pattern that looks at both sides.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 256
#: Longer words are encoded where they occur and not remembered.
LONG = 64
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?"


@lru_cache(maxsize=1)
def _loaded(path: str, changed: int) -> tuple:
    """The tokenizer of a file, and which of its ids begin with a space.

    Kept by the process: each tokenizer that has encoded leaves some MB behind when it goes, and a
    worker runs many tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # how byte-level vocabularies write a space
    return tokenizer, begins


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; about ``most`` words are remembered."""

    def __init__(self, path: str, most: int = 300_000):
        self.tokenizer, self.begins = _loaded(path, os.stat(path).st_mtime_ns)
        self.size = len(self.begins)
        self.most = most
        # The bank: ids of known words end to end; rows say where each begins, how long it is, and if it was met again.
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.bank, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.again, self.rows = *np.zeros((2, 1 << 14), np.int64), np.zeros(1 << 14, bool), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of the bank that hold these ids."""
        need, a, b = self.filled + len(ids), self.rows, self.rows + len(lengths)
        if need > len(self.bank):
            self.bank = np.concatenate([self.bank[: self.filled], np.zeros(2 * need - self.filled, np.uint32)])
        if b > len(self.begin):
            self.begin, self.length, self.again = (np.concatenate([x[:a], np.zeros(2 * b - a, x.dtype)]) for x in (self.begin, self.length, self.again))
        self.bank[self.filled : need] = ids
        self.begin[a:b] = self.filled + np.cumsum(lengths) - lengths
        self.length[a:b] = lengths
        self.again[a:b] = False
        self.filled, self.rows = need, b
        return np.arange(a, b)

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows end to end."""
        lengths = self.length[rows]
        ends = np.cumsum(lengths)
        return self.bank[np.repeat(self.begin[rows] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _trim(self) -> None:
        """Forget the words that were not met again since the last time."""
        if len(self.inner) + len(self.first) <= self.most and self.filled <= 16 * self.most:
            return
        for words in (self.inner, self.first):
            for w in [w for w, r in words.items() if not self.again[r]]:
                del words[w]
        kept = np.array([*self.inner.values(), *self.first.values()], np.int64)
        if len(kept) > self.most // 2:
            kept, self.inner, self.first = kept[:0], {}, {}
        ids, lengths = self._gather(kept), self.length[kept]
        self.filled = self.rows = 0
        rows = iter(self._add(ids, lengths).tolist())
        self.inner, self.first = dict(zip(self.inner, rows, strict=False)), dict(zip(self.first, rows, strict=False))

    def _encode_words(self, words: list[str], inner: bool) -> np.ndarray:
        """New rows of words that follow a space (``inner``) or begin a text."""
        found: list[bytes] = []
        if inner:
            # Many words in one text, told apart by the tokens that begin with a space, save most of the cost of a call.
            groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
            for group, ids in zip(groups, self._ids([" " + " ".join(g) for g in groups]), strict=True):
                at = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
                found += map(ids.__getitem__, map(slice, at, [*at[1:], len(ids)])) if len(at) == len(group) else self._ids([f" {w}" for w in group])
        else:
            found = self._ids(words)
        return self._add(np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def _learn(self, words: list[str], inner: bool) -> np.ndarray:
        """Rows of distinct words that are not known; short ones are remembered.

        Letters and the marks behind them are different tokens, so ``word,`` is put together from ``word`` and ``,``.
        """
        out = np.empty(len(words), np.int64)
        plain, marked, other = [], [], []
        for i, w in enumerate(words):
            stem = w.rstrip(MARKS)
            (other if len(w) > LONG or w[-1:].isspace() else marked if len(stem) < len(w) and stem.isalpha() else plain).append(i)
        known = self.inner if inner else self.first
        if plain:
            fresh = [words[i] for i in plain]
            out[plain] = self._encode_words(fresh, inner)
            known.update(zip(fresh, out[plain].tolist(), strict=True))
        if marked:
            fresh = [words[i] for i in marked]
            stems = [w.rstrip(MARKS) for w in fresh]
            tails = [w[len(x) :] for w, x in zip(fresh, stems, strict=True)]
            pairs = np.column_stack([self._known(stems, inner), self._known(tails, False)]).ravel()
            out[marked] = self._add(self._gather(pairs), self.length[pairs].reshape(-1, 2).sum(axis=1))
            known.update(zip(fresh, out[marked].tolist(), strict=True))
        for i in other:  # long, or with white space at the end of the text
            ids = self._ids([f" {words[i]}" if inner else words[i]])[0]
            out[i] = self._add(np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))[0]
        return out

    def _known(self, words: list[str], inner: bool) -> np.ndarray:
        """Rows of words, learned where they are new."""
        known = self.inner if inner else self.first
        rows = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        if (rows < 0).any():
            new = list({words[i] for i in np.flatnonzero(rows < 0).tolist()})
            fresh = dict(zip(new, self._learn(new, inner).tolist(), strict=True))
            rows = np.array([r if r >= 0 else fresh[w] for w, r in zip(words, rows.tolist(), strict=True)], np.int64)
        self.again[rows] = True
        return rows

    def encode_flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text's followed by ``end``, and the place where each text ends."""
        self._trim()
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, " ")
        edges, table = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        edges = edges - edges[0]
        distinct, code = table.dictionary.to_numpy(zero_copy_only=False).tolist(), table.indices.to_numpy()
        rows_of = np.fromiter(map(self.inner.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.again[rows_of[rows_of >= 0]] = True
        # White space at an end of a word stands beside a space. No such word is known.
        strange = np.zeros(len(distinct), bool)
        strange[[i for i in np.flatnonzero(rows_of < 0).tolist() if not (w := distinct[i]) or w[0].isspace() or w[-1].isspace()]] = True
        beside = strange[code]
        beside[edges[:-1][np.diff(edges) == 1]] = False  # a text without a space is one word, whatever it holds
        odd = np.logical_or.reduceat(beside, edges[:-1])
        if odd.any():
            cuts: list[list[str]] = [SAFE_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            extra = [w for c in cuts for w in c]
            number = {w: i for i, w in enumerate(dict.fromkeys(extra), len(distinct))}
            many = np.diff(edges)
            keep = code[np.repeat(~odd, many)]
            many[odd] = [len(c) for c in cuts]
            place = np.repeat(odd, many)
            code = np.empty(len(place), np.int64)
            code[~place], code[place] = keep, np.fromiter((number[w] for w in extra), np.int64, len(extra))
            distinct, edges = distinct + list(number), np.append(0, np.cumsum(many))
            rows_of = np.append(rows_of, np.fromiter(map(self.inner.get, number, repeat(-1)), np.int64, len(number)))
        first = np.zeros(len(code), bool)
        first[edges[:-1]] = True
        used = np.zeros(len(distinct), bool)
        used[code[~first]] = True
        new = np.flatnonzero(used & (rows_of < 0))
        if len(new):
            rows_of[new] = self._learn([distinct[i] for i in new.tolist()], True)
        rows = rows_of[code]
        rows[edges[:-1]] = self._known([distinct[i] for i in code[edges[:-1]].tolist()], False)
        if end is not None:
            rows, edges = np.insert(rows, edges[1:], self._add(np.array([end], np.uint32), np.array([1]))), edges + np.arange(n + 1)
        return self._gather(rows).astype("<u4", copy=False), np.append(0, np.cumsum(self.length[rows]))[edges[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes."""
        ids, ends = self.encode_flat(pa.array(texts, pa.large_string()))
        whole, stops = ids.tobytes(), (4 * ends).tolist()
        return [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
