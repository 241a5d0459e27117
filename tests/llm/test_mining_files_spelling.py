"""Hard negatives, token files and spelling variants against brute force, with nulls, ties, repeated rows and empty tables."""

import os
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import negatives, spelling, token_files
from tidemark.llm import queries as q
from tidemark.llm.encoder import Encoder

VECTORS = "vec_id long, label int, embedding array<float>, score double, node string, d int"


def brute_negatives(rows, every=100):
    ids, lab, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = Counter()
    for a in np.flatnonzero(ids % every == 0):
        s = v @ v[a]
        c = np.flatnonzero((lab == lab[a]) & (ids != ids[a]))
        for p in c[np.lexsort((ids[c], -s[c]))][:5]:
            n = np.flatnonzero((lab != lab[a]) & (30 * s[p] <= 100 * s) & (100 * s <= 90 * s[p]))
            for rank, j in enumerate(n[np.lexsort((ids[n], -s[n]))][:10], 1):
                out[int(ids[a]), int(ids[p]), rank, int(ids[j]), int(s[p]), int(s[j])] += 1
    return out


def vectors(n=900, d=8, seed=3):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((6, d))
    rows = [(i, int(r.integers(0, 10)), (centre[r.integers(0, 6)] + 0.4 * r.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]
    hot = rows[5][2]
    rows += [(2000 + i, i % 3, hot) for i in range(300)]  # copies with three labels
    return rows


@pytest.mark.parametrize(("points", "leaf"), [(16, 1024), (4, 60)])
def test_hard_negatives_equal_brute_force(spark, points, leaf):
    good = vectors()
    bad = [(100, None, [1.0] * 8), (200, 1, None), (300, 1, [float("nan")] + [0.0] * 7), (None, 1, [1.0] * 8), (400, 2, [None] + [1.0] * 7), (500, 2, [float("inf")] * 8),
           (600, 3, []), good[0], good[0]]
    extra = [(r[0], r[1], r[2], 0.5, "n", 3) for r in good + bad]
    df = spark.createDataFrame(extra, VECTORS).repartition(5)
    moved = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(x, np.float32).astype(float)).astype(np.int64)) for i, y, x in good]
    got = negatives.mine(negatives.quantised(negatives.moved_labels(df)), points=points, sample=64, leaf=leaf).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives(moved)


def test_hard_negatives_of_large_numbers_few_rows_and_none(spark):
    rows = [(0, 0, [3.0e9, 1.0]), (1, 0, [2.9e9, -7.0]), (2, 1, [2.0e9, 5.0]), (100, 0, [3.0e9, 1.0]), (3, 1, [1.0, 1.0])]
    df = spark.createDataFrame([(i, y, [int(c) for c in v]) for i, y, v in rows], "vec_id long, label long, v array<long>")
    got = negatives.mine(df.filter("vec_id <> 100")).collect()
    assert [tuple(r)[:4] for r in got] == [(0, 1, 1, 2)]
    assert negatives.mine(df.limit(0)).collect() == []
    # two dimensions side by side
    wide = spark.createDataFrame([(200, 0, [5, 5, 5]), (201, 0, [5, 5, 4]), (202, 1, [3, 3, 3])], "vec_id long, label long, v array<long>")
    both = negatives.mine(df.filter("vec_id <> 100").union(wide)).collect()
    assert {tuple(r)[:4] for r in both} == {(0, 1, 1, 2), (200, 201, 1, 202)}


def test_pruning_is_safe_and_prunes():
    r = np.random.default_rng(1)
    rows = (100 * np.concatenate([r.standard_normal((60, 3)) + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 9])])).astype(np.int64)
    points = negatives.split_points(rows, 3)
    dist = negatives.distances(rows, points)
    child = dist.argmin(axis=1)
    norm = (rows.astype(float) ** 2).sum(axis=1)
    facts = [{"low": dist[child == j].min(axis=0), "high": dist[child == j].max(axis=0), "low_norm": norm[child == j].min(), "high_norm": norm[child == j].max()} for j in range(3)]
    s = rows @ rows.T
    high = np.sort(s, axis=1)[:, -5][:, None].astype(float)
    keep = negatives.surviving(rows, high, np.full_like(high, 2.0**62), points, facts)
    for i in range(len(rows)):
        assert keep[i][np.unique(child[s[i] >= high[i, 0]])].all()
    assert keep.mean() < 0.9


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    for n in (0, 1, 8, 1001):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack_bits(ids, bits)
        assert int.from_bytes(packed, "little") == sum(v << (i * bits) for i, v in enumerate(ids.tolist()))
        assert len(packed) == (n * bits + 7) // 8 and (token_files.unpack_bits(packed, n, bits) == ids).all()
    assert [token_files.bits_for(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_random_access_of_a_file(tmp_path):
    r = np.random.default_rng(0)
    docs = [r.integers(0, 32_000, n).astype(np.uint32) for n in (0, 1, 700, 5, 64, 300)]
    ids, begins = np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs]))
    file = token_files.FileBuilder(token_files.bits_for(32_000), 2, 3, block=64)
    file.add([1, None], begins[1:3], ids[: begins[2]])
    file.add([3, -4, 5, 6], begins[3:] - begins[2], ids[begins[2] :])
    data = file.bytes() + b"\n"
    (tmp_path / "f").write_bytes(data)
    f = token_files.TokenFile(np.memmap(tmp_path / "f", np.uint8, "r"))
    assert (f.bits, f.doc_ids, f.shard, f.part, f.n_ids) == (15, [1, None, 3, -4, 5, 6], 2, 3, len(ids))
    assert all((f.document(i) == d).all() for i, d in enumerate(docs))
    for a, b in ((0, 1), (63, 65), (100, 1070), (64, 128), (5, 5), (1069, 5000)):
        assert (f.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError, match="token file"):
        token_files.TokenFile(b"\0" * 100)


DOCUMENTS = "doc_id long, text string, start string, n_tokens int, _text int"


def test_token_files_round_trip(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(q.tokenizer())
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "Straße", "中文", "a  b", "\n", "x" * 90, "word,", "Tokens."]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (7, "same id, other text"), (7, "same id, other text"), (-3, "negative"), (502, "long text, " * 30_000)]
    df = spark.createDataFrame([(i, t, "clash", 9, 9) for i, t in rows], DOCUMENTS).repartition(6)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, q.tokenizer(), path, file_ids=700, block=64)
    got = token_files.read_tokens(spark, path).collect()
    want = Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"])
    names = [(1 << 63) - 1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert names == sorted(names) and [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got]))[:-1].tolist()
    plain = token_files.read_tokens(spark, path, with_ids=False)
    assert Counter(plain.collect()) == Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)
    assert token_files.round_trip(df.limit(0), q.tokenizer()).collect() == []


def test_encoder_keeps_words_it_meets_again():
    tokenizers = pytest.importorskip("tokenizers")
    whole, rng = tokenizers.Tokenizer.from_file(q.tokenizer()), random.Random(5)
    encoder = Encoder(q.tokenizer(), most=60)
    for k in range(40):
        texts = [" ".join([*(f"w{rng.randrange(400)}," for _ in range(20)), "common", "common,"]) for _ in range(4)]
        assert encoder.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts], k
    assert len(encoder.inner) < 400


def test_encoders_of_a_process_share_one_tokenizer(tmp_path):
    """A tokenizer that has encoded leaves memory behind when it goes, and a worker makes an encoder for every task."""
    path = tmp_path / "tokenizer.json"
    path.write_bytes(Path(q.tokenizer()).read_bytes())
    first, second = Encoder(str(path)), Encoder(str(path))
    assert first.encode(["one two"]) == second.encode(["one two"])
    assert first.tokenizer is second.tokenizer and first.inner is not second.inner
    os.utime(path, ns=(1, 1))  # a file written anew is read anew
    assert Encoder(str(path)).tokenizer is not first.tokenizer


def neighbours(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    for i in range(len(w) + 1):
        for c in letters:
            out |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]}
    return out - {w}


def brute_variants(counts, letters, times=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = neighbours(w, letters) & counts.keys()
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out[w] = [n, len(near)]
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, out[w][0], out[w][1], None if form[w] is None else counts[form[w]])
    return set(out.values())


def test_variants_equal_brute_force(spark):
    r = random.Random(1)
    words = {"".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(900)} | {"a" * k for k in range(4, 60)} | {"ab" * k for k in range(2, 30)}
    counts = {w: r.choice([5, 6, 30, 151, 800, 4001]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert {tuple(x) for x in spelling.group_variants(df).collect()} == brute_variants(counts, "abé")


def test_pivots_are_disjoint_and_lightest():
    r = random.Random(4)
    for _ in range(300):
        places = sorted(r.sample(range(12), r.randint(3, 8)))
        weights = [r.randint(1, 5) for _ in places]
        p, s = spelling.pivots(places, weights)
        cost = dict(zip(places, weights, strict=True))
        assert cost[p] + cost[s] == min(cost[a] + cost[b] for a in places for b in places if b >= a + 2) and s >= p + 2


def test_spelling_variants_of_documents(spark):
    r = random.Random(9)
    base = ["straßen", "computer", "Müller's", "GRÖSSE", "writing", "été", "Élévation", "niñera×x", "abc12def"]
    rows = [(i, " ".join(r.choice(base) for _ in range(r.randrange(200)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "computer " * 30), (3, "computre computr " * 20), (60, "x" * 100_000 + " " + "computers " * 400)] + [rows[0]] * 3
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.spelling_variants(df, drop_every=7).collect()
    letters = set("".join(counts))
    assert {tuple(x) for x in got} == brute_variants(counts, letters) and len(got) == len(counts)
    assert spelling.spelling_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="4 code points"):
        spelling.spelling_variants(df, least_length=3)
