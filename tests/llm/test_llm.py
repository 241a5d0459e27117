"""Every operator against brute force on small tables, and on nulls, empty and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, mixing, near_dup, neighbours, packing, quality, suffix_sort, suffix_tree, toxicity
from tidemark.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, n int"


def text(seed, n, vocabulary=5000):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    shared, base = text(1, 80), text(2, 120)
    out = [(i, text(100 + i, 60 + i), "en", f"s{i % 3}") for i in range(30)]
    out += [(100 + i, f"{text(200 + i, 30)} {shared}\n{text(300 + i, 20)}", "en", "s1") for i in range(12)]
    out += [(200 + i, " ".join(w if j != 7 * i % 120 else f"x{i}" for j, w in enumerate(base.split())), "fr", None) for i in range(10)]
    out += [(300, None, None, None), (301, "", "en", "s0"), (302, "a", None, "s0"), (None, base, "en", "s0"), (0, out[0][1], "en", "s0"),
            (303, "é " * 300 + "aaaa" * 200, "fr", "s2"), (304, base, "fr", "s1"), (305, base, "fr", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", 7) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def key(i):
    return (1 << 63) - 1 if i is None else i


@pytest.mark.parametrize("heavy", [400, 2])
def test_suffix_tree_equals_brute_force(docs, rows, heavy):
    first = {}
    split = [(key(r[0]), (r[1] or "").encode().split()) for r in rows]
    for i, w in split:
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            first[k] = min(i, first.get(k, i))
    want = Counter()
    for i, w in split:
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        want[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    out = suffix_tree.dedup_substrings(docs, heavy=heavy).select("doc_id", "_n_words", "_n_removed", F.coalesce("text", F.lit("")), "_rest").collect()
    assert Counter((key(r[0]), r[1], r[2], r[3]) for r in out) == want
    assert all(r["_rest"]["_doc"] == "clash" for r in out)


@pytest.mark.parametrize("heavy", [400, 2])
def test_suffix_sort_equals_brute_force(docs, rows, heavy):
    texts = [(key(r[0]), (r[1] or "").encode()) for r in rows]
    seen = Counter(t[s : s + 200] for _, t in texts for s in range(len(t) - 199))
    want = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])] += 1
    out = suffix_sort.remove_repeats(docs, heavy=heavy).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept").collect()
    assert Counter((key(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in out) == want


def test_hash_compared_merge_sort():
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 99, r.integers(0, 12)).astype(np.uint8)) for _ in range(300)]
    group = np.sort(r.integers(0, 9, 300))
    order = suffix_sort.merge_sort(suffix_sort.Suffixes(texts), group)
    assert order.tolist() == sorted(range(300), key=lambda i: (group[i], texts[i], i))


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key(r[0])), key(r[0]))
    return Counter((key(r[0]), len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [400_000, 300])
def test_near_duplicates_equal_brute_force(docs, rows, block):
    out = near_dup.near_duplicates(docs, 3, 85, block=block).collect()
    assert Counter((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in out) == brute_components(rows, 3, 85)
    assert all(r["kept"] == (key(r["doc_id"]) == key(r["component_id"])) for r in out)
    one = near_dup.one_of_each(docs, 3, 85)
    assert one.columns == docs.columns and one.filter("text like '%w%'").count() == len({r["component_id"] for r in out if r["n_shingles"] > 1 and r["doc_id"] != 303})


def test_sketch_estimates_and_fills():
    r = np.random.default_rng(3)
    items = r.integers(1, 2**63, 600).astype(np.uint64)
    a, b = near_dup.sketch(np.unique(items[:500]), 256), near_dup.sketch(np.unique(items[100:]), 256)
    assert abs((a == b).mean() - 400 / 600) < 0.12
    assert (near_dup.sketch(items[:1], 256) < near_dup.MAX).all()


def test_group_links_equal_brute_force():
    r = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([np.arange(60), r.integers(60, 90, r.integers(0, 14))])).astype(np.uint64) for _ in range(80)]
    pairs = {(i, j) for i in range(80) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 92 * len(set(sets[i]) | set(sets[j]))}

    def parts(edges):
        root = list(range(80))
        for _ in range(80):
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert parts(near_dup.group_links(sets, np.arange(80), 92)) == parts(pairs)


def test_window_hashes_are_independent():
    from tidemark.llm import repeats, rolling

    a = np.random.default_rng(7).integers(0, 1 << 62, 50).astype(np.uint64)
    b = a.copy()
    b[:2] += np.array([rolling.BASE, (1 << 64) - 1], np.uint64)  # equal by the first hash
    (one, two), (one_, two_) = (repeats.window_hashes(x, np.array([0]), 50) for x in (a, b))
    assert one == one_ and two != two_ and rolling.Prefix(~a * np.uint64(3)).range(0, 50) == rolling.Prefix(~b * np.uint64(3)).range(0, 50)


def test_mixing(spark, docs, rows):
    pieces, facts = mixing.mix(docs, block=16)
    got = mixing.taken(pieces, facts).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        assert r["size"] == len([x for i, t, *_ in rows if key(i) == r["_doc"] and (t is not None) for x in t.encode().split()]) or r["_doc"] == 0
        assert r["taken"] <= 2 * r["size"]
        s = sizes.setdefault(r["source"], [r["source_size"], r["target"], 0])
        s[2] += r["taken"]
    total = sum(s[0] for s in sizes.values())
    assert abs(sum(s[1] for s in sizes.values()) - min(1.5 * total, 2 * total)) < 1e-6
    order = sorted((s for s in sizes if s is not None)) + [None]
    want, left, open_ = {}, 1.5 * total, dict(zip(order, [5, 2, 1, 5], strict=True))
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 2 * sizes[s][0]]
        if not full:
            want |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = 2.0 * sizes[s][0]
            left -= want[s]
            del open_[s]
    for s, (_, target, taken) in sizes.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= 0.05 * target + 48
    assert Counter(map(str, got)) == Counter(map(str, mixing.taken(*mixing.mix(docs, block=16)).collect()))
    assert mixing.mixed(docs).columns == docs.columns


@pytest.mark.parametrize("share", [1.5, 1.9])
def test_mixing_of_small_sources(spark, share):
    r = np.random.default_rng(6)
    sizes = {"big": 20_000, "s65": 65, "s20": 20, None: 7} | {f"t{i}": int(r.integers(1, 300)) for i in range(60)}
    data = []
    for s, n in sizes.items():
        while n:
            k = min(n, int(r.integers(1, 90)))
            data.append((len(data), text(len(data), k), s))
            n -= k
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    pieces, facts = mixing.mix(docs, share=share)
    got = {}
    for x in mixing.taken(pieces, facts).collect():
        assert x["taken"] <= 2 * x["size"]
        s = got.setdefault(x["source"], [x["target"], 0])
        s[1] += x["taken"]
    assert got.keys() == sizes.keys() and all(abs(target - taken) <= 0.5 for target, taken in got.values())
    slots = sorted({x["slot"] for x in pieces.select("slot").collect()})
    assert slots == list(range(len(slots)))
    assert mixing.mixed(docs).agg(F.sum(mixing.n_words())).first()[0] == sum(round(x["target"]) for x in mixing.mix(docs)[1].select("source", "target").distinct().collect())


def test_packing(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(q.tokenizer())
    want = Counter()
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[key(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack(docs, q.tokenizer(), size=64).collect()
    assert Counter((key(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.concatenate(([0], np.cumsum([n for _, n in sorted(p)])[:-1])).tolist() and sum(n for _, n in p) <= 64
    assert len(places) <= sum(m for _, m in packing.best_fit(Counter(r["length"] for r in got), 64))


def test_encoder_on_odd_white_space():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(q.tokenizer())
    texts = ["a  b", " a", "a ", "\n x\ty", "it's  <|endoftext|> don't", "", " ", "é  b", "a \nb c"]
    e = packing.Encoder(q.tokenizer())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_tokenizer_on_random_texts():
    tokenizers = pytest.importorskip("tokenizers")
    rng, whole = random.Random(7), tokenizers.Tokenizer.from_file(q.tokenizer())
    parts = ["a", "b", "the", "word", " ", " ", " ", "  ", "\n", "\t", "\u00e9", "\u4e2d", "<|endoftext|>", "'s", "12", "!?", "\u0120", "\u00a0", "\u3000", "\r\n", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    encoder = packing.Encoder(q.tokenizer(), most=500)
    for i in range(0, len(texts), 300):
        want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts[i : i + 300], add_special_tokens=False)]
        assert encoder.encode(texts[i : i + 300]) == want


def test_bin_completion_is_not_worse_than_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 7: 1}
    plan = packing.plan(counts, 10)
    got = Counter()
    for p, m in plan:
        assert sum(p) <= 10
        for x in p:
            got[x] += m
    assert got == counts and sum(m for _, m in plan) <= sum(m for _, m in packing.best_fit(counts, 10))
    assert packing.plan({}, 10) == []


def test_quality_counts(docs, rows):
    for r in quality.quality(docs).collect():
        text = r["text"] or ""
        w = text.encode().split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.encode().split(b"\n") if x.strip()]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(lines) - len(set(lines)), len(hit))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.jensen_shannon(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1


def test_neighbours_rank_few_pairs_one_by_one(monkeypatch):
    """In many random dimensions the codes leave out little; single distances are for the closest pairs, ties and copies included."""
    r = np.random.default_rng(5)
    c = r.standard_normal((3_000, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[40:70], c[90:95] = c[100], 1e6 * c[90:95]  # the first query's copies fill its list; some vectors are far longer
    c_id, q, q_id = np.arange(3_000), c[::100], np.arange(0, 3_000, 100)
    ranked, exact = [], neighbours.exact
    monkeypatch.setattr(neighbours, "exact", lambda a, b: ranked.append(len(a)) or exact(a, b))
    centre = c.mean(axis=0)
    row, col, d = neighbours.block_search(q_id, q, c_id, c, neighbours.encode(c, centre), centre, 10, 8.0)
    for i in range(len(q)):
        full = exact(np.broadcast_to(q[i], c.shape), c)
        best = [j for j in np.lexsort((c_id, full)) if j != q_id[i]][:10]
        assert col[row == i].tolist() == best and d[row == i].tolist() == full[best].tolist()
    assert sum(ranked) < 20 * len(q)
    huge = 1e200 * c[:50]  # squares overflow: every pair stays, in the order of ids
    assert neighbours.contenders(huge[:2], huge, np.ones((2, 50), bool), 10)[0].tolist() == [0] * 50 + [1] * 50


def test_neighbours_recall(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 32)).astype(np.float32)
    x[300:400] = x[0]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(800, None, 1), (None, x[0].tolist(), 1), (900, [0.0] * 32, 1), (1000, [float("nan")] * 32, 1), (5, x[5].tolist(), 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {}
    for row in neighbours.search(df, query_block=4, candidate_block=300).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    hits = 0
    for i in range(0, 700, 100):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        want = sorted((j for j in range(700) if j != i), key=lambda j: (d[j], j))[:10]
        hits += len(set(want) & set(got[i].values()))
    assert set(got) == set(range(0, 700, 100)) and hits >= 0.9 * 70


def test_rotation_of_perspectives(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (1, 1, "bot", "yo"), (1, 2, None, None), (1, None, "user", "pre"), (None, 0, "a", "x"), (2, 70, "u", "z")],
                               "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(df).collect()}
    r = got[1, "bot", 0]
    assert r["dialogue"] == "<|user name=user|>\nhi\n<|assistant|>\nyo\n<|user name=unknown|>\n\n"
    assert [r["dialogue"][int(a) : int(b)] for a, b in (x.split("-") for x in r["mask"].split(","))] == ["yo"]
    assert got[1, "bot", -1]["mask"] == "" and got[2, "u", 1]["n_own"] == 1 and (None, "a", 0) in got
    assert chat.rotate(df.limit(0)).count() == 0


def test_pieces_of_a_perspective_join_to_the_whole_dialogue(spark):
    data = [(1, i, f"r{i % 3}", f"turn {i} é") for i in range(200)]
    # 600 turns share a number, two roles, one of them with 500 texts; and a second conversation of the same turns
    data += [(2, 70 if i < 600 else i, "loud" if i < 500 else "calm", f"{i}" * (1 + i % 4)) for i in range(700)] + [(None, None, None, None), (2, -3, "calm", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1)).repartition(5)
    got = {}
    for r in chat.rotate(df).orderBy("conv_id", "speaker", "part", "piece").collect():
        got.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    order = lambda x: (x[1], x[2], hashlib.md5(x[3].encode()).hexdigest())
    for (conv, speaker), pieces in got.items():
        whole, own = "", []
        for _, _, role, words in sorted((x for x in set(data) if x[0] == conv and conv), key=order):
            whole += "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
            own += [words] * (role == speaker)
            whole += words + "\n"
        if conv is None:
            whole, own = "<|assistant|>\n\n", [""]
        assert "".join(r["dialogue"] for r in pieces) == whole
        assert [r["start"] for r in pieces] == [sum(len(x["dialogue"]) for x in pieces[:i]) for i in range(len(pieces))]
        assert max(r["n_turns"] for r in pieces) <= chat.MOST and sum(r["n_own"] for r in pieces) == len(own)
        spans = [tuple(map(int, x.split("-"))) for r in pieces for x in r["mask"].split(",") if x]
        shifts = [r["start"] for r in pieces for x in r["mask"].split(",") if x]
        assert [whole[a + s : b + s] for (a, b), s in zip(spans, shifts, strict=True)] == own
    assert set(got) == {(1, "r0"), (1, "r1"), (1, "r2"), (2, "loud"), (2, "calm"), (None, "unknown")}
    assert [len(v) for k, v in sorted(got.items(), key=repr) if k[0] == 1] == [4, 4, 4]


def test_chain_and_language(spark):
    r = np.random.default_rng(2)
    data, labels = [], []
    for i in range(400):
        bad, rude = i % 5 == 0, i % 7 == 0
        data.append((i, " ".join([*(f"w{x}" for x in r.integers(0, 300, 40)), *(["JUNK"] * bad), *(["idiot,"] * rude)]), "en" if i % 2 else "xx"))
        if i < 300:
            labels.append((i, int(bad), int(rude)))
    data += [(1000, None, None), (1001, "", "en"), (1001, "123", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labelled = spark.createDataFrame(labels, "doc_id long, bad int, rude int")
    kinds = {"bad": "bad", "rude": "rude"}
    out = toxicity.score(docs, toxicity.train(docs, labelled, kinds), list(kinds)).collect()
    held = [x for x in out if 300 <= x["doc_id"] < 400]
    assert np.mean([x["rude"] == (x["doc_id"] % 7 == 0) and x["bad"] == (x["doc_id"] % 5 == 0) for x in held]) > 0.95 and len(out) == 403
    none = toxicity.score(docs, toxicity.train(docs, labelled.limit(0), kinds), list(kinds)).first()
    assert none["p_rude"] is None and none["rude"] is False
    german, english = "der hund und die katze sind im garten ", "the dog and the cat are in the garden "
    two = spark.createDataFrame([(i, (german if i % 2 else english) * (1 + i % 5), "de" if i % 2 else "en") for i in range(60)] + [(77, None, "de"), (78, "1 2", None)],
                                "doc_id long, text string, lang string")
    for x in language.identify(two).collect():
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1
        assert x["lang_pred"] == ("und" if x["doc_id"] > 70 else "de" if x["doc_id"] % 2 else "en")
    assert language.identify(two.limit(0)).count() == 0


def labelled(spark, texts):
    """Documents none of which is held out, from (text, lang)."""
    ids = (i for i in range(1 << 30) if zlib.crc32(str(i).encode()) % 4 != 2)
    return spark.createDataFrame([(next(ids), t, lang) for t, lang in texts], "doc_id long, text string, lang string")


def drawn_samples(monkeypatch, docs, **more):
    monkeypatch.setattr(language, "Parser", lambda samples, **_: samples)
    return language.train(docs, **more)


def test_language_of_copies(spark, monkeypatch):
    copied = {c: [(text(seed, 200)[:1000], c)] * 1000 for seed, c in enumerate("abcdef")}
    mixed_ = [(text(50 + i, 30)[:100], "m") for i in range(400)] + [(text(99, 30)[:100], "m")] * 5000
    samples = drawn_samples(monkeypatch, labelled(spark, [x for v in copied.values() for x in v] + mixed_))
    assert all(samples[c] == [v[0][0]] for c, v in copied.items())
    assert sum(map(len, samples["m"])) == 30_000 and len(set(samples["m"])) == len(samples["m"])


def test_language_of_long_documents(spark, monkeypatch):
    long = [text(seed, 1500)[:6000] for seed in range(20)]
    docs = labelled(spark, [(t, "a") for t in long] + [("one short line", "a"), (text(77, 30_000)[:100_000] + "\nend", "b"), (long[0][:5000] + "\n", "c")])
    samples = drawn_samples(monkeypatch, docs)
    assert samples["a"][0] == "one short line" and sum(map(len, samples["a"])) == 30_000
    assert all(any(x in t for t in long) for x in samples["a"][1:]) and len({x[:100] for x in samples["a"]}) == len(samples["a"])
    whole = docs.filter("lang = 'b'").first()["text"]
    assert sum(map(len, samples["b"])) == 30_000 and max(whole.index(x) for x in samples["b"]) > 30_000
    assert sorted(map(len, samples["c"])) == [2001, 3000]


@pytest.mark.parametrize("rare", ["ok", "etao", "-"])
def test_language_of_one_short_text(spark, rare):
    r = np.random.default_rng(3)
    words = {c: ["".join(r.choice(list(letters), r.integers(2, 9))) for _ in range(300)] for c, letters in {"a": "etaoinshrdlk", "b": "etaoinsrzumk"}.items()}
    docs = labelled(spark, [(" ".join(r.choice(words[c], 40)) + " 12.50 13.60, 14.70 - 15 16" * (i % 3), c) for i in range(200) for c in "ab"] + [(rare, "xx")])
    got = Counter((x["lang"], x["lang_pred"]) for x in docs.join(language.identify(docs), "doc_id").filter("lang != 'xx'").collect())
    assert got == {("a", "a"): 200, ("b", "b"): 200}


@pytest.mark.parametrize("letters", [60, 2])
def test_phrases_equal_brute_force(letters):
    r = np.random.default_rng(4)
    samples = {c: ["".join(r.choice(list(s), 300))] for c, s in {"a": "abc ", "b": "bcde1 ", "c": "".join(map(chr, range(0x4E00, 0x4E50)))}.items()}
    p = language.Parser(samples, letters)
    texts = ["".join(r.choice(list("abcde 1z\u4e00\u4e07\u4e20\u5e00"), n)) for n in (1, 40, 255)] + [samples["c"][0][40:240], "", "1"]
    cost = p.cost(texts)
    for i, t in enumerate(texts):
        t = "".join("0" if not c.isalpha() else c for c in t)
        while "00" in t:
            t = t.replace("00", "0")
        for k, lang in enumerate(p.langs):
            s = "".join("0" if not c.isalpha() else c for c in samples[lang][0] + " ")
            while "00" in s:
                s = s.replace("00", "0")
            n, now = 1, ""
            for c in t:
                if now + c in s:
                    now += c
                else:
                    n, now = n + 1, c if c in s else ""
            unseen = sum(c not in s for c in t)
            want = 0 if not t else (n * np.log2(len(s)) + unseen * p.escape) / len(t)
            assert abs(cost[i, k] - want) < 1e-9


def test_languages_of_many_letters(spark):
    r = np.random.default_rng(5)
    scripts = {"en": range(97, 123), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "ar": range(0x627, 0x64B), "he": range(0x5D0, 0x5EB),
               "zh": range(0x4E00, 0x5600), "ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xB400), "z2": range(0x7000, 0x7800)}
    docs = labelled(spark, [("".join(map(chr, r.choice(list(s), 80))), c) for c, s in scripts.items() for _ in range(400 if c == "en" else 40)])
    got = Counter((x["lang"], x["lang_pred"]) for x in docs.join(language.identify(docs), "doc_id").collect())
    assert got == {(c, c): 400 if c == "en" else 40 for c in scripts}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert suffix_tree.dedup_substrings(docs).count() == 0 and near_dup.one_of_each(docs).count() == 0
    assert mixing.mixed(docs).count() == 0 and packing.pack(docs, q.tokenizer()).count() == 0 and quality.quality(docs).count() == 0
    assert suffix_sort.remove_repeats(docs).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("_doc", "n").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["length"] <= 1024 for r in out)
