import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandemframe.llm import byte_bpe, byte_gru, class_lm, exact_dedup, license_scan, packing, parity_join, syncmers, toxicity
from tandemframe.llm.components import components

from .conftest import KINDS, made_rows


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# exact dedup


def test_exact_dedup_against_brute_force(spark, edge, empty):
    groups = defaultdict(list)
    for r in made_rows():
        groups[lower(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_dedup(edge, salts=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_is_the_sql(spark, tmp_path):
    import duckdb

    rows = pd.DataFrame([r[:2] for r in made_rows() if r[0] is not None], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", rows)
    got = {tuple(r) for r in exact_dedup.exact_dedup(spark.createDataFrame(made_rows(), KINDS).where("doc_id is not null")).collect()}
    assert got == {(a, b, c, d, e) for a, b, c, d, e in con.execute(exact_dedup.SQL).fetchall()}


# n-gram Jaccard


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    """Least reachable id of each id by comparing every two sets."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_against_all_pairs(edge, empty):
    want = linked([r[:2] for r in made_rows()])
    got = parity_join.ngram_jaccard(edge).collect()
    assert len(got) == edge.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (1, None))
    assert sum(r.doc_id != r.component_id for r in got) > 20
    assert parity_join.ngram_jaccard(empty).count() == 0


def test_jaccard_clusters_cut_into_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK_DOCS", 5)
    rng = np.random.default_rng(4)
    rows = []
    for base in range(2):
        w = [f"w{base}x{k}" for k in range(60)]
        for i in range(25):
            v = list(w) + [f"t{j}" for j in range(int(rng.integers(0, 14)))]
            v[int(rng.integers(0, 50))] = "new"
            rows.append((base * 100 + i, " ".join(v)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_jaccard_join_by_any_number_of_partitions(spark, partitions):
    """Near copies of several texts beside texts that share a passage only."""
    rng, rows = np.random.default_rng(9), []
    passage = [f"p{k}" for k in range(30)]
    for base in range(4):
        w = [f"w{base}x{k}" for k in range((40, 60, 150, 300)[base])]
        for i in range(18):
            v = list(w)
            for _ in range(int(rng.integers(0, len(w) // 20))):
                v[int(rng.integers(0, len(v)))] = f"n{rng.integers(0, 9)}"
            rows.append((base * 100 + i, " ".join(v)))
    rows += [(1000 + i, " ".join(passage + [f"o{i}x{k}" for k in range(30)])) for i in range(40)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == linked(rows)


def test_a_bucket_returns_an_edge_for_each_document_at_most(spark):
    """Candidate edges grow with the documents, not with the pairs of a group."""
    made = {}
    for n in (50, 200):
        rows = [(i, " ".join(f"w{k}" if k != i % 60 else f"x{i}" for k in range(80))) for i in range(n)]
        signed = parity_join.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
        edges = parity_join.candidate_edges(signed.select("doc_id", "keys"), 8).toPandas()
        assert len(edges) <= 8 * n and (edges.u > edges.v).all()
        made[n] = len(edges)
    assert made[200] <= 5 * made[50]


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 500, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(2))
        for words in (1, 4, 16):
            far = int(np.bitwise_count(parity_join.folded(x, words) ^ parity_join.folded(y, words)).sum())
            assert far <= len(np.setxor1d(x, y))
        wide = parity_join.folded(x, 8)
        assert (wide[:4] ^ wide[4:] == parity_join.folded(x, 4)).all()


def test_least_node_of_random_edges():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(-20, 40, (2, int(rng.integers(1, 60))))
        root = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(70):
            for x, y in zip(a.tolist(), b.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        u, v = parity_join.forest(a, b)
        assert dict(zip(u.tolist(), v.tolist())) == {x: y for x, y in root.items() if x != y}


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(400):
        a = int(rng.integers(5, 400))
        shared = int(rng.integers(math.ceil(0.8 * a), a + 1))
        x = np.unique(rng.integers(0, 2**63, a, dtype=np.uint64))
        y = np.unique(np.concatenate([x[:shared], rng.integers(0, 2**63, int(rng.integers(0, 1 + a // 4)), dtype=np.uint64)]))
        inter, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 100 * inter >= 80 * union and inter != union:
            keys = [set(np.concatenate(k).tolist()) if (k := parity_join.keys_of(s)) else set() for s in (x, y)]
            assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (5, 5), (7, 3), (200, 201)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[99] == 98 and got[201] == 200 and got[329] == 300 and 0 not in got


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def test_bpe_against_tiktoken(edge, empty, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in made_rows() for ids in [enc.encode_ordinary(r[1] or "")]), key=str)
    assert sorted((tuple(r) for r in byte_bpe.byte_bpe(edge, path, pattern).collect()), key=str) == want
    assert byte_bpe.byte_bpe(empty, path, pattern).count() == 0
    ids = byte_bpe.bpe_ids(edge.where("doc_id = 40"), path, pattern).first()
    assert ids.decoded == made_rows()[13][1] and list(ids.ids) == enc.encode_ordinary(ids.decoded)


def test_quick_pretokens_are_the_full_ones(vocabulary):
    import random

    rng, pre = random.Random(1), byte_bpe.PreTokenizer(vocabulary[1])
    every = [chr(c) for c in range(0x250)]
    for _ in range(300):
        t = "".join(rng.choice(every + [" "] * 80 + list("'stremvdll") * 4) for _ in range(rng.randrange(60)))
        assert pre.quick(t) == pre.full(t) and "".join(pre(t)) == t
    assert all(pre.quick(c) == pre.full(c) for c in every)


# fingerprints


def test_fingerprints(edge, empty):
    got = syncmers.syncmer_fingerprints(edge).collect()
    rows = sorted(((r[0], r[1] or "") for r in made_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by_text = defaultdict(set)
    texts = {r[0]: r[1] or "" for r in made_rows()}
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if r.n_chars > 500 and " " in texts[r.doc_id]]
    assert sum(r.near_edited > 0.15 for r in long) >= 0.9 * len(long)
    assert syncmers.syncmer_fingerprints(empty).count() == 0


def test_fingerprint_holds_closed_syncmers(spark):
    text = " ".join(f"w{k % 37}" for k in range(300))
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(syncmers.fingerprint(F.col("t")).alias("f"), F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h")).first()
    h = row.h
    closed = {i for i in range(len(h) - 3) if min(h[i], h[i + 3]) <= min(h[i + 1], h[i + 2])}
    assert row.f and all((x & (1 << 24) - 1) in closed for x in row.f) and [x >> 24 for x in row.f] == sorted({x >> 24 for x in row.f})


def plain_fingerprint(text):
    """Anchors (hash, position) of a text, window by window."""
    import re
    import struct

    import xxhash

    mask = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def of_longs(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return seed & mask

    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(syncmers.TOKEN, text)]
    if len(h) < 4:
        found = [(of_longs([x]), i) for i, x in enumerate(h)]
    else:
        found = [(of_longs(h[i : i + 4]), i) for i in range(len(h) - 3) if min(h[i], h[i + 3]) <= min(h[i + 1], h[i + 2])]
        if not found:
            return None  # the hash of a whole row of tokens isn't recomputed here
    first = {}
    for x, i in sorted((x >> 25, i) for x, i in found):
        first.setdefault(x, i)
    return sorted(first.items())[: syncmers.ANCHORS]


def plain_likeness(a, b):
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    at_a, at_b = dict(a), dict(b)
    least = sorted({*at_a, *at_b})[: syncmers.ANCHORS]
    moved = sorted(at_b[x] - at_a[x] for x in least if x in at_a and x in at_b)
    return sum(abs(x - moved[len(moved) // 2]) <= syncmers.STRAY for x in moved) / len(least) if moved else 0.0


def test_fingerprints_by_plain_windows(edge):
    got = {(r.doc_id, r.edited_sha256): r for r in syncmers.syncmer_fingerprints(edge).collect()}
    rows = sorted(((r[0], r[1] or "") for r in made_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    shown = lambda f: "".join(f"{(x << 24) | i:016X}" for x, i in f)
    compared = 0
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, other, changed = (plain_fingerprint(x) for x in (t, following, edited))
        r = got[(i, hashlib.sha256(edited.encode()).hexdigest())]
        if own is not None:
            assert r.fingerprint == shown(own)
        if own is not None and changed is not None:
            assert r.edited_fingerprint == shown(changed) and r.near_edited == pytest.approx(plain_likeness(own, changed))
            compared += 1
        if own is not None and other is not None:
            assert r.near_next == pytest.approx(plain_likeness(own, other))
    assert compared > 30


# packing


def test_packing_holds_every_token_once(edge, empty):
    rows = packing.pack(edge, capacities=(64, 128, 512)).toPandas()
    lengths = [math.ceil(len((r[1] or "").encode()) / 4) for r in made_rows()]
    assert rows.n_tokens.sum() == sum(lengths)
    binned = rows.dropna(subset=["bin_id"])
    for _, b in binned.groupby("bin_id"):
        b = b.sort_values("offset")
        assert b.offset.tolist() == np.concatenate([[0], np.cumsum(b.n_tokens)[:-1]]).tolist()
        used = b.n_tokens.sum()
        assert (b.bin_tokens == used).all() and b.bin_capacity.iloc[0] == min(c for c in (64, 128, 512) if c >= used)
    assert len(rows) - len(binned) == sum(n == 0 for n in lengths)
    assert packing.pack(empty).count() == 0


def test_query_packs_the_tokens_of_the_encoder(spark, tmp_path, vocabulary):
    rows = [r[:2] for r in made_rows()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = Counter((r.doc_id, r.n_tokens) for r in byte_bpe.byte_bpe(docs, *vocabulary).collect())
    assert Counter((r.doc_id, r.n_tokens) for r in byte_bpe.token_counts(docs, *vocabulary, remember=50).collect()) == want
    got = packing.query(spark, str(tmp_path)).toPandas()
    assert got.n_tokens.sum() == sum(n * times for (_, n), times in want.items())
    assert set(got[got.doc_id == 1 + 3 * 3].n_tokens) == {n for (i, n) in want if i == 1 + 3 * 3}


def test_packing_beats_one_size():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 512, 3000).tolist()
    placed = packing.best_fit(lengths, (128, 256, 512))
    capacity = sum({b: c for b, _, c in placed}.values())
    assert sum(lengths) / capacity > 0.97 and packing.best_fit([], (8,)) == [] and packing.best_fit([8], (4, 8)) == [(0, 0, 8)]


# toxicity


def test_machine_learns_a_pair_that_weights_cannot():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.sort(np.array([2 if a else 3, 4 if b else 5, *rng.choice(np.arange(10, 40), 3, replace=False)], np.int32)))
        labels.append(int(a == b))
    m = toxicity.fit(rows[:1200], np.array(labels[:1200]), dims=64, epochs=30, l1=0.01, sure_l1=0.01)
    right = np.mean([(m.score(r) >= 0.5) == y for r, y in zip(rows[1200:], labels[1200:], strict=True)])
    assert right > 0.9


def test_queries_machine_learns_that_pair():
    """As the query fits it: each term of the pair is neutral alone."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.sort(np.array([2 if a else 3, 4 if b else 5, *rng.choice(np.arange(10, 40), 3, replace=False)], np.int32)))
        labels.append(int(a == b))
    m = toxicity.fit(rows[:1200], np.array(labels[:1200]), dims=64)
    assert np.mean([(m.score(r) >= 0.5) == y for r, y in zip(rows[1200:], labels[1200:], strict=True)]) > 0.9


def test_toxicity_on_held_out_rows(spark, edge, empty):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [f"w{int(k)}" for k in rng.integers(0, 300, 40)]
        if bad:
            w[int(rng.integers(0, 40))] = ("vile", "rottenest", "rottenly")[int(rng.integers(0, 3))]
        rows.append((i, " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w)))
        labels.append((i, None, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 100
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    some = toxicity.toxicity(edge, marks).collect()
    assert len(some) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in some)
    assert toxicity.toxicity(empty, marks.limit(0)).count() == 0


def test_scores_have_the_odds_of_all_labels(spark):
    """Texts that say nothing: the score is the share of toxic labels, capped or not."""
    rows = [(i, "the same words in every text") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, None, int(i % 10 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    train = [i % 10 == 0 for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    for per_class in (100, 4000):
        score = toxicity.toxicity(docs, marks, per_class).first().score
        assert abs(score - np.mean(train)) < 0.06, (per_class, score)


# language


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = byte_gru.Network.new(["a", "b"], 3, 0)
    for name in "xucob":
        setattr(net, name, getattr(net, name).astype(float))
    w, n, y = rng.integers(0, 4, (5, 7)), np.array([7, 7, 3, 7, 1]), np.array([0, 1, 1, 0, 1])
    grads = dict(zip("xucob", net.gradients(w, n, y)[1], strict=True))
    for name, g in grads.items():
        p = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.integers(0, 4 if name == "x" and k == 2 else s) for k, s in enumerate(p.shape))
            p[at] += 1e-5
            up = net.gradients(w, n, y)[0]
            p[at] -= 2e-5
            down = net.gradients(w, n, y)[0]
            p[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-7


def test_languages_on_held_out_rows(spark, edge, empty):
    rng = np.random.default_rng(3)
    stems = {"aa": ["the", "thing", "ship", "ation"], "bb": ["der", "schön", "über", "keit"], "cc": ["qué", "ñaño", "ción", "los"]}
    rows = [(i, " ".join(rng.choice(stems[k], 30)), k) for i in range(360) for k in [sorted(stems)[i % 3]]]
    rows += [(1000, "1234 --- 56", "aa"), (1001, None, "bb"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = byte_gru.train(docs, per_language=100)
    got = {r.doc_id: r for r in byte_gru.predict(docs, net).collect()}
    held = [i for i, _, _ in rows if i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([got[i].lang_pred == sorted(stems)[i % 3] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002))
    again = byte_gru.predict(edge, net).collect()
    assert len(again) == edge.count() and all(0 <= r.score <= 1 for r in again)
    assert byte_gru.language_id(empty).count() == 0


def test_every_byte_is_in_one_window():
    texts = [b"", b"a", bytes(range(1, 200)), b"z" * 96]
    windows, lengths, of = byte_gru.windows_of(texts, 96)
    assert [b"".join(bytes(w[:n]) for w, n, k in zip(windows, lengths, of, strict=True) if k == i) for i in range(4)] == texts


# language model


def test_base_score_and_counts(edge, empty):
    train = [r for r in made_rows() if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in (r[1] or "").encode().lower().split()) + Counter({None: len(train)})
    n, v = sum(counts.values()), len(counts)
    got = class_lm.class_lm(edge, frequent=20, classes=6).collect()
    texts = defaultdict(list)
    for r in made_rows():
        texts[r[0]].append(r[1] or "")
    assert len(got) == len(made_rows())
    for r in got:
        w = [*texts[r.doc_id][0].encode().lower().split(), None]
        assert r.train_tokens == n and r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9) and r.score <= 0
    assert class_lm.class_lm(empty).count() == 0


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((21, 21), int)
    seq = [20]
    for k in range(6000):
        seq.append(int(rng.integers(0, 10) + (10 if k % 2 else 0)))
    np.add.at(pairs, (seq[:-1], seq[1:]), 1)
    of = class_lm.exchange(pairs, 3)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2


def test_classes_are_a_distribution_and_beat_the_base(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{int(rng.integers(0, 40))}" for k in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = class_lm.train(docs, frequent=90, classes=8)
    assert np.allclose((10.0**model.log_next).sum(1), 1)
    held = [r for r in class_lm.class_lm(docs, frequent=90, classes=8).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_words_beyond_the_exchange_find_their_class(spark):
    """Words that no exchange saw follow their neighbours, not their shape."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{'xyzuvw'[int(rng.integers(0, 6))]}" if rng.random() < 0.5 else f"qq{int(rng.integers(0, 60)) * 2 + k % 2:03d}" for k in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {least: [r for r in class_lm.class_lm(docs, frequent=12, classes=8, least=least).collect() if r.held_out] for least in (class_lm.LEAST, 10**9)}
    per_token = {k: sum(r.score for r in v) / sum(r.n_tokens for r in v) for k, v in held.items()}
    assert per_token[class_lm.LEAST] > per_token[10**9] + 0.1
    model = class_lm.train(docs, frequent=12, classes=8)
    assert np.allclose((10.0**model.log_next).sum(1), 1) and np.isclose(model.room.sum(), model.tokens + model.distinct + len(model.room))


def test_scores_against_a_plain_model(spark):
    """Counts, placing of every word by the whole likelihood, transitions and scores, recomputed step by step."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"{'ab'[(k + i) % 2]}{'xyz' * int(rng.integers(0, 2))}{int(rng.integers(0, 30) * rng.integers(0, 2))}" for k in range(int(rng.integers(0, 25))))) for i in range(70)] + [(900, None), (901, "never seen words here")]
    frequent, classes, least = 12, 5, 2
    got = {r.doc_id: r for r in class_lm.class_lm(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), frequent, classes, least).collect()}
    streams = {i: (t or "").encode().lower().split() for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in streams[i])
    top = sorted(counts, key=lambda w: (-counts[w], w))[:frequent]
    types = class_lm.Types(top)
    size = types.end + 1
    pairs = np.zeros((size, size), int)
    for i in train:
        path = [types.end, *(types[w] for w in streams[i]), types.end]
        np.add.at(pairs, (path[:-1], path[1:]), 1)
    of = class_lm.exchange(pairs, classes)
    k = int(of.max()) + 1
    start = {w: int(of[types[w]]) for w in {w for s in streams.values() for w in s}}

    def table(classed):
        m = np.zeros((k, k))
        for i in train:
            path = [k - 1, *(classed[w] for w in streams[i]), k - 1]
            np.add.at(m, (path[:-1], path[1:]), 1)
        return m

    def likelihood(m):
        x = lambda v: float(sum(a * math.log(a) for a in np.ravel(v) if a))
        return x(m) - x(m.sum(0)) - x(m.sum(1))

    final = dict(start)
    for w, c in counts.items():
        if c >= least and w not in top:
            own = [likelihood(table(start | {w: to})) for to in range(k - 1)]
            best = int(np.argmax(own))
            final[w] = best if own[best] > own[start[w]] + 1e-6 else start[w]
    m = table(final)
    share = (m.sum(0) + 1 / k) / (m.sum() + 1)
    step = (m + class_lm.BACK_OFF * share) / (m.sum(1, keepdims=True) + class_lm.BACK_OFF)
    room = m.sum(0) + np.bincount([*(final[w] for w in counts), k - 1], minlength=k) + 1
    for i, words in streams.items():
        path, seen = [k - 1, *(final[w] for w in words), k - 1], [*(counts[w] for w in words), len(train)]
        score = sum(math.log10(step[a, b] * (c + 1) / room[b]) for a, b, c in zip(path[:-1], path[1:], seen))
        assert got[i].score == pytest.approx(score, rel=1e-9)
    assert any(final[w] != start[w] for w in final)


def test_placing_is_the_move_of_the_exchange():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 30, (9, 9))
    start = np.array([0, 1, 2, 0, 1, 2, 0, 1, 3])
    one_hot = np.eye(4)[start]
    m, f = one_hot.T @ pairs @ one_hot, class_lm.f

    def likelihood(of):
        h = np.eye(4)[of]
        c = h.T @ pairs @ h
        return f(c).sum() - f(c.sum(0)).sum() - f(c.sum(1)).sum()

    w = np.arange(8)
    got = class_lm.place(m, (pairs @ one_hot)[w], (pairs.T @ one_hot)[w], pairs[w, w], start[w])
    for x in w:
        tried = [likelihood(np.where(np.arange(9) == x, c, start)) for c in range(3)]
        assert tried[got[x]] >= max(tried) - 1e-6


# licences


def test_license_scan(spark, edge, empty):
    model = license_scan.train()
    cases = [
        ("x\nLicensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.\nmore", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), ("Code is covered by the BSD 3-Clause License; see LICENSE.", "bsd"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Der Mann ging mit der Frau mit", "none"), ("The driver's license expired in June", "unknown"), ("the license of a poet\nCopyright is hard", "unknown"), ("plain words", "none"), (None, "none"), ("", "none"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(rows, model).collect()}
    assert [got[i].best_family for i in range(len(cases))] == [w for _, w in cases]
    assert license_scan.license_scan(edge, model).count() == edge.count() and license_scan.license_scan(empty, model).count() == 0


FULL = {
    "mit": ["The MIT License (MIT)\n\nCopyright (c) 2021 Jo Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this data and associated documentation files, to deal in it without restriction"],
    "bsd": ["Copyright 2019 The Authors. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice.",
            "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc": ["Copyright (c) 2020, Someone\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."],
    "apache-2.0": ["Copyright 2018 Somebody\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2.0": ["This file is part of thing.\nIt is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."],
    "agpl-3.0": ["You may copy it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Released under MPL 2.0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "public-domain": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."],
}


def test_wrapped_license_texts_are_found(spark):
    """Whole texts with other holders and endings, wrapped and in comments: recall 0.9 and more, none for another family."""
    import textwrap

    rows, want = [], []
    for family, given in FULL.items():
        for text in given:
            for width in (40, 55, 70, 10_000):
                for mark in ("", "# ", " * ", "// "):
                    paragraphs = ["\n".join(mark + x for x in textwrap.wrap(p, width)) for p in text.split("\n\n")]
                    rows.append((len(rows), "Some code begins.\n\n" + f"\n{mark.rstrip()}\n".join(paragraphs) + "\n\nand goes on for long."))
                    want.append(family)
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = [want[i] in got[i].families.split(",") for i in range(len(rows))]
    assert np.mean(right) >= 0.9
    wrong = [f for i in range(len(rows)) for f in got[i].families.split(",") if f and f != want[i]]
    assert len(wrong) <= 0.05 * len(rows)


def test_every_template_has_an_anchor():
    """Whatever part of a template's grams confirms it, one of its words is an anchor."""
    import itertools
    import re

    held = set(license_scan.anchors())
    for _, grams in license_scan.templates():
        need = math.ceil(license_scan.CONFIRM * len(grams))
        without = [g for g in grams if not held & set(g.split())]
        assert len(without) < need
    for frame, names in itertools.product(license_scan.FRAMES, license_scan.NAMES.values()):
        assert all(re.search(license_scan.ANCHOR, lower(frame.format(n))) for n in names)


def plain_scan(text, model):
    """The scan's answer for a text, paragraph by paragraph."""
    import re

    def judge(t):
        words = license_scan.words_of(t)
        grams = license_scan.grams_of(words)
        z = np.array(model.bias) + sum((np.array(model.grams[g]) for g in grams if g in model.grams), np.zeros(len(model.bias)))
        e = np.exp(np.clip(z / model.temperature, -50, 50))
        p = e / e.sum()
        k = int(p[:-1].argmax())
        alike = max((len(set(g) & grams) / len(g) for f, g in license_scan.templates() if f == model.families[k]), default=0)
        return model.families[k] if p[k] >= model.least and alike >= license_scan.CONFIRM else None, p[k]

    found = []
    for paragraph in re.split(license_scan.BLANK, lower(text)):
        if not re.search(license_scan.ANCHOR, paragraph):
            continue
        lines = paragraph.split("\n")
        by_line = [j for x in lines if re.search(license_scan.ANCHOR, x) for j in [judge(x)] if j[0]] if len(lines) > 1 else []
        own = judge(paragraph)
        if own[0] and own[0] not in [f for f, _ in by_line]:
            found.append(own)
        found += by_line
    return sorted({f for f, _ in found}), max((p for _, p in found), default=0.0), len(found)


def test_scan_is_the_plain_scorer(spark):
    rng, model = np.random.default_rng(4), license_scan.train()
    pool = [license_scan.FRAMES[i % 14].format(n) for i, n in enumerate(n for v in license_scan.NAMES.values() for n in v)] + license_scan.LIKE_NOTICES
    pool += [t for v in FULL.values() for x in v for t in x.split("\n\n")] + ["plain words of no meaning", "", "und mit der Zeit", "x" * 5000]
    rows = [(i, "".join(str(rng.choice(pool)) + str(rng.choice(["\n", "\n\n", " "])) for _ in range(int(rng.integers(1, 9))))) for i in range(150)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        families, best, n = plain_scan(t, model)
        assert got[i].families == ",".join(families) and got[i].n_licenses == n and got[i].best_probability == pytest.approx(best, abs=1e-6)
    assert sum(r.n_licenses > 0 for r in got.values()) > 50
