"""N-gram Jaccard join by parity sketches.

A document's set of five-word shingles is drawn on a bit sketch of m segments of
2^32 bits: every shingle flips one bit of one segment. Two sketches differ in at
most as many bits, and so in at most as many segments, as their sets differ in
shingles. At a similarity of 0.8 sets of a and b shingles differ in
d <= (a + b) / 9 of them, so of the m segments at least m - d are equal
(pigeonhole). With the segments of a document in a fixed order, fullest first,
linked documents therefore share one of their first d + 1. Those segments are
what is joined, per band of sizes; a segment is named by the XOR of a code for
each of its set bits, which equal segments have in common. No link is lost;
nothing is sampled.

1. One pass over the texts gives size, digests and keys of each set. Texts with
   one set fall into a class, of which one document goes on.
2. Keys are shuffled packed by bucket; of the documents of a batch with a common
   key one goes on, so a key of any frequency is one entry a batch. A bucket
   joins all that have keys in common and returns one edge a document at most.
   The components of these edges deal the documents to tasks: both ends of every
   link are in one.
3. In a task the sketch join is made pair by pair: documents with a common key
   whose sketches, folded to two bits a shingle, have a Hamming distance of at
   most (a + b) / 9 are compared exactly; documents that are connected already
   aren't. A component beyond a task's bounds is cut by size band and salt into
   blocks, and every two blocks that can hold a link meet in a task.
4. Components of the verified links.

Shingles are compared as 64-bit hashes and equal sets are found by 128 bits of
digest: two texts are taken for others than they are with a chance of some
2^-64 for each pair of their shingles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, documents
from .components import components
from .word_blocks import Dictionary, pack, unpack

WORDS = 5
#: Similarity as a fraction, so that comparisons are exact.
SIMILAR, OUT_OF = 80, 100
#: Sizes of a band's documents are within this ratio.
BAND = 1.25**4
#: Segments for each shingle in which two documents of a band may differ.
SEGMENTS = 1.6
#: A cluster within these bounds is compared in one task.
BLOCK_DOCS, BLOCK_SHINGLES = 4000, 4_000_000
SALTS = 32

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _ODD[0]
        x = (x ^ (x >> _U(30))) * _ODD[1]
        x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    seen, streams = Dictionary(), []
    for t in texts:
        streams.append(np.array([seen[w] for w in t.encode().lower().split()], np.int64) if t else np.empty(0, np.int64))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), _U, len(seen))
    out = []
    with np.errstate(over="ignore"):
        for s in streams:
            h = hashes[s]
            n = min(len(h), words)
            if not n:
                out.append(np.empty(0, _U))
                continue
            x = np.full(len(h) - n + 1, n, _U)
            for k in range(n):
                x = mix(x * _ODD[2] + h[k : len(h) - n + 1 + k])
            out.append(np.unique(x))
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a, b = np.bitwise_xor.reduce(mix(s ^ _ODD[1])), mix(s + _ODD[2]).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def band(size: int) -> int:
    return int(np.log(size) / np.log(BAND) + 1e-9)


def keys_of(s: np.ndarray) -> list[np.ndarray]:
    """Keys of a set, in its own band and, if a partner may be there, the next."""
    a, out = len(s), []
    most = a * OUT_OF // SIMILAR
    if not a or (a + most) // 9 == 0:
        return out  # only an equal set is similar
    for at in sorted({band(a), band(most)}):
        top = BAND ** (at + 1)
        segments = int(SEGMENTS * (int(2 * top / 9) + 1)) + 1
        differ = int((a + min(most, top)) // 9)
        of = ((s >> _U(33)) % _U(segments)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        own, starts, full = np.unique(of[order], return_index=True, return_counts=True)
        drawn = np.zeros(segments, _U)
        drawn[own] = np.bitwise_xor.reduceat(mix(s[order] & _U(0xFFFFFFFF)), starts)
        fill = np.zeros(segments, np.int64)
        fill[own] = full
        with np.errstate(over="ignore"):
            keys = mix(drawn ^ mix(np.arange(segments, dtype=_U) + _U(segments) * _ODD[0]))
        out.append(keys[np.lexsort((keys, -fill))[: differ + 1]])
    return out


def folded(s: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of a set folded to ``words`` (a power of two) of 64 bits:
    the Hamming distance of two is at most the number of shingles they differ in."""
    out = np.zeros(words, _U)
    at = mix(s) % _U(64 * words)
    np.bitwise_xor.at(out, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, d1, d2, keys: size, digests and sketch keys of every row's shingle set."""

    def made(frames):
        for f in frames:
            sets = shingle_sets(f.text)
            digests = [set_digest(s) for s in sets]
            keys = [b"".join(k.tobytes() for k in keys_of(s)) for s in sets]
            yield pd.DataFrame({"doc_id": f.doc_id, "n": [len(s) for s in sets], "d1": [d[0] for d in digests], "d2": [d[1] for d in digests], "keys": keys})

    schema = "doc_id string, n long, d1 long, d2 long, keys binary"
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(made, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def classes(signed: DataFrame) -> DataFrame:
    """doc_id, n, d1, d2, salt, class_id, the least id of the rows with an equal set; by a
    salted tree, as a third of all rows may have one set. Empty sets are left out."""
    same = ["n", "d1", "d2"]
    some = signed.where("n > 0 and doc_id is not null").select("doc_id", *same).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = some.groupBy(*same, "salt").agg(F.min("doc_id").alias("class_id"))
    merged = salted.groupBy(*same).agg(F.min("class_id").alias("class_id"), F.collect_set("salt").alias("salts"))
    down = merged.withColumn("salt", F.explode("salts")).drop("salts")
    return some.join(down, [*same, "salt"]).select("doc_id", *same, "salt", "class_id")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that aren't the least of their component, and those."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each key is first, with its least id, in the returned order, and the least id of each entry's key."""
    order = np.lexsort((ids, keys))
    first = np.diff(keys[order], prepend=~keys[order][:1]) != 0
    return order, first, ids[order][np.flatnonzero(first)[np.cumsum(first) - 1]]


def _packed_ids(ids: np.ndarray) -> bytes:
    steps = np.diff(ids, prepend=np.int64(0)).astype(_U)
    return pack((steps & _U(0xFFFFFFFF)).astype(np.uint32), (steps >> _U(32)).astype(np.uint32))


def _unpacked_ids(data: bytes) -> np.ndarray:
    lo, hi = unpack(data)
    return np.cumsum((lo.astype(_U) | (hi.astype(_U) << _U(32))).astype(np.int64))


def candidate_edges(heads: DataFrame, parts: int) -> DataFrame:
    """u, v: edges that connect the documents of each common key, from (doc_id, keys)."""

    def made(frames):
        for f in frames:
            counts = f["keys"].str.len().to_numpy() // 8
            keys, ids = np.frombuffer(b"".join(f["keys"]), _U), np.repeat(f.doc_id.to_numpy(), counts)
            if not len(keys):
                continue
            order, first, least = by_key(keys, ids)
            own = ids[order] != least
            u, v = forest(ids[order][own], least[own])
            if len(u):
                yield pd.DataFrame({"bucket": [int(u[0] % parts)], "ids": [_packed_ids(u)], "keys": [b""], "roots": [_packed_ids(v)]})
            keys, ids = keys[order][first], least[first]
            of = (keys % _U(parts)).astype(np.int64)
            order = np.lexsort((ids, of))
            keys, ids, of = keys[order], ids[order], of[order]
            at = np.flatnonzero(np.diff(of, prepend=-1))
            ends = [*at[1:], len(of)]
            yield pd.DataFrame({
                "bucket": of[at], "ids": [_packed_ids(ids[a:b]) for a, b in zip(at, ends, strict=True)],
                "keys": [keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], "roots": b"",
            })

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        a, b, keys, ids = [], [], [np.empty(0, _U)], [np.empty(0, np.int64)]
        for i, k, r in zip(f["ids"], f["keys"], f["roots"], strict=True):
            if r:
                a.append(_unpacked_ids(i))
                b.append(_unpacked_ids(r))
            else:
                ids.append(_unpacked_ids(i))
                keys.append(np.frombuffer(k, _U))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        if len(keys):
            order, _, least = by_key(keys, ids)
            own = ids[order] != least
            a.append(ids[order][own])
            b.append(least[own])
        u, v = forest(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"u": u, "v": v})

    rows = heads.mapInPandas(made, "bucket int, ids binary, keys binary, roots binary")
    return rows.groupBy("bucket").applyInPandas(joined, "u long, v long")


def links_among(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of the similarity graph of some documents:
    a common key, then the Hamming distance of the folded sketches, then the sets."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = np.asarray(ids)[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    keys = [np.unique(np.concatenate(k)) if (k := keys_of(s)) else np.empty(0, _U) for s in sets]
    # only keys that several have are looked up
    _, at, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    keys = [k[seen[k] > 1].tolist() for k in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]
    # sizes of linked documents are within a factor of 1.25, so a width is theirs or its half
    widths = 1 << np.ceil(np.log2(np.maximum(sizes / 32, 1))).astype(np.int64)
    row = np.empty(len(sets), np.int64)
    sketches = {}
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        row[own] = np.arange(len(own))
        sketches[w] = np.stack([folded(sets[i], w) for i in own])
    root, postings, links = np.arange(len(sets)), {}, []
    for i, s in enumerate(sets):
        a, w, mine = len(s), int(widths[i]), sketches[int(widths[i])][row[i]]
        found = [np.array(p) for k in keys[i] if (p := postings.get(k))]
        if found:
            near = np.unique(np.concatenate(found))
            near = near[OUT_OF * sizes[near] >= SIMILAR * a]
            apart = np.full(len(near), 1 << 60)
            for width in (w, w // 2):
                of = widths[near] == width
                if of.any():
                    drawn = mine if width == w else mine[:width] ^ mine[width:]
                    apart[of] = np.bitwise_count(sketches[width][row[near[of]]] ^ drawn).sum(1, dtype=np.int64)
            near = near[9 * apart <= a + sizes[near]]
            while len(near):
                j = int(near[0])
                common = len(np.intersect1d(s, sets[j], assume_unique=True))
                near = near[1:]
                if OUT_OF * common >= SIMILAR * (a + sizes[j] - common):
                    links.append((int(ids[i]), int(ids[j])))
                    root[root == root[i]] = root[j]
                    near = near[root[near] != root[j]]
        for k in keys[i]:
            postings.setdefault(k, []).append(i)
    return links


def verified_links(docs: DataFrame, clustered: DataFrame) -> DataFrame:
    """u, v: exact links that span the components, from (class_id, n, d1, d2, cluster)."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")
    rows = clustered.withColumn("step", step)
    load = rows.groupBy("cluster", "step").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    parts = F.ceil(F.greatest(F.sum("c") / BLOCK_DOCS, F.sum("t") / BLOCK_SHINGLES)).cast("int")
    whole = load.groupBy("cluster").agg((parts <= 1).alias("one"))
    cuts = load.groupBy("cluster", "step").agg(F.greatest(F.lit(1), parts).alias("parts")).join(whole, "cluster")
    near = lambda k: cuts.select("cluster", (F.col("step") + k).alias("step"), F.col("parts").alias({0: "own", 1: "below", -1: "above"}[k]), *(["one"] if k == 0 else []))
    planned = rows.join(near(0), ["cluster", "step"]).join(near(1), ["cluster", "step"], "left").join(near(-1), ["cluster", "step"], "left")
    salt = F.pmod(F.xxhash64("class_id"), F.col("own")).cast("int")
    # a task is named by its two blocks (step, part); a row goes to each that has its block
    block = lambda s, p: F.struct(s.cast("int").alias("s"), p.cast("int").alias("p"))
    task = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda p: p < F.coalesce(n, F.lit(0)))
    mine = block(F.col("step"), F.col("salt"))
    tasks = F.concat(
        F.transform(up_to(F.col("own")), lambda p: task(block(F.col("step"), F.least(p, F.col("salt"))), block(F.col("step"), F.greatest(p, F.col("salt"))))),
        F.transform(up_to(F.col("below")), lambda p: task(block(F.col("step") - 1, p), mine)),
        F.transform(up_to(F.col("above")), lambda p: task(mine, block(F.col("step") + 1, p))),
    )
    single = F.array(task(block(F.lit(-1), F.lit(0)), block(F.lit(-1), F.lit(0))))
    planned = planned.withColumn("salt", salt).select("class_id", "n", "d1", "d2", "cluster", F.when(F.col("one"), single).otherwise(tasks).alias("tasks"))

    def drawn(frames):
        for f in frames:
            sets = shingle_sets(f.text)
            same = [(len(s), *set_digest(s)) == k for s, k in zip(sets, zip(f.n, f.d1, f.d2, strict=True), strict=True)]
            yield f.drop(columns=["text", "n", "d1", "d2"]).assign(shingles=[s.tobytes() for s in sets])[same]

    with_text = docs.select(F.col("doc_id").alias("class_id"), "text").join(planned, "class_id")
    task_type = planned.schema["tasks"].dataType.elementType.simpleString()
    # tasks travel as text, so that pandas sees plain columns
    with_sets = (
        with_text.select("class_id", "text", "n", "d1", "d2", "cluster", F.to_json("tasks").alias("tasks"))
        .mapInPandas(drawn, "class_id long, cluster long, tasks string, shingles binary")
        .withColumn("task", F.explode(F.from_json("tasks", f"array<{task_type}>")))
    )

    def compared(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["class_id", "shingles"])
        return pd.DataFrame(links_among(f.class_id.to_numpy(), [np.frombuffer(s, _U) for s in f.shingles]), columns=["u", "v"], dtype="int64")

    return with_sets.select("cluster", "task.a.s", "task.a.p", F.col("task.b.s").alias("s2"), F.col("task.b.p").alias("p2"), "class_id", "shingles").groupBy("cluster", "s", "p", "s2", "p2").applyInPandas(compared, "u long, v long")


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A set has the distinct five-word shingles of the text, or the whole
    sequence as one with fewer words; null, empty and blank texts have none and
    are linked with nothing: their component is their own id. So it is for rows
    without partner. Rows with a null id are never linked and have a null
    component. Rows that repeat an id are rows of the result each. An empty
    table gives no rows. Other columns of the input aren't read.
    """
    signed = cut(signatures(docs), "sets")
    members = cut(classes(signed), "classes")
    heads = members.where("doc_id = class_id").select("class_id", "n", "d1", "d2").distinct()
    with_keys = signed.where("length(keys) > 0").join(heads.withColumnRenamed("class_id", "doc_id").hint("merge"), ["doc_id", "n", "d1", "d2"], "left_semi")
    edges = candidate_edges(with_keys.select("doc_id", "keys"), buckets(docs))
    dealt = components(edges, "candidates")
    clustered = dealt.select(F.col("node").alias("class_id"), F.col("root").alias("cluster"))
    clustered = clustered.unionByName(clustered.select(F.col("cluster").alias("class_id"), "cluster").distinct())
    links = verified_links(docs, clustered.join(heads, "class_id"))
    # down to the members, dealt by the salts of the classes: one of them may have a third of all rows
    found = components(links, "links").select(F.col("node").alias("class_id"), "root")
    roots = members.select("class_id", "salt").distinct().join(found, "class_id")
    linked = members.join(roots.hint("merge"), ["class_id", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class_id").alias("component_id"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def query(spark, sf_dir):
    return ngram_jaccard(documents(spark, sf_dir))
