"""Brown class-based bigrams: words fall into classes by exchange clustering.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class).

1. Documents are dictionary-coded by blocks (``word_blocks``), once; words of the
   training documents are counted over the whole corpus. The most frequent ones
   are types of their own; others start in the type of their shape (length,
   letters, ending).
2. Bigrams of types are counted over all training documents; their number is
   bounded by the number of types squared. The exchange algorithm moves types
   between classes while the likelihood of the class bigrams grows.
3. Every other word seen at least ``LEAST`` times is then taken out of its shape's
   class and put where the same likelihood is greatest, given the classes of
   step 2 around it. Words are judged each on its own, by hash bucket, from the
   sparse counts of their neighbours' classes: the vocabulary has no bound and
   none of it meets on the driver. Only rarer and unseen words keep their shape.
4. Count and class of a word come back to the blocks that have it; bigrams of the
   classes of step 3 are counted anew, and each document is scored from its own
   stream of classes.

Counts of classes and words are those of the whole training part, whatever its
size. Only matrices of types and of classes meet on the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_blocks as wb
from .common import buckets, crc_bucket, crc_bucket_py, cut, documents

FOLDS, HELD_OUT = 7, 2
#: Words whose exchange in turn makes the classes, and classes.
FREQUENT, CLASSES = 2000, 48
#: Training occurrences from which any other word has a class of its own choice.
LEAST = 2
#: Words placed at a time.
_BATCH = 1024
#: Passes of the exchange, at most.
PASSES = 12
#: Weight of the class frequencies in a class's transitions.
BACK_OFF = 1.0
_SHAPES = 48


def tokenize(text: str) -> list[bytes]:
    """Words between ASCII white space (x09 to x0D and x20), A-Z lower-cased:
    what bytes.lower() and bytes.split() do."""
    return text.encode().lower().split()


def shape(word: bytes) -> int:
    """One of ``_SHAPES``: by length, kind of characters and closing mark."""
    n = len(word)
    size = 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 6 else 3 if n <= 9 else 4 if n <= 14 else 5
    kind = 0 if word.isalpha() else 1 if any(48 <= c <= 57 for c in word) else 2 if max(word) > 127 else 3
    return (size * 4 + kind) * 2 + (word[-1:] in b".!?")


class Types(dict):
    """word -> type: its own if frequent, else that of its shape; the last type is the end."""

    def __init__(self, frequent: list[bytes], remember: int = 400_000):
        super().__init__((w, k) for k, w in enumerate(frequent))
        self.first_shape, self.end, self.remember = len(frequent), len(frequent) + _SHAPES, remember

    def __missing__(self, word):
        at = self.first_shape + shape(word)
        if len(self) < self.remember:
            self[word] = at
        return at


def f(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each type; the last type stays alone in the last class.

    Types start in turn by frequency. A pass takes every type, in that order,
    out of its class and puts it where the log likelihood of the class bigrams,
    sum f(n(c,d)) - sum f(n(c,.)) - sum f(n(.,d)) with f(x) = x log x, is
    greatest; ties go to the class it was in, then to the lowest. Ends when a
    pass moves nothing.
    """
    t = len(pairs)
    classes = max(2, min(classes, t))
    pairs = pairs.astype(float)
    by_count = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    by_count = by_count[by_count != t - 1]
    of = np.full(t, classes - 1)
    of[by_count] = np.arange(len(by_count)) % (classes - 1)
    one_hot = np.eye(classes)[of]
    to, fro = pairs @ one_hot, pairs.T @ one_hot  # of each type: followers, predecessors by class
    m = one_hot.T @ to

    for _ in range(passes):
        moved = 0
        for w in by_count:
            k, own = of[w], pairs[w, w]
            r, q = to[w].copy(), fro[w].copy()
            r[k] -= own
            q[k] -= own
            m[k] -= r
            m[:, k] -= q
            m[k, k] -= own
            # other classes' bigrams with w count in their sums wherever w is
            left, right, fm = m.sum(1) + q, m.sum(0) + r, f(m)
            grown_row, grown_col = f(m + r) - fm, f(m + q[:, None]) - fm
            d = np.diag(m)
            gain = grown_row.sum(1) - np.diag(grown_row) + grown_col.sum(0) - np.diag(grown_col) + f(d + r + q + own) - f(d)
            a, b = r.sum() + own, q.sum() + own
            gain -= f(left + a) - f(left) + f(right + b) - f(right)
            gain[classes - 1] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9 * max(1.0, abs(gain[k])):
                best = k
            m[best] += r
            m[:, best] += q
            m[best, best] += own
            if best != k:
                moved += 1
                of[w] = best
                to[:, k] -= pairs[:, w]
                to[:, best] += pairs[:, w]
                fro[:, k] -= pairs[w]
                fro[:, best] += pairs[w]
        if not moved:
            break
    return of


def place(m: np.ndarray, r: np.ndarray, q: np.ndarray, own: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Best class of each word, the move of ``exchange`` with all other words where they are.

    ``m`` are the class bigrams with the words in their classes ``k``; row by row
    ``r`` and ``q`` are a word's followers and predecessors by class, ``own`` of
    which the word itself.
    """
    out, m = np.array(k), m.astype(float)
    rows, cols, diagonal = m.sum(1), m.sum(0), np.diag(m)
    for at in range(0, len(k), _BATCH):
        x, y, o, c = (v[at : at + _BATCH] for v in (r.astype(float), q.astype(float), own.astype(float), k))
        i = np.arange(len(c))
        x[i, c] -= o
        y[i, c] -= o
        home = np.eye(len(m))[c]  # the bigrams that go with the word leave its class
        a, b, o = x.sum(1)[:, None] + o[:, None], y.sum(1)[:, None] + o[:, None], o[:, None]
        left, right, d = rows - home * a, cols - home * b, diagonal - home * (x + y + o)
        gain = f(d + x + y + o) - f(d) - f(left + a) + f(left) - f(right + b) + f(right)
        gain += _grown(m.T, x, y, o, c) + _grown(m, y, x, o, c)
        gain[:, -1] = -np.inf
        best, stays = gain.argmax(1), gain[i, c]
        out[at : at + _BATCH] = np.where(gain[i, best] <= stays + 1e-9 * np.maximum(1.0, np.abs(stays)), c, best)
    return out


def _grown(m: np.ndarray, x: np.ndarray, y: np.ndarray, o: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each word (row of ``x``) and class: what f of the bigrams of the class with
    others grows by as the word's ``x`` join them; only where there are any.
    ``m[j]`` are the bigrams with class j, from which the word's own are taken first."""
    out = np.zeros(x.shape)
    w, j = np.nonzero(x)
    if not len(w):
        return out
    seen, n = m[j], np.arange(len(w))
    seen[n, c[w]] -= x[w, j]
    at = j == c[w]
    seen[at] -= y[w[at]]
    seen[n[at], j[at]] -= o[w[at], 0]
    grown = f(seen + x[w, j][:, None]) - f(seen)
    grown[n, j] = 0
    first = np.flatnonzero(np.diff(w, prepend=-1))
    out[w[first]] = np.add.reduceat(grown, first, axis=0)
    return out


@dataclass
class Model:
    frequent: list[bytes]
    of: np.ndarray  # first class of each type
    log_next: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # of each class: its tokens, its distinct words, one for words never seen
    tokens: int
    distinct: int
    ends: int


def vocabulary(counted: DataFrame, frequent: int, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The most frequent words of the training documents (ties: by bytes), with
    their counts, and tokens and distinct words by shape of all words."""
    def of_bucket(f: pd.DataFrame) -> pd.DataFrame:
        total = bucket_counts([wb.unpack_words(x) for x in f.words], [wb.unpack(x) for x in f["at"]])
        seen = [(w, c) for w, c in total.items() if c]
        shapes, counts = np.array([shape(w) for w, _ in seen], int), np.array([c for _, c in seen], np.int64)
        by_shape = np.zeros((_SHAPES, 2), np.int64)
        np.add.at(by_shape[:, 0], shapes, counts)
        by_shape[:, 1] = np.bincount(shapes, minlength=_SHAPES)
        return _summary(f.bucket.iloc[0], heapq.nsmallest(frequent, seen, key=lambda x: (-x[1], x[0])), by_shape)

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        seen = [x for w, n in zip(f.words, f.counts, strict=True) for x in zip(wb.unpack_words(w), np.frombuffer(n, np.int64).tolist(), strict=True)]
        by_shape = sum(np.frombuffer(x, np.int64).reshape(_SHAPES, 2) for x in f.shapes)
        return _summary(f.bucket.iloc[0], heapq.nsmallest(frequent, seen, key=lambda x: (-x[1], x[0])), by_shape)

    # one packed row for each bucket; they meet in a tree, so that the driver sees one
    kind = "bucket int, words binary, counts binary, shapes binary"
    found = counted.groupBy("bucket").applyInPandas(of_bucket, kind)
    width = max(2, int(parts**0.5))
    for step in (width, 1):
        found = found.withColumn("bucket", F.pmod("bucket", F.lit(step)).cast("int")).groupBy("bucket").applyInPandas(merged, kind)
    rows = found.collect()
    if not rows:
        return [], np.empty(0, np.int64), np.zeros((_SHAPES, 2), np.int64)
    return wb.unpack_words(rows[0].words), np.frombuffer(rows[0].counts, np.int64), np.frombuffer(rows[0].shapes, np.int64).reshape(_SHAPES, 2)


def _summary(bucket, top, by_shape) -> pd.DataFrame:
    counts = np.array([c for _, c in top], np.int64)
    return pd.DataFrame({"bucket": [bucket], "words": [wb.pack_words([w for w, _ in top])], "counts": [counts.tobytes()], "shapes": [by_shape.astype(np.int64).tobytes()]})


def bucket_counts(words, at) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for own, arrays in zip(words, at, strict=True):
        for w, c in zip(own, arrays[1].tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    return total


def type_pairs(docs: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """Bigrams of types over all training documents, ends included."""
    size = len(frequent) + _SHAPES + 1
    train = docs.where(crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT).select("text")

    def counted(frames):
        types, sums = Types(frequent), np.zeros(size * size, np.int64)
        for f in frames:
            ids = [types.end]
            for t in f.text:
                if t:
                    ids += [types[w] for w in tokenize(t)]
                ids.append(types.end)
                if len(ids) > 1 << 20:
                    a = np.array(ids)
                    sums += np.bincount(a[:-1] * size + a[1:], minlength=size * size)
                    ids = [types.end]
            a = np.array(ids)
            sums += np.bincount(a[:-1] * size + a[1:], minlength=size * size)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"pair": at, "n": sums[at]})

    got = train.mapInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(size * size, np.int64)
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    return pairs.reshape(size, size)


def _trained(doc_id) -> bool:
    return crc_bucket_py(doc_id, FOLDS) != HELD_OUT


def _later(total: dict[bytes, int], first: Types, least: int) -> list[bytes]:
    """The words of a bucket that are placed after the exchange, sorted."""
    return sorted(w for w, c in total.items() if c >= least and first[w] >= first.first_shape)


def _path(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words of documents one after the other with an end, -1, before, between and after."""
    path = np.full(len(words) + len(counts) + 1, -1, np.int64)
    path[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts) + 1] = words
    return path


def later_classes(counted: DataFrame, streamed: DataFrame, words: list[bytes], of: np.ndarray, m: np.ndarray, least: int, buckets: int) -> DataFrame:
    """bucket, classes (of its later words, in order), moved (by class, distinct
    words that came less those that left)."""
    spark, k = counted.sparkSession, len(m)
    size = 2 * k + 1
    sent = spark.sparkContext.broadcast((words, of, m))

    def valued(found, at):
        frequent, of, _ = sent.value
        total, types = bucket_counts(found, at), Types(frequent)
        rank = {w: i + 1 for i, w in enumerate(_later(total, types, least))}
        bucket = xxhash.xxh32_intdigest(found[0][0]) % buckets
        return [[
            of[np.fromiter((types[w] for w in own), np.int64, len(own))], np.fromiter((rank.get(w, 0) for w in own), np.uint32, len(own)), np.full(len(own), bucket),
        ] for own in found]

    def of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, got = [wb.unpack(x)[0] for x in right["at"]], [wb.unpack(x) for x in right["values"]]
        start, rank, bucket = (np.append(wb.scattered(at, [g[j] for g in got], np.int64), last) for j, last in enumerate((k - 1, 0, 0)))
        keys = [np.empty(0, np.int64)]
        for ids, counts, stream in zip(left.ids, left.counts, left.words, strict=True):
            counts, train = np.asarray(counts, np.int64), np.fromiter(map(_trained, _ids(ids)), bool, len(ids))
            path = _path(counts[train], wb.unpack(stream)[0][np.repeat(train, counts)])
            a, b = path[:-1], path[1:]
            x, y = rank[a] > 0, rank[b] > 0
            keys += [a[x] * size + start[b[x]], b[y] * size + k + start[a[y]], a[x & (a == b)] * size + 2 * k]
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        word, slot = key // size, key % size
        order = np.argsort(bucket[word], kind="stable")
        word, slot, n = word[order], slot[order], n[order]
        named, first = np.unique(bucket[word], return_index=True)
        parts = zip(*(np.split(v, first[1:]) for v in (rank[word], slot, n, start[word])), strict=True) if len(named) else []
        return pd.DataFrame({"bucket": named.astype(np.int32), "seen": [wb.pack(*p) for p in parts]})

    def of_bucket(f: pd.DataFrame) -> pd.DataFrame:
        rank, slot, n, start = (np.concatenate(v).astype(np.int64) for v in zip(*map(wb.unpack, f.seen), strict=True))
        own = np.empty(rank.max(), np.int64)
        own[rank - 1] = start
        seen = np.bincount((rank - 1) * size + slot, n, len(own) * size).reshape(-1, size)
        to = place(sent.value[2], seen[:, :k], seen[:, k : 2 * k], seen[:, 2 * k], own)
        moved = np.bincount(to, minlength=k) - np.bincount(own, minlength=k)
        return pd.DataFrame({"bucket": [f.bucket.iloc[0]], "classes": [wb.pack(to)], "moved": [moved.tolist()]})

    values = wb.by_bucket(counted, valued)
    seen = streamed.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(of_block, "bucket int, seen binary")
    return seen.groupBy("bucket").applyInPandas(of_bucket, "bucket int, classes binary, moved array<long>")


def _ids(ids) -> list:
    return [None if i is None or i != i else int(i) for i in ids]


def class_streams(counted: DataFrame, streamed: DataFrame, chosen: DataFrame, words: list[bytes], of: np.ndarray, least: int) -> DataFrame:
    """ids, counts, known and logs (sum of log10 of count + 1) of some documents, and
    path: the classes of their words, the last class before, between and after."""
    sent = counted.sparkSession.sparkContext.broadcast((words, of))

    def of_bucket(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frequent, of = sent.value
        found, at = [wb.unpack_words(x) for x in left.words], [wb.unpack(x) for x in left["at"]]
        total, types = bucket_counts(found, at), Types(frequent)
        later = dict(zip(_later(total, types, least), wb.unpack(right.classes.iloc[0])[0].tolist(), strict=True)) if len(right) else {}
        first, values = of.tolist(), []
        for own in found:
            c = np.fromiter((total[w] for w in own), np.int64, len(own))
            to = np.fromiter((later[w] if w in later else first[types[w]] for w in own), np.uint32, len(own))
            values.append(wb.pack((c & 0xFFFFFFFF).astype(np.uint32), (c >> 32).astype(np.uint32), to))
        return pd.DataFrame({"block": left.block, "at": [wb.pack(a[0]) for a in at], "values": values})

    def prepare(at, got):
        count = wb.scattered(at, [g[0].astype(np.int64) + (g[1].astype(np.int64) << 32) for g in got], np.int64)
        return count > 0, np.log10(count + 1.0), np.append(wb.scattered(at, [g[2] for g in got], np.int64), sent.value[1][-1])

    def finished(doc_ids, counts, words, lookup):
        known, logs, to = lookup
        doc, n = np.repeat(np.arange(len(counts)), counts), len(counts)
        of_doc = (np.bincount(doc, v[words], n) if len(words) else np.zeros(n) for v in (known, logs))
        seen, total = of_doc
        return pd.DataFrame({"ids": [_ids(doc_ids)], "counts": [counts.tolist()], "known": [seen.astype(int).tolist()], "logs": [total.tolist()], "path": [wb.pack(to[_path(counts, words)])]})

    values = counted.groupBy("bucket").cogroup(chosen.groupBy("bucket")).applyInPandas(of_bucket, "block long, at binary, values binary")
    return wb.by_block(streamed, values, (prepare, finished), "ids array<long>, counts array<int>, known array<int>, logs array<double>, path binary")


def class_pairs(paths: DataFrame, k: int) -> np.ndarray:
    """Bigrams of classes over the training documents, ends included."""

    def counted(frames):
        sums = np.zeros(k * k, np.int64)
        for part in frames:
            for ids, counts, path in zip(part.ids, part.counts, part.path, strict=True):
                train = np.fromiter(map(_trained, _ids(ids)), bool, len(ids))
                path = wb.unpack(path)[0].astype(np.int64)
                # a document's steps: into each of its words and into its end
                step = np.repeat(train, np.asarray(counts, np.int64) + 1)
                sums += np.bincount((path[:-1] * k + path[1:])[step], minlength=k * k)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"pair": at, "n": sums[at]})

    got = paths.select("ids", "counts", "path").mapInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(k * k, np.int64)
    m[got["pair"].to_numpy()] = got["n"].to_numpy()
    return m.reshape(k, k)


def _fitted(docs: DataFrame, frequent: int, classes: int, least: int) -> tuple[Model, DataFrame]:
    """The model, and the documents as streams of classes."""
    parts = buckets(docs)
    counted = cut(wb.entries(docs, tokenize, parts, _trained), "words")
    streamed = cut(wb.streams(docs, tokenize), "streams")
    words, _, by_shape = vocabulary(counted, frequent, parts)
    pairs = type_pairs(docs, words)
    of = exchange(pairs, classes)
    k = int(of.max()) + 1
    one_hot = np.eye(k)[of]
    chosen = cut(later_classes(counted, streamed, words, of, one_hot.T @ pairs @ one_hot, least, parts), "classes")
    paths = cut(class_streams(counted, streamed, chosen, words, of, least), "paths")
    m = class_pairs(paths, k)
    share = (m.sum(0) + 1 / k) / (m.sum() + 1)
    log_next = np.log10((m + BACK_OFF * share) / (m.sum(1, keepdims=True) + BACK_OFF))
    ends = int(pairs[-1].sum())
    rare = by_shape[:, 1].copy()
    for w in words:
        rare[shape(w)] -= 1
    distinct = np.bincount(of, np.concatenate([np.ones(len(words)), rare, [ends > 0]]), k)
    for row in chosen.select("moved").collect():
        distinct += row.moved
    return Model(words, of, log_next, m.sum(0) + distinct + 1, int(by_shape[:, 0].sum()) + ends, int(by_shape[:, 1].sum()) + (ends > 0), ends), paths


def train(docs: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, least: int = LEAST) -> Model:
    return _fitted(docs, frequent, classes, least)[0]


def class_lm(docs: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null text counts as empty: its only token is the end. Rows that repeat an
    id are scored each. Without training documents all counts are zero: the
    scores stay defined. An empty table gives no rows. Other columns of the
    input aren't read.
    """
    model, paths = _fitted(docs, frequent, classes, least)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(frames):
        m = sent.value
        total, log_room, end = np.log10(m.tokens + m.distinct + 1.0), np.log10(m.room), np.log10(m.ends + 1.0)
        for part in frames:
            for ids, counts, known, logs, path in zip(part.ids, part.counts, part.known, part.logs, part.path, strict=True):
                ids, n, path = _ids(ids), np.asarray(counts, np.int64) + 1, wb.unpack(path)[0].astype(np.int64)
                steps = m.log_next[path[:-1], path[1:]] - log_room[path[1:]]
                yield pd.DataFrame({
                    "doc_id": pd.array(ids, "Int64"), "held_out": [not _trained(i) for i in ids], "n_tokens": n,
                    "n_known": np.asarray(known, np.int64) + (m.ends > 0), "train_tokens": m.tokens, "base_score": np.asarray(logs) + end - n * total,
                    "score": np.asarray(logs) + end + np.bincount(np.repeat(np.arange(len(ids)), n), steps, len(ids)),
                })

    return paths.mapInPandas(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir):
    return class_lm(documents(spark, sf_dir))
