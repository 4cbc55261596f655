"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut, whole, into windows of bytes. In each window one recurrence runs
forward and one backward; at every position both states together give language
probabilities, and a document's are the mean over all its positions. Training
is backpropagation through time in numpy, with every position of a window
labelled by its document's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, documents

FOLDS, HELD_OUT = 4, 2
#: Bytes of a window, hidden units of each direction.
WINDOW, HIDDEN = 96, 8
#: Documents of a language that the network is fitted on, at most; windows of each.
SAMPLE_PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 1500, 3
#: Windows that are labelled at a time.
BATCH = 4096
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Network:
    """Direction 0 reads forward, 1 backward.

    x (2, 3h, 256): what a byte adds to reset gate, update gate, candidate;
    u (2, 3h, h), c (2, 3h): the same of the state; o (k, 2h), b (k): languages.
    """

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    o: np.ndarray
    b: np.ndarray
    langs: list[str]

    def parts(self):
        return [self.x, self.u, self.c, self.o, self.b]

    @classmethod
    def new(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = [(2, 3 * hidden, 256), (2, 3 * hidden, hidden), (2, 3 * hidden), (len(langs), 2 * hidden), (len(langs),)]
        scale = [0.3, hidden**-0.5, 0, (2 * hidden) ** -0.5, 0]
        return cls(*(rng.normal(0, s, n).astype(np.float32) if s else np.zeros(n, np.float32) for n, s in zip(shape, scale, strict=True)), langs)

    def states(self, windows: np.ndarray, keep: bool = False):
        """States (t, 2, h, n) after each byte of windows (n, t); with keep also
        what the backward pass needs. The backward direction is in reading order."""
        t = windows.shape[1]
        h = self.u.shape[2]
        n = len(windows)
        seen = np.ascontiguousarray(windows.T)
        out = np.empty((t, 2, h, n), self.x.dtype)
        kept = []
        state = np.zeros((2, h, n), self.x.dtype)
        a = np.empty((2, 3 * h, n), self.x.dtype)
        c = self.c[:, :, None]
        for k in range(t):
            np.take(self.x[0], seen[k], axis=1, out=a[0], mode="clip")
            np.take(self.x[1], seen[t - 1 - k], axis=1, out=a[1], mode="clip")
            s = self.u @ state
            s += c
            gates = a[:, : 2 * h] + s[:, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            r, z = gates[:, :h], gates[:, h:]
            cand = r * s[:, 2 * h :]
            cand += a[:, 2 * h :]
            np.tanh(cand, out=cand)
            new = state - cand
            new *= z
            new += cand
            if keep:
                kept.append((state, r, z, cand, s[:, 2 * h :]))
            state = new
            out[k, 0] = state[0]
            out[t - 1 - k, 1] = state[1]
        return out, kept

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(t, k, n)"""
        t, _, h, n = states.shape
        return self.o @ states.reshape(t, 2 * h, n) + self.b[:, None]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.logits(self.states(windows)[0])
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
        """Loss (mean over the positions within ``lengths``) and its gradient by each part."""
        n, t = windows.shape
        h, dtype = self.u.shape[2], self.x.dtype
        states, kept = self.states(windows, keep=True)
        z = self.logits(states)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        inside = (np.arange(t)[:, None] < lengths).astype(dtype)
        total = inside.sum()
        at = p[:, labels, np.arange(n)]
        loss = float(-(np.log(np.maximum(at, 1e-20)) * inside).sum() / total)
        p[:, labels, np.arange(n)] -= 1
        p *= (inside / total)[:, None]
        flat = states.reshape(t, 2 * h, n)
        go, gb = np.einsum("tkn,thn->kh", p, flat, optimize=True), p.sum((0, 2))
        ds = (self.o.T @ p).reshape(t, 2, h, n)
        gx, gu, gc = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.c)
        d = np.zeros((2, h, n), dtype)
        da_all = np.empty((t, 2, 3 * h, n), dtype)
        for k in range(t - 1, -1, -1):
            d[0] += ds[k, 0]
            d[1] += ds[t - 1 - k, 1]
            before, r, zz, cand, s_cand = kept[k]
            d_cand = d * (1 - zz) * (1 - cand * cand)
            d_z = d * (before - cand) * zz * (1 - zz)
            d_r = d_cand * s_cand * r * (1 - r)
            d_s = np.concatenate([d_r, d_z, d_cand * r], 1)
            da_all[k] = np.concatenate([d_r, d_z, d_cand], 1)
            gu += d_s @ before.transpose(0, 2, 1)
            gc += d_s.sum(2)
            d = d * zz + self.u.transpose(0, 2, 1) @ d_s
        seen = windows.T
        for way in (0, 1):
            bytes_at = (seen if way == 0 else seen[::-1]).ravel()
            rows = da_all[:, way].transpose(0, 2, 1).reshape(-1, 3 * h)
            order = np.argsort(bytes_at, kind="stable")
            starts = np.flatnonzero(np.diff(bytes_at[order], prepend=-1))
            gx[way][:, bytes_at[order][starts]] = np.add.reduceat(rows[order], starts, axis=0).T
        return loss, [gx, gu, gc, go, gb]


def fit(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, steps: int = 400, batch: int = 192, rate: float = 0.015, seed: int = 3) -> Network:
    """Adam over shuffled windows. The same windows in the same order give the same network."""
    net, rng = Network.new(langs, hidden, seed), np.random.default_rng(seed)
    if len(langs) < 2 or not len(windows):
        return net
    parts = net.parts()
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    by_label = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        own = np.concatenate([rng.choice(at, max(1, batch // len(langs))) for at in by_label if len(at)])
        _, grads = net.gradients(windows[own].astype(np.intp), lengths[own], labels[own])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1, (steps - step + 1) / (0.4 * steps))
        for p, g, a, b in zip(parts, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return net


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, padded with zeros: (n, size), used lengths, index of the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // size)
    raw = b"".join([t + bytes(int(c) * size - len(t)) for t, c in zip(texts, counts, strict=True)])
    of = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(raw, np.uint8).reshape(-1, size), np.minimum(size, sizes[of] - nth * size), of


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(documents, languages): means over all positions; zeros for empty texts."""
    k = len(net.langs)
    total = np.zeros((len(texts), k))
    windows, lengths, of = windows_of(texts, WINDOW)
    for start in range(0, len(windows), BATCH):
        own = slice(start, start + BATCH)
        p = net.probabilities(windows[own])
        p *= (np.arange(WINDOW)[:, None] < lengths[own])[:, None]
        sums = p.sum(0)
        for j in range(k):
            total[:, j] += np.bincount(of[own], sums[j], len(texts))
    sizes = np.array([len(t) for t in texts])
    return total / np.maximum(sizes, 1)[:, None]


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, hidden: int = HIDDEN) -> Network:
    """Fitted on at most ``per_language`` documents of each non-null language,
    the first by the hash of their id; the held-out fold never enters."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "lang", "text")
    counts = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Network.new([], hidden, 0)
    # thin each language to about twice what is wanted before rows are ranked
    rate = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, 2.0 * per_language / counts[k])))), F.col("lang"))
    at = F.xxhash64(F.col("doc_id").cast("string"))
    thin = known.withColumn("at", at).where(F.pmod("at", F.lit(1_000_000)) < rate * 1_000_000)

    def cut_windows(frames):
        for f in frames:
            rows = []
            for lang, at, text in zip(f.lang, f["at"], f.text, strict=True):
                if not has_letter(text):
                    continue
                raw = text.encode()
                n = -(-len(raw) // WINDOW)
                rng = np.random.default_rng(abs(at))
                for k in sorted(rng.choice(n, min(n, WINDOWS_PER_DOCUMENT), replace=False).tolist()):
                    rows.append((lang, at, k, raw[k * WINDOW : (k + 1) * WINDOW]))
            yield pd.DataFrame(rows, columns=["lang", "at", "k", "bytes"])

    # a bounded sample: windows of about 2 * per_language documents of a language
    got = thin.select("lang", "at", "text").mapInPandas(cut_windows, "lang string, at long, k int, bytes binary").toPandas()
    got = got.sort_values(["lang", "at", "k", "bytes"], kind="stable").groupby("lang").head(per_language * WINDOWS_PER_DOCUMENT)
    windows, lengths, of = windows_of([bytes(b) for b in got.bytes])
    labels = np.array([langs.index(x) for x in got.lang], int)[of]
    return fit(windows, lengths, labels, langs, hidden)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """All rows of ``docs`` as they are, with lang_pred and score; columns of
    those names in the input are replaced; of languages with one probability the
    first by name is taken. Texts that are null or have no letter
    get ``und`` with score 1; so do all, with score 0, where no language was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for texts in batches:
            lettered = np.array([has_letter(t) for t in texts], bool)
            langs, score = np.full(len(texts), UNKNOWN, object), np.where(lettered, 0.0, 1.0)
            if net.langs and lettered.any():
                own = np.flatnonzero(lettered)
                p = document_probabilities(net, [t.encode() for t in texts.iloc[own]])
                langs[own], score[own] = np.array(net.langs, object)[p.argmax(1)], np.clip(p.max(1), 0, 1)
            yield pd.DataFrame({"lang_pred": langs, "score": score})

    return docs.withColumn("_labelled", labelled("text")).withColumns({"lang_pred": F.col("_labelled.lang_pred"), "score": F.col("_labelled.score")}).drop("_labelled")


def language_id(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Repeated rows get equal
    results; an empty table gives no rows; other columns are never read."""
    net = train(docs, per_language)
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


def query(spark, sf_dir):
    return language_id(documents(spark, sf_dir))
