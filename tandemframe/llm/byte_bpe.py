"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Pre-tokens go out by the hash of their bytes, one entry for each block of
documents that has them (``word_blocks``); a bucket encodes each distinct one
once and sends the ids back; a block puts its documents' ids together by
position. Decoding looks the ids up in the table of token bytes, whose size is
that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_blocks as wb
from .common import buckets, documents

#: Letters and numbers below U+0250, by Unicode category; checked by a test.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")


class PreTokenizer:
    """All matches of ``pattern`` in a text, in order.

    For the public pattern (letters, numbers, the rest, white space), texts of
    characters below U+0250 go through an equivalent pattern with explicit
    classes, which the faster built-in engine runs.
    """

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern).findall
        self.quick = None
        if r"\p{L}" in pattern:
            quick = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
            quick = quick.replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]")
            self.quick = re.compile(quick).findall

    def __call__(self, text: str) -> list[str]:
        if self.quick is None or _BEYOND.search(text):
            return self.full(text)
        return self.quick(text)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, leftmost first, until none is left.

    A heap of candidate pairs over a linked list: n log n steps, so a word of a
    hundred thousand bytes is no trouble.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue  # one of the pair has grown or gone since
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, before[i], end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def encoded_size(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many ids ``encode_word`` gives; a short word's few pairs need no heap."""
    if word in ranks:
        return 1
    n, get = len(word), ranks.get
    if n > 64:
        return len(encode_word(word, ranks))
    none = 1 << 62
    edges, found = list(range(n + 1)), [get(word[i : i + 2], none) for i in range(n - 1)]
    while found and (low := min(found)) < none:
        i = found.index(low)
        del edges[i + 1], found[i]
        if i < len(found):
            found[i] = get(word[edges[i] : edges[i + 2]], none)
        if i:
            found[i - 1] = get(word[edges[i - 1] : edges[i + 1]], none)
    return len(edges) - 1


def encode_documents(docs: DataFrame, path: str, pattern: str, finish, schema: str) -> DataFrame:
    """``finish(doc_ids, token counts, ids of all in one array, token table)``
    gives the rows of some documents; ``schema`` is theirs."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(read_ranks(path))
    made: dict[str, PreTokenizer] = {}

    def tokenize(text: str) -> list[str]:
        if pattern not in made:
            made[pattern] = PreTokenizer(pattern)
        return made[pattern](text)

    def valued(words, _):
        ranks = {t: k for k, t in enumerate(table.value) if t}
        known: dict[bytes, list[int]] = {}
        out = []
        for own in words:
            got = []
            for w in own:
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = encode_word(w, ranks)
                got.append(ids)
            sizes = np.fromiter(map(len, got), np.uint32, len(got))
            out.append([sizes, np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))])
        return out

    def prepare(at, got):
        sizes = wb.scattered(at, [g[0] for g in got], np.int64)
        starts = wb.scattered(at, [np.concatenate([[0], np.cumsum(g[0].astype(np.int64))[:-1]]) + base for g, base in zip(got, np.cumsum([0, *(len(g[1]) for g in got)])[:-1], strict=True) if len(g[0])], np.int64)
        ids = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.uint32)
        return sizes, starts, ids

    def finished(doc_ids, counts, words, lookup):
        sizes, starts, ids = lookup
        n = sizes[words] if len(words) else np.empty(0, np.int64)
        ends = np.cumsum(n)
        where = np.repeat(starts[words] - (ends - n), n) + np.arange(int(n.sum())) if len(words) else np.empty(0, np.int64)
        last = np.cumsum(counts)
        edges = np.concatenate([[0], ends])
        return finish(doc_ids, np.diff(np.concatenate([[0], edges[last]])), ids[where], table.value)

    values = wb.by_bucket(wb.entries(docs, tokenize, buckets(docs)), valued)
    return wb.by_block(wb.streams(docs, tokenize), values, (prepare, finished), schema)


def _digests(doc_ids, counts, ids, table) -> pd.DataFrame:
    ends = np.cumsum(counts)
    rows = []
    for doc_id, n, end in zip(doc_ids, counts.tolist(), ends.tolist(), strict=True):
        own = ids[end - n : end]
        rows.append((doc_id, n, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(own, table)).hexdigest()))
    return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def bpe_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> and decoded text of every row of ``docs``."""

    def finish(doc_ids, counts, ids, table):
        ends = np.cumsum(counts)
        own = [ids[e - n : e] for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "ids": [x.astype(np.int32) for x in own], "decoded": [decode(x, table).decode() for x in own]})

    return encode_documents(docs, path, pattern, finish, "doc_id long, ids array<int>, decoded string")


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    Null text counts as empty: no tokens, the digest of nothing. Rows that
    repeat an id are rows of the result each. An empty table gives no rows.
    Other columns of the input aren't read.
    """
    return encode_documents(docs, path, pattern, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, path: str, pattern: str, remember: int = 400_000) -> DataFrame:
    """doc_id, n_tokens of every row of ``docs``: those of ``byte_bpe``, where it
    lies. What a pre-token gives is remembered for up to ``remember`` of them,
    after which the memory starts anew."""
    table = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def counted(frames):
        pre, ranks = PreTokenizer(pattern), {t: k for k, t in enumerate(table.value) if t}

        class Sizes(dict):
            def __missing__(self, word):
                if len(self) >= remember:
                    self.clear()
                self[word] = n = encoded_size(word.encode(), ranks)
                return n

        size = Sizes().__getitem__
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "n_tokens": [sum(map(size, pre(t))) if t else 0 for t in f.text]})

    # as text, ids stay exact in pandas beside nulls
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(counted, "doc_id string, n_tokens long")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_tokens")


def public() -> tuple[str, str]:
    """Path and pattern of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir):
    return byte_bpe(documents(spark, sf_dir), *public())
