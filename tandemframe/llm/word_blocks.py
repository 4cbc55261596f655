"""Texts as blocks of dictionary-coded words, for joins on distinct words.

A row for every word of a corpus is many times the size of the corpus. So a
task cuts its documents into blocks of some megabytes; a block has its own
dictionary, and its documents are streams of dictionary indexes in word order.
What travels by word is one entry for each distinct word of a block, packed by
the hash of the word; what comes back is a value for each entry; the streams
meet the values by block. A word of any frequency is one entry in each block,
so no key is hot, and a block's size is bounded whatever the input is.

    docs --streams()--------------------------------> by block --> results
    docs --entries()--> by word bucket --> values --> by block --^
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text after which a block ends.
BLOCK_BYTES = 32 << 20
#: Documents of a stream row, and words after which it ends sooner.
STREAM_DOCS, STREAM_WORDS = 1000, 1 << 20

Tokenize = Callable[[str], list]


class Dictionary(dict):
    """word -> its index in order of first sight."""

    def __missing__(self, word):
        self[word] = at = len(self)
        return at


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of unsigned 32-bit arrays, compressed; planes of zeros cost nothing."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u4")
        planes += [len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zstandard.compress(b"".join(planes), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 8 + 4 * n
    return out


def pack_words(words: list[bytes]) -> bytes:
    """Compressed lengths and bytes; words with common beginnings should be adjacent."""
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.compress(len(words).to_bytes(8, "little") + lengths.tobytes() + b"".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 8)).tolist()
    raw, starts = raw[8 + 4 * n :], [0, *ends[:-1]]
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(block, rows): the block's number is a hash of what it holds, so a second
    reading of the same rows gives the same blocks."""
    held, size = [], 0

    def close():
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        seen = hashlib.blake2b(digest_size=8)
        seen.update("\n".join("" if x is None else x for x in rows.doc_id).encode())
        for t in rows.text:
            seen.update(zlib.crc32(t.encode()).to_bytes(4, "little"))
        return int.from_bytes(seen.digest(), "little", signed=True), rows

    for f in frames:
        f = f.assign(text=f.text.fillna(""))
        sizes, start = f.text.str.len().to_numpy(), 0
        for k, n in enumerate(sizes.tolist()):
            size += n
            if size >= BLOCK_BYTES:
                held.append(f.iloc[start : k + 1])
                yield close()
                held, size, start = [], 0, k + 1
        if start < len(f):
            held.append(f.iloc[start:])
    if held:
        yield close()


def streams(docs: DataFrame, tokenize: Tokenize) -> DataFrame:
    """block, docs (doc_id and number of words of some documents), words (their indexes)."""

    def made(frames):
        for block, rows in _blocks(frames):
            words, ids, counts, parts, held = Dictionary(), [], [], [], 0
            for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
                got = [words[w] for w in tokenize(text)]
                ids.append(doc_id)
                counts.append(len(got))
                parts.append(np.array(got, np.uint32))
                held += len(got)
                if len(ids) >= STREAM_DOCS or held >= STREAM_WORDS:
                    yield _stream_row(block, ids, counts, parts)
                    ids, counts, parts, held = [], [], [], 0
            if ids:
                yield _stream_row(block, ids, counts, parts)

    return _texts(docs).mapInPandas(made, "block long, ids array<long>, counts array<int>, words binary")


def _texts(docs: DataFrame) -> DataFrame:
    # as text, ids stay exact in pandas beside nulls
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def _stream_row(block, ids, counts, parts):
    ids = [None if x is None else int(x) for x in ids]
    return pd.DataFrame({"block": [block], "ids": [ids], "counts": [counts], "words": [pack(np.concatenate(parts))]})


def entries(docs: DataFrame, tokenize: Tokenize, buckets: int, counted: Callable[[object], bool] | None = None) -> DataFrame:
    """bucket, block, words (sorted), at (their indexes and, if ``counted`` is
    given, their occurrences in the documents whose id passes it)."""

    def made(frames):
        for block, rows in _blocks(frames):
            words, held, sums = Dictionary(), [], []
            for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
                got = [words[w] for w in tokenize(text)]
                if counted is not None and counted(doc_id):
                    held += got
                    if len(held) >= STREAM_WORDS:  # a count costs as much as the dictionary is long
                        sums.append(np.bincount(held))
                        held = []
            seen = np.zeros(len(words), np.int64)
            for c in [*sums, np.bincount(np.array(held, np.int64), minlength=1)] if len(words) else []:
                seen[: len(c)] += c
            split: list[list] = [[] for _ in range(buckets)]
            for w in words:
                raw = w if isinstance(w, bytes) else w.encode()
                split[xxhash.xxh32_intdigest(raw) % buckets].append((raw, words[w]))
            for bucket, own in enumerate(split):
                if own:
                    own.sort()
                    at = np.fromiter((x[1] for x in own), np.uint32, len(own))
                    yield pd.DataFrame({
                        "bucket": [bucket], "block": [block], "words": [pack_words([x[0] for x in own])],
                        "at": [pack(at, *([seen[at]] if counted is not None else []))],
                    })

    return _texts(docs).mapInPandas(made, "bucket int, block long, words binary, at binary")


def by_bucket(found: DataFrame, valued: Callable[[list[list[bytes]], list[list[np.ndarray]]], list[list[np.ndarray]]]) -> DataFrame:
    """Calls ``valued(words of each block, their packed arrays)`` once for each
    bucket; it returns, for each block, arrays for the words in their order."""

    def of_bucket(f: pd.DataFrame) -> pd.DataFrame:
        words, at = [unpack_words(x) for x in f.words], [unpack(x) for x in f["at"]]
        values = valued(words, at)
        return pd.DataFrame({
            "block": f.block, "at": [pack(a[0]) for a in at], "values": [pack(*v) for v in values],
        })

    return found.groupBy("bucket").applyInPandas(of_bucket, "block long, at binary, values binary")


def by_block(streamed: DataFrame, values: DataFrame, finished, schema: str) -> DataFrame:
    """``finished(doc_ids, counts, words, lookup)`` for each stream row, where
    ``lookup`` is what ``prepare`` makes of a block's values."""
    prepare, finish = finished

    def of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = [unpack(x)[0] for x in right["at"]]
        got = [unpack(x) for x in right["values"]]
        lookup = prepare(at, got)
        return pd.concat(
            [finish(ids, np.asarray(counts, np.int64), unpack(words)[0], lookup) for ids, counts, words in zip(left.ids, left.counts, left.words, strict=True)],
            ignore_index=True,
        )

    return streamed.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(of_block, schema)


def scattered(at: list[np.ndarray], arrays: list[np.ndarray], dtype) -> np.ndarray:
    """One array by index from parts of (indexes, values)."""
    out = np.zeros(sum(map(len, at)), dtype)
    for i, v in zip(at, arrays, strict=True):
        out[i] = v
    return out
