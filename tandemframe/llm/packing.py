"""Best-fit packing into bins of several permitted capacities.

Pieces go, longest first, into the open bin they fill best. Where none has
room, a bin is opened in the capacity whose cost per token is least, given the
piece and the best filling that the pieces still to come offer. At the end each
bin shrinks to the least permitted capacity that holds its contents.

Pieces are dealt by hash to shards of bounded size, each packed on its own; the
number of shards follows the input, so a shard never outgrows a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import cut, documents

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Bytes of text that count as a token where no tokens are given.
TOKEN_BYTES = 4
#: Tokens and pieces of a shard, about.
SHARD_TOKENS, SHARD_PIECES = 16_000_000, 40_000
#: Tokens at which a bin's quadratic part of the cost equals its linear part.
QUADRATIC = 32_768


def cost(capacity: int) -> float:
    """Compute for a sequence of that length: linear, and quadratic in attention."""
    return capacity * (1 + capacity / QUADRATIC)


class _Left:
    """Lengths of the pieces still to come."""

    def __init__(self, lengths):
        values, counts = np.unique(lengths, return_counts=True)
        self.values, self.count = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            del self.count[length]
            self.values.pop(bisect_left(self.values, length))

    def filling(self, room: int) -> int:
        """Tokens that a greedy choice of the longest fitting pieces puts in ``room``."""
        used, at = 0, bisect_right(self.values, room) - 1
        while at >= 0 and room >= self.values[0]:
            length = self.values[at]
            n = min(self.count[length], room // length)
            used, room = used + n * length, room - n * length
            at = min(at - 1, bisect_right(self.values, room) - 1)
        return used


def best_fit(lengths, capacities=CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) for each length; none may exceed the largest capacity.

    Equal lengths keep their order; the bins are numbered as they open.
    """
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = _Left(np.asarray(lengths, int))
    rooms: list[int] = []  # of open bins, distinct and ascending
    open_by_room: dict[int, list[int]] = {}
    used: list[int] = []
    size: list[int] = []
    out: list = [None] * len(lengths)
    for i in order:
        n = int(lengths[i])
        left.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
        else:
            room = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / (n + left.filling(c - n)), -c))
            b = len(used)
            used.append(0)
            size.append(room)
        out[i] = (b, used[b])
        used[b] += n
        room -= n
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append(b)
    final = [capacities[bisect_left(capacities, u)] for u in used]
    return [(b, offset, final[b]) for b, offset in out]


def pack(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, n_tokens, bin_id, offset, bin_tokens, bin_capacity.

    ``tokens`` is a document's length (default: its bytes / 4, rounded up). A
    document longer than the largest capacity is cut into full pieces and a
    rest; every token is in exactly one piece. Null and empty texts have no
    token and no bin: one row with nulls for the bin. Repeated rows are packed
    each. An empty table gives no rows. Other columns aren't read.
    """
    largest = max(capacities)
    tokens = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / TOKEN_BYTES) if tokens is None else F.coalesce(tokens, F.lit(0))
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens.cast("bigint").alias("t"))
    total = sized.agg(F.sum("t").alias("t"), F.sum(F.ceil(F.col("t") / largest)).alias("n")).first()
    shards = max(1, ceil((total.t or 0) / SHARD_TOKENS), ceil((total.n or 0) / SHARD_PIECES))
    count = F.ceil(F.col("t") / largest).cast("int")
    pieces = sized.where("t > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece").cast("bigint") * largest
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("t") - start).cast("bigint").alias("n_tokens"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int"))

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "piece", "n_tokens"], kind="stable", na_position="first")
        placed = np.array(best_fit(f.n_tokens.tolist(), capacities), np.int64).reshape(-1, 3)
        bins = (f.shard.to_numpy(np.int64) << 32) | placed[:, 0]
        filled = pd.Series(f.n_tokens.to_numpy()).groupby(bins).transform("sum").to_numpy()
        return f.drop(columns="shard").assign(bin_id=bins, offset=placed[:, 1], bin_tokens=filled, bin_capacity=placed[:, 2])

    schema = "doc_id long, piece int, start long, n_tokens long, bin_id long, offset long, bin_tokens long, bin_capacity long"
    binned = pieces.groupBy("shard").applyInPandas(packed, schema)
    nothing = sized.where("t = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.col("t").alias("n_tokens"),
        *(F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "offset", "bin_tokens", "bin_capacity")),
    )
    return binned.unionByName(nothing)


def pack_encoded(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """``pack`` by the tokens that byte-level BPE (``byte_bpe``) makes of each text."""
    return pack(cut(byte_bpe.token_counts(docs, *byte_bpe.public()), "tokens"), F.col("n_tokens"), capacities)


def query(spark, sf_dir):
    return pack_encoded(documents(spark, sf_dir))
