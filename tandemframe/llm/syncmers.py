"""Document fingerprints from closed syncmers, in Spark's own functions.

A text is a row of tokens; a window of four is a closed syncmer when the least
of its tokens, by hash, is the first or the last. Whether it is depends on the
window alone, so an edit moves no anchor that it doesn't touch. A fingerprint
holds the anchors with the least hashes, each with its position. Two
fingerprints are alike in the share of their least common anchors that both
have and that lie at a common displacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, documents

#: Anchors of a fingerprint, at most.
ANCHORS = 64
#: Tokens by which matched anchors may stray from the common displacement.
STRAY = 64
_SINGLE = r"฀-๿぀-ヿ㐀-鿿"
#: Characters of scripts without spaces one by one, else runs without white space, cut at 24.
TOKEN = f"[{_SINGLE}]|[^\\s{_SINGLE}]{{1,24}}"
_POSITION_BITS = 24
#: Ranges of ids that rows are dealt by, at most: each bound is compared with every id.
RANGES = 4096


def let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, at: Column) -> Column:
    """39 bits of a hash above 24 bits of a position: positive, ordered by hash."""
    high = F.shiftleft(F.shiftrightunsigned(hashed, _POSITION_BITS + 1), _POSITION_BITS)
    return high.bitwiseOR(F.least(at, F.lit((1 << _POSITION_BITS) - 1)).cast("bigint"))


def _hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, _POSITION_BITS)


def _position_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def fingerprint(text: Column, anchors: int = ANCHORS) -> Column:
    """array<bigint>: the anchors of the whole text with the least hashes, one for
    each hash (its first). A text of under four tokens has its tokens as anchors;
    one without closed syncmer has itself; one without token has none."""

    def found(h: Column) -> Column:
        def anchor(x, i):
            b, c, d = (F.get(h, i + k) for k in (1, 2, 3))
            return F.when(F.least(x, d) <= F.least(b, c), _packed(F.xxhash64(x, b, c, d), i))

        n = F.size(h)
        closed = F.filter(F.transform(F.slice(h, F.lit(1), F.greatest(n - 3, F.lit(0))), anchor), lambda x: x.isNotNull())
        few = F.transform(h, lambda x, i: _packed(F.xxhash64(x), i))
        return F.when(n < 4, few).otherwise(let(closed, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(_packed(F.xxhash64(h), F.lit(0))))))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda w: F.xxhash64(w))
    ordered = F.sort_array(let(hashes, found))
    first = let(ordered, lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(F.get(a, i - 1)))))
    return F.slice(first, 1, anchors)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, anchors: int = ANCHORS, stray: int = STRAY) -> Column:
    """0 to 1. Two fingerprints without anchors are equal: 1; with one such: 0."""

    def of(ha: Column, hb: Column, least: Column) -> Column:
        both = F.filter(F.array_intersect(ha, hb), lambda h: F.array_contains(least, h))
        moved = F.transform(both, lambda h: _position_of(F.element_at(b, F.array_position(hb, h).cast("int"))) - _position_of(F.element_at(a, F.array_position(ha, h).cast("int"))))
        together = let(F.sort_array(moved), lambda d: let(F.get(d, F.floor(F.size(d) / 2).cast("int")), lambda mid: F.size(F.filter(d, lambda x: F.abs(x - mid) <= stray))))
        return F.coalesce(together, F.lit(0)) / F.size(least)

    hashes = lambda x: F.transform(x, _hash_of)
    scored = let(hashes(a), lambda ha: let(hashes(b), lambda hb: let(F.slice(F.sort_array(F.array_union(ha, hb)), 1, anchors), lambda u: of(ha, hb, u))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(scored)


def with_next(docs: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """``docs`` (doc_id, text and more) with next_<column> of the row that follows
    in the order of (doc_id, text), nulls first; after the last row, the first.

    Rows are dealt once, by ranges of ids; a range's first rows are also dealt
    to the range before it. What the driver sees is a number for each range.
    """
    quantiles = [k / ranges for k in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, 10_000).alias("q")).first().q if quantiles else None
    bounds = sorted(set(bounds or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    ranged = docs.withColumn("_bucket", bucket)
    starts = ranged.groupBy("_bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("_bucket").collect()
    guest = F.lit(None).cast("int")
    for k, start in enumerate(starts):
        before = starts[k - 1]["_bucket"]  # of the first: the last
        low = F.lit(None if start.nulls else start.low).cast("bigint")
        guest = F.when(F.col("doc_id").eqNullSafe(low), F.lit(before)).otherwise(guest)
    if len(starts) > 8:  # many ranges: one lookup instead of a cascade
        lows = F.array(*(F.lit(s.low) for s in starts))
        to = F.array(*(F.lit(starts[k - 1]["_bucket"]) for k in range(len(starts))))
        guest = F.get(to, F.array_position(lows, F.col("doc_id")).cast("int") - 1)
        if starts[0].nulls:
            guest = F.when(F.col("doc_id").isNull(), F.lit(starts[-1]["_bucket"])).when(F.col("doc_id") == starts[0].low, F.lit(None).cast("int")).otherwise(guest)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("turn"))
    places = F.when(guest.isNotNull(), F.array(own, F.struct(guest.alias("bucket"), F.lit(1).alias("turn")))).otherwise(F.array(own))
    dealt = ranged.withColumn("_place", F.explode(places)).select("*", "_place.bucket", "_place.turn").drop("_place", "_bucket")
    order = Window.partitionBy("bucket").orderBy("turn", "doc_id", "text")
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return following.where("turn = 0").drop("bucket", "turn")


def syncmer_fingerprints(docs: DataFrame, anchors: int = ANCHORS, stray: int = STRAY) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by as many first ones (or all) of the next row's. Null text counts
    as empty. Positions count up to 2^24 tokens, those beyond count as that; a
    fingerprint is a sample of at most ``anchors`` anchors, exact for texts with
    no more. Of rows that repeat an id the next is by text; the only row of a
    table is its own next. Equal texts have equal fingerprints. An empty table
    gives no rows. Other columns of the input aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    ranges = max(2, min(RANGES, buckets(docs, 64 << 20)))
    rows = with_next(rows.withColumn("fp", fingerprint(F.col("text"), anchors)), ["text", "fp"], ranges)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = let(
        edited,
        lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e, anchors).alias("fp")),
    )
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "fp", "next_fp", made.alias("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited.fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited.fp"), anchors, stray).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), anchors, stray).alias("near_next"),
    )


def query(spark, sf_dir):
    return syncmer_fingerprints(documents(spark, sf_dir))
