"""Exact duplicates, combined up a salted tree.

1. Every task aggregates its own rows by (digest, salt, whole text): Spark's
   map-side half of the first aggregate. Copies in one task become one row.
2. The groups of each (digest, salt) merge; a text that a third of all rows
   share is spread over ``salts`` reducers.
3. The at most ``salts`` winners of a digest combine, again on whole texts.

The whole text is a grouping key at every stage, so two texts with one digest
never merge; should SHA-256 ever give two texts one digest, the job stops with
an error instead of mixing them up. The decision then walks the same tree down:
a digest's winner goes to its salted rows, these to the documents, so no join
key holds more than a salt's share of a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lower_ascii

#: Salts of one digest: a hot text reaches that many reducers.
SALTS = 32


def exact_dedup(docs: DataFrame, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when identical after
    lower-casing A-Z. The row with the largest id stays; a null id loses to any
    other; in a group where all ids are null, keep_id is null and every row is
    kept. Rows that repeat an id and its text all carry that id as keep_id and
    are all marked kept: they are one document. An empty table gives no rows.
    Other columns of the input aren't read.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
        .withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    )
    salted = rows.groupBy("digest", "salt", "norm").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")
    )
    # one exchange by digest serves both aggregates below
    contents = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"), F.collect_set("salt").alias("salt_set"))
    )
    winners = contents.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_contents"),
        F.max("n").alias("n"),
        F.max("keep_id").alias("keep_id"),
        F.flatten(F.collect_list("salt_set")).alias("salt_set"),
    )
    clash = F.raise_error(F.concat(F.lit("different texts share the digest "), F.hex("digest")))
    down = winners.select(
        "digest",
        "keep_id",
        F.when(F.col("n_contents") > 1, clash.cast("bigint")).otherwise(F.col("n")).alias("n"),
        F.explode(F.array_distinct("salt_set")).alias("salt"),
    )
    return (
        rows.select("doc_id", "digest", "salt")
        .join(down, ["digest", "salt"])
        .select(
            "doc_id",
            "keep_id",
            F.col("n").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def query(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
