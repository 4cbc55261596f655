"""A corpus cleaned in stages, each written as Parquet and read again.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
works on all that the one before kept; all but the last return the columns of
the documents, untouched. Rows without id or text are judged like any other: a null
text has no letter and goes with the second stage. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemframe.llm import byte_gru, packing
from tandemframe.llm import toxicity as toxic
from tandemframe.llm.common import cut, documents, lower_ascii, table
from tandemframe.llm.exact_dedup import exact_dedup
from tandemframe.llm.parity_join import ngram_jaccard

#: Below this mean probability of its best language a text is in none of them.
LEAST_LANGUAGE_SCORE = 0.4


def _apart(docs, **own):
    """A row's own columns as the struct ``row``, beside columns that a stage names:
    whatever a table's columns are called, a stage's don't meet them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def toxicity(spark, docs, sf_dir):
    """Documents that the factorization machine predicts to be toxic go."""
    machine = toxic.train(docs, table(spark, sf_dir, "labels"))
    return toxic.score_documents(_apart(docs, text=F.col("text")), machine).where("predicted = 0").select("row.*")


def language_id(spark, docs, sf_dir):
    """Documents without a letter, or in none of the learned languages, go. Where
    no language was learned, all with a letter stay."""
    net = byte_gru.train(docs)
    labelled = byte_gru.predict(_apart(docs, text=F.col("text")), net)
    if not net.langs:
        return labelled.where("score = 0").select("row.*")
    return labelled.where((F.col("lang_pred") != byte_gru.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def exact_duplicates(spark, docs, sf_dir):
    """Of texts that are equal but for the case of A-Z one document stays, that
    with the largest id; rows that repeat an id and its text are one document."""
    kept = cut(exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")), "kept")
    repeated = not kept.groupBy("kept_id", "kept_sha").count().where("count > 1").isEmpty()
    own = _apart(docs, id=F.col("doc_id"), sha=F.sha2(lower_ascii(F.coalesce("text", F.lit(""))).cast("binary"), 256))
    own = own.join(kept.distinct() if repeated else kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return (own.dropDuplicates(["id", "sha"]) if repeated else own).select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """Of documents connected by links of the n-gram Jaccard join one stays, that
    with the least id."""
    heads = ngram_jaccard(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("head"))
    return _apart(docs, id=F.col("doc_id")).join(heads, F.col("id").eqNullSafe(F.col("head")), "left_semi").select("row.*")


def best_fit_packing(spark, docs, sf_dir):
    """What is left, packed into sequences by its BPE tokens: a row for each piece."""
    return packing.pack_encoded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: Trained models aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
