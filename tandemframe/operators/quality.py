"""Flags of a locus, audit of a run."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import stats
from ..params import FLAGS, Settings

LOCUS = ("sample_id", "marker")


def flag(code: str, when: Column, message: Column) -> Column:
    severity, short = FLAGS[code]
    made = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(short).alias("short"), message.alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def locus_summary(alleles: DataFrame) -> DataFrame:
    """One row for each locus from called_alleles(): what its flags and views need."""
    called = F.col("is_called")
    thing = F.struct(
        F.col("allele_index").alias("allele_index"), *("cluster_index number number_label number_method isfg iso_suffix length_bp n_reads n_hp1 n_hp2 n_forward n_reverse hp_rescued consensus_method status consensus".split()),
        *[F.col(c) for c in ("repeat_label", "repeat_label_source", "repeat_summary", "ce", "bp_diff", "allele_numeric", "allele_numeric_source", "number_is_absolute", "n_reads_absorbed", "fraction", "iso_match") if c in alleles.columns],
    )
    return alleles.groupBy(*LOCUS).agg(
        *(F.first(c).alias(c) for c in ("marker_ord", "total_reads", "call_rule", "tri_type", "category", "kit_nomenclature_note")),
        F.array_sort(F.collect_list(F.when(called, thing))).alias("alleles_called"),
        F.sum(F.when(called, F.col("n_reads")).otherwise(0)).cast("long").alias("called_reads"),
        F.count_if(F.col("status") == "hp_phantom").alias("n_phantoms"), F.count_if(F.col("n_phase_sets") > 1).alias("n_split"), F.count_if(F.col("consensus_method") == "failed").alias("n_failed"),
    )


def flagged(loci: DataFrame, params: Settings = Settings()) -> DataFrame:
    """loci with flags (array of code, severity, short, message), allele_balance, discarded_reads, needs_review."""
    c = F.col("alleles_called")
    reads = lambda k: F.get(c, F.lit(k))["n_reads"]
    balance = F.when(F.size(c) == 2, stats.allele_balance(reads(0), reads(1)))
    loci = loci.withColumns({"allele_balance": balance, "discarded_reads": F.col("total_reads") - F.col("called_reads")})
    numbered = F.filter(c, lambda a: a["number"].isNotNull())
    pairs = F.transform(numbered, lambda a: F.struct(a["number"].alias("n"), a["isfg"].alias("i")))
    iso = F.size(F.array_distinct(pairs)) > F.size(F.array_distinct(F.transform(numbered, lambda a: a["number"])))
    biased = F.exists(c, lambda a: (a["n_forward"] + a["n_reverse"] >= P.STRAND_MIN_READS) & (stats.two_sided_binomial_p(a["n_forward"], a["n_forward"] + a["n_reverse"]) < P.STRAND_P))
    any_ = lambda test: F.exists(c, test)
    none = F.col("call_rule") == "no_data"
    failed = F.col("n_failed") > 0 if "n_failed" in loci.columns else F.lit(False)
    m = F.col("marker")
    derived = params.changed("derived")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    made = [
        flag("mixture_suspected", F.col("tri_type") == "mixture_suspected", text(m, ": more alleles than expected; possibly a mixture")),
        flag("triallelic", F.col("tri_type").isin("tri_I_unbalanced", "tri_II_balanced"), text(m, ": three alleles, ", F.col("tri_type"))),
        flag("isoallele", iso | any_(lambda a: F.coalesce(a["iso_suffix"], F.lit("")) != ""), text(m, ": one number, different sequences")),
        flag("hp_phantom_collapsed", F.col("n_phantoms") > 0, text(m, ": ", F.col("n_phantoms").cast("string"), " candidate(s) absorbed by a stronger one of their haplotype")),
        flag("phase_block_split", F.col("n_split") > 0, text(m, ": haplotype tags span several phase blocks and count as unphased")),
        flag("hp_rescued_het", any_(lambda a: a["hp_rescued"]), text(m, ": heterozygous by phasing, not by balance")),
        flag("consensus_fallback", any_(lambda a: a["consensus_method"] == "mode"), text(m, ": a called allele has an unpolished consensus")),
        flag("dropout", none, text(m, ": no allele called; ", F.when(failed, "its clustering failed").otherwise(F.concat(F.col("total_reads").cast("string"), F.lit(" read(s)"))))),
        flag("low_coverage", ~none & (F.col("called_reads") < params["low_coverage_reads"]), text(m, ": called on ", F.col("called_reads").cast("string"), " of ", F.col("total_reads").cast("string"), " read(s); ", F.when(F.col("category") == "y_chromosomal", "the call is thin").otherwise("a minor allele may be missed"))),
        flag("strand_bias", biased, text(m, ": a called allele's reads are mostly of one strand")),
        flag("inexact_allele", any_(lambda a: a["status"] == "inexact_allele"), text(m, ": a called allele is a reconstruction")),
        flag("allele_imbalance", (F.col("allele_balance") > params["balanced_ab_max"]) & ~any_(lambda a: a["hp_rescued"]), text(m, ": allele balance ", F.format_string("%.2f", F.col("allele_balance")))),
        flag("ce_nomenclature_offset", (F.coalesce("kit_nomenclature_note", F.lit("")) != "") & (F.size(c) > 0) & any_(lambda a: a["number_method"] != "strnaming"), text(m, ": counted in the sequence, not a kit's designation. ", F.coalesce("kit_nomenclature_note", F.lit("")))),
        flag("non_default_threshold", F.lit(bool(derived)), F.lit("overridden: " + ", ".join(derived))),
    ]
    loci = loci.withColumn("flags", F.filter(F.array(*made), lambda f: f.isNotNull()))
    return loci.withColumn("needs_review", F.exists("flags", lambda f: f["severity"].isin("warn", "error")))


def flag_rows(loci: DataFrame) -> DataFrame:
    """The QC view: one row for each flag, worst severity first within the panel's order."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return loci.select(*LOCUS, "marker_ord", F.explode("flags").alias("f")).select(*LOCUS, "marker_ord", "f.*").withColumn("severity_rank", rank)


def flag_census(loci: DataFrame) -> DataFrame:
    """code, severity, loci; codes that never fired have 0."""
    spark = loci.sparkSession
    codes = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity")) for c, (s, _) in FLAGS.items()))).alias("x")).select("x.*")
    counts = flag_rows(loci).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return codes.join(counts, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def canonical(record: dict[str, Any]) -> bytes:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def sealed(record: dict[str, Any]) -> dict[str, Any]:
    """The record with the SHA-256 of its own content (sorted keys, compact)."""
    body = {k: v for k, v in record.items() if k != "record_sha256"}
    return body | {"record_sha256": hashlib.sha256(canonical(body)).hexdigest()}


def verify(record: dict[str, Any]) -> bool:
    return sealed(record)["record_sha256"] == record.get("record_sha256")


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def audit_frame(loci: DataFrame, params: Settings, backend: str = "poa_native", stutter_version: str = "default", run_id: str = "") -> DataFrame:
    """One row for each sample: counts by flag, review state, parameters, seal."""
    per = flag_rows(loci).groupBy("sample_id", "code").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("flag_counts"))
    review = loci.groupBy("sample_id").agg(F.max("needs_review").alias("needs_review"), F.count(F.lit(1)).alias("n_markers"), F.count_if(F.col("call_rule") != "no_data").alias("n_called"))
    rows = review.join(counts, "sample_id", "left").withColumns({
        "schema_version": F.lit("1.0"), "run_id": F.lit(run_id), "poa_backend": F.lit(backend), "stutter_model_version": F.lit(stutter_version),
        "flags_checked": F.array(*map(F.lit, sorted(FLAGS))), "parameters": F.lit(json.dumps(dict(params), sort_keys=True)),
    })
    ordered = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.withColumn("record_sha256", F.sha2(ordered, 256))
