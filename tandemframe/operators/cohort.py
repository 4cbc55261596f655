"""Views over many samples: tidy tables, summaries, margins, concordance, calibration."""

from __future__ import annotations

from dataclasses import replace

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..errors import InterpretationError
from ..functions import sequence as S
from ..functions import stats
from ..params import StutterModel

LOCUS = ("sample_id", "marker")
SEVERITY_RANK = {"error": 0, "warn": 1, "info": 2}
NULL_TOKENS = ("", "NA", "ND", "-", "?", "N/A")


def tidy(loci: DataFrame, run: dict[str, str] | None = None) -> DataFrame:
    """29 columns, one row for each called allele; a locus without call keeps one
    row with allele_index 0."""
    run = run or {}
    rows = loci.withColumn("a", F.explode_outer("alleles_called"))
    a = lambda c: F.col(f"a.{c}")
    called = F.col("a").isNotNull()
    return rows.select(
        F.col("sample_id").alias("sample"), "marker", F.coalesce(a("allele_index"), F.lit(0)).cast("int").alias("allele_index"), called.alias("called"),
        a("number").alias("allele_number"), a("number_label").alias("allele_label"), a("number_method").alias("number_method"), a("number_is_absolute").alias("number_is_absolute"),
        a("isfg").alias("isfg"), a("iso_suffix").alias("iso_suffix"), a("iso_match").alias("iso_match"), a("length_bp").cast("int").alias("length_bp"),
        a("n_reads").cast("int").alias("reads"), a("n_hp1").cast("int").alias("reads_hp1"), a("n_hp2").cast("int").alias("reads_hp2"), a("n_reads_absorbed").cast("int").alias("reads_absorbed"),
        a("fraction").alias("allele_fraction"), a("consensus_method").alias("consensus_method"), "call_rule", F.col("total_reads").cast("int").alias("locus_reads"), F.size("alleles_called").alias("n_alleles_called"),
        F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("marker_flags"), "needs_review",
        *(F.lit(run.get(k, "")).alias(k) for k in ("panel_name", "panel_version", "poa_backend", "stutter_model", "run_id")), a("consensus").alias("consensus"),
    )


def genotype(called: Column) -> Column:
    """Labels of the called alleles, three at most: 12 / 14; a dash without any."""
    labels = F.array_join(F.transform(F.slice(called, 1, 3), lambda a: a["number_label"]), " / ")
    return F.when(F.size(called) > 0, labels).otherwise("–")


def status_chip() -> Column:
    warned = F.exists("flags", lambda f: f["severity"].isin("warn", "error"))
    return F.when(F.col("call_rule") == "no_data", "no_data").when(warned, "review").otherwise("ok")


def worst_severity() -> Column:
    has = lambda s: F.exists("flags", lambda f: f["severity"] == s)
    return F.when(has("error"), "error").when(has("warn"), "warn").when(has("info"), "info").otherwise("")


def profile_rows(loci: DataFrame) -> DataFrame:
    """One wide row for each locus, up to three allele slots."""
    slots = []
    for k in range(3):
        a = F.get("alleles_called", F.lit(k))
        for name, field in (("isfg", "repeat_label"), ("repeat_summary", "repeat_summary"), ("ce", "ce"), ("label", "number_label"), ("bp_diff", "bp_diff"), ("cov", "n_reads"), ("hp1", "n_hp1"), ("hp2", "n_hp2"), ("seq", "consensus")):
            slots.append(a[field].alias(f"allele{k + 1}_{name}"))
    return loci.select(
        F.col("sample_id").alias("sample"), "marker", "marker_ord", "call_rule", "tri_type", "total_reads", "called_reads", "discarded_reads", "allele_balance",
        status_chip().alias("status_chip"), worst_severity().alias("worst_severity"), genotype(F.col("alleles_called")).alias("genotype"), F.array_join(F.transform("flags", lambda f: f["short"]), " ").alias("flags"), *slots,
    )


def batch_summary(loci: DataFrame, markers: list[str]) -> DataFrame:
    """One row for each sample, a column for each marker of the panel: 12,14; ? where nothing is called."""
    labels = F.array_join(F.transform("alleles_called", lambda a: a["number_label"]), ",")
    cell = F.when(F.size("alleles_called") > 0, labels).otherwise("?")
    return loci.select("sample_id", "marker", cell.alias("cell")).groupBy("sample_id").pivot("marker", markers).agg(F.first("cell"))


def margins(loci: DataFrame) -> DataFrame:
    """Counts and call rate by marker, by sample and over all, in one pass of grouping sets."""
    facts = loci.select(*LOCUS, F.size("alleles_called").alias("k"), F.size("flags").alias("f"))
    grouped = facts.groupingSets([["marker"], ["sample_id"], []], "marker", "sample_id").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 0).alias("n_called"), F.count_if(F.col("f") > 0).alias("n_flagged")
    )
    level = F.when(F.col("gid") == 1, "marker").when(F.col("gid") == 2, "sample").otherwise("all")
    return grouped.select(level.alias("level"), F.coalesce("marker", "sample_id").alias("key"), "n", "n_called", "n_flagged", (F.col("n_called") / F.col("n")).alias("call_rate"))


def worst(margin: DataFrame, level: str, k: int = 5) -> DataFrame:
    """The k of lowest call rate, most flags; of these, the imperfect ones (so maybe fewer than k)."""
    top = margin.where(F.col("level") == level).orderBy("call_rate", F.desc("n_flagged"), "key").limit(k)
    return top.where((F.col("call_rate") < 1) | (F.col("n_flagged") > 0))


def sequence_rows(alleles: DataFrame) -> DataFrame:
    """Distinct sequences of a repeat group: strongest row of each, canonical or iso, stacked by reads."""
    group = F.coalesce(F.floor(F.coalesce("allele_numeric", "ce")).cast("int"), F.col("length_bp"))
    rows = alleles.where(~F.col("is_deletion")).withColumn("repeat_group", group)
    by_seq = rows.groupBy(*LOCUS, "repeat_group", "consensus").agg(F.max_by(F.struct("n_reads", "cluster_index", "isfg", "status", "fraction"), F.struct("n_reads", (-F.col("cluster_index")).alias("i"))).alias("r")).select(*LOCUS, "repeat_group", "consensus", "r.*")
    own = Window.partitionBy(*LOCUS, "repeat_group")
    best = F.row_number().over(own.orderBy(F.desc("n_reads"), "cluster_index"))
    stack = F.row_number().over(own.orderBy("n_reads", "cluster_index")) - 1
    rows = by_seq.withColumns({"canonical": best == 1, "stack_index": stack})
    ordinal = F.when(F.col("canonical"), 0).otherwise(F.sum(F.when(~F.col("canonical"), 1).otherwise(0)).over(own.orderBy("stack_index")))
    return rows.withColumn("iso_ordinal", ordinal.cast("int"))


def strand_table(alleles: DataFrame) -> DataFrame:
    locus = Window.partitionBy(*LOCUS)
    fwd, rev = F.col("n_forward"), F.col("n_reverse")
    pct = lambda a, b: F.round(100 * stats.share(a, b), 2)
    return alleles.select(*LOCUS, "cluster_index", "n_forward", "n_reverse", pct(fwd, fwd + rev).alias("allele_forward_pct"), pct(F.sum("n_forward").over(locus), F.sum(F.col("n_forward") + F.col("n_reverse")).over(locus)).alias("locus_forward_pct"))


# truth and concordance


def canonical_sample_id(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "^GM", "NA")


def canonical_allele(c: Column) -> Column:
    """NULL for the tokens that mean nothing; numbers with one decimal or none; else as it is."""
    t = F.trim(c.cast("string"))
    number = t.try_cast("double")
    shown = F.regexp_replace(F.format_string("%.1f", number), r"\.0$", "")
    return F.when(t.isNull() | F.upper(t).isin(*NULL_TOKENS), F.lit(None)).when(number.isNotNull(), shown).otherwise(t)


def canonical_genotype(alleles: Column) -> Column:
    """Array of raw alleles: nulls dropped, a single one doubled, numbers in order before words."""
    kept = F.filter(F.transform(alleles, canonical_allele), lambda x: x.isNotNull())
    keyed = F.transform(kept, lambda x: F.struct(x.try_cast("double").isNull().alias("w"), x.try_cast("double").alias("n"), x.alias("x")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["x"])
    return F.when(F.size(ordered) == 1, F.concat(ordered, ordered)).otherwise(ordered)


def called_long(summary: DataFrame, markers: list[str]) -> DataFrame:
    """The wide summary back to sample_id, marker, called genotype."""
    long = summary.unpivot(["sample_id"], markers, "marker", "cell")
    return long.select(canonical_sample_id(F.col("sample_id")).alias("sample_id"), "marker", canonical_genotype(F.split(F.coalesce("cell", F.lit("")), ",")).alias("called"))


def called_genotypes(loci: DataFrame) -> DataFrame:
    """sample_id, marker, called genotype, as ``called_long`` has them from a summary."""
    labels = F.transform("alleles_called", lambda a: a["number_label"])
    return loci.select(canonical_sample_id(F.col("sample_id")).alias("sample_id"), "marker", canonical_genotype(labels).alias("called"))


def compare(called: DataFrame, truth: DataFrame, technology: str = "ILLUMINA") -> DataFrame:
    """A verdict for each truth genotype of the samples that were run: no_call before no_truth before match."""
    wanted = truth.where(F.col("technology") == technology) if technology else truth
    wanted = wanted.select(canonical_sample_id(F.col("sample_id")).alias("sample_id"), "marker", canonical_genotype(F.array("allele1", "allele2")).alias("truth"))
    # a sample's calls are a row, no longer than the panel: who was run and what was called come from one join
    run = called.groupBy("sample_id").agg(F.collect_list(F.struct("marker", "called")).alias("calls"))
    own = F.filter("calls", lambda c: c["marker"] == F.col("marker"))
    rows = wanted.join(run, "sample_id").select("sample_id", "marker", "truth", F.explode_outer(own).alias("call")).select("sample_id", "marker", "truth", F.col("call.called").alias("called"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    verdict = F.when(empty("called"), "no_call").when(empty("truth"), "no_truth").when(F.col("called") == F.col("truth"), "match").otherwise("mismatch")
    return rows.withColumn("verdict", verdict)


def unscored(called: DataFrame, truth: DataFrame) -> DataFrame:
    return called.select("sample_id").distinct().join(truth.select(canonical_sample_id(F.col("sample_id")).alias("sample_id")).distinct(), "sample_id", "left_anti")


def concordance(compared: DataFrame) -> DataFrame:
    """By marker and, in the row without marker, over all."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    rows = compared.rollup("marker").agg(n("match"), n("mismatch"), n("no_call"), n("no_truth"))
    return rows.withColumn("concordance", F.try_divide(F.col("match"), F.col("match") + F.col("mismatch")))


def discordances(compared: DataFrame, k: int | None = None) -> DataFrame:
    rows = compared.where(F.col("verdict").isin("mismatch", "no_call")).orderBy("marker", "sample_id")
    return rows if k is None else rows.limit(k)


# stutter calibration


def stutter_observations(alleles: DataFrame) -> DataFrame:
    """Reads one and two repeats below and one above each usable called allele,
    zeros included; loci whose called cores lie within three repeats are left out.

    All of it is windows by locus, which the alleles are dealt by already.
    """
    period = F.when(F.col("period") > 0, F.col("period")).otherwise(4)
    rows = alleles.where(F.coalesce("motif", F.lit("")) != "").withColumns({
        "core": S.repeat_core_length(F.col("consensus"), F.col("motif"), F.col("marker_strand")), "unit": period,
        "lus": S.lus_units(F.col("consensus"), F.col("motif"), F.col("marker_strand")),
    }).where("core is not null")
    locus = Window.partitionBy(*LOCUS)
    rows = rows.withColumns({
        "cores": F.collect_list(F.struct("core", F.col("n_reads").cast("long").alias("n"))).over(locus),
        "called_cores": F.sort_array(F.collect_list(F.when(F.col("is_called"), F.col("core"))).over(locus)),
    }).where("is_called")
    at = lambda core: F.aggregate(F.filter("cores", lambda c: c["core"] == core), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    gaps = F.zip_with(F.slice("called_cores", F.lit(2), F.size("called_cores")), F.slice("called_cores", F.lit(1), F.size("called_cores") - 1), lambda b, a: b - a)
    rows = rows.withColumns({"closest": F.array_min(gaps), "parent_reads": at(F.col("core"))})
    rows = rows.where((F.col("closest").isNull() | (F.col("closest") >= P.CALIBRATION_SEPARATION * F.col("unit"))) & (F.col("parent_reads") >= P.CALIBRATION_PARENT_READS))
    stepped = rows.withColumn("step", F.explode(F.array(*map(F.lit, P.STUTTER_STEPS))))
    return stepped.select(*LOCUS, "cluster_index", "step", "lus", "parent_reads", at(F.col("core") + F.col("step") * F.col("unit")).alias("stutter_reads"))


def stutter_summary(obs: DataFrame) -> DataFrame:
    """Pooled ratios by step, LUS and marker: one pass of grouping sets."""
    rows = obs.groupingSets([["step"], ["lus"], ["marker"]], "step", "lus", "marker").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.bround(stats.pooled_ratio(F.col("stutter_reads"), F.col("parent_reads")), 4).alias("ratio"), F.count_if(F.col("stutter_reads") == 0).alias("n_zero")
    )
    level = F.when(F.col("gid") == 3, "step").when(F.col("gid") == 5, "lus").otherwise("marker")
    return rows.select(level.alias("level"), F.coalesce(F.col("marker"), F.col("lus").cast("string"), F.col("step").cast("string")).alias("key"), "n", "ratio", "n_zero")


def stutter_fit(obs: DataFrame, least: int = P.CALIBRATION_BIN) -> DataFrame:
    """One row: weighted least squares of log(ratio) on LUS at step -1, and step
    factors; sums by step and LUS, then sums of those."""
    one = F.col("step") == -1
    first = F.row_number().over(Window.partitionBy(*LOCUS, "step").orderBy("cluster_index")) == 1
    bins = obs.withColumn("first", one & first).groupBy("step", "lus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("parent_reads").cast("double").alias("w"), F.sum("stutter_reads").cast("double").alias("q"), F.count_if("first").alias("loci"),
    )
    usable = one & (F.col("n") >= least) & (F.coalesce(F.try_divide(F.col("q"), F.col("w")), F.lit(0.0)) > 0)
    x, y, w = F.col("lus").cast("double"), F.log(F.col("q") / F.col("w")), F.col("w")
    of = lambda v: F.sum(F.when(usable, v))
    ratio = lambda k: F.try_divide(F.sum(F.when(F.col("step") == k, F.col("q"))), F.sum(F.when(F.col("step") == k, F.col("w"))))
    line = bins.agg(
        F.count_if(usable).alias("bins"), F.min(F.when(usable, F.col("lus"))).alias("lus_min"), F.max(F.when(usable, F.col("lus"))).alias("lus_max"),
        of(w).alias("sw"), of(w * x).alias("sx"), of(w * y).alias("sy"), of(w * x * x).alias("sxx"), of(w * x * y).alias("sxy"), of(w * y * y).alias("syy"),
        *(F.coalesce(F.try_divide(ratio(k), ratio(-1)), F.lit(0.0)).alias(n) for k, n in ((-1, "f_minus1"), (-2, "f_minus2"), (1, "f_plus1"))),
        F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("n_observations"), F.coalesce(F.sum("loci"), F.lit(0)).alias("n_loci"),
    )
    mx, my = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
    cxx, cxy, cyy = F.col("sxx") - F.col("sw") * mx * mx, F.col("sxy") - F.col("sw") * mx * my, F.col("syy") - F.col("sw") * my * my
    line = line.withColumn("slope", F.when(cxx > 0, cxy / cxx)).withColumns({"intercept": my - F.col("slope") * mx, "r2": F.when(cyy > 0, 1 - (cyy - F.col("slope") * cxy) / cyy)})
    return line.select(
        "bins", "lus_min", "lus_max", F.bround("intercept", 4).alias("log_intercept"), F.bround("slope", 4).alias("log_slope"), F.bround("r2", 3).alias("r_squared"),
        *(F.bround(c, 3).alias(c) for c in ("f_minus1", "f_minus2", "f_plus1")), "n_observations", "n_loci",
    )


def fitted_model(obs: DataFrame, version: str = "custom") -> StutterModel:
    r = stutter_fit(obs).first()
    if not r.bins or r.bins < 2 or r.log_slope is None:
        raise InterpretationError(f"two usable LUS bins are needed to fit a slope, there are {r.bins}")
    return replace(StutterModel(), version=version, log_intercept=r.log_intercept, log_slope=r.log_slope, lus_min=r.lus_min, lus_max=r.lus_max, step_factors={-1: r.f_minus1, -2: r.f_minus2, 1: r.f_plus1}, n_observations=r.n_observations, n_loci=r.n_loci, r_squared=r.r_squared)


def nice_axis_max(top: float) -> int:
    """The least of 1, 2, 5 times a power of ten that is not below ``top``."""
    if top <= 0:
        return 1
    power = 10 ** math.floor(math.log10(top))
    return int(next(m * power for m in (1, 2, 5, 10) if m * power >= top)) or 1


def select_cohort(listing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, missing) of the wanted sample ids: of a sample's eligible basecalls
    (R10 by the current basecaller) the lexically last path."""
    p = F.lower("path")
    name = F.element_at(F.split("path", "/"), -1)
    ok = p.contains("-r10") & p.contains("dorado") & ~p.contains("-r9") & ~p.contains("guppy")
    by = listing.where(ok).select(F.element_at(F.split(name, "-(?i)ont"), 1).alias("sample_id"), "path").groupBy("sample_id").agg(F.max("path").alias("path"))
    return wanted.join(by, "sample_id"), wanted.join(by, "sample_id", "left_anti")


# reference calibration of panels

_TOKEN = r"\[[A-Z]+\]\d+|[A-Z]{2,}"


def core_and_flanking(notation: Column, gap: int = P.GAP) -> Column:
    """struct<core, flanking>: repeats in the richest group of motif tokens, and
    outside it. Tokens up to ``gap`` characters of the notation apart are one group."""

    def grouped(tokens: Column, gaps: Column) -> Column:
        zero = F.lit(0)
        start = F.struct(zero.alias("best"), zero.alias("now"), zero.alias("total"))

        def step(s, i):
            token = F.get(tokens, i)
            n = F.coalesce(F.regexp_extract(token, r"\](\d+)", 1).try_cast("int"), F.lit(1))
            now = F.when((i > 0) & (F.length(F.get(gaps, i)) <= gap), s["now"] + n).otherwise(n)
            return F.struct(F.greatest(s["best"], now).alias("best"), now.alias("now"), (s["total"] + n).alias("total"))

        indexes = F.filter(F.sequence(zero, F.size(tokens)), lambda i: i < F.size(tokens))
        return F.aggregate(indexes, start, step, lambda s: F.struct(s["best"].alias("core"), (s["total"] - s["best"]).alias("flanking")))

    return S.let(F.regexp_extract_all(notation, F.lit(_TOKEN), 0), lambda t: S.let(F.split(notation, _TOKEN), lambda g: grouped(t, g)))


def calibrated_panel(panel: DataFrame, contigs: DataFrame) -> DataFrame:
    """For markers counted by brackets: the repeats of the reference window outside
    its core, which a count has to leave out. ``contigs`` has name and seq."""
    rows = panel.where("period = -1 and marker_type = 'str'").join(contigs.select(F.col("name").alias("chromosome"), "seq"), "chromosome")
    window = F.upper(F.substring("seq", F.col("ref_start"), F.col("ref_end") - F.col("ref_start") + 1))
    rows = rows.withColumn("ref_isfg", S.brackets(window, F.col("motif"), F.col("strand")))
    rows = rows.withColumn("_c", core_and_flanking(F.col("ref_isfg")))
    return rows.select("marker_ord", "name", "period", (F.col("ref_end") - F.col("ref_start") + 1).alias("window_bp"), F.col("_c.flanking").alias("corr_value"), "ref_isfg", S.ce_from_brackets(F.col("ref_isfg")).alias("raw_ce"), F.col("_c.core").alias("core_units"), F.col("_c.flanking").alias("flanking_units"))


def sequence_panel(alleles: DataFrame) -> DataFrame:
    """The stacked sequences of each locus as nested rows, one record a locus."""
    rows = sequence_rows(alleles)
    entry = F.struct("repeat_group", "stack_index", (~F.col("canonical")).alias("allele_iso"), "iso_ordinal", F.col("n_reads").alias("coverage_reads"), F.round(F.col("fraction") * 100, 2).alias("coverage_fraction"), F.col("isfg").alias("repeat_sequence"), F.col("consensus").alias("full_sequence"))
    return rows.groupBy(*LOCUS).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
