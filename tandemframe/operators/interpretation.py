"""From clusters to genotypes: naming, stutter, classification, haplotypes, calls.

Every step is a projection or a window by (sample_id, marker); the clusters are
dealt once by that key and all steps reuse the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import sequence as S
from ..functions import stats
from ..params import Settings, StutterModel
from .sizes import sent

LOCUS = ("sample_id", "marker")
PANEL_COLUMNS = (
    "marker_ord", "chromosome", "ref_start", "ref_end", "motif", "period", "corr_value", "category", "reference_ce", "allele_bp_step",
    "kit_nomenclature_note", "allow_triallelic", "tri_balanced_thr", "min_reads_third", "stutter_overrides",
)


def locus() -> Window:
    return Window.partitionBy(*LOCUS)


def named(clusters: DataFrame, panel: DataFrame, ranges: DataFrame | None = None, namer=None) -> DataFrame:
    """Clusters as allele candidates with notation, number and label.

    Without a naming tool the status says so and the calibrated number, the
    bracket count or an offset stands in, in that order. ``ranges`` adds the
    reporting range between its anchors; ``namer(sequence, marker)``, Columns in
    and out, names it: a name that begins with CE<number>_ gives the number. On
    the minus strand the range is turned first.
    """
    rows = clusters.join(sent(panel.select(F.col("name").alias("marker"), F.col("strand").alias("marker_strand"), *PANEL_COLUMNS), panel), "marker")
    bp = F.length("consensus")
    anchor = F.col("ref_end") - F.col("ref_start") + 1
    rows = rows.withColumns({
        "length_bp": bp, "is_deletion": bp == 0, "isfg": S.brackets(F.col("consensus"), F.col("motif"), F.col("marker_strand")),
        "bp_diff": bp - anchor, "repeat_summary": S.repeat_summary(F.col("consensus"), F.col("motif"), F.col("marker_strand")),
    })
    by_brackets = S.ce_from_brackets(F.col("isfg")) - F.when(F.col("corr_value") != 0, F.col("corr_value")).otherwise(F.lit(0))
    ce = F.when(F.col("period") > 0, S.ce_from_length(bp, F.col("period"), F.col("corr_value"))).otherwise(by_brackets)
    numeric = S.allele_numeric(bp, F.col("period"), F.col("corr_value"), anchor, F.col("allele_bp_step"), F.col("reference_ce"))
    rows = rows.withColumn("ce", ce).withColumn("_n", numeric).withColumns({"allele_numeric": F.col("_n.value"), "allele_numeric_source": F.col("_n.source")}).drop("_n")
    if ranges is not None:
        from ..functions.scan import reporting_range

        anchors = ranges.select(F.col("name").alias("marker"), "left_anchor", "right_anchor", "minus")
        rows = rows.join(sent(anchors, ranges), "marker", "left").withColumn("_r", reporting_range()("consensus", "left_anchor", "right_anchor"))
        rows = rows.withColumns({"range_seq": F.col("_r.range_seq"), "strnaming_status": F.when(F.col("left_anchor").isNull(), "no_range").when(F.col("_r.range_status") == "ok", "error").otherwise(F.col("_r.range_status"))})
        rows = rows.withColumn("range_seq", F.when(F.col("minus"), S.reverse_complement(F.col("range_seq"))).otherwise(F.col("range_seq"))).drop("_r", "left_anchor", "right_anchor", "minus")
    else:
        rows = rows.withColumn("strnaming_status", F.lit("unavailable"))
    name = F.coalesce(namer(F.col("range_seq"), F.col("marker")), F.lit("")) if namer is not None and ranges is not None else F.lit("")
    rows = rows.withColumn("strnaming_name", name)
    rows = rows.withColumn("strnaming_ce", F.regexp_extract("strnaming_name", r"^CE(-?\d+(?:\.\d+)?)_", 1).try_cast("double"))
    rows = rows.withColumn("strnaming_status", F.when(F.col("strnaming_ce").isNotNull(), "ok").otherwise(F.col("strnaming_status")))
    return numbered(rows)


def naming_fallbacks(alleles: DataFrame) -> DataFrame:
    """Alleles whose number isn't the naming tool's, and why: a warning where the
    allele is called, as a reported number rests on it, else news for debugging.
    Markers without a reporting range never have one and aren't told."""
    status = F.coalesce("strnaming_status", F.lit(""))
    return alleles.where(~status.isin("", "ok", "no_range")).select(
        *LOCUS, "cluster_index", status.alias("reason"), F.when(F.col("is_called"), "warning").otherwise("debug").alias("level"), "n_reads", "length_bp", "consensus_method", "number_method",
    )


def numbered(rows: DataFrame) -> DataFrame:
    chosen = S.allele_number(F.col("strnaming_ce"), F.col("allele_numeric"), F.col("allele_numeric_source"), F.col("ce"), F.col("length_bp"))
    rows = rows.withColumn("_c", chosen).withColumns({"number": F.col("_c.number"), "number_method": F.col("_c.method")}).drop("_c")
    named_first = F.coalesce(F.col("strnaming_name"), F.lit("")) != ""
    return rows.withColumns({
        "number_is_absolute": F.col("number_method").isin("strnaming", "period_ce", "reference_offset", "bracket_count"),
        "number_label": S.number_label(F.col("number"), F.col("number_method"), F.col("isfg")),
        "repeat_label": F.when(named_first, F.col("strnaming_name")).otherwise(F.col("isfg")),
        "repeat_label_source": F.when(named_first, "strnaming").when(F.col("isfg") != "", "bracket_scan").otherwise("none"),
    })


def with_fraction(rows: DataFrame) -> DataFrame:
    total = F.sum("n_reads").over(locus())
    return rows.withColumn("total_reads", total.cast("long")).withColumn("fraction", stats.share(F.col("n_reads"), F.col("total_reads")))


def _variant(run: Column, seq: Column, delta: int) -> Column:
    copies = run["copies"] + delta
    changed = F.concat(F.substring(seq, F.lit(1), run["start"]), F.repeat(run["motif"], copies), F.substring(seq, run["start"] + run["bp"] + 1, F.length(seq)))
    return F.when(copies >= 1, changed)


def _products() -> Column:
    """array<struct<variant, step, origin, run_copies>> of a row's consensus."""

    def of_runs(sorted_runs: Column) -> Column:
        parts = []
        for k, origin in ((0, "LUS"), (1, "SLUS")):
            run = F.get(sorted_runs, F.lit(k))
            for delta in P.STUTTER_STEPS:
                v = _variant(run, F.col("consensus"), delta)
                ok = run.isNotNull() & (run["copies"] >= 2) & v.isNotNull() & (v != F.col("consensus"))
                parts.append(F.when(ok, F.struct(v.alias("variant"), F.lit(delta).alias("step"), F.lit(origin).alias("origin"), run["copies"].alias("run_copies"))))
        return F.filter(F.array(*parts), lambda x: x.isNotNull())

    return S.let(S.longest_runs(S.runs(F.col("consensus"), F.col("motif"))), of_runs)


def virtual_stutters(rows: DataFrame) -> DataFrame:
    """A row for each product that slippage of a row's longest or second longest
    run may give: variant, step, origin (LUS or SLUS), run_copies.

    Runs are looked for in the consensus as it lies, not turned to the marker's strand.
    """
    return rows.where(F.coalesce(F.col("motif"), F.lit("")) != "").withColumn("_v", F.explode(_products())).select("*", "_v.*").drop("_v")


def _slips(rows: DataFrame, model: StutterModel, parent_fraction: float) -> Column:
    """array<struct<variant, e>>: expected reads on each product of a strong candidate; else empty."""
    over = lambda k: F.element_at("stutter_overrides", F.lit(k)) if "stutter_overrides" in rows.columns else F.lit(None).cast("double")

    def weighted(v: Column) -> Column:
        factor = F.lit(0.0)
        for k, x in model.step_factors.items():
            factor = F.when(v["step"] == k, F.coalesce(over(f"step_{k}"), F.lit(float(x)))).otherwise(factor)
        clamped = F.least(F.greatest(v["run_copies"], F.lit(model.lus_min)), F.lit(model.lus_max))
        fitted = F.exp(F.coalesce(over("log_intercept"), F.lit(model.log_intercept)) + F.coalesce(over("log_slope"), F.lit(model.log_slope)) * clamped) * factor
        rate = F.when(over("lus").isNotNull(), F.pow(over("lus"), F.abs(v["step"])) * factor).otherwise(fitted)
        rate = rate * F.when(v["origin"] == "SLUS", F.coalesce(over("slus_factor"), F.lit(model.slus_factor))).otherwise(F.lit(1.0))
        return F.struct(v["variant"].alias("variant"), (rate * F.col("n_reads")).alias("e"))

    made = F.filter(F.transform(_products(), weighted), lambda x: x["e"] > 0)
    strong = (F.col("fraction") >= parent_fraction) & ~F.col("is_deletion") & (F.coalesce(F.col("motif"), F.lit("")) != "")
    return F.when(strong, made).otherwise(F.array().cast("array<struct<variant:string,e:double>>"))


def expected_stutter(rows: DataFrame, model: StutterModel = StutterModel(), parent_fraction: float = P.PARENT_FRACTION) -> DataFrame:
    """sample_id, marker, variant, expected: reads that slippage of all strong
    candidates would put on a sequence. Needs ``fraction`` in rows.

    A marker's overrides replace the curve (log_intercept, log_slope), a step's
    factor (step_-1, ...), the SLUS factor, or all by a flat rate (lus).
    """
    slips = rows.select(*LOCUS, F.explode(_slips(rows, model, parent_fraction)).alias("s"))
    return slips.groupBy(*LOCUS, F.col("s.variant").alias("variant")).agg(F.sum("s.e").alias("expected"))


def with_stutter(rows: DataFrame, model: StutterModel = StutterModel(), parent_fraction: float = P.PARENT_FRACTION) -> DataFrame:
    """rows with expected_stutter of their own sequence. A locus has some dozen
    products, so they are gathered over its window; nothing is dealt anew."""
    rows = rows.withColumn("_s", _slips(rows, model, parent_fraction))
    rows = rows.withColumn("_all", F.flatten(F.collect_list("_s").over(locus())))
    own = F.aggregate(F.filter("_all", lambda x: x["variant"] == F.col("consensus")), F.lit(0.0), lambda a, x: a + x["e"])
    return rows.withColumn("expected_stutter", own).drop("_s", "_all")


def status(params: Settings) -> Column:
    """Ordered: stutter comes before both thresholds, and wins a tie with its expectation."""
    return (
        F.when(F.col("total_reads") <= 0, "no_data").when(F.col("is_deletion"), "deletion")
        .when((F.col("expected_stutter") > 0) & (F.col("n_reads") <= F.col("expected_stutter")), "stutter")
        .when(F.col("fraction") < params["analytical_thresh"], "noise").when(F.col("fraction") < params["calling_thresh"], "artefact").otherwise("allele")
    )


def dominant_hp(purity: float = P.HP_PURITY, least: int = P.MIN_TAGGED) -> Column:
    """1 or 2 if the tagged reads of one phase block agree; NULL otherwise."""
    tagged = F.col("n_hp1") + F.col("n_hp2")
    return F.when((F.col("n_phase_sets") > 1) | (tagged < least), F.lit(None).cast("int")).when(F.col("n_hp1") >= purity * tagged, 1).when(F.col("n_hp2") >= purity * tagged, 2)


def suppress_phantoms(rows: DataFrame, most_bp: int = P.MAX_PHANTOM_BP) -> DataFrame:
    """Candidates within ``most_bp`` of the strongest one of their haplotype become
    hp_phantom; their reads are counted as absorbed by it. Lengths are compared
    with the owner's only, never along a chain. Triallelic markers are exempt."""
    rows = rows.withColumn("dominant_hp", dominant_hp())
    candidate = (F.col("status") == "allele") & ~F.col("is_deletion")
    several = F.count_if(candidate).over(locus()) >= 2
    open_ = candidate & F.col("dominant_hp").isNotNull() & ~F.col("allow_triallelic") & several
    rows = rows.withColumn("_open", open_)
    haplotype = Window.partitionBy(*LOCUS, "phase_set", "dominant_hp", "_open")
    strongest = haplotype.orderBy(F.desc("n_reads"), "cluster_index")
    rows = rows.withColumns({"_owner": F.first("cluster_index").over(strongest), "_owner_bp": F.first("length_bp").over(strongest)})
    phantom = F.col("_open") & (F.col("cluster_index") != F.col("_owner")) & (F.abs(F.col("length_bp") - F.col("_owner_bp")) <= most_bp)
    rows = rows.withColumn("_phantom", phantom)
    absorbed = F.sum(F.when(F.col("_phantom"), F.col("n_reads")).otherwise(0)).over(haplotype)
    return rows.withColumns({
        "n_reads_absorbed": F.when(F.col("_open") & (F.col("cluster_index") == F.col("_owner")), absorbed).otherwise(0).cast("int"),
        "status": F.when(F.col("_phantom"), "hp_phantom").otherwise(F.col("status")),
    }).drop("_open", "_owner", "_owner_bp", "_phantom")


def opposite(a: Column, b: Column) -> Column:
    """On opposite haplotypes: one phase block, both assigned, not alike."""
    return F.coalesce(a["ps"].eqNullSafe(b["ps"]) & (a["hp"] != b["hp"]), F.lit(False))


def _candidate() -> Column:
    """What a locus's call is made from, of a candidate row; NULL of others."""
    candidate = F.col("status").isin("allele", "inexact_allele") & ~F.col("is_deletion")
    return F.when(candidate, F.struct((-F.col("n_reads")).alias("r"), F.col("cluster_index").alias("i"), F.col("n_reads").alias("n"), F.col("dominant_hp").alias("hp"), F.col("phase_set").alias("ps")))


def _decided(rows: DataFrame, params: Settings) -> DataFrame:
    """From c (candidates, strongest first), tri, thr and floor: call_rule, tri_type, called, rescued."""
    a1, a2, a3 = (F.get("c", F.lit(k)) for k in range(3))
    n = F.size("c")
    third_floor = F.lit(params["min_reads_third"]) if "min_reads_third" in params.changed() else F.coalesce("floor", F.lit(params["min_reads_third"]))
    t = F.coalesce("thr", F.lit(P.TRI_BALANCED))
    r12, r23, r13 = a2["n"] / a1["n"], a3["n"] / a2["n"], a3["n"] / a1["n"]
    low = r12 < params["min_phr_for_het"]
    weak_third = (n == 2) | (r13 < params["calling_thresh"]) | (a3["n"] < third_floor)
    rule = (
        F.when(n == 0, "no_data").when(n == 1, "homozygous").when(low & ~opposite(a1, a2), "homozygous").when(weak_third, "heterozygous")
        .when(~F.col("tri"), "two_called_three_present_review").when((r12 >= t) & (r23 >= t), "triallelic_type_II").when((r12 >= t) & (r23 >= P.TRI_LOW), "triallelic_type_I")
        .otherwise("triallelic_review")
    )
    rows = rows.withColumn("call_rule", rule)
    count = F.when(F.col("call_rule") == "no_data", 0).when(F.col("call_rule") == "homozygous", 1).when(F.col("call_rule").startswith("triallelic"), 3).otherwise(2)
    rescued = (n >= 2) & low & opposite(a1, a2) & (F.col("call_rule") != "homozygous")
    return rows.withColumns({
        "tri_type": F.when(F.col("call_rule").endswith("review"), "mixture_suspected").when(F.col("call_rule") == "triallelic_type_II", "tri_II_balanced").when(F.col("call_rule") == "triallelic_type_I", "tri_I_unbalanced").otherwise(""),
        "called": F.transform(F.slice("c", F.lit(1), count), lambda x: x["i"]), "rescued": F.when(rescued, a2["i"]),
    }).drop("c", "tri", "thr", "floor")


def genotypes(rows: DataFrame, params: Settings) -> DataFrame:
    """One row for each locus: call_rule, tri_type, called (cluster indexes, strongest first), rescued."""
    loci = rows.groupBy(*LOCUS).agg(
        F.array_sort(F.collect_list(_candidate())).alias("c"), F.sum("n_reads").cast("long").alias("total_reads"), F.first("allow_triallelic").alias("tri"),
        F.first("tri_balanced_thr").alias("thr"), F.first("min_reads_third").alias("floor"), F.first("marker_ord").alias("marker_ord"),
    )
    return _decided(loci, params)


def called_alleles(rows: DataFrame, params: Settings) -> DataFrame:
    """Candidates with their locus's call and is_called, allele_index (from 1; 0 if
    not called), hp_rescued; over the locus's window, as a join would deal all anew."""
    gathered = rows.withColumns({"c": F.array_sort(F.collect_list(_candidate()).over(locus())), "tri": F.col("allow_triallelic"), "thr": F.col("tri_balanced_thr"), "floor": F.col("min_reads_third")})
    decided = _decided(gathered, params)
    at = F.array_position("called", F.col("cluster_index"))
    return decided.withColumns({
        "is_called": at > 0, "allele_index": at.cast("int"),
        "hp_rescued": F.coalesce(F.col("rescued") == F.col("cluster_index"), F.lit(False)),
    })


def best_catalog_entry(alleles: DataFrame, catalog: DataFrame, most: int = P.CATALOG_DISTANCE, window: int = P.CATALOG_LENGTH_WINDOW) -> DataFrame:
    """Each allele's nearest entry of its marker, at most ``most`` edits away; the
    first entry on a tie. The length window comes before the distance, which is bounded."""
    entries = catalog.select(F.col("marker").alias("c_marker"), "entry_ord", F.col("ce").alias("c_ce"), "suffix", "source", F.upper("sequence").alias("c_seq"), F.col("isfg").alias("c_isfg"))
    near = (F.col("marker") == F.col("c_marker")) & (F.abs(F.length("consensus") - F.length("c_seq")) <= window)
    hits = alleles.select(*LOCUS, "cluster_index", "consensus").join(sent(entries, catalog), near).withColumn("distance", F.levenshtein("consensus", "c_seq", most))
    hits = hits.where(F.col("distance").between(0, most))
    first = F.min_by(F.struct("distance", "c_ce", "suffix", "source", "c_isfg"), F.struct("distance", "entry_ord"))
    return hits.groupBy(*LOCUS, "cluster_index").agg(first.alias("hit")).select(*LOCUS, "cluster_index", "hit.*")


def annotated(alleles: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Catalog notation, and its number where there was none; iso suffix and match."""
    if catalog is None:
        return alleles.withColumns({"iso_suffix": F.lit(""), "iso_match": F.lit("none"), "iso_distance": F.lit(None).cast("int"), "iso_source": F.lit("")})
    hits = best_catalog_entry(alleles.where(~F.col("is_deletion")), catalog)
    rows = alleles.join(hits, [*LOCUS, "cluster_index"], "left").withColumns({
        "iso_suffix": F.coalesce("suffix", F.lit("")), "iso_match": F.when(F.col("distance") == 0, "exact").when(F.col("distance").isNotNull(), "approx").otherwise("none"),
        "iso_distance": F.col("distance"), "iso_source": F.coalesce("source", F.lit("")), "isfg": F.when(F.coalesce("c_isfg", F.lit("")) != "", F.col("c_isfg")).otherwise(F.col("isfg")),
        "ce": F.coalesce("ce", "c_ce"),
    })
    return numbered(rows.drop("distance", "suffix", "source", "c_isfg", "c_ce"))


def sex_calls(gate: DataFrame, panel: DataFrame, samples: DataFrame, least: int = P.SEX_MIN_READS) -> DataFrame:
    """X and Y read counts of the sex marker, and who shows which."""
    sex = sent(panel.where("marker_type = 'amel'").select(F.col("name").alias("marker"), "marker_ord"), panel)
    counts = gate.where("reason is null").join(sex.select("marker"), "marker", "left_semi").groupBy(*LOCUS).agg(
        F.count_if(F.col("window") == "own").alias("x_reads"), F.count_if(F.col("window") == "y").alias("y_reads")
    )
    rows = samples.crossJoin(sex).join(counts, list(LOCUS), "left").fillna(0, ["x_reads", "y_reads"])
    has_x, has_y = F.col("x_reads") >= least, F.col("y_reads") >= least
    return rows.select(
        *LOCUS, "marker_ord", "x_reads", "y_reads", F.when(has_x | has_y, F.col("x_reads") + F.col("y_reads")).otherwise(0).alias("total_reads"),
        F.when(has_x & has_y, "heterozygous").when(has_x | has_y, "homozygous").otherwise("no_data").alias("call_rule"),
        F.concat_ws(",", F.when(has_x, "X"), F.when(has_y, "Y")).alias("genotype"),
    )


def sex_alleles(sex: DataFrame, like: DataFrame) -> DataFrame:
    """The letters of ``sex_calls`` as called alleles with the columns of ``like``
    (from ``called_alleles``): no sequence and no number, the letter is the notation."""
    letter = lambda name, reads, k: F.when(F.array_contains(F.split("genotype", ","), name), F.struct(F.lit(name).alias("letter"), F.col(reads).alias("n"), F.lit(k).alias("k")))
    rows = sex.withColumn("called", F.filter(F.array(letter("X", "x_reads", 0), letter("Y", "y_reads", 1)), lambda a: a.isNotNull()))
    rows = rows.select("*", F.posexplode("called").alias("at", "a"))
    letters, n, none = F.col("a.letter"), F.col("a.n"), F.lit(0)
    told = {
        "sample_id": F.col("sample_id"), "marker": F.col("marker"), "marker_ord": F.col("marker_ord"), "call_rule": F.col("call_rule"), "total_reads": F.col("total_reads"),
        "cluster_index": F.col("a.k"), "allele_index": F.col("at") + 1, "is_called": F.lit(True), "called": F.transform("called", lambda x: x["k"]),
        **{c: letters for c in ("consensus", "isfg", "repeat_label", "number_label")}, "n_reads": n, "n_hp_none": n, "fraction": stats.share(n, F.col("total_reads")),
        **{c: none for c in ("n_hp1", "n_hp2", "n_forward", "n_reverse", "n_phase_sets", "n_reads_absorbed", "length_bp", "bp_diff", "mean_qual", "expected_stutter")},
        **{c: F.lit(False) for c in ("is_deletion", "hp_rescued", "number_is_absolute", "allow_triallelic")},
        **{c: F.lit("") for c in ("tri_type", "iso_suffix", "iso_source", "repeat_summary", "consensus_method", "strnaming_name")},
        "status": F.lit("allele"), "number_method": F.lit("none"), "repeat_label_source": F.lit("none"), "iso_match": F.lit("none"), "strnaming_status": F.lit("no_range"),
    }
    return rows.select(*(told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields))
