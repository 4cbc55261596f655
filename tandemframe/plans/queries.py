"""Registered queries on the driver's tables, each with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats
from ..operators import cohort as C
from ..operators import evidence as E
from ..operators import interpretation as I
from ..operators import quality as Q
from ..params import FLAGS, THRESHOLDS, Settings
from ..sources import tables
from . import engine, fixtures, run_queries

PARAMS = Settings()


def _gate(spark, d):
    r = fixtures.reads(spark, d)
    return r.withColumns({"start0": 1000 * (F.col("marker_ord") + 1), "end0": 1000 * (F.col("marker_ord") + 1) + 98}).withColumn("seq", F.col("sequence")).withColumn("reason", E.reject_reason(PARAMS))


def _obs(spark, d):
    return _gate(spark, d).where("reason is null").select("sample_id", "marker", "read_ord", "sequence", "hp", "ps", F.lit(30.0).alias("mean_qual"), "strand")


def _clusters(spark, d):
    return E.quick_clusters(_obs(spark, d), F.lit("AGAT"))


def _alleles(spark, d):
    return engine.interpret(_clusters(spark, d), fixtures.panel(spark), PARAMS)


def _loci(spark, d):
    return Q.flagged(Q.locus_summary(_alleles(spark, d)), PARAMS)


# evidence


def q_reject_funnel(spark, d):
    return E.funnel(_gate(spark, d)).select("sample_id", "marker", "reason", "n")


def q_range_join_windows(spark, d):
    spans = E.windows(fixtures.panel(spark))
    hits = E.fetched(fixtures.reads(spark, d).drop("marker", "marker_ord"), spans, n_windows=5)
    inside = (F.col("ref_start") <= F.col("start0") - 20) & (F.col("ref_end") >= F.col("end0") + 20)
    return hits.groupBy("marker").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(inside).alias("spanning"), F.count_if(inside & (F.col("mapq") >= 20)).alias("kept"))


def q_range_join_binned(spark, d):
    """The same join by genome bins, as for panels too large to broadcast."""
    spans = E.windows(fixtures.panel(spark))
    hits = E.fetched(fixtures.reads(spark, d).drop("marker", "marker_ord"), spans, n_windows=E.BROADCAST_WINDOWS + 1)
    return hits.groupBy("marker").agg(F.count(F.lit(1)).alias("fetched"))


def q_core_length_bins(spark, d):
    o = _obs(spark, d).withColumn("bin", S.repeat_core_length(F.col("sequence"), "AGAT"))
    return o.groupBy("sample_id", "marker", "bin").agg(F.count(F.lit(1)).alias("n_reads"))


def q_isfg_brackets(spark, d):
    return _obs(spark, d).select("sequence").distinct().select("sequence", S.brackets(F.col("sequence"), "AGAT").alias("isfg"))


def q_revcomp(spark, d):
    s = _obs(spark, d).select("sequence").distinct()
    return s.select("sequence", S.reverse_complement(F.col("sequence")).alias("rc"), S.repeat_core_length(S.reverse_complement(F.col("sequence")), "AGAT", "-").alias("core_bp"))


def q_ce_number(spark, d):
    s = _obs(spark, d).select("sequence").distinct()
    bp = F.length("sequence")
    return s.select("sequence", S.ce_from_length(bp, F.lit(4), F.lit(50)).alias("ce_length"), S.ce_from_brackets(S.brackets(F.col("sequence"), "AGAT")).alias("ce_brackets"), S.allele_numeric(bp, F.lit(-1), F.lit(0), F.lit(98), F.lit(4), F.lit(12.0))["value"].alias("offset_number"))


def q_repeat_summary(spark, d):
    return _obs(spark, d).select("sequence").distinct().select("sequence", S.repeat_summary(F.col("sequence"), "AGAT").alias("summary"), S.lus_units(F.col("sequence"), "AGAT").alias("lus"))


def q_mode_consensus(spark, d):
    return _clusters(spark, d).select("sample_id", "marker", "cluster_index", "consensus", "n_reads", "n_hp1", "n_hp2", "n_hp_none", "n_forward", "n_reverse", "n_phase_sets")


def _identities(c):
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.marker") == F.col("b.marker")) & (F.col("a.cluster_index") < F.col("b.cluster_index")))
    return pairs.select(F.col("a.sample_id").alias("sample_id"), F.col("a.marker").alias("marker"), F.col("a.cluster_index").alias("i"), F.col("b.cluster_index").alias("j"), F.round(S.identity(F.col("a.consensus"), F.col("b.consensus")), 6).alias("identity"))


def q_identity(spark, d):
    return _identities(_clusters(spark, d))


def q_fraction_status(spark, d):
    return I.with_fraction(I.named(_clusters(spark, d), fixtures.panel(spark))).withColumn("expected_stutter", F.lit(0.0)).select("sample_id", "marker", "cluster_index", F.round("fraction", 6).alias("fraction"), I.status(PARAMS).alias("status"))


def q_expected_stutter(spark, d):
    rows = I.with_fraction(I.named(_clusters(spark, d), fixtures.panel(spark)))
    return I.expected_stutter(rows).select("sample_id", "marker", "variant", F.round("expected", 6).alias("expected"))


def q_stutter_status(spark, d):
    rows = I.with_stutter(I.with_fraction(I.named(_clusters(spark, d), fixtures.panel(spark)))).withColumn("status", I.status(PARAMS))
    return rows.select("sample_id", "marker", "cluster_index", F.round("expected_stutter", 6).alias("expected"), "status")


def q_dominant_hp(spark, d):
    return _clusters(spark, d).select("sample_id", "marker", "cluster_index", I.dominant_hp().alias("hp"))


def q_phantom_suppress(spark, d):
    return _alleles(spark, d).select("sample_id", "marker", "cluster_index", "status", "n_reads_absorbed")


def q_call_profile(spark, d):
    rows = _loci(spark, d)
    return rows.select("sample_id", "marker", "call_rule", "tri_type", "total_reads", "called_reads", F.array_join(F.transform("alleles_called", lambda a: a["cluster_index"].cast("string")), ",").alias("called"))


def q_genotype_profile(spark, d):
    """The flagship: a genotype, balance and flags for each sample and marker."""
    rows = _loci(spark, d)
    return rows.select("sample_id", "marker", C.genotype(F.col("alleles_called")).alias("genotype"), "call_rule", "total_reads", "called_reads", F.round("allele_balance", 3).alias("allele_balance"), F.array_join(F.array_sort(F.transform("flags", lambda f: f["short"])), ",").alias("flags"))


def q_allele_number(spark, d):
    return _alleles(spark, d).select("sample_id", "marker", "cluster_index", "number", "number_method", "number_label", "number_is_absolute", "bp_diff")


def q_strand_bias(spark, d):
    n = F.col("n_forward") + F.col("n_reverse")
    return _clusters(spark, d).select("sample_id", "marker", "cluster_index", F.round(stats.two_sided_binomial_p(F.col("n_forward"), n) + 1e-9, 6).alias("p"))


def q_strand_table(spark, d):
    return C.strand_table(_clusters(spark, d))


def q_flag_census(spark, d):
    return Q.flag_census(_loci(spark, d))


def q_flag_rows(spark, d):
    return Q.flag_rows(_loci(spark, d)).select("sample_id", "marker", "code", "severity")


def q_catalog_best_hit(spark, d):
    """Candidates against a catalog of pure AGAT cores with and without the variant unit."""
    unit = F.col("id").cast("int") + 7
    plain = F.repeat(F.lit("AGAT"), unit)
    iso = F.concat(F.repeat(F.lit("AGAT"), F.lit(3)), F.lit("AGCT"), F.repeat(F.lit("AGAT"), unit - 4))
    flank = lambda x: F.concat(F.repeat(F.lit("C"), F.lit(25)), x, F.repeat(F.lit("G"), F.lit(25)))
    base = spark.range(6, numPartitions=1)
    entries = base.select((F.col("id") * 2).alias("entry_ord"), unit.cast("double").alias("ce"), F.lit("").alias("suffix"), flank(plain).alias("sequence")).unionByName(base.select((F.col("id") * 2 + 1).alias("entry_ord"), unit.cast("double").alias("ce"), F.lit("a").alias("suffix"), flank(iso).alias("sequence")))
    catalog = entries.crossJoin(spark.range(5, numPartitions=1).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("marker"))).withColumns({"source": F.lit("made"), "isfg": F.lit("")})
    hits = I.best_catalog_entry(_clusters(spark, d), catalog)
    return hits.select("sample_id", "marker", "cluster_index", "distance", "c_ce", "suffix")


def q_sex_typing(spark, d):
    """Reads of M0 count as X, of M1 as Y: present from three reads on."""
    sides = F.when(F.col("marker") == "M0", "own").when((F.col("marker") == "M1") & (F.col("n_units") > 11), "y")
    gate = _gate(spark, d).withColumn("window", sides).where("window is not null or reason is not null").withColumn("marker", F.lit("AMEL"))
    windows = fixtures.panel(spark).where("marker_ord = 0").withColumns({"name": F.lit("AMEL"), "marker_type": F.lit("amel")})
    samples = _gate(spark, d).where("reason is null").select("sample_id").distinct()
    return I.sex_calls(gate, windows, samples).select("sample_id", "x_reads", "y_reads", "call_rule")


# cohort


def q_tidy(spark, d):
    return C.tidy(_loci(spark, d)).select("sample", "marker", "allele_index", "called", "allele_label", "number_method", "reads", "reads_hp1", "reads_hp2", "call_rule", "locus_reads", "n_alleles_called")


def q_batch_summary_pivot(spark, d):
    return C.batch_summary(_loci(spark, d), [f"M{k}" for k in range(5)])


def q_unpivot(spark, d):
    markers = [f"M{k}" for k in range(5)]
    return C.called_long(C.batch_summary(_loci(spark, d), markers), markers).select("sample_id", "marker", F.array_join("called", "/").alias("called"))


def q_cohort_margins(spark, d):
    return C.margins(_loci(spark, d)).withColumn("call_rate", F.round("call_rate", 6))


def q_worst5(spark, d):
    return C.worst(C.margins(_loci(spark, d)), "sample").select("key", F.round("call_rate", 6).alias("call_rate"), "n_flagged")


def q_seq_rows(spark, d):
    return C.sequence_rows(_alleles(spark, d)).select("sample_id", "marker", "repeat_group", "cluster_index", "n_reads", "canonical", "stack_index", "iso_ordinal")


def _truth(spark, d):
    s, m = F.col("s_suppkey"), F.col("id").cast("int")
    a1 = 8 + (s * 7 + m * 3) % 6
    a2 = F.when(s % 10 == 3, a1 + 4).otherwise(a1 + (s + m) % 4)
    sup = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").where("s_suppkey % 9 <> 8")
    return sup.crossJoin(F.broadcast(spark.range(5, numPartitions=1))).select(
        F.concat(F.lit("s"), F.lpad(s.cast("string"), 7, "0")).alias("sample_id"), F.concat(F.lit("M"), m.cast("string")).alias("marker"), F.lit("ILLUMINA").alias("technology"),
        F.greatest(a1, a2).cast("string").alias("allele1"), F.when(a1 != a2, F.concat(F.least(a1, a2).cast("string"), F.lit(".0"))).otherwise("NA").alias("allele2"), F.lit(30.0).alias("coverage"),
    )


def _compared(spark, d):
    return C.compare(C.called_genotypes(_loci(spark, d)), _truth(spark, d))


def q_concordance(spark, d):
    return _compared(spark, d).select("sample_id", "marker", F.array_join("truth", "/").alias("truth"), F.array_join("called", "/").alias("called"), "verdict")


def q_concordance_rollup(spark, d):
    return C.concordance(_compared(spark, d)).withColumn("concordance", F.round("concordance", 6))


def q_unscored(spark, d):
    return C.unscored(_loci(spark, d).select("sample_id"), _truth(spark, d))


def q_stutter_observations(spark, d):
    return C.stutter_observations(_alleles(spark, d)).select("sample_id", "marker", "cluster_index", "step", "lus", "parent_reads", "stutter_reads")


def q_stutter_summary(spark, d):
    return C.stutter_summary(C.stutter_observations(_alleles(spark, d)))


def q_stutter_fit(spark, d):
    f = C.stutter_fit(C.stutter_observations(_alleles(spark, d)))
    return f.select("bins", "lus_min", "lus_max", F.round("log_intercept", 3).alias("log_intercept"), F.round("log_slope", 3).alias("log_slope"), "f_minus1", F.round("f_plus1", 2).alias("f_plus1"), "n_observations", "n_loci")


def q_forward_fill(spark, d):
    """A merged header's labels carried to the cells right of them: nations by region."""
    from pyspark.sql import Window

    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    lead = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) == 1
    sparse = n.withColumn("label", F.when(lead, F.col("n_name")).otherwise(""))
    return sparse.select("n_nationkey", tables.carried("label", Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("header"))


def q_canonical_genotype(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    a, b = F.format_string("%.1f", F.col("p_size").cast("double")), F.when(F.col("p_partkey") % 7 == 0, "ND").when(F.col("p_partkey") % 5 == 0, "X").otherwise((F.col("p_partkey") % 13).cast("string"))
    return p.select("p_partkey", F.array_join(C.canonical_genotype(F.array(a, b)), "/").alias("genotype"))


def q_parameters(spark, d):
    return PARAMS.table(spark).select("name", "value", "provenance", "is_default")


# beyond SQL: clusters by identity and alignment


def q_cluster_full(spark, d):
    return E.full_clusters(_obs(spark, d).withColumn("read_id", F.col("read_ord").cast("string")), fixtures.panel(spark), PARAMS).select("sample_id", "marker", "cluster_index", "consensus", "consensus_method", "n_reads", "n_hp1", "n_hp2", "n_phase_sets")


def q_infix_range(spark, d):
    from ..functions.scan import reporting_range

    c = _clusters(spark, d).select("sample_id", "marker", "cluster_index", "consensus")
    found = reporting_range()("consensus", F.lit("C" * 20), F.lit("G" * 20))
    return c.withColumn("_r", found).select("sample_id", "marker", "cluster_index", F.col("_r.range_seq").alias("range_seq"), F.col("_r.range_status").alias("range_status"))


def _units(c):
    return I.virtual_stutters(c.withColumn("motif", F.lit("AGAT"))).select("sample_id", "marker", "variant", "step", "origin", "run_copies")


def q_alleles_by_units(spark, d):
    return _units(_clusters(spark, d))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")} | run_queries.QUERIES

_R = "WITH " + fixtures.READS_SQL
_CLUSTERS = _R + """,
sq AS (SELECT sample_id, marker, marker_ord, bin, sequence, count(*) AS n, min(read_ord) AS fo FROM obs GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, marker, bin ORDER BY n DESC, fo) AS k FROM sq) WHERE k = 1),
bins AS (SELECT sample_id, marker, marker_ord, bin, count(*) AS n_reads, min(read_ord) AS fo, count(*) FILTER (hp = 1) AS n_hp1, count(*) FILTER (hp = 2) AS n_hp2, count(*) FILTER (hp IS NULL) AS n_hp_none,
  count(*) FILTER (strand = '+') AS n_forward, count(*) FILTER (strand = '-') AS n_reverse, count(DISTINCT ps) FILTER (hp IS NOT NULL) AS n_phase_sets, min(ps) FILTER (hp IS NOT NULL) AS ps1 FROM obs GROUP BY ALL),
clusters AS (SELECT b.*, t.sequence AS consensus, CAST(row_number() OVER (PARTITION BY b.sample_id, b.marker ORDER BY n_reads DESC, b.fo) - 1 AS INT) AS cluster_index,
  sum(n_reads) OVER (PARTITION BY b.sample_id, b.marker) AS total FROM bins b JOIN top t USING (sample_id, marker, bin)),
runs AS (SELECT c.*, list_transform(regexp_extract_all(consensus, '(AGAT)+', 0), lambda x: CAST(length(x) // 4 AS INT)) AS r FROM clusters c),
segs AS (SELECT *, string_split_regex(consensus, '(AGAT)+') AS g, CASE WHEN len(r) > 1 AND r[2] > r[1] THEN 2 ELSE 1 END AS li FROM runs),
var AS (SELECT s.*, o.origin, d.step, CASE WHEN o.origin = 'LUS' THEN li ELSE 3 - li END AS ri FROM segs s, (VALUES ('LUS'), ('SLUS')) o(origin), (VALUES (-1), (-2), (1)) d(step)
  WHERE o.origin = 'LUS' OR len(r) > 1),
vs AS (SELECT *, r[ri] AS run_copies, CASE WHEN len(r) = 1 THEN concat(g[1], repeat('AGAT', r[1] + step), g[2])
  WHEN ri = 1 THEN concat(g[1], repeat('AGAT', r[1] + step), g[2], repeat('AGAT', r[2]), g[3]) ELSE concat(g[1], repeat('AGAT', r[1]), g[2], repeat('AGAT', r[2] + step), g[3]) END AS variant
  FROM var WHERE r[ri] >= 2 AND r[ri] + step >= 1),
ex AS (SELECT sample_id, marker, variant, sum(n_reads * exp(-12.1125 + 0.7159 * least(greatest(run_copies, 10), 14)) * CASE step WHEN -1 THEN 1.0 WHEN -2 THEN 0.242 ELSE 0.726 END) AS expected
  FROM vs WHERE n_reads / total >= 0.20 GROUP BY ALL),
st AS (SELECT c.*, coalesce(e.expected, 0.0) AS expected, n_reads / total AS fraction,
  CASE WHEN coalesce(e.expected, 0) > 0 AND n_reads <= e.expected THEN 'stutter' WHEN n_reads / total < 0.02 THEN 'noise' WHEN n_reads / total < 0.10 THEN 'artefact' ELSE 'allele' END AS status0,
  CASE WHEN n_phase_sets > 1 OR n_hp1 + n_hp2 < 3 THEN NULL WHEN n_hp1 >= 0.8 * (n_hp1 + n_hp2) THEN 1 WHEN n_hp2 >= 0.8 * (n_hp1 + n_hp2) THEN 2 END AS hp,
  CASE WHEN n_phase_sets = 1 THEN ps1 END AS phase_set
  FROM clusters c LEFT JOIN ex e ON e.sample_id = c.sample_id AND e.marker = c.marker AND e.variant = c.consensus),
ph0 AS (SELECT *, (status0 = 'allele' AND hp IS NOT NULL AND marker <> 'M3' AND count(*) FILTER (status0 = 'allele') OVER (PARTITION BY sample_id, marker) >= 2) AS op FROM st),
ph1 AS (SELECT *, first_value(cluster_index) OVER w AS owner, first_value(length(consensus)) OVER w AS owner_bp FROM ph0 WINDOW w AS (PARTITION BY sample_id, marker, phase_set, hp, op ORDER BY n_reads DESC, cluster_index)),
ph2 AS (SELECT *, (op AND cluster_index <> owner AND abs(length(consensus) - owner_bp) <= 2) AS phantom FROM ph1),
ph AS (SELECT *, CASE WHEN phantom THEN 'hp_phantom' ELSE status0 END AS status,
  CASE WHEN op AND cluster_index = owner THEN coalesce(sum(n_reads) FILTER (phantom) OVER (PARTITION BY sample_id, marker, phase_set, hp, op), 0) ELSE 0 END AS absorbed FROM ph2),
nm AS (SELECT *, length(consensus) AS bp, CASE WHEN marker = 'M4' THEN round(12 + (length(consensus) - 98) / 4.0, 2) ELSE floor((length(consensus) - 50) / 4.0) + ((length(consensus) - 50) % 4) / 10.0 END AS number FROM ph),
lab AS (SELECT *, CASE WHEN marker = 'M4' THEN 'reference_offset' ELSE 'period_ce' END AS method, regexp_replace(regexp_replace(printf('%.4f', CAST(number AS DOUBLE)), '0+$', ''), '\\.$', '') AS label,
  CASE WHEN status = 'allele' THEN row_number() OVER (PARTITION BY sample_id, marker ORDER BY CASE WHEN status = 'allele' THEN 0 ELSE 1 END, n_reads DESC, cluster_index) END AS k FROM nm),
c3 AS (SELECT sample_id, marker, marker_ord, CAST(max(total) AS BIGINT) AS total, count(*) FILTER (k IS NOT NULL) AS n,
  max(n_reads) FILTER (k = 1) AS r1, max(n_reads) FILTER (k = 2) AS r2, max(n_reads) FILTER (k = 3) AS r3, max(hp) FILTER (k = 1) AS h1, max(hp) FILTER (k = 2) AS h2, max(phase_set) FILTER (k = 1) AS p1, max(phase_set) FILTER (k = 2) AS p2 FROM lab GROUP BY ALL),
opp AS (SELECT *, coalesce((p1 IS NOT DISTINCT FROM p2) AND h1 <> h2, false) AS opposite FROM c3),
calls AS (SELECT *, CASE WHEN n = 0 THEN 'no_data' WHEN n = 1 THEN 'homozygous' WHEN r2 / r1 < 0.4 AND NOT opposite THEN 'homozygous' WHEN n = 2 OR r3 / r1 < 0.10 OR r3 < 5 THEN 'heterozygous'
  WHEN marker <> 'M3' THEN 'two_called_three_present_review' WHEN r2 / r1 >= 0.6 AND r3 / r2 >= 0.6 THEN 'triallelic_type_II' WHEN r2 / r1 >= 0.6 AND r3 / r2 >= 0.3 THEN 'triallelic_type_I' ELSE 'triallelic_review' END AS call_rule FROM opp),
called AS (SELECT l.*, c.call_rule, c.total AS locus_total, (l.k = 2 AND c.r2 / c.r1 < 0.4 AND c.opposite AND c.call_rule <> 'homozygous') AS rescued,
  coalesce(l.k <= CASE WHEN c.call_rule = 'no_data' THEN 0 WHEN c.call_rule = 'homozygous' THEN 1 WHEN c.call_rule LIKE 'triallelic%' THEN 3 ELSE 2 END, false) AS is_called FROM lab l JOIN calls c USING (sample_id, marker)),
fac AS (SELECT * FROM range(0, 1000) t(i)),
pv AS (SELECT sample_id, marker, cluster_index, least(1.0, 2 * sum(exp(lgamma(n_forward + n_reverse + 1) - lgamma(i + 1) - lgamma(n_forward + n_reverse - i + 1) - (n_forward + n_reverse) * ln(2)))) AS p
  FROM clusters JOIN fac ON i <= least(n_forward, n_reverse) GROUP BY ALL),
locus AS (SELECT c.sample_id, c.marker, c.marker_ord, any_value(c.call_rule) AS call_rule, any_value(CAST(c.locus_total AS BIGINT)) AS total_reads, CAST(coalesce(sum(n_reads) FILTER (is_called), 0) AS BIGINT) AS called_reads,
  coalesce(string_agg(label, ' / ' ORDER BY k) FILTER (is_called), '–') AS genotype, coalesce(string_agg(label, ',' ORDER BY k) FILTER (is_called), '?') AS cell, coalesce(string_agg(CAST(cluster_index AS VARCHAR), ',' ORDER BY k) FILTER (is_called), '') AS called,
  count(*) FILTER (is_called) AS n_called, max(n_reads) FILTER (is_called) AS mx, sum(n_reads) FILTER (is_called) AS sm, bool_or(rescued AND is_called) AS resc, bool_or(status = 'hp_phantom') AS phan, bool_or(n_phase_sets > 1) AS split,
  bool_or(is_called AND n_reads > 1) AS moded, count(DISTINCT CASE WHEN is_called THEN label END) < count(DISTINCT CASE WHEN is_called THEN concat(label, consensus) END) AS iso,
  bool_or(is_called AND n_forward + n_reverse >= 10 AND p < 0.01) AS biased FROM called c JOIN pv USING (sample_id, marker, cluster_index) GROUP BY ALL),
ab AS (SELECT *, CASE WHEN n_called = 2 THEN round_even(mx / sm, 3) END AS balance FROM locus),
flagset AS (SELECT *, list_filter([CASE WHEN call_rule LIKE '%review' THEN 'mixture_suspected' END, CASE WHEN call_rule LIKE 'triallelic_type%' THEN 'triallelic' END, CASE WHEN iso THEN 'isoallele' END, CASE WHEN phan THEN 'hp_phantom_collapsed' END,
  CASE WHEN split THEN 'phase_block_split' END, CASE WHEN resc THEN 'hp_rescued_het' END, CASE WHEN moded THEN 'consensus_fallback' END, CASE WHEN call_rule = 'no_data' THEN 'dropout' END, CASE WHEN call_rule <> 'no_data' AND called_reads < 20 THEN 'low_coverage' END,
  CASE WHEN biased THEN 'strand_bias' END, CASE WHEN balance > 0.65 AND NOT resc THEN 'allele_imbalance' END, CASE WHEN marker = 'M4' AND n_called > 0 THEN 'ce_nomenclature_offset' END], lambda x: x IS NOT NULL) AS flags FROM ab)
"""
_CODES = ", ".join(f"('{c}', '{s}', '{a}')" for c, (s, a) in FLAGS.items())
_COHORT = _CLUSTERS + f", codes AS (SELECT * FROM (VALUES {_CODES}) t(code, severity, short))"
_TRUTH = _COHORT + """,
truth AS (SELECT concat('S', lpad(CAST(s_suppkey AS VARCHAR), 7, '0')) AS sample_id, concat('M', CAST(m AS VARCHAR)) AS marker, 8 + (s_suppkey*7 + m*3) % 6 AS a1,
  CASE WHEN s_suppkey % 10 = 3 THEN 8 + (s_suppkey*7 + m*3) % 6 + 4 ELSE 8 + (s_suppkey*7 + m*3) % 6 + (s_suppkey + m) % 4 END AS a2 FROM supplier, range(0, 5) t(m) WHERE s_suppkey % 9 <> 8),
tg AS (SELECT sample_id, marker, concat(CAST(a1 AS VARCHAR), '/', CAST(a2 AS VARCHAR)) AS truth FROM truth),
cg AS (SELECT sample_id, marker, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN concat(one, '/', one) ELSE gt END AS called FROM (
  SELECT sample_id, marker, count(*) FILTER (is_called) AS n, min(label) FILTER (is_called) AS one,
  string_agg(regexp_replace(printf('%.1f', CAST(number AS DOUBLE)), '\\.0$', ''), '/' ORDER BY number) FILTER (is_called) AS gt FROM called GROUP BY ALL)),
cmp AS (SELECT t.sample_id, t.marker, t.truth, c.called, CASE WHEN coalesce(c.called, '') = '' THEN 'no_call' WHEN c.called = t.truth THEN 'match' ELSE 'mismatch' END AS verdict
  FROM tg t LEFT JOIN cg c USING (sample_id, marker) WHERE t.sample_id IN (SELECT sample_id FROM cg))
"""
_OBS = _CLUSTERS + """,
pa AS (SELECT *, length(consensus) - 50 AS core, list_max(r) AS lus FROM (SELECT c.*, r.r FROM called c JOIN runs r USING (sample_id, marker, cluster_index)) WHERE is_called),
pg AS (SELECT *, min(gap) OVER (PARTITION BY sample_id, marker) AS closest FROM (SELECT *, core - lag(core) OVER (PARTITION BY sample_id, marker ORDER BY core, cluster_index) AS gap FROM pa)),
so AS (SELECT p.sample_id, p.marker, p.cluster_index, d.step, p.lus, p.n_reads AS parent_reads, coalesce(c.n_reads, 0) AS stutter_reads FROM pg p, (VALUES (-1), (-2), (1)) d(step)
  LEFT JOIN clusters c ON c.sample_id = p.sample_id AND c.marker = p.marker AND length(c.consensus) - 50 = p.core + d.step * 4 WHERE (closest IS NULL OR closest >= 12) AND p.n_reads >= 8)
"""

ORACLE = {
    "q_reject_funnel": _R + """SELECT l.sample_id, l.marker, r.reason, count(g.read_ord) AS n FROM (SELECT DISTINCT sample_id, marker FROM gate) l
      CROSS JOIN (VALUES ('kept'), ('not_primary'), ('low_mapq'), ('no_alignment_end'), ('left_flank_short'), ('right_flank_short'), ('no_sequence'), ('window_unlocatable')) r(reason)
      LEFT JOIN gate g ON g.sample_id = l.sample_id AND g.marker = l.marker AND coalesce(g.reason, 'kept') = r.reason GROUP BY ALL""",
    "q_range_join_windows": _R + """SELECT concat('M', CAST(k AS VARCHAR)) AS marker, count(*) AS fetched, count(*) FILTER (sp) AS spanning, count(*) FILTER (sp AND mapq >= 20) AS kept FROM (
      SELECT k, mapq, ref_start <= 1000*(k+1) - 20 AND ref_end >= 1000*(k+1) + 118 AS sp FROM reads, range(0, 5) t(k) WHERE chrom = concat('chr', CAST(k+1 AS VARCHAR)) AND ref_start < 1000*(k+1) + 298 AND ref_end > 1000*(k+1) - 200) GROUP BY k""",
    "q_range_join_binned": _R + "SELECT marker, count(*) AS fetched FROM reads GROUP BY marker",
    "q_core_length_bins": _R + "SELECT sample_id, marker, CAST(bin AS INT) AS bin, count(*) AS n_reads FROM obs GROUP BY ALL",
    "q_isfg_brackets": _R + """SELECT sequence, array_to_string(list_transform(list_filter(string_split(regexp_replace(sequence, '((AGAT)+)', ' \\1 ', 'g'), ' '), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_full_match(x, '(AGAT)+') THEN CASE WHEN length(x) = 4 THEN x ELSE concat('[AGAT]', CAST(length(x) // 4 AS VARCHAR)) END ELSE lower(x) END), ' ') AS isfg FROM (SELECT DISTINCT sequence FROM obs)""",
    "q_revcomp": _R + "SELECT sequence, reverse(translate(sequence, 'ACGTN', 'TGCAN')) AS rc, CAST(bin AS INT) AS core_bp FROM (SELECT DISTINCT sequence, bin FROM obs)",
    "q_ce_number": _R + """SELECT sequence, floor((length(sequence) - 50) / 4.0) + ((length(sequence) - 50) % 4) / 10.0 AS ce_length,
      CAST(list_sum(list_transform(regexp_extract_all(sequence, '(AGAT)+', 0), lambda x: length(x) // 4)) AS DOUBLE) AS ce_brackets, CAST(round(12 + (length(sequence) - 98) / 4.0, 2) AS DOUBLE) AS offset_number FROM (SELECT DISTINCT sequence FROM obs)""",
    "q_repeat_summary": _R + """SELECT sequence, concat(array_to_string(list_transform(regexp_extract_all(sequence, '(AGAT)+', 0), lambda x: concat('AGATx', CAST(length(x) // 4 AS VARCHAR))), ' + '), ' (TR ', CAST(length(sequence) AS VARCHAR), ' bp)') AS summary,
      CAST(list_max(list_transform(regexp_extract_all(sequence, '(AGAT)+', 0), lambda x: length(x) // 4)) AS INT) AS lus FROM (SELECT DISTINCT sequence FROM obs)""",
    "q_mode_consensus": _CLUSTERS + "SELECT sample_id, marker, cluster_index, consensus, CAST(n_reads AS INT) AS n_reads, CAST(n_hp1 AS INT) AS n_hp1, CAST(n_hp2 AS INT) AS n_hp2, CAST(n_hp_none AS INT) AS n_hp_none, CAST(n_forward AS INT) AS n_forward, CAST(n_reverse AS INT) AS n_reverse, CAST(n_phase_sets AS INT) AS n_phase_sets FROM clusters",
    "q_identity": _CLUSTERS + "SELECT a.sample_id, a.marker, a.cluster_index AS i, b.cluster_index AS j, round(1 - levenshtein(a.consensus, b.consensus) / greatest(length(a.consensus), length(b.consensus)), 6) AS identity FROM clusters a JOIN clusters b ON a.sample_id = b.sample_id AND a.marker = b.marker AND a.cluster_index < b.cluster_index",
    "q_fraction_status": _CLUSTERS + "SELECT sample_id, marker, cluster_index, round(n_reads / total, 6) AS fraction, CASE WHEN n_reads / total < 0.02 THEN 'noise' WHEN n_reads / total < 0.10 THEN 'artefact' ELSE 'allele' END AS status FROM clusters",
    "q_expected_stutter": _CLUSTERS + "SELECT sample_id, marker, variant, round(expected, 6) AS expected FROM ex",
    "q_stutter_status": _CLUSTERS + "SELECT sample_id, marker, cluster_index, round(expected, 6) AS expected, status0 AS status FROM st",
    "q_dominant_hp": _CLUSTERS + "SELECT sample_id, marker, cluster_index, hp FROM st",
    "q_phantom_suppress": _CLUSTERS + "SELECT sample_id, marker, cluster_index, status, CAST(absorbed AS INT) AS n_reads_absorbed FROM ph",
    "q_call_profile": _CLUSTERS + "SELECT sample_id, marker, call_rule, CASE WHEN call_rule LIKE '%review' THEN 'mixture_suspected' WHEN call_rule = 'triallelic_type_II' THEN 'tri_II_balanced' WHEN call_rule = 'triallelic_type_I' THEN 'tri_I_unbalanced' ELSE '' END AS tri_type, total_reads, called_reads, called FROM locus",
    "q_genotype_profile": _COHORT + "SELECT sample_id, marker, genotype, call_rule, total_reads, called_reads, balance AS allele_balance, array_to_string(list_sort(list_transform(flags, lambda f: CASE f " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, (_, a) in FLAGS.items()) + " END)), ',') AS flags FROM flagset",
    "q_allele_number": _CLUSTERS + "SELECT sample_id, marker, cluster_index, CAST(number AS DOUBLE) AS number, method AS number_method, label AS number_label, true AS number_is_absolute, CAST(bp - 98 AS INT) AS bp_diff FROM lab",
    "q_strand_bias": _CLUSTERS + "SELECT sample_id, marker, cluster_index, round(p + 1e-9, 6) AS p FROM pv",
    "q_strand_table": _CLUSTERS + "SELECT sample_id, marker, cluster_index, CAST(n_forward AS INT) AS n_forward, CAST(n_reverse AS INT) AS n_reverse, round(100 * (n_forward / (n_forward + n_reverse)), 2) AS allele_forward_pct, round(100 * (sum(n_forward) OVER w / sum(n_forward + n_reverse) OVER w), 2) AS locus_forward_pct FROM clusters WINDOW w AS (PARTITION BY sample_id, marker)",
    "q_flag_census": _COHORT + "SELECT c.code, c.severity, count(f.code) AS n FROM codes c LEFT JOIN (SELECT unnest(flags) AS code FROM flagset) f USING (code) GROUP BY ALL",
    "q_flag_rows": _COHORT + "SELECT f.sample_id, f.marker, f.code, c.severity FROM (SELECT sample_id, marker, unnest(flags) AS code FROM flagset) f JOIN codes c USING (code)",
    "q_catalog_best_hit": _CLUSTERS + """, cat AS (SELECT 2*i AS o, i + 7.0 AS ce, '' AS suffix, concat(repeat('C',25), repeat('AGAT', CAST(i+7 AS INT)), repeat('G',25)) AS s FROM range(0,6) t(i)
      UNION ALL SELECT 2*i+1, i + 7.0, 'a', concat(repeat('C',25), repeat('AGAT',3), 'AGCT', repeat('AGAT', CAST(i+3 AS INT)), repeat('G',25)) FROM range(0,6) t(i))
      SELECT sample_id, marker, cluster_index, CAST(distance AS INT) AS distance, CAST(ce AS DOUBLE) AS c_ce, suffix FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, marker, cluster_index ORDER BY distance, o) AS k FROM (
      SELECT c.*, cat.*, levenshtein(consensus, s) AS distance FROM clusters c JOIN cat ON abs(length(consensus) - length(s)) <= 6) WHERE distance <= 2) WHERE k = 1""",
    "q_sex_typing": _R + """SELECT sample_id, x_reads, y_reads, CASE WHEN x_reads >= 3 AND y_reads >= 3 THEN 'heterozygous' WHEN x_reads >= 3 OR y_reads >= 3 THEN 'homozygous' ELSE 'no_data' END AS call_rule FROM (
      SELECT sample_id, count(*) FILTER (marker = 'M0') AS x_reads, count(*) FILTER (marker = 'M1' AND n_units > 11) AS y_reads FROM obs GROUP BY sample_id)""",
    "q_tidy": _CLUSTERS + """SELECT l.sample_id AS sample, l.marker, coalesce(CAST(c.k AS INT), 0) AS allele_index, c.k IS NOT NULL AS called, c.label AS allele_label, c.method AS number_method, CAST(c.n_reads AS INT) AS reads, CAST(c.n_hp1 AS INT) AS reads_hp1, CAST(c.n_hp2 AS INT) AS reads_hp2,
      l.call_rule, CAST(l.total_reads AS INT) AS locus_reads, CAST(l.n_called AS INT) AS n_alleles_called FROM locus l LEFT JOIN (SELECT * FROM called WHERE is_called) c USING (sample_id, marker)""",
    "q_batch_summary_pivot": _CLUSTERS + "SELECT sample_id, " + ", ".join(f"max(cell) FILTER (marker = 'M{k}') AS M{k}" for k in range(5)) + " FROM locus GROUP BY sample_id",
    "q_unpivot": _TRUTH + "SELECT sample_id, marker, called FROM cg",
    "q_cohort_margins": _COHORT + "SELECT level, key, n, n_called, n_flagged, round(n_called / n, 6) AS call_rate FROM (SELECT CASE WHEN grouping(sample_id) = 1 AND grouping(marker) = 1 THEN 'all' WHEN grouping(marker) = 0 THEN 'marker' ELSE 'sample' END AS level, coalesce(marker, sample_id) AS key, count(*) AS n, count(*) FILTER (n_called > 0) AS n_called, count(*) FILTER (len(flags) > 0) AS n_flagged FROM flagset GROUP BY GROUPING SETS ((marker), (sample_id), ()))",
    "q_worst5": _COHORT + "SELECT key, call_rate, n_flagged FROM (SELECT sample_id AS key, round(count(*) FILTER (n_called > 0) / count(*), 6) AS call_rate, count(*) FILTER (len(flags) > 0) AS n_flagged FROM flagset GROUP BY sample_id ORDER BY call_rate, n_flagged DESC, key LIMIT 5) WHERE call_rate < 1 OR n_flagged > 0",
    "q_seq_rows": _CLUSTERS + """, g AS (SELECT sample_id, marker, CAST(floor(number) AS INT) AS repeat_group, consensus, n_reads, cluster_index FROM lab),
      w AS (SELECT *, row_number() OVER (PARTITION BY sample_id, marker, repeat_group ORDER BY n_reads DESC, cluster_index) = 1 AS canonical, row_number() OVER (PARTITION BY sample_id, marker, repeat_group ORDER BY n_reads, cluster_index) - 1 AS stack_index FROM g)
      SELECT sample_id, marker, repeat_group, cluster_index, CAST(n_reads AS INT) AS n_reads, canonical, CAST(stack_index AS INT) AS stack_index, CASE WHEN canonical THEN 0 ELSE CAST(count(*) FILTER (NOT canonical) OVER (PARTITION BY sample_id, marker, repeat_group ORDER BY stack_index) AS INT) END AS iso_ordinal FROM w""",
    "q_concordance": _TRUTH + "SELECT sample_id, marker, truth, called, verdict FROM cmp",
    "q_concordance_rollup": _TRUTH + "SELECT marker, count(*) FILTER (verdict = 'match') AS \"match\", count(*) FILTER (verdict = 'mismatch') AS mismatch, count(*) FILTER (verdict = 'no_call') AS no_call, count(*) FILTER (verdict = 'no_truth') AS no_truth, round(count(*) FILTER (verdict = 'match') / nullif(count(*) FILTER (verdict IN ('match', 'mismatch')), 0), 6) AS concordance FROM cmp GROUP BY ROLLUP (marker)",
    "q_unscored": _TRUTH + "SELECT DISTINCT sample_id FROM locus WHERE sample_id NOT IN (SELECT sample_id FROM tg)",
    "q_stutter_observations": _OBS + "SELECT sample_id, marker, cluster_index, step, lus, CAST(parent_reads AS BIGINT) AS parent_reads, CAST(stutter_reads AS BIGINT) AS stutter_reads FROM so",
    "q_stutter_summary": _OBS + "SELECT CASE WHEN grouping(step) = 0 THEN 'step' WHEN grouping(lus) = 0 THEN 'lus' ELSE 'marker' END AS level, coalesce(marker, CAST(lus AS VARCHAR), CAST(step AS VARCHAR)) AS key, count(*) AS n, round(sum(stutter_reads) / sum(parent_reads), 4) AS ratio, count(*) FILTER (stutter_reads = 0) AS n_zero FROM so GROUP BY GROUPING SETS ((step), (lus), (marker))",
    "q_stutter_fit": _OBS + """, b AS (SELECT lus, count(*) AS n, CAST(sum(parent_reads) AS DOUBLE) AS w, sum(stutter_reads) / sum(parent_reads) AS ratio FROM so WHERE step = -1 GROUP BY lus), p AS (SELECT *, ln(ratio) AS y FROM b WHERE n >= 7 AND ratio > 0),
      m AS (SELECT sum(w*lus)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM p), f AS (SELECT count(*) AS bins, min(lus) AS lus_min, max(lus) AS lus_max, sum(w*(lus-mx)*(y-my))/nullif(sum(w*(lus-mx)*(lus-mx)), 0) AS slope, any_value(mx) AS mx, any_value(my) AS my FROM p, m),
      r AS (SELECT sum(stutter_reads) FILTER (step = -1) / sum(parent_reads) FILTER (step = -1) AS r1, sum(stutter_reads) FILTER (step = 1) / sum(parent_reads) FILTER (step = 1) AS r2, count(*) FILTER (step = -1) AS n, count(DISTINCT concat(sample_id, marker)) FILTER (step = -1) AS nl FROM so)
      SELECT bins, lus_min, lus_max, round(round(my - slope*mx, 4), 3) AS log_intercept, round(round(slope, 4), 3) AS log_slope, CAST(1.0 AS DOUBLE) AS f_minus1, round(round(r2 / r1, 3), 2) AS f_plus1, n AS n_observations, nl AS n_loci FROM f, r""",
    "q_forward_fill": "SELECT n_nationkey, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS header FROM nation",
    "q_canonical_genotype": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat(p_size, '/', p_size) WHEN p_partkey % 5 = 0 THEN concat(p_size, '/X')
      ELSE concat(least(p_size, p_partkey % 13), '/', greatest(p_size, p_partkey % 13)) END AS genotype FROM part""",
    "q_parameters": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{r.default}', '{r.basis}', true)" for n, r in THRESHOLDS.items()) + ") t(name, value, provenance, is_default)",
    "q_alleles_by_units": _CLUSTERS + "SELECT sample_id, marker, variant, step, origin, run_copies FROM vs",
    "q_infix_range": _CLUSTERS + "SELECT sample_id, marker, cluster_index, substr(consensus, 21, length(consensus) - 45) AS range_seq, 'ok' AS range_status FROM clusters",
    "q_cluster_full": _CLUSTERS + "SELECT sample_id, marker, cluster_index, consensus, CASE WHEN n_reads = 1 THEN 'single' ELSE 'poa_native' END AS consensus_method, CAST(n_reads AS INT) AS n_reads, CAST(n_hp1 AS INT) AS n_hp1, CAST(n_hp2 AS INT) AS n_hp2, CAST(n_phase_sets AS INT) AS n_phase_sets FROM clusters",
    **run_queries.ORACLE, **run_queries.later_oracles(_CLUSTERS, _COHORT),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["DataFrame", "SparkSession", "oracle_sql", "queries"]
