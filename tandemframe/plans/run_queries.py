"""Registered queries over the path that a user's reads take, and over the views beside it.

The reads are aligned ones: clipped, with insertions and deletions, of both
strands' markers, of compound motifs, of motifs of different lengths and of a
sex marker; the settings aren't the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats
from ..operators import cohort as C
from ..operators import evidence as E
from ..operators import interpretation as I
from ..operators import quality as Q
from ..params import FLAGS, THRESHOLDS, Settings, StutterModel
from ..sinks import exports
from ..sources import tables
from . import engine, fixtures

SETTINGS = Settings(min_mapq=10, calling_thresh=0.15, low_coverage_reads=10, min_reads_third=6)
#: Slippage explains nothing here, so that thresholds alone decide.
MODEL = StutterModel(version="none", step_factors={-1: 0.0, -2: 0.0, 1: 0.0})
_SYSTEMS = (
    {"motif": "AGAT", "period": 4, "corr_value": 50}, {"motif": "AGAT", "period": 4, "corr_value": 50, "strand": "-"}, {"motif": "AGAT,AGAC"}, {"motif": "AGAT,AGATA"}, {"motif": "AGAT", "reference_ce": 12.0},
)


def panel(spark: SparkSession) -> DataFrame:
    """K0 to K4 on chr1 to chr5 and the sex marker on chrX and chrY, windows of 98 bases."""
    systems = [s | {"name": f"K{m}", "chromosome": f"chr{m + 1}", "ref_start": 1000 * (m + 1) + 1, "ref_end": 1000 * (m + 1) + 98} for m, s in enumerate(_SYSTEMS)]
    sex = {"name": "AMEL", "marker_type": "amel", "chromosome": "chrX", "ref_start": 6001, "ref_end": 6098, "y_chromosome": "chrY", "y_ref_start": 7001, "y_ref_end": 7098}
    return tables.checked_panel(spark, [*systems, sex])


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each order line, in the columns of the alignment source."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*fixtures.COLUMNS)
    s, m = F.col("l_suppkey"), F.col("m")
    even = F.col("l_orderkey") % 2 == 0
    base = 8 + (s * 7 + m * 3) % 6
    units = F.when(even, base).otherwise(base + (s + m) % 4) + F.when(F.col("l_quantity") >= 48, -1).when(F.col("l_quantity") <= 1, 1).otherwise(0)
    r = r.withColumn("m", (F.col("l_partkey") % 6).cast("int")).withColumns({
        "n": F.when(m == 5, 12).otherwise(units).cast("int"), "start": (1000 * (F.when((m == 5) & ~even, m + 1).otherwise(m) + 1)).cast("int"),
        "lf": (15 + F.col("l_orderkey") % 60).cast("int"), "rf": (15 + F.col("l_partkey") % 60).cast("int"),
        "gone": (F.col("l_discount") == 0.03) & (F.col("l_quantity") < 3), "noend": (F.col("l_tax") == 0.01) & (F.col("l_quantity") == 7), "noseq": (F.col("l_linenumber") == 4) & (F.col("l_tax") == 0.05),
    })
    text = lambda x, k: F.repeat(F.lit(x), F.lit(k) if isinstance(k, int) else k)
    core = F.when(m == 1, text("ATCT", F.col("n"))).when(m == 2, F.concat(text("AGAT", F.col("n")), F.lit("AGACAGAC"))).when(m == 3, F.concat(text("AGAT", F.col("n")), F.lit("CCAGATA"))).when(m == 5, text("T", 48)).otherwise(text("AGAT", F.col("n")))
    r = r.withColumn("core", core).withColumns({"window": F.concat(text("C", 25), "core", text("G", 25)), "size": F.length("core")})
    op = lambda code, n: F.struct((F.lit(code) if isinstance(code, int) else code).cast("tinyint").alias("op"), n.cast("int").alias("len"))
    size, lf, rf, gone, clipped = F.col("size"), F.col("lf"), F.col("rf"), F.col("gone"), F.col("l_linenumber") == 5
    # clip, bases, gap, bases; what has no length is left out. A lambda isn't fused with what is around it: with the
    # range join on top, the code that Spark made of a branch for each shape was longer than the JVM compiles
    whole = ~gone & (size == 48)
    cigar = F.filter(F.array(
        op(4, F.when(clipped, 3).otherwise(0)), op(0, F.when(whole, lf + 98 + rf).when(gone, lf).otherwise(lf + 25 + F.least(size, F.lit(48)))),
        op(F.when(gone | (size < 48), 2).otherwise(1), F.when(gone, 98).otherwise(F.abs(size - 48))), op(0, F.when(whole, 0).when(gone, rf).otherwise(rf + 25)),
    ), lambda x: x["len"] > 0)
    seq = F.concat(F.when(clipped, "TTT").otherwise(""), text("C", lf), F.when(F.col("gone"), "").otherwise(F.col("window")), text("G", rf))
    order = Window.partitionBy("l_suppkey", "m").orderBy(*fixtures.ORDER)
    return r.withColumn("read_ord", F.row_number().over(order).cast("long")).withColumn("seq", F.when(F.col("noseq"), "").otherwise(seq)).select(
        F.concat(F.lit("S"), F.lpad(s.cast("string"), 7, "0")).alias("sample_id"), "read_ord", F.concat_ws("-", "l_orderkey", "read_ord").alias("qname"),
        F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") >= 0.08), 256).otherwise(F.when(F.col("l_returnflag") == "R", 16).otherwise(0)).alias("flag"),
        F.when(m < 5, F.concat(F.lit("chr"), (m + 1).cast("string"))).when(even, "chrX").otherwise("chrY").alias("chrom"), (F.col("start") - lf).alias("ref_start"),
        F.when(~F.col("noend"), F.col("start") + 98 + rf).alias("ref_end"), F.when(F.col("l_discount") >= 0.10, 5).when(F.col("l_tax") == 0.04, 15).otherwise(60).alias("mapq"),
        cigar.alias("cigar"), "seq",
        F.array_repeat((20 + F.col("l_quantity").cast("int") % 20).cast("tinyint"), F.length("seq")).alias("qual"), F.lit(None).cast("int").alias("hp"), F.lit(None).cast("int").alias("ps"),
    )


def _run(spark, d) -> tuple[engine.RunFrames, DataFrame]:
    windows = panel(spark)
    return engine.run(aligned(spark, d), windows, SETTINGS, MODEL, strict=True), windows


def q_gate_windows(spark, d):
    """What the gates say of each read, and the window's bases and quality of those that pass."""
    gate = E.gated(aligned(spark, d), panel(spark), SETTINGS)
    return gate.groupBy("sample_id", "marker", F.col("window").alias("side"), F.coalesce("reason", F.lit("kept")).alias("reason"), F.coalesce("sequence", F.lit("")).alias("sequence")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum("mean_qual"), 3), F.lit(0.0)).alias("quality")
    )


def q_gate_funnel(spark, d):
    """Reads by reason, zeros included, each reason in its place."""
    return E.funnel(E.gated(aligned(spark, d), panel(spark), SETTINGS)).select("sample_id", "marker", "reason_ord", "reason", "n")


def q_run_clusters(spark, d):
    run = _run(spark, d)[0]
    return run.clusters.select("sample_id", "marker", "cluster_index", "consensus", "consensus_method", "n_reads", "n_forward", "n_reverse", F.round("mean_qual", 6).alias("mean_qual"))


def q_run_evidence(spark, d):
    """The evidence table of a run: notation, summary and number of every cluster."""
    run = _run(spark, d)[0]
    numbers = ("number", "number_method", "number_label")
    return exports.evidence_table(run.alleles, *numbers).select("sample", "marker", "cluster_index", "status", "isfg", "motif_repeat_summary", "length_bp", "bp_diff", "is_deletion", "n_reads_total", *numbers)


def q_run_loci(spark, d):
    """Calls of a run at every marker of the panel, the sex marker too, with some of their flags."""
    shown = F.filter("flags", lambda f: f["code"].isin("dropout", "low_coverage", "allele_imbalance", "non_default_threshold"))
    return _run(spark, d)[0].loci.select("sample_id", "marker", "call_rule", C.genotype(F.col("alleles_called")).alias("genotype"), "total_reads", "called_reads", F.array_join(F.array_sort(F.transform(shown, lambda f: f["code"])), ",").alias("flags"))


def q_run_variants(spark, d):
    """Position, bases and genotype of the variant lines; no sex marker."""
    run, windows = _run(spark, d)
    refs = spark.createDataFrame([(f"K{m}", m, _window(m, 10 if m in (2, 3) else 12)) for m in range(5)], "marker string, contig_ord int, ref string")
    cells = F.split("line", "\t")
    at = lambda k: F.get(cells, k)
    return exports.vcf_rows(run.loci, windows, refs).select("sample_id", "pos", at(2).alias("marker"), at(3).alias("ref"), at(4).alias("alt"), F.get(F.split(at(9), ":"), 0).alias("gt"))


def _window(m: int, n: int) -> str:
    core = {1: "ATCT" * n, 2: "AGAT" * n + "AGACAGAC", 3: "AGAT" * n + "CCAGATA"}.get(m, "AGAT" * n)
    return "C" * 25 + core + "G" * 25


def q_audit(spark, d):
    from . import queries

    audit = Q.audit_frame(queries._loci(spark, d), queries.PARAMS)
    return audit.select("sample_id", "n_markers", "n_called", "needs_review", F.explode_outer("flag_counts").alias("code", "n"))


def q_settings_changed(spark, d):
    return SETTINGS.table(spark).select("name", "value", "default", "provenance", "is_default")


def q_naming_ranges(spark, d):
    """The reporting range between anchors, turned on the minus strand; markers without a range."""
    from . import queries

    ranges = spark.createDataFrame([(f"M{k}", "C" * 20, "G" * 20, k == 1) for k in range(3)], "name string, left_anchor string, right_anchor string, minus boolean")
    return I.named(queries._clusters(spark, d), fixtures.panel(spark), ranges).select("sample_id", "marker", "cluster_index", "range_seq", "strnaming_status")


def q_display_parts(spark, d):
    found = fixtures.reads(spark, d).select("sequence").distinct().withColumn("p", S.display_parts(F.col("sequence"), "AGAT"))
    return found.select("sequence", F.col("p.left").alias("shown_left"), F.col("p.core").alias("core"), F.col("p.right").alias("shown_right"))


def q_upper_median(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_quantity")
    return rows.groupBy("l_suppkey").agg(stats.upper_median(F.collect_list("l_quantity")).alias("median"))


def q_canonical_sample(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    given = F.concat(F.when(F.col("c_custkey") % 2 == 0, "  gm").when(F.col("c_custkey") % 3 == 0, "NA").otherwise("hgm"), F.col("c_custkey").cast("string"), F.lit(" "))
    return rows.select("c_custkey", C.canonical_sample_id(given).alias("sample_id"))


def q_cohort_selection(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "-R10-dorado").when(k % 4 == 1, "-R10-guppy").when(k % 4 == 2, "-R9-dorado").otherwise("-R10-LSK-dorado")
    path = F.concat(F.lit("s3/run"), (k % 3).cast("string"), F.lit("/NA"), (k % 97).cast("string"), F.when(k % 2 == 0, "-ONT").otherwise("-ont"), F.lit("-hg38"), kind, F.lit(".bam"))
    listing = spark.read.parquet(f"{d}/customer.parquet").select(path.alias("path"))
    wanted = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("NA"), (F.col("s_suppkey") % 120).cast("string")).alias("sample_id")).distinct()
    chosen, missing = C.select_cohort(listing, wanted)
    return chosen.select("sample_id", "path").unionByName(missing.select("sample_id", F.lit(None).cast("string").alias("path")))


def q_build_catalog(spark, d):
    seq = F.concat(F.repeat(F.lit("AGAT"), (F.col("p_size") % 5 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "agac").otherwise("AGAC"))
    records = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("entry_ord"), F.col("p_brand").alias("marker"), seq.alias("sequence"))
    return tables.build_catalog(records).select("entry_ord", "marker", "sequence")


def q_calibrated_panel(spark, d):
    """A marker for each supplier: repeats of its window in the core, and outside of it."""
    s = F.col("s_suppkey")
    seq = F.concat(F.lit("C" * 10), F.repeat(F.lit("AGAT"), (5 + s % 7).cast("int")), F.lit("C" * 20), F.repeat(F.lit("AGAT"), (s % 3).cast("int")), F.lit("G" * 5))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", seq.alias("seq"), F.concat(F.lit("c"), s.cast("string")).alias("contig"))
    windows = rows.select(
        s.cast("int").alias("marker_ord"), F.concat(F.lit("K"), s.cast("string")).alias("name"), F.col("contig").alias("chromosome"), F.lit(1).alias("ref_start"), F.length("seq").alias("ref_end"),
        F.lit("AGAT").alias("motif"), F.lit("+").alias("strand"), F.lit(-1).alias("period"), F.lit("str").alias("marker_type"),
    )
    return C.calibrated_panel(windows, rows.select(F.col("contig").alias("name"), "seq")).select("name", "window_bp", "corr_value", "core_units", "raw_ce")


def q_slice_bed(spark, d):
    return exports.slice_bed(panel(spark)).select("chrom", "start", "end", "name")


def q_panel_bed(spark, d):
    return exports.panel_bed(panel(spark).where("marker_type = 'str'"))


def q_variant_text(spark, d):
    """Text in a variant file and back."""
    given = F.concat("p_name", F.lit(";=,:% "), "p_type")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", given.alias("given")).withColumn("encoded", exports.vcf_encode(F.col("given")))
    return rows.select("p_partkey", "encoded", (exports.vcf_decode(F.col("encoded")) == F.col("given")).alias("same"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_ALIGNED = """
f0 AS (SELECT *, CAST(l_partkey % 6 AS INT) AS m, l_suppkey AS s, 8 + (l_suppkey*7 + (l_partkey % 6)*3) % 6 AS a1 FROM lineitem),
f1 AS (SELECT *, concat('S', lpad(CAST(s AS VARCHAR), 7, '0')) AS sample_id, CASE WHEN m = 5 THEN 'AMEL' ELSE concat('K', CAST(m AS VARCHAR)) END AS marker,
  row_number() OVER (PARTITION BY s, m ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS read_ord,
  CAST(CASE WHEN m = 5 THEN 12 ELSE (CASE WHEN l_orderkey % 2 = 0 THEN a1 ELSE a1 + (s + m) % 4 END) + (CASE WHEN l_quantity >= 48 THEN -1 WHEN l_quantity <= 1 THEN 1 ELSE 0 END) END AS INT) AS n,
  CASE WHEN m = 5 AND l_orderkey % 2 = 1 THEN 'y' ELSE 'own' END AS side, 15 + l_orderkey % 60 AS lf, 15 + l_partkey % 60 AS rf,
  CASE WHEN l_linenumber = 6 AND l_tax >= 0.08 THEN 256 WHEN l_returnflag = 'R' THEN 16 ELSE 0 END AS flag, CASE WHEN l_discount >= 0.10 THEN 5 WHEN l_tax = 0.04 THEN 15 ELSE 60 END AS mapq FROM f0),
f2 AS (SELECT *, concat(repeat('C', 25), CASE m WHEN 1 THEN repeat('ATCT', n) WHEN 2 THEN concat(repeat('AGAT', n), 'AGACAGAC') WHEN 3 THEN concat(repeat('AGAT', n), 'CCAGATA') WHEN 5 THEN repeat('T', 48) ELSE repeat('AGAT', n) END, repeat('G', 25)) AS w,
  CASE WHEN (flag & 2308) <> 0 THEN 'not_primary' WHEN mapq < 10 THEN 'low_mapq' WHEN l_tax = 0.01 AND l_quantity = 7 THEN 'no_alignment_end' WHEN lf < 20 THEN 'left_flank_short' WHEN rf < 20 THEN 'right_flank_short'
  WHEN l_linenumber = 4 AND l_tax = 0.05 THEN 'no_sequence' WHEN l_discount = 0.03 AND l_quantity < 3 THEN 'window_unlocatable' ELSE 'kept' END AS reason FROM f1),
k0 AS (SELECT * FROM f2 WHERE reason = 'kept'),
k1 AS (SELECT sample_id, marker, m, n, w, count(*) AS n_reads, min(read_ord) AS fo, count(*) FILTER (flag <> 16) AS n_forward, count(*) FILTER (flag = 16) AS n_reverse, avg(20 + CAST(l_quantity AS INT) % 20) AS mean_qual FROM k0 WHERE m < 5 GROUP BY ALL),
k2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, marker ORDER BY n_reads DESC, fo) - 1 AS INT) AS cluster_index, sum(n_reads) OVER (PARTITION BY sample_id, marker) AS total, length(w) AS bp FROM k1),
k3 AS (SELECT *, CASE WHEN n_reads / total < 0.02 THEN 'noise' WHEN n_reads / total < 0.15 THEN 'artefact' ELSE 'allele' END AS status,
  CASE m WHEN 2 THEN n + 2 WHEN 3 THEN n + 1 ELSE n END AS number, CASE WHEN m IN (2, 3) THEN 'bracket_count' WHEN m = 4 THEN 'reference_offset' ELSE 'period_ce' END AS method,
  concat(repeat('c', 25), ' [AGAT]', n, CASE m WHEN 2 THEN ' [AGAC]2' WHEN 3 THEN ' cc AGATA' ELSE '' END, ' ', repeat('g', 25)) AS isfg,
  concat('AGATx', n, CASE m WHEN 2 THEN ' + AGACx2' WHEN 3 THEN ' + AGATAx1' ELSE '' END, ' (TR ', length(w), ' bp)') AS summary FROM k2),
k4 AS (SELECT *, CASE WHEN status = 'allele' THEN row_number() OVER (PARTITION BY sample_id, marker ORDER BY status <> 'allele', n_reads DESC, cluster_index) END AS k FROM k3),
k5 AS (SELECT sample_id, marker, CAST(max(total) AS BIGINT) AS total_reads, count(k) AS c, max(n_reads) FILTER (k = 1) AS r1, max(n_reads) FILTER (k = 2) AS r2, max(n_reads) FILTER (k = 3) AS r3,
  max(number) FILTER (k = 1) AS l1, max(number) FILTER (k = 2) AS l2, max(n) FILTER (k = 1) AS u1, max(n) FILTER (k = 2) AS u2, max(w) FILTER (k = 1) AS w1, max(w) FILTER (k = 2) AS w2 FROM k4 GROUP BY ALL),
k6 AS (SELECT *, CASE WHEN c = 0 THEN 'no_data' WHEN c = 1 OR r2 / r1 < 0.4 THEN 'homozygous' WHEN c = 2 OR r3 / r1 < 0.15 OR r3 < 6 THEN 'heterozygous' ELSE 'two_called_three_present_review' END AS call_rule FROM k5),
s0 AS (SELECT sample_id, count(*) FILTER (reason = 'kept' AND side = 'own') AS x, count(*) FILTER (reason = 'kept' AND side = 'y') AS y FROM f2 WHERE m = 5 GROUP BY ALL),
s1 AS (SELECT *, (x >= 3) AS hx, (y >= 3) AS hy FROM s0),
loci AS (SELECT sample_id, marker, call_rule, CASE call_rule WHEN 'no_data' THEN '–' WHEN 'homozygous' THEN CAST(l1 AS VARCHAR) ELSE concat(l1, ' / ', l2) END AS genotype, total_reads,
    CASE call_rule WHEN 'no_data' THEN 0 WHEN 'homozygous' THEN r1 ELSE r1 + r2 END AS called_reads, CASE WHEN call_rule NOT IN ('no_data', 'homozygous') THEN r1 / (r1 + r2) END AS balance FROM k6
  UNION ALL SELECT sample_id, 'AMEL', CASE WHEN hx AND hy THEN 'heterozygous' WHEN hx OR hy THEN 'homozygous' ELSE 'no_data' END, CASE WHEN hx AND hy THEN 'X / Y' WHEN hx THEN 'X' WHEN hy THEN 'Y' ELSE '–' END,
    CASE WHEN hx OR hy THEN x + y ELSE 0 END, CASE WHEN hx THEN x ELSE 0 END + CASE WHEN hy THEN y ELSE 0 END, CASE WHEN hx AND hy THEN greatest(x, y) / (x + y) END FROM s1),
grid AS (SELECT * FROM (SELECT DISTINCT sample_id FROM f1) a, (VALUES ('K0'), ('K1'), ('K2'), ('K3'), ('K4'), ('AMEL')) t(marker))
"""
_A = "WITH " + _ALIGNED
_REASONS = ("kept", "not_primary", "low_mapq", "no_alignment_end", "left_flank_short", "right_flank_short", "no_sequence", "window_unlocatable")
_WARNED = ", ".join(f"'{c}'" for c, (s, _) in FLAGS.items() if s in ("warn", "error"))

ORACLE = {
    "q_gate_windows": _A + "SELECT sample_id, marker, side, reason, CASE WHEN reason = 'kept' THEN w ELSE '' END AS sequence, count(*) AS n, round(CAST(coalesce(sum(20 + CAST(l_quantity AS INT) % 20) FILTER (reason = 'kept'), 0) AS DOUBLE), 3) AS quality FROM f2 GROUP BY ALL",
    "q_gate_funnel": _A + f"""SELECT l.sample_id, l.marker, CAST(r.o AS INT) AS reason_ord, r.reason, count(f.read_ord) AS n FROM (SELECT DISTINCT sample_id, marker FROM f2) l
      CROSS JOIN (VALUES {", ".join(f"({k}, '{r}')" for k, r in enumerate(_REASONS))}) r(o, reason) LEFT JOIN f2 f ON f.sample_id = l.sample_id AND f.marker = l.marker AND f.reason = r.reason GROUP BY ALL""",
    "q_run_clusters": _A + "SELECT sample_id, marker, cluster_index, w AS consensus, CASE WHEN n_reads = 1 THEN 'single' ELSE 'poa_native' END AS consensus_method, CAST(n_reads AS INT) AS n_reads, CAST(n_forward AS INT) AS n_forward, CAST(n_reverse AS INT) AS n_reverse, round(mean_qual, 6) AS mean_qual FROM k2",
    "q_run_evidence": _A + """SELECT sample_id AS sample, marker, cluster_index, status, isfg, summary AS motif_repeat_summary, CAST(bp AS INT) AS length_bp, CAST(bp - 98 AS INT) AS bp_diff, false AS is_deletion, CAST(n_reads AS INT) AS n_reads_total,
      CAST(number AS DOUBLE) AS number, method AS number_method, CAST(number AS VARCHAR) AS number_label FROM k3
      UNION ALL SELECT sample_id, 'AMEL', a.k, 'allele', a.l, '', 0, 0, false, CAST(a.n AS INT), NULL, 'none', a.l FROM (SELECT sample_id, unnest(list_filter([CASE WHEN hx THEN {'k': 0, 'l': 'X', 'n': x} END, CASE WHEN hy THEN {'k': 1, 'l': 'Y', 'n': y} END], lambda v: v IS NOT NULL)) AS a FROM s1)""",
    "q_run_loci": _A + """SELECT g.sample_id, g.marker, coalesce(call_rule, 'no_data') AS call_rule, coalesce(genotype, '–') AS genotype, CAST(coalesce(total_reads, 0) AS BIGINT) AS total_reads, CAST(coalesce(called_reads, 0) AS BIGINT) AS called_reads,
      array_to_string(list_filter([CASE WHEN round_even(balance, 3) > 0.65 THEN 'allele_imbalance' END, CASE WHEN coalesce(call_rule, 'no_data') = 'no_data' THEN 'dropout' END, CASE WHEN call_rule <> 'no_data' AND called_reads < 10 THEN 'low_coverage' END, 'non_default_threshold'], lambda v: v IS NOT NULL), ',') AS flags
      FROM grid g LEFT JOIN loci USING (sample_id, marker)""",
    "q_run_variants": _A + f""", v AS (SELECT k.*, r.ref, r.m, CASE call_rule WHEN 'no_data' THEN 0 WHEN 'homozygous' THEN 1 ELSE 2 END AS called FROM k6 k JOIN (VALUES {", ".join(f"('K{m}', {m}, '{_window(m, 10 if m in (2, 3) else 12)}')" for m in range(5))}) r(marker, m, ref) USING (marker)),
      i AS (SELECT *, CASE WHEN called >= 1 THEN CASE WHEN w1 = ref THEN 0 ELSE 1 END END AS i1, CASE WHEN called = 2 THEN CASE WHEN w2 = ref THEN 0 WHEN w1 = ref THEN 1 ELSE 2 END END AS i2 FROM v)
      SELECT sample_id, CAST(1000 * (m + 1) + 1 AS INT) AS pos, marker, ref, coalesce(nullif(concat_ws(',', CASE WHEN i1 > 0 THEN w1 END, CASE WHEN i2 > 0 THEN w2 END), ''), '.') AS alt,
      CASE called WHEN 0 THEN './.' WHEN 1 THEN concat(i1, '/', i1) ELSE concat(least(i1, i2), '/', greatest(i1, i2)) END AS gt FROM i""",
    "q_settings_changed": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{SETTINGS[n]}', '{r.default}', '{r.basis}', {str(SETTINGS[n] == r.default).lower()})" for n, r in THRESHOLDS.items()) + ") t(name, value, \"default\", provenance, is_default)",
    "q_upper_median": "SELECT l_suppkey, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM lineitem GROUP BY l_suppkey",
    "q_canonical_sample": "SELECT c_custkey, regexp_replace(upper(trim(concat(CASE WHEN c_custkey % 2 = 0 THEN '  gm' WHEN c_custkey % 3 = 0 THEN 'NA' ELSE 'hgm' END, c_custkey, ' '))), '^GM', 'NA') AS sample_id FROM customer",
    "q_cohort_selection": """WITH p AS (SELECT concat('NA', c_custkey % 97) AS sample_id, concat('s3/run', c_custkey % 3, '/NA', c_custkey % 97, CASE WHEN c_custkey % 2 = 0 THEN '-ONT' ELSE '-ont' END, '-hg38', CASE c_custkey % 4 WHEN 0 THEN '-R10-dorado' ELSE '-R10-LSK-dorado' END, '.bam') AS path
      FROM customer WHERE c_custkey % 4 IN (0, 3)) SELECT w.sample_id, max(p.path) AS path FROM (SELECT DISTINCT concat('NA', s_suppkey % 120) AS sample_id FROM supplier) w LEFT JOIN p USING (sample_id) GROUP BY w.sample_id""",
    "q_build_catalog": "SELECT min(p_partkey) AS entry_ord, p_brand AS marker, concat(repeat('AGAT', CAST(p_size % 5 + 1 AS INT)), 'AGAC') AS sequence FROM part GROUP BY ALL",
    "q_calibrated_panel": "SELECT concat('K', s_suppkey) AS name, CAST(35 + 4 * (5 + s_suppkey % 7 + s_suppkey % 3) AS INT) AS window_bp, CAST(s_suppkey % 3 AS INT) AS corr_value, CAST(5 + s_suppkey % 7 AS INT) AS core_units, CAST(5 + s_suppkey % 7 + s_suppkey % 3 AS DOUBLE) AS raw_ce FROM supplier",
    "q_slice_bed": """SELECT concat('chr', i + 1) AS chrom, CAST(0 AS INT) AS start, CAST(1000 * (i + 1) + 10098 AS INT) AS "end", concat('K', i) AS name FROM range(0, 5) t(i) UNION ALL SELECT * FROM (VALUES ('chrX', 0, 16098, 'AMEL'), ('chrY', 0, 17098, 'AMEL_Y')) v""",
    "q_panel_bed": "SELECT concat_ws(chr(9), concat('chr', i + 1), 1000 * (i + 1), 1000 * (i + 1) + 98, CASE i WHEN 2 THEN 'AGAT,AGAC' WHEN 3 THEN 'AGAT,AGATA' ELSE 'AGAT' END, concat('K', i)) AS value FROM range(0, 5) t(i)",
    "q_variant_text": "SELECT p_partkey, " + "replace(" * 6 + "concat(p_name, ';=,:% ', p_type), '%', '%25'), ':', '%3A'), ';', '%3B'), '=', '%3D'), ',', '%2C'), ' ', '%20') AS encoded, true AS same FROM part",
    "q_display_parts": "WITH " + fixtures.READS_SQL + """SELECT DISTINCT sequence, concat('…', repeat('C', 12)) AS shown_left, regexp_extract(sequence, '(AGAT)+([ACGTN]{0,12}?(AGAT)+)*', 0) AS core, concat(repeat('G', 12), '…') AS shown_right FROM reads""",
}


def later_oracles(clusters: str, cohort: str) -> dict[str, str]:
    """Those that begin with the expressions of the other queries."""
    between = "substr(consensus, 21, length(consensus) - 45)"
    return {
        "q_naming_ranges": clusters + f"SELECT sample_id, marker, cluster_index, CASE WHEN marker IN ('M0', 'M2') THEN {between} WHEN marker = 'M1' THEN reverse(translate({between}, 'ACGTN', 'TGCAN')) END AS range_seq, CASE WHEN marker IN ('M0', 'M1', 'M2') THEN 'error' ELSE 'no_range' END AS strnaming_status FROM clusters",
        "q_audit": cohort + f""", per AS (SELECT sample_id, count(*) AS n_markers, count(*) FILTER (call_rule <> 'no_data') AS n_called, bool_or(len(list_filter(flags, lambda f: f IN ({_WARNED}))) > 0) AS needs_review FROM flagset GROUP BY ALL)
          SELECT p.*, c.code, c.n FROM per p LEFT JOIN (SELECT sample_id, code, count(*) AS n FROM (SELECT sample_id, unnest(flags) AS code FROM flagset) GROUP BY ALL) c USING (sample_id)""",
    }
