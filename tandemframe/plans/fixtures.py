"""Reads derived from the order lines: a cohort with known genotypes.

Every supplier is a sample, five markers, some hundred reads a locus; so the
number of loci, not their depth, grows with the tables. ``READS_SQL`` is the
same derivation for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
COLUMNS = ("l_suppkey", "l_returnflag", "l_linestatus", *ORDER)


def panel(spark: SparkSession) -> DataFrame:
    """Markers M0 to M4: AGAT on chr1 to chr5, windows of 98 bases; M3 may be triallelic."""
    m = F.col("id").cast("int")
    start = 1000 * (m + 1)
    return spark.range(5, numPartitions=1).select(
        m.alias("marker_ord"), F.concat(F.lit("M"), m.cast("string")).alias("name"), F.lit(None).cast("string").alias("codis_name"), F.concat(F.lit("chr"), (m + 1).cast("string")).alias("chromosome"),
        (start + 1).alias("ref_start"), (start + 98).alias("ref_end"), F.lit("AGAT").alias("motif"), F.when(m == 4, -1).otherwise(4).alias("period"), F.when(m == 4, 0).otherwise(50).alias("corr_value"),
        F.when(m == 2, "y_chromosomal").otherwise("autosomal").alias("category"), F.when(m == 4, 12.0).alias("reference_ce"), F.lit(4).alias("allele_bp_step"),
        F.when(m == 4, "kit counts one repeat more").alias("kit_nomenclature_note"), F.lit(None).cast("int").alias("min_mapq"), F.lit(None).cast("int").alias("min_mean_qual"), F.lit(1000).alias("max_tr_len"),
        (m == 3).alias("allow_triallelic"), F.lit(None).cast("double").alias("tri_balanced_thr"), F.lit(5).alias("min_reads_third"), F.lit(0).alias("ont_len_tolerance"), F.lit(None).cast("map<string,double>").alias("stutter_overrides"),
        F.lit("str").alias("marker_type"), F.lit("+").alias("strand"), F.lit(None).cast("string").alias("y_chromosome"), F.lit(None).cast("int").alias("y_ref_start"), F.lit(None).cast("int").alias("y_ref_end"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, marker, read_ord (within the locus), n_units, hp, ps, strand, mapq, flag, chrom, ref_start, ref_end, sequence.

    The order within a locus comes from the columns of a line, so no global sort
    is needed; the one exchange by locus serves all that follows.
    """
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS)  # noqa: E741
    s, m = F.col("l_suppkey"), (F.col("l_partkey") % 5).cast("int")
    a1 = 8 + (s * 7 + m * 3) % 6
    even = F.col("l_orderkey") % 2 == 0
    units = F.when(even, a1).otherwise(a1 + (s + m) % 4) + F.when(F.col("l_quantity") >= 48, -1).when(F.col("l_quantity") <= 1, 1).otherwise(0)
    start = 1000 * (m + 1)
    order = Window.partitionBy("sample_id", "marker").orderBy(*ORDER)
    r = l.select(
        "*", F.concat(F.lit("S"), F.lpad(s.cast("string"), 7, "0")).alias("sample_id"), F.concat(F.lit("M"), m.cast("string")).alias("marker"), m.alias("marker_ord"), units.cast("int").alias("n_units"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).when(even, 1).otherwise(2).cast("int").alias("hp"), F.when(F.col("l_linenumber") != 7, F.when((s % 7 == 0) & (F.col("l_orderkey") % 5 == 0), 2).otherwise(1)).cast("int").alias("ps"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), F.when(F.col("l_discount") >= 0.10, 5).otherwise(60).alias("mapq"),
        F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") >= 0.08), 256).otherwise(F.when(F.col("l_returnflag") == "R", 16).otherwise(0)).alias("flag"),
        F.concat(F.lit("chr"), (m + 1).cast("string")).alias("chrom"), (start - 15 - F.col("l_orderkey") % 60).cast("int").alias("ref_start"), (start + 98 + 15 + F.col("l_partkey") % 60).cast("int").alias("ref_end"),
        ((F.col("l_tax") >= 0.07) & F.col("l_quantity").between(20, 22)).alias("snv"),
    )
    repeat = F.when(F.col("snv"), F.concat(F.repeat(F.lit("AGAT"), F.lit(3)), F.lit("AGCT"), F.repeat(F.lit("AGAT"), F.col("n_units") - 4))).otherwise(F.repeat(F.lit("AGAT"), F.col("n_units")))
    r = r.withColumn("sequence", F.concat(F.repeat(F.lit("C"), F.lit(25)), repeat, F.repeat(F.lit("G"), F.lit(25))))
    r = r.withColumn("read_ord", F.row_number().over(order).cast("long"))
    return r.select("sample_id", "marker", "marker_ord", "read_ord", "n_units", "hp", "ps", "strand", "mapq", "flag", "chrom", "ref_start", "ref_end", "sequence")


READS_SQL = """
u AS (SELECT *, CAST(l_partkey % 5 AS INT) AS m, l_suppkey AS s, 8 + (l_suppkey*7 + (l_partkey % 5)*3) % 6 AS a1 FROM lineitem),
r0 AS (SELECT concat('S', lpad(CAST(s AS VARCHAR), 7, '0')) AS sample_id, concat('M', CAST(m AS VARCHAR)) AS marker, m AS marker_ord,
  row_number() OVER (PARTITION BY s, m ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS read_ord,
  CAST((CASE WHEN l_orderkey % 2 = 0 THEN a1 ELSE a1 + (s + m) % 4 END) + (CASE WHEN l_quantity >= 48 THEN -1 WHEN l_quantity <= 1 THEN 1 ELSE 0 END) AS INT) AS n_units,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 2 = 0 THEN 1 ELSE 2 END AS hp,
  CASE WHEN l_linenumber <> 7 THEN CASE WHEN s % 7 = 0 AND l_orderkey % 5 = 0 THEN 2 ELSE 1 END END AS ps,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CASE WHEN l_discount >= 0.10 THEN 5 ELSE 60 END AS mapq,
  CASE WHEN l_linenumber = 6 AND l_tax >= 0.08 THEN 256 WHEN l_returnflag = 'R' THEN 16 ELSE 0 END AS flag,
  concat('chr', CAST(m + 1 AS VARCHAR)) AS chrom, CAST(1000*(m+1) - 15 - l_orderkey % 60 AS INT) AS ref_start, CAST(1000*(m+1) + 113 + l_partkey % 60 AS INT) AS ref_end,
  (l_tax >= 0.07 AND l_quantity BETWEEN 20 AND 22) AS snv FROM u),
reads AS (SELECT * EXCLUDE (snv), concat(repeat('C', 25), CASE WHEN snv THEN concat(repeat('AGAT', 3), 'AGCT', repeat('AGAT', n_units - 4)) ELSE repeat('AGAT', n_units) END, repeat('G', 25)) AS sequence FROM r0),
gate AS (SELECT *, CASE WHEN (flag & 2308) <> 0 THEN 'not_primary' WHEN mapq < 20 THEN 'low_mapq' WHEN ref_start > 1000*(marker_ord+1) - 20 THEN 'left_flank_short'
  WHEN ref_end < 1000*(marker_ord+1) + 118 THEN 'right_flank_short' END AS reason FROM reads),
obs AS (SELECT *, length(regexp_extract(sequence, '(AGAT)+([ACGTN]{0,12}?(AGAT)+)*', 0)) AS bin FROM gate WHERE reason IS NULL)
"""
