import pytest
from pyspark.sql import functions as F

from tandemframe.operators import cohort as C
from tandemframe.sinks import exports
from tandemframe.sources import tables


def test_core_and_flanking(spark):
    cases = [("[TCTA]6 [TCTG]5 ta [TCTA]3", 14, 0), ("[TCTA]6 aaaaaaaaaaaaaaaaaaaa [TCTA]2", 6, 2), ("acgt", 0, 0), ("TCTA ccccccccccccccccc [TCTA]9 TCTG", 10, 1)]
    rows = spark.createDataFrame(cases, "s string, a int, b int").select(C.core_and_flanking(F.col("s")).alias("c"), "a", "b").collect()
    assert [tuple(r.c) for r in rows] == [(r.a, r.b) for r in rows]


def test_calibrated_panel(spark):
    window = "TCTA" + "C" * 20 + "TCTA" * 9 + "G" * 5
    panel = tables.checked_panel(spark, [{"name": "X", "chromosome": "chr1", "ref_start": 11, "ref_end": 10 + len(window), "motif": "TCTA", "period": -1}])
    contigs = spark.createDataFrame([("chr1", "A" * 10 + window.lower() + "A" * 10)], "name string, seq string")
    r = C.calibrated_panel(panel, contigs).first()
    assert (r.corr_value, r.core_units, r.raw_ce, r.window_bp) == (1, 9, 10.0, len(window))


def test_slices_are_widened_and_clamped(spark):
    panel = tables.checked_panel(spark, [{"name": "TPOX", "chromosome": "chr2", "ref_start": 1489551, "ref_end": 1489784, "motif": "AATG"}, {"name": "AMEL", "chromosome": "chrX", "ref_start": 5, "ref_end": 9, "marker_type": "amel", "y_chromosome": "chrY", "y_ref_start": 20, "y_ref_end": 30}])
    rows = [tuple(r)[1:] for r in exports.slice_bed(panel).orderBy("marker_ord", "name").collect()]
    assert rows == [("chr2", 1479550, 1499784, "TPOX"), ("chrX", 0, 10009, "AMEL"), ("chrY", 0, 10030, "AMEL_Y")]


def test_cohort_selection(spark):
    paths = ["s3/x/NA1-ONT-hg38-R10-dorado-v1.bam", "s3/x/NA1-ONT-hg38-R10-dorado-v2.bam", "s3/x/NA2-ONT-R9-guppy.bam", "s3/x/NA3-ONT-R10-DORADO.bam"]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    wanted = spark.createDataFrame([("NA1",), ("NA2",), ("NA3",)], "sample_id string")
    chosen, missing = C.select_cohort(listing, wanted)
    assert {r.sample_id: r.path for r in chosen.collect()} == {"NA1": paths[1], "NA3": paths[3]} and [r.sample_id for r in missing.collect()] == ["NA2"]


@pytest.mark.parametrize(("raw", "want"), [("9.30", "9.3"), ("14.0", "14"), ("nd", None), ("-", None), ("OL", "OL"), ("?", None), (" 12 ", "12")])
def test_canonical_allele(spark, raw, want):
    assert spark.range(1).select(C.canonical_allele(F.lit(raw))).first()[0] == want


def test_axis():
    assert [C.nice_axis_max(x) for x in (0, 1, 3, 7, 19, 51, 120)] == [1, 1, 5, 10, 20, 100, 200]


def test_ranges_have_anchors(spark, tmp_path):
    left, core, right = "A" * 40, "TCTA" * 10, "G" * 40
    (tmp_path / "r.tsv").write_text("name\tchromosome\tstart\tend\tref_ce\toptions\tslice_start\tslice_seq\n" + f"X\tchr1\t180\t141\t10\tlimit=3;keep=1\t101\t{left}{core}{right}\n")
    r = tables.load_ranges(spark, str(tmp_path / "r.tsv")).first()
    assert r.minus and r.left_anchor == "A" * 30 and r.right_anchor == "G" * 30 and r.options == "keep=1"


def test_log_lines_are_json(tmp_path):
    import json

    from tandemframe import log

    log.configure(str(tmp_path / "x.jsonl"))
    with log.timed("scan", sample="A"):
        pass
    log.configure(str(tmp_path / "y.jsonl"))
    line = json.loads((tmp_path / "x.jsonl").read_text())
    assert line["stage"] == "scan" and line["sample"] == "A" and line["level"] == "INFO" and list(line) == sorted(line)


def test_a_plugged_namer_wins(spark):
    from tandemframe.operators import interpretation as I

    panel = tables.checked_panel(spark, [{"name": "X", "chromosome": "chr1", "ref_start": 1, "ref_end": 88, "motif": "AGAT", "period": 4}])
    left, right = "CTCTCTGGCATTCAGGACTTCAGGATCCAA", "GGCATACCGTTAAGGCCTTGACCGATTGCA"
    ranges = spark.createDataFrame([("X", left, right, False)], "name string, left_anchor string, right_anchor string, minus boolean")
    clusters = spark.createDataFrame([("S", "X", 0, left + "AGAT" * 7 + right, 9)], "sample_id string, marker string, cluster_index int, consensus string, n_reads int")
    namer = lambda seq, marker: F.concat(F.lit("CE"), (F.length(seq) / 4).cast("int").cast("string"), F.lit("_"), seq)
    got, plain = I.named(clusters, panel, ranges, namer).first(), I.named(clusters, panel, ranges).first()
    assert (got.number, got.number_method, got.strnaming_status, got.repeat_label) == (7.0, "strnaming", "ok", "CE7_" + "AGAT" * 7)
    assert (plain.number_method, plain.strnaming_status, plain.range_seq) == ("period_ce", "error", "AGAT" * 7)
