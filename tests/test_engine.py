import json
import random

import pytest
from pyspark.sql import functions as F

from tandemframe.errors import EvidenceError, PanelError, SourceError
from tandemframe.operators import cohort as C
from tandemframe.operators import evidence as E
from tandemframe.operators import interpretation as I
from tandemframe.operators import quality as Q
from tandemframe.operators.consensus import Backend, NoBackend, consensus_of
from tandemframe.params import Settings
from tandemframe.plans import engine
from tandemframe.sinks import exports, report
from tandemframe.sources import bam, tables

LEFT, RIGHT = "A" * 0 + "CT" * 50, "GC" * 50


def record(name, units, hp=None, mapq=60, reverse=False, snv=None, ps=None):
    """A read over the window [100, 148) of 12 AGAT with 100 bases on both sides."""
    core = "AGAT" * units
    if snv is not None:
        core = core[:snv] + ("C" if core[snv] != "C" else "G") + core[snv + 1 :]
    n = 4 * units
    cigar = [(0, 100), (0, n), (2, 48 - n), (0, 100)] if n < 48 else [(0, 248)] if n == 48 else [(0, 148), (1, n - 48), (0, 100)]
    return {"qname": name, "flag": 16 if reverse else 0, "chrom": "chr1", "ref_start": 0, "mapq": mapq, "cigar": cigar, "seq": LEFT + core + RIGHT, "qual": [40] * (200 + n), "hp": hp, "ps": ps}


def cohort_file(tmp_path, records, sample="synthetic"):
    path = str(tmp_path / f"{sample}.bam")
    bam.write_bam(path, [("chr1", 1000)], records, f"@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@RG\tID:rg1\tSM:{sample}\n")
    return path


@pytest.fixture
def panel(spark):
    return tables.checked_panel(spark, [{"name": "TEST", "chromosome": "chr1", "ref_start": 101, "ref_end": 148, "motif": "AGAT", "period": 4}, {"name": "EMPTY", "chromosome": "chr2", "ref_start": 11, "ref_end": 50, "motif": "AGAT", "period": 4}])


def het():
    return [record(f"a{i}", 12, 1, reverse=i % 2 == 1, ps=7) for i in range(15)] + [record(f"b{i}", 11, 2, reverse=i % 2 == 1, ps=7) for i in range(12)] + [record(f"c{i}", 10) for i in range(2)]


def read(spark, path, **options):
    bam.register(spark)
    return spark.read.format("alignments").options(path=path, **options).load()


def test_source_round_trip(spark, tmp_path):
    path = cohort_file(tmp_path, het())
    rows = read(spark, path).orderBy("read_ord").collect()
    assert len(rows) == 29 and rows[0].seq == LEFT + "AGAT" * 12 + RIGHT and rows[0].qual[0] == 40 and rows[0].hp == 1 and rows[0].ps == 7
    assert (rows[0].ref_start, rows[0].ref_end, rows[15].ref_end) == (0, 248, 248) and rows[0].sample_id == "synthetic"
    assert read(spark, path, regions="chr1:500-600").count() == 0 and read(spark, path, regions="chr1:100-148").count() == 29
    assert read(spark, path).where("chrom = 'chr9'").count() == 0


def test_source_splits_see_every_record_once(spark, tmp_path):
    rng = random.Random(1)
    records = [record(f"r{i}", rng.randrange(8, 15), rng.choice([None, 1, 2])) for i in range(3000)]
    for r in records:
        r["seq"] = "".join(rng.choice("ACGT") for _ in r["seq"])  # so that blocks are many
        r["qual"] = [rng.randrange(2, 60) for _ in r["seq"]]
    path = cohort_file(tmp_path, records)
    names = [r.qname for r in read(spark, path, splitBytes="70000").select("qname").collect()]
    assert sorted(names) == sorted(r["qname"] for r in records)


def test_index_reads_only_what_regions_touch(spark, tmp_path):
    rng = random.Random(4)
    starts = sorted(rng.randrange(0, 3_000_000) for _ in range(3000))
    rows = [record(f"r{i}", 8 + i % 9) | {"ref_start": s} for i, s in enumerate(starts)]
    rows += [record(f"z{i}", 12) | {"chrom": "chr2", "ref_start": 400 * i} for i in range(200)]
    path = str(tmp_path / "wide.bam")
    bam.write_bam(path, [("chr1", 4_000_000), ("chr2", 100_000)], rows, "@RG\tID:a\tSM:wide\n")
    for regions in ("chr1:1000000-1000100", "chr1:5-9,chr1:16380-16390,chr2:40000-40400", "chr2:99000-99001", "chr1:2999000-4000000"):
        want = {(r.read_ord, r.qname) for r in read(spark, path, regions=regions).collect()}
        bam.write_index(path)
        planned = bam.AlignmentReader({"path": path, "regions": regions}, read(spark, path).schema).partitions()
        assert {(r.read_ord, r.qname) for r in read(spark, path, regions=regions).collect()} == want
        assert {(r.read_ord, r.qname) for r in read(spark, path, regions=regions, splitBytes=1).collect()} == want
        touched = sum((b >> 16) - (a >> 16) for p in planned for a, b in p.ranges)
        assert len(planned) <= 1 and touched < 0.5 * (tmp_path / "wide.bam").stat().st_size
        (tmp_path / "wide.bam.bai").unlink()
    bam.write_index(path)
    assert read(spark, path).where("chrom = 'chr2'").count() == 200
    assert {r.sample_id for r in read(spark, f"file://{path}", regions="chr2:0-900", samples=json.dumps({f"file://{path}": "other"})).collect()} == {"other"}


def test_a_thousand_files_are_one_scan(spark, tmp_path, panel):
    from tandemframe import cli

    paths = [cohort_file(tmp_path, [record(f"q{k}", 12)], f"f{k}") for k in range(40)]
    bam.register(spark)
    reads = cli._reads(spark, paths, panel, samples={p: f"S{k}" for k, p in enumerate(paths)})
    assert reads._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert {r.sample_id for r in reads.collect()} == {f"S{k}" for k in range(40)}


def test_detect_and_validate(spark, tmp_path):
    path = cohort_file(tmp_path, het())
    assert tables.detect(path) | {"size": 0} == {"kind": "bam", "gzipped": True, "aligned": True, "size": 0}
    got = tables.validate(spark, path)
    assert got["samples"] == ["synthetic"] and got["contigs"] == ["chr1"] and got["median_mapq"] == 60 and got["warnings"] == []
    for name, text in (("x.fq", b"@r\nA\n"), ("x.fa", b">c\nA\n")):
        (tmp_path / name).write_bytes(text)
    assert tables.detect(str(tmp_path / "x.fq"))["kind"] == "fastq" and tables.detect(str(tmp_path / "x.fa"))["kind"] == "fasta"
    (tmp_path / "empty").write_bytes(b"")
    for bad in ("empty", "missing"):
        with pytest.raises(SourceError):
            tables.detect(str(tmp_path / bad))


def test_heterozygote_end_to_end(spark, tmp_path, panel):
    frames = engine.run(read(spark, cohort_file(tmp_path, het())), panel)
    loci = {r.marker: r for r in C.profile_rows(frames.loci).collect()}
    assert loci["TEST"].genotype == "12 / 11" and loci["TEST"].call_rule == "heterozygous" and loci["TEST"].total_reads == 29
    assert loci["EMPTY"].call_rule == "no_data" and loci["EMPTY"].flags == "DO"
    funnel = {(r.marker, r.reason): r.n for r in E.funnel(frames.gate).collect()}
    assert funnel["TEST", "kept"] == 29 and sum(v for (m, _), v in funnel.items() if m == "TEST") == 29
    tidy = C.tidy(frames.loci).collect()
    assert len(tidy[0]) == 29 and sum(r.marker == "EMPTY" and r.allele_index == 0 and not r.called for r in tidy) == 1


def test_homozygote_and_low_mapq(spark, tmp_path, panel):
    frames = engine.run(read(spark, cohort_file(tmp_path, [record(f"h{i}", 12, reverse=i % 2 == 0) for i in range(8)] + [record(f"l{i}", 10, mapq=5) for i in range(3)])), panel)
    row = C.profile_rows(frames.loci).where("marker = 'TEST'").first()
    assert (row.genotype, row.call_rule, row.total_reads, row.flags) == ("12", "homozygous", 8, "LC")
    assert E.funnel(frames.gate).where("marker = 'TEST' and reason = 'low_mapq'").first().n == 3


def test_boundary_indels_of_a_window(spark, tmp_path, panel):
    shorter, longer = engine.run(read(spark, cohort_file(tmp_path, [record("s", 9)])), panel), engine.run(read(spark, cohort_file(tmp_path, [record("l", 15)], "b")), panel)
    assert shorter.observations.first().sequence == "AGAT" * 9 and longer.observations.first().sequence == "AGAT" * 15


def clusterer(**k):
    return E.LocusClusterer(["AGAT"], "+", k.get("threshold", 0.97), k.get("tolerance", 0), k.get("backend", Backend()))


def test_one_snv_is_noise_at_97_and_an_allele_at_99():
    good = "AGAT" * 12
    reads = [good] * 5 + [good[:20] + "C" + good[21:]]
    assert [len(m) for m, _, _ in clusterer()(reads)] == [6] and [len(m) for m, _, _ in clusterer(threshold=0.99)(reads)] == [5, 1]


def test_a_read_of_another_length_is_not_absorbed():
    """160 against 156 bases are alike enough, but another allele."""
    ten, nine = "C" * 60 + "AGAT" * 10 + "G" * 60, "C" * 60 + "AGAT" * 9 + "G" * 60
    found = E.LocusClusterer(["AGAT"], "+", 0.97, 0, Backend())([ten] * 10 + [nine])
    assert [(len(m), c) for m, c, _ in found] == [(10, ten), (1, nine)]


def test_refinement_within_bins_by_plain_rule():
    """Several bins of noisy reads: no read is nearer to a consensus of its bin than to its own."""
    rng = random.Random(5)
    truth = ["C" * 40 + "AGAT" * n + "G" * 20 + tail for n, tail in ((10, "T" * 20), (10, "A" * 20), (8, "T" * 20))]
    seqs = []
    for _ in range(40):
        t = list(rng.choice(truth))
        if rng.random() < 0.3:
            t[rng.randrange(0, 30)] = "T"
        seqs.append("".join(t))
    found = E.LocusClusterer(["AGAT"], "+", 0.95, 0, Backend())(seqs)
    assert sorted(i for m, _, _ in found for i in m) == list(range(40)) and {c for _, c, _ in found} == set(truth)
    for members, consensus, _ in found:
        for i in members:
            own = E.core_length(seqs[i], ["AGAT"], "+")
            near = [E.likeness(seqs[i], c) for m, c, _ in found if E.core_length(c, ["AGAT"], "+") == own]
            assert E.likeness(seqs[i], consensus) == max(near)


def test_a_locus_that_fails_fails_alone(spark, tmp_path, panel):
    rows = het() + [record("o", 12) | {"ref_start": 0}]
    path = cohort_file(tmp_path, rows)
    good = {r.marker: r.call_rule for r in engine.run(read(spark, path), panel).loci.collect()}
    assert good["TEST"] == "heterozygous" and good["EMPTY"] == "no_data"

    class Odd(E.LocusClusterer):
        def __call__(self, seqs):
            raise RuntimeError("no clusters")

    was, E.LocusClusterer = E.LocusClusterer, Odd
    try:
        loci = engine.run(read(spark, path), panel).loci.collect()
    finally:
        E.LocusClusterer = was
    assert {r.marker: r.call_rule for r in loci} == {"TEST": "no_data", "EMPTY": "no_data"}


def test_a_failed_locus_is_told_from_one_without_reads(spark, tmp_path, panel):
    """Strict runs end with the locus's name; others keep a row, a count and a message."""
    class Odd(E.LocusClusterer):
        def __call__(self, *a):
            raise RuntimeError("odd")

    reads = read(spark, cohort_file(tmp_path, het()))
    was, E.LocusClusterer = E.LocusClusterer, Odd
    try:
        with pytest.raises(Exception, match="marker TEST: clustering failed"):
            engine.run(reads, panel, strict=True).clusters.collect()
        frames = engine.run(reads, panel)
        row, loci = frames.clusters.first(), {r.marker: r for r in frames.loci.collect()}
    finally:
        E.LocusClusterer = was
    assert (row.consensus, row.consensus_method, row.n_reads) == (None, "failed", 0)
    assert {m: r.n_failed for m, r in loci.items()} == {"TEST": 1, "EMPTY": 0}
    assert [f.message for f in loci["TEST"].flags if f.code == "dropout"] == ["TEST: no allele called; its clustering failed"]


def test_distinct_sequences_with_counts_cluster_as_their_reads_do():
    """A backend that is given every read, and one that goes by counts and keeps its graphs."""
    class Listed(Backend):
        def consensus(self, seqs):
            return super().consensus(seqs)

    rng, kept = random.Random(11), Backend()
    for _ in range(30):
        reads = ["C" * 40 + "AGAT" * rng.choice((8, 9)) + rng.choice(("", "T", "TT")) + "G" * 20 for _ in range(25)] + ["", ""]
        rng.shuffle(reads)
        plain = clusterer(backend=Listed())(reads)
        assert clusterer(backend=kept)(reads) == plain and sorted(i for m, _, _ in plain for i in m) == list(range(27))
    assert clusterer()(["AGAT" * 9, "AGAT" * 8], [2, 5]) == [([1], "AGAT" * 8, "poa_native"), ([0], "AGAT" * 9, "poa_native")]


def test_settings_are_checked():
    from tandemframe.errors import ParameterError

    for bad in ({"min_mapq": 2.5}, {"min_mapq": -1}, {"identity_threshold": 0}, {"identity_threshold": 1.5}, {"calling_thresh": "x"}, {"min_reads_third": True}):
        with pytest.raises(ParameterError):
            Settings(**bad)
    s = Settings(min_mapq=30.0, balanced_ab_max=1)
    assert s["min_mapq"] == 30 and dict(s)["balanced_ab_max"] == 1.0 and len(s) == 10 and s.changed("chosen") == ["min_mapq", "balanced_ab_max"]
    assert "* min_mapq = 30 (default 20, chosen)" in s.text()


def test_clusters_do_not_depend_on_read_order():
    rng = random.Random(2)
    reads = ["AGAT" * 12] * 9 + ["AGAT" * 11] * 7 + ["AGAT" * 6 + "AGAC" + "AGAT" * 5] * 2
    want = sorted((c, len(m)) for m, c, _ in clusterer()(reads))
    for _ in range(5):
        rng.shuffle(reads)
        assert sorted((c, len(m)) for m, c, _ in clusterer()(reads)) == want


def test_thresholds_are_checked():
    with pytest.raises(EvidenceError):
        clusterer(threshold=0)
    with pytest.raises(EvidenceError):
        clusterer(tolerance=-1)


def test_consensus_of_noisy_reads_is_the_truth():
    rng = random.Random(7)
    truth = "".join(rng.choice("ACGT") for _ in range(120)) + "AGAT" * 12 + "".join(rng.choice("ACGT") for _ in range(80))

    def noisy():
        out = []
        for b in truth:
            x = rng.random()
            if x < 0.01:
                out.append(rng.choice("ACGT"))
            elif x < 0.013:
                out += [b, rng.choice("ACGT")]
            elif x > 0.003 + 0.013 or x < 0.013:
                out.append(b)
        return "".join(out)

    assert consensus_of([noisy() for _ in range(15)], Backend()) == (truth, "poa_native")
    assert consensus_of(["A", "A", "C"], NoBackend()) == ("A", "mode") and consensus_of([], Backend()) == ("", "empty") and consensus_of(["AC"], Backend()) == ("AC", "single")


def candidates(spark, rows, **panel):
    """Rows of (cluster_index, length_bp, reads, hp1, hp2[, n_phase_sets]) as candidates of one locus."""
    given = {"allow_triallelic": False, "tri_balanced_thr": None, "min_reads_third": 5} | panel
    data = [("S", "M", i, bp, n, h1, h2, *(more or (1,)), 1, "allele", False, *given.values(), 0) for i, bp, n, h1, h2, *more in rows]
    names = "sample_id marker cluster_index length_bp n_reads n_hp1 n_hp2 n_phase_sets phase_set status is_deletion allow_triallelic tri_balanced_thr min_reads_third marker_ord"
    kinds = "string string int int int int int int int string boolean boolean double int int"
    return spark.createDataFrame(data, ", ".join(f"{a} {b}" for a, b in zip(names.split(), kinds.split(), strict=True)))


def call(spark, rows, **panel):
    df = I.suppress_phantoms(candidates(spark, rows, **panel))
    r = I.genotypes(df, Settings()).first()
    return r.call_rule, list(r.called), r.rescued


def test_call_tree(spark):
    assert call(spark, [(0, 48, 20, 0, 0)])[:2] == ("homozygous", [0])
    assert call(spark, [(0, 48, 20, 0, 0), (1, 44, 7, 0, 0)])[:2] == ("homozygous", [0])
    assert call(spark, [(0, 48, 20, 0, 0), (1, 44, 9, 0, 0)])[:2] == ("heterozygous", [0, 1])
    assert call(spark, [(0, 48, 17, 17, 0), (1, 44, 5, 0, 5)]) == ("heterozygous", [0, 1], 1)
    three = [(0, 48, 22, 0, 0), (1, 44, 20, 0, 0), (2, 40, 20, 0, 0)]
    assert call(spark, three)[:2] == ("two_called_three_present_review", [0, 1])
    assert call(spark, three, allow_triallelic=True)[:2] == ("triallelic_type_II", [0, 1, 2])
    assert call(spark, [(0, 48, 22, 0, 0), (1, 44, 20, 0, 0), (2, 40, 8, 0, 0)], allow_triallelic=True)[:2] == ("triallelic_type_I", [0, 1, 2])
    assert call(spark, [(0, 48, 22, 0, 0), (1, 44, 20, 0, 0), (2, 40, 5, 0, 0)], allow_triallelic=True)[:2] == ("triallelic_review", [0, 1, 2])
    assert call(spark, [(0, 48, 22, 0, 0), (1, 44, 20, 0, 0), (2, 40, 4, 0, 0)])[:2] == ("heterozygous", [0, 1])


def test_phantoms_are_near_the_owner_of_their_haplotype(spark):
    rows = [(0, 289, 10, 10, 0), (1, 288, 6, 6, 0), (2, 301, 5, 0, 5), (3, 302, 4, 0, 4)]
    got = {r.cluster_index: (r.status, r.n_reads_absorbed) for r in I.suppress_phantoms(candidates(spark, rows)).collect()}
    assert got == {0: ("allele", 6), 1: ("hp_phantom", 0), 2: ("allele", 4), 3: ("hp_phantom", 0)}
    assert call(spark, rows)[1] == [0, 2]
    chain = [(0, 100, 10, 10, 0), (1, 102, 6, 6, 0), (2, 104, 5, 5, 0)]
    assert [r.status for r in I.suppress_phantoms(candidates(spark, chain)).orderBy("cluster_index").collect()] == ["allele", "hp_phantom", "allele"]
    assert call(spark, [(0, 48, 17, 17, 0, 2), (1, 44, 5, 0, 5, 1)])[:2] == ("homozygous", [0])


def test_status_order(spark):
    base = {"total_reads": 100, "is_deletion": False, "expected_stutter": 0.0, "n_reads": 50, "fraction": 0.5}
    cases = [({}, "allele"), ({"total_reads": 0}, "no_data"), ({"is_deletion": True}, "deletion"), ({"expected_stutter": 50.0}, "stutter"), ({"fraction": 0.019}, "noise"), ({"fraction": 0.09}, "artefact"), ({"fraction": 0.01, "expected_stutter": 60.0}, "stutter")]
    for change, want in cases:
        r = base | change
        assert spark.range(1).select(*(F.lit(v).alias(k) for k, v in r.items())).select(I.status(Settings())).first()[0] == want


def test_sex(spark, tmp_path):
    panel = tables.checked_panel(spark, [{"name": "AMEL", "chromosome": "chr1", "ref_start": 101, "ref_end": 148, "marker_type": "amel", "y_chromosome": "chr1", "y_ref_start": 401, "y_ref_end": 448}])
    x = [record(f"x{i}", 12) for i in range(4)]
    y = [r | {"ref_start": 300, "qname": f"y{i}"} for i, r in enumerate([record("y", 12)] * 3)]
    for rows, want in ((x + y, "X,Y"), (x, "X"), (x[:2], "")):
        run = engine.run(read(spark, cohort_file(tmp_path, rows, f"s{len(rows)}")), panel)
        assert run.sex.first().genotype == want
        locus = run.loci.first()
        assert [a.number_label for a in locus.alleles_called] == [x for x in want.split(",") if x] and locus.total_reads == (len(rows) if want else 0)
        assert locus.call_rule == ("heterozygous" if "," in want else "homozygous" if want else "no_data")
        assert {f.code for f in locus.flags} == ({"low_coverage"} if want else {"dropout"})


def test_sex_marker_is_in_every_output(spark, tmp_path, panel):
    systems = [{"name": "TEST", "chromosome": "chr1", "ref_start": 101, "ref_end": 148, "motif": "AGAT", "period": 4}, {"name": "AMEL", "chromosome": "chr1", "ref_start": 601, "ref_end": 648, "marker_type": "amel", "y_chromosome": "chr2", "y_ref_start": 101, "y_ref_end": 148}]
    both = tables.checked_panel(spark, systems)
    x = [record(f"x{i}", 12) | {"ref_start": 500} for i in range(14)]
    y = [record(f"y{i}", 12) | {"chrom": "chr2"} for i in range(9)]
    path = str(tmp_path / "sex.bam")
    bam.write_bam(path, [("chr1", 1000), ("chr2", 1000)], het() + x + y, "@RG\tID:rg1\tSM:s\n")
    run = engine.run(read(spark, path), both)
    tidy = [(r.marker, r.allele_label, r.reads, r.call_rule) for r in C.tidy(run.loci).collect() if r.marker == "AMEL"]
    assert sorted(tidy) == [("AMEL", "X", 14, "heterozygous"), ("AMEL", "Y", 9, "heterozygous")]
    assert C.batch_summary(run.loci, ["TEST", "AMEL"]).first().AMEL == "X,Y"
    record_ = exports.run_records(run.loci, run.alleles).first()
    assert [r.call_rule for r in record_.results if r.marker == "AMEL"] == ["heterozygous"]
    assert {r.marker for r in exports.evidence_table(run.alleles).collect()} == {"TEST", "AMEL"} == {r.marker for r in exports.profile_table(run.loci, both).collect()}
    refs = spark.createDataFrame([("TEST", 0, "AGAT" * 12), ("AMEL", 0, "A" * 48)], "marker string, contig_ord int, ref string")
    assert [r.line.split("\t")[2] for r in exports.vcf_rows(run.loci, both, refs).collect()] == ["TEST"]
    assert {m: g for m, g in ((r.marker, r.genotype) for r in C.profile_rows(run.loci).collect())} == {"TEST": "12 / 11", "AMEL": "X / Y"}


def test_panel_checks(spark, tmp_path):
    ok = {"name": "A", "chromosome": "chr1", "ref_start": 1, "ref_end": 9, "motif": "AGAT"}
    for bad in ({"ref_end": 0}, {"category": "x"}, {"strand": "*"}, {"motif": "AGAX"}, {"marker_type": "snp"}, {"allele_bp_step": 0}):
        with pytest.raises(PanelError):
            tables.checked_panel(spark, [ok | bad])
    with pytest.raises(PanelError):
        tables.checked_panel(spark, [ok, ok])
    (tmp_path / "p.bed").write_text("# x\ntrack y\nchr1\t100\t148\tAGAT\tTEST\nchr2\t10\t50\tAGAT,AGAC\n")
    panel, warnings = tables.load_panel_bed(spark, str(tmp_path / "p.bed"))
    rows = panel.orderBy("marker_ord").collect()
    assert [(r.name, r.ref_start, r.period) for r in rows] == [("TEST", 101, -1), ("chr2_10", 11, -1)] and len(warnings) == 1
    assert [r.value for r in exports.panel_bed(panel).collect()] == ["chr1\t100\t148\tAGAT\tTEST", "chr2\t10\t50\tAGAT,AGAC\tchr2_10"]


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("# c\nsample_id\tbam\trole\nA\ta.bam\t\nB\tb.bam\tcontrol\n")
    assert [tuple(r) for r in tables.load_manifest(spark, str(p)).collect()] == [("A", "a.bam", "sample"), ("B", "b.bam", "control")]
    for bad in ("sample_id\tbam\nA\ta\nA\tb\n", "sample_id\nA\n", "sample_id\tbam\n", "sample_id\tbam\trole\nA\ta\tking\n"):
        p.write_text(bad)
        with pytest.raises(SourceError):
            tables.load_manifest(spark, str(p))


def test_truth_sheet(spark, tmp_path):
    sheet = spark.createDataFrame([("", "D3S1358", None, None, "TH01", None), ("", "ILLUMINA", None, None, "ILLUMINA", None), ("s", "A1", "A2", "COBERTURA", "A1", "A2"), ("GM1", "14", "15.0", "30", "9.3", "NA")], "a string, b string, c string, d string, e string, f string")
    path = str(tmp_path / "t.xlsx")
    exports.write_xlsx(path, {"T": sheet})
    cells = tables.read_xlsx(path)[1:]  # the writer's own header row goes
    rows = {r.marker: r for r in tables.truth_from_cells(spark, cells).collect()}
    assert (rows["D3S1358"].allele1, rows["D3S1358"].allele2, rows["D3S1358"].coverage) == ("14", "15.0", 30.0) and rows["TH01"].allele1 == "9.3"
    called = spark.createDataFrame([("NA1", "D3S1358", ["14", "15"]), ("NA1", "TH01", ["9.3", "9.3"]), ("NA2", "TH01", ["6", "7"])], "sample_id string, marker string, called array<string>")
    verdicts = C.compare(called, tables.truth_from_cells(spark, cells))
    assert {r.verdict for r in verdicts.collect()} == {"match"} and [r.sample_id for r in C.unscored(called, tables.truth_from_cells(spark, cells)).collect()] == ["NA2"]


def test_vcf_alleles_follow_their_index(spark, tmp_path, panel):
    frames = engine.run(read(spark, cohort_file(tmp_path, het())), panel)
    refs = spark.createDataFrame([("TEST", 0, "AGAT" * 11)], "marker string, contig_ord int, ref string")
    line = exports.vcf_rows(frames.loci, panel, refs).first().line.split("\t")
    fields = dict(zip(line[8].split(":"), line[9].split(":"), strict=True))
    assert line[4] == "AGAT" * 12 and fields["GT"] == "0/1" and fields["AD"] == "12,15" and fields["MC"] == "11,12"
    path = str(tmp_path / "x.vcf")
    exports.write_vcf(exports.vcf_rows(frames.loci, panel, refs), "synthetic", [("chr1", 1000)], path)
    text = open(path).read()
    assert text.startswith("##fileformat") and "##FILTER=<ID=allele_imbalance" in text and text.count("\nchr1\t") == 1


def test_vcf_encoding_round_trip(spark):
    words = ["a:b;c=d,e", "100% x", "plain", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", exports.vcf_encode(F.col("w")).alias("e"))
    assert [r.e for r in df.collect()][3] == "." and [r.d for r in df.select(exports.vcf_decode(F.col("e")).alias("d")).collect()] == words


def test_reports_carry_their_digest(spark, tmp_path, panel):
    frames = engine.run(read(spark, cohort_file(tmp_path, het())), panel)
    text = report.sample_report(frames.loci, "synthetic")
    assert report.verify_page(text) and not report.verify_page(text.replace("12 / 11", "12 / 12")) and "12 / 11" in text
    assert report.highlight("CCAGAT<", ["AGAT"]) == "CC<mark>AGAT</mark>&lt;"
    lines = report.trace(frames.alleles, E.funnel(frames.gate)).first().text
    assert lines.startswith("TEST: heterozygous, 29 reads (29 kept)") and "called as allele 1" in lines


def test_audit_seal():
    sealed = Q.sealed({"b": 1, "a": [1, 2]})
    assert Q.verify(sealed) and not Q.verify(sealed | {"b": 2})


def test_parameters(spark):
    p = Settings(min_mapq=30, len_tolerance_bp=1, calling_thresh=None)
    assert p.changed() == ["min_mapq", "len_tolerance_bp"] and p.changed("derived") == ["len_tolerance_bp"] and p["calling_thresh"] == 0.10
    with pytest.raises(KeyError):
        Settings(nonsense=1)


def test_stutter_fit_recovers_a_known_trend(spark):
    import math

    rows = []
    for lus in range(10, 15):
        for k in range(8):
            parent = 1_000_000
            rows += [("S", f"M{k}{lus}", 0, step, lus, parent, round(parent * math.exp(-12 + 0.7 * lus) * f)) for step, f in ((-1, 1.0), (-2, 0.25), (1, 0.5))]
    obs = spark.createDataFrame(rows, "sample_id string, marker string, cluster_index int, step int, lus int, parent_reads long, stutter_reads long")
    m = C.fitted_model(obs)
    assert m.log_slope == pytest.approx(0.7, abs=0.01) and m.log_intercept == pytest.approx(-12, abs=0.1) and m.step_factors[-2] == pytest.approx(0.25, abs=0.01) and m.r_squared > 0.99


def test_streamed_records_become_tidy_rows(spark, tmp_path, panel):
    from tandemframe.streaming import tidy_stream as T

    frames = engine.run(read(spark, cohort_file(tmp_path, het())), panel)
    records = exports.run_records(frames.loci, frames.alleles, {"run_id": "r1"}, panel, Settings(calling_thresh=0.2), [("bam", "x.bam", "d")])
    one = records.first()
    test = next(r for r in one.results if r.marker == "TEST")
    assert (test.system.motif, test.system.ref_start, test.thresholds.calling_thresh, one.audit.n_called, one.inputs[0].path) == ("AGAT", 101, 0.2, 1, "x.bam")
    assert [(x.repeat_group, x.coverage_reads) for x in test.ngs_panel] == [(10, 2), (11, 12), (12, 15)] and one.summary.n_markers == 2
    exports.write_pretty(records, str(tmp_path / "pretty"))
    assert json.loads((tmp_path / "pretty" / "synthetic.json").read_text())["results"][0]["marker"] == "TEST"
    exports.write_json(records, str(tmp_path / "runs"))
    stream = T.tidy_stream(spark, str(tmp_path / "runs"), records.schema)
    T.start(stream, str(tmp_path / "tidy"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "tidy")).collect()
    assert sorted((r.marker, r.allele_index, r.allele_label) for r in rows) == [("EMPTY", 0, None), ("TEST", 1, "12"), ("TEST", 2, "11")]


def test_consensus_backends_in_turn():
    from tandemframe.operators.consensus import Abpoa, Spoa, preferred

    class Here(Backend):
        name = "here"

    assert preferred((Abpoa, Spoa, Here)).name in ("poa_abpoa", "poa_spoa", "here") and preferred(()).name == "none" and preferred().consensus(["ACGT", "ACGT", "ACT"]) == "ACGT"


def test_contigs_and_ranges(spark, tmp_path, panel):
    contigs = spark.createDataFrame([("chr1",), ("2",)], "name string")
    assert [tuple(r) for r in tables.missing_contigs(panel, contigs).collect()] == [("chr2", True)]
    (tmp_path / "r.txt").write_text("name\tchromosome\tstart\tend\tref_ce\toptions\nTEST\t1\t148\t101\t12\tlimit=3\nNONE\t1\t5\t9\t7\n")
    known = tables.load_range_table(spark, str(tmp_path / "r.txt"))
    rows, skipped = tables.build_ranges(panel, known, spark.createDataFrame([("chr1", "ACGT" * 100)], "name string, seq string"), pad=20)
    r = rows.first()
    assert (r.name, r.start, r.end, r.slice_start, len(r.slice_seq)) == ("TEST", 148, 101, 81, 88) and [x.name for x in skipped.collect()] == ["EMPTY"]


def test_naming_fallbacks_are_told(spark, tmp_path, panel):
    ranges = spark.createDataFrame([("TEST", LEFT[-20:], RIGHT[:20], False)], "name string, left_anchor string, right_anchor string, minus boolean")
    run = engine.run(read(spark, cohort_file(tmp_path, het())), panel, ranges=ranges)
    told = {(r.cluster_index, r.level, r.number_method) for r in I.naming_fallbacks(run.alleles).collect()}
    assert told == {(0, "warning", "period_ce"), (1, "warning", "period_ce"), (2, "debug", "period_ce")}


def test_command_line(spark, tmp_path, capsys):
    from tandemframe import cli

    path = cohort_file(tmp_path, het())
    other = cohort_file(tmp_path, [record(f"h{i}", 12) for i in range(30)], "second")
    (tmp_path / "p.yaml").write_text("systems:\n- {name: TEST, chromosome: chr1, ref_start: 101, ref_end: 148, motif: AGAT, period: 4}\n")
    p = str(tmp_path / "p.yaml")
    assert cli.main(["interpret", "--bam", path, "--panel", p, "--min-mapq", "30"]) == 0 and "12 / 11" in capsys.readouterr().out
    (tmp_path / "ref.fa").write_text(">chr1\n" + LEFT + "AGAT" * 12 + RIGHT + "\n")
    assert cli.main(["export", "--bam", path, "--panel", p, "--out", str(tmp_path / "x"), "--formats", "json,csv,xlsx,vcf", "--reference", str(tmp_path / "ref.fa")]) == 0
    assert (tmp_path / "x/synthetic.vcf").exists() and (tmp_path / "x/run.xlsx").exists()
    (tmp_path / "m.tsv").write_text(f"sample_id\tbam\nA\t{path}\nB\t{other}\nC\t{tmp_path}/none.bam\n")
    assert cli.main(["batch", str(tmp_path / "m.tsv"), "--panel", p, "--out", str(tmp_path / "b")]) == 1
    summary = spark.read.option("header", True).csv(str(tmp_path / "b/batch_summary")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.status, r.TEST) for r in summary] == [("A", "ok", "12,11"), ("B", "ok", "12"), ("C", "error", None)]
    assert cli.main(["tidy", str(tmp_path / "b/json"), "--out", str(tmp_path / "t")]) == 0 and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert cli.main(["inspect", str(tmp_path / "none")]) == 2 and cli.main(["doctor", "--bam", path, "--panel", p]) == 0
    assert cli.main(["report", "--bam", path, "--panel", p, "--out", str(tmp_path / "r.html")]) == 0
