import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandemframe.functions import scan
from tandemframe.functions import sequence as S
from tandemframe.functions import stats
from tandemframe.operators.evidence import core_length, edits, window_on_read
from tandemframe.params import StutterModel
from tandemframe.schemas import CIGAR


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_brackets(spark):
    cases = [("CCGATTCTATCTATCTATT", "TCTA,TCTG", "ccgat [TCTA]3 tt"), ("AGAT", "AGAT", "AGAT"), ("", "AGAT", ""), ("ACGT", "", "ACGT"), ("TCTATCTGTCTATCTA", "TCTA,TCTG", "TCTA TCTG [TCTA]2")]
    rows = spark.createDataFrame(cases, "s string, m string, want string").select(S.brackets(F.col("s"), F.col("m")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert one(spark, S.brackets(F.lit("ATCTATCT"), "AGAT", "-"))[0] == "[AGAT]2"


@pytest.mark.parametrize(("bp", "period", "corr", "want"), [(48, 4, 0, 12.0), (48, 4, 4, 11.0), (49, 4, 0, 12.1), (39, 4, 0, 9.3), (34, 4, 0, 8.2), (49, 3, 0, 16.1), (48, -1, 0, None)])
def test_ce_from_length(spark, bp, period, corr, want):
    assert one(spark, S.ce_from_length(F.lit(bp), F.lit(period), F.lit(corr)))[0] == want


def test_ce_from_brackets(spark):
    cases = [("[TCTA]6 [TCTG]5 [TCTA]3 ta [TCTA]3 tca [TCTA]2 tccata [TCTA]12", 31.0), ("[TCTA]4 [TCTG]6 [TCTA]3 ta [TCTA]3 tca [TCTA]2 tccata [TCTA]11", 29.0), ("TCTA TCTG [TCTA]11", 13.0), ("acgt", None)]
    rows = spark.createDataFrame(cases, "s string, w double").select(S.ce_from_brackets(F.col("s")).alias("g"), "w").collect()
    assert [r.g for r in rows] == [r.w for r in rows]


def test_core_keeps_microvariants_apart(spark):
    nine, variant = "AATG" * 9, "AATG" * 6 + "ATG" + "AATG" * 3
    row = one(spark, S.repeat_core_length(F.lit(nine), "AATG"), S.repeat_core_length(F.lit(variant), "AATG"))
    assert tuple(row) == (36, 39)


def test_core_expression_is_the_scan(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice(["AGAT", "AGAC", "A", "C", "GATT", "AGATAGAT"]) for _ in range(rng.randrange(1, 18))) for _ in range(400)]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.repeat_core_length(F.col("s"), "AGAT,AGAC").alias("c")).collect()
    assert [r.c for r in rows] == [core_length(r.s, ["AGAT", "AGAC"], "+") for r in rows]


def test_runs(spark):
    got = one(spark, S.runs(F.lit("CCAGATAGATTTAGATAGATAGAT"), "AGAT").alias("r")).r
    assert [tuple(x) for x in got] == scan.find_runs("CCAGATAGATTTAGATAGATAGAT", ["AGAT"])
    assert one(spark, S.longest_runs(S.runs(F.lit("CCAGATAGATTTAGATAGATAGAT"), "AGAT")).alias("r")).r[0].copies == 3


def test_mixed_motifs_take_the_longer_run(spark):
    assert scan.find_runs("AGATAGATAGATA", ["AGAT", "AGATA"]) == [(0, "AGAT", 3, 12)]
    row = one(spark, S.runs(F.lit("AGATAGATAGATAAAGATA"), "AGAT,AGATA").alias("r")).r
    assert [tuple(r) for r in row] == [(0, "AGAT", 3, 12), (14, "AGATA", 1, 5)]


def test_motifs_of_any_lengths_are_those_of_the_scan(spark):
    """Runs, core, units, notation and summary by column against a plain scan."""
    rng, rows = random.Random(8), []
    for motifs in ("AGAT,AGATA", "CTTT,TTCC,CT", "AG,AGAT", "AGAT,AGAC", "ATT,A"):
        parts = [*motifs.split(","), "A", "C", "GATT", "TTTTTTTTTTTTTTT"]
        rows += [("".join(rng.choice(parts) for _ in range(rng.randrange(0, 16))), motifs, rng.choice("+-")) for _ in range(60)]
    seq, motif, strand = F.col("s"), F.col("m"), F.col("d")
    got = spark.createDataFrame(rows, "s string, m string, d string").select(
        "s", "m", "d", S.runs(seq, motif).alias("runs"), S.repeat_core_length(seq, motif, strand).alias("core"), S.lus_units(seq, motif, strand).alias("lus"),
        S.brackets(seq, motif, strand).alias("notation"), S.repeat_summary(seq, motif, strand).alias("summary"),
    ).collect()
    for r in got:
        motifs = r.m.split(",")
        turned = r.s if r.d == "+" else r.s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        runs = scan.find_runs(turned, motifs)
        assert [tuple(x) for x in r.runs] == scan.find_runs(r.s, motifs)
        assert r.core == core_length(r.s, motifs, r.d) and r.lus == max((n for _, _, n, _ in runs), default=None)
        parts, at = [], 0
        for start, m, n, bp in runs:
            parts += [turned[at:start].lower(), m if n == 1 else f"[{m}]{n}"]
            at = start + bp
        assert r.notation == " ".join(x for x in [*parts, turned[at:].lower()] if x)
        if runs:
            assert r.summary == " + ".join(f"{m}x{n}" for _, m, n, _ in runs) + f" (TR {len(r.s)} bp)"


def test_labels(spark):
    n = lambda v, m: S.number_label(F.lit(v).cast("double"), F.lit(m), F.lit("X"))
    assert tuple(one(spark, n(9.3, "period_ce"), n(14.0, "strnaming"), n(-2.0, "delta"), n(0.0, "delta"), n(52.0, "bp_sizing"), n(None, "none"))) == ("9.3", "14", "Δ-2", "0", "52 bp TR", "X")


def test_numbers(spark):
    a = S.allele_numeric(F.lit(90), F.lit(-1), F.lit(0), F.lit(98), F.lit(4), F.lit(None).cast("double"))
    row = one(spark, a.alias("a"), S.allele_number(F.lit(None).cast("double"), a["value"], a["source"], F.lit(13.0), F.lit(90)).alias("n"))
    assert tuple(row.a) == (-2.0, "delta_only") and tuple(row.n) == (13.0, "bracket_count")


@pytest.mark.parametrize(("k", "n"), [(0, 10), (5, 10), (2, 17), (40, 100), (700, 1500), (0, 0)])
def test_binomial(spark, k, n):
    low = min(k, n - k)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0
    assert one(spark, stats.two_sided_binomial_p(F.lit(k), F.lit(n)))[0] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(("lus", "rate"), [(10, 0.0070), (11, 0.0145), (12, 0.0296), (13, 0.0605), (14, 0.1237), (20, 0.1237), (3, 0.0070)])
def test_stutter_rate(spark, lus, rate):
    assert one(spark, stats.stutter_rate(F.lit(lus), F.lit(-1), StutterModel()))[0] == pytest.approx(rate, abs=1e-4)


def test_upper_median(spark):
    assert one(spark, stats.upper_median(F.array(*map(F.lit, [1, 2, 3, 4]))))[0] == 3


def test_infix_and_range():
    assert scan.infix("ACGT", "TTACGTTT")[0] == 0 and scan.infix("ACGT", "TTACTTT")[0] == 1
    assert scan.between_anchors("GGGGACGTACGTCCCC", "GGGG", "CCCC") == ("ACGTACGT", "ok")
    assert scan.between_anchors("ACGT", "GGGGGGGG", "CCCC")[1] == "anchor_mismatch"


@pytest.mark.parametrize(("cigar", "want"), [
    ([(0, 300)], (100, 148)), ([(0, 100), (2, 4), (0, 196)], (100, 144)), ([(0, 148), (1, 8), (0, 100)], (100, 156)), ([(4, 5), (0, 300)], (105, 153)),
    ([(0, 100), (1, 3), (0, 200)], (103, 151)), ([(0, 100), (2, 48), (0, 100)], None), ([(0, 120)], (100, 120)),
])
def test_window_on_a_read(cigar, want):
    assert scan.locate_window(cigar, 0, 100, 148) == want


def test_window_column_is_the_walk(spark):
    rng, rows = random.Random(2), []
    for _ in range(400):
        cigar = [(rng.choice([0, 0, 0, 1, 2, 3, 4, 7, 8]), rng.randrange(1, 12)) for _ in range(rng.randrange(0, 9))]
        start = rng.randrange(0, 40)
        rows.append((cigar, rng.randrange(0, 20), start, start + rng.randrange(1, 20)))
    at = window_on_read(F.col("c"), F.col("r"), F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, f"c {CIGAR}, r int, a int, b int").select("*", at.alias("at")).collect()
    assert all((None if g["at"] is None else tuple(g["at"])) == scan.locate_window([(x.op, x.len) for x in g.c], g.r, g.a, g.b) for g in got)
    assert sum(g["at"] is not None for g in got) > 100


def test_edits_against_plain_dynamic_programming():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert edits(a, b) == plain(a, b)


def test_reverse_complement_is_its_own_inverse(spark):
    assert one(spark, S.reverse_complement(S.reverse_complement(F.lit("ACGTNacgtn"))))[0] == "ACGTNacgtn"
    assert re.fullmatch("[ACGTN]+", one(spark, S.reverse_complement(F.lit("GATTACA")))[0])


def test_windows_of_batches_with_nulls_and_means():
    kind = pa.list_(pa.struct([("op", pa.int8()), ("len", pa.int32())]))
    cigar = pa.array([[{"op": 0, "len": 300}], None, [], [{"op": 4, "len": 5}, {"op": 0, "len": 300}], [{"op": 0, "len": 300}]], kind)
    starts, ends = pa.array([100, 100, 100, 100, None], pa.int32()), pa.array([148] * 5, pa.int32())
    nought = pa.array([0] * 5, pa.int32())
    whole = scan.locate_windows(cigar, nought, starts, ends).to_pylist()
    assert whole == [{"from": 100, "to": 148}, None, None, {"from": 105, "to": 153}, None]
    assert scan.locate_windows(cigar[3:], nought[3:], starts[3:], ends[3:]).to_pylist() == whole[3:]
    assert scan.locate_windows(cigar[:0], nought[:0], starts[:0], ends[:0]).to_pylist() == []
    quals = pa.array([[1, 2, 4, 5], None, [], [127] * 9, [3, None]], pa.list_(pa.int8()))
    assert scan.means(quals).to_pylist() == [3.0, None, None, 127.0, None]
    assert scan.means(quals[3:]).to_pylist() == [127.0, None] and scan.means(quals[:0]).to_pylist() == []
