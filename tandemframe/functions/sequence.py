"""Sequences as Column expressions: motif runs, repeat cores, notation, numbers.

Motifs are a comma-separated string column or literal. Motifs of one length, as
most markers have, are found by one regular expression. Where a marker's motifs
differ in length the run of most bases wins at each position, which no
expression says: ``_scanned`` walks those sequences, still in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GAP

_ONE_RUN = "(?:{0})+"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """body(value), the value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def oriented(seq: Column, strand) -> Column:
    return F.when(_col(strand) == "-", reverse_complement(seq)).otherwise(seq)


def run_pattern(motif) -> Column:
    """AGAT,TCTA -> (?:AGAT)+|(?:TCTA)+"""
    return F.concat(F.lit("(?:"), F.replace(_col(motif), F.lit(","), F.lit(")+|(?:")), F.lit(")+"))


def core_pattern(motif, gap: int = GAP) -> Column:
    runs = run_pattern(motif)
    return F.concat(F.lit("(?:"), runs, F.lit(f")(?:[ACGTN]{{0,{gap}}}?(?:"), runs, F.lit("))*"))


def motif_length(motif) -> Column:
    return F.length(F.substring_index(_col(motif), ",", 1))


def mixed(motif) -> Column:
    """Do the motifs differ in length?"""
    return F.size(F.array_distinct(F.transform(F.split(_col(motif), ","), lambda m: F.length(m)))) > 1


def _either(motif, general, even: Column) -> Column:
    """``general()`` where the motifs differ in length, ``even`` elsewhere; decided
    once for motifs that are given as text."""
    if isinstance(motif, str):
        return general() if len({len(m) for m in motif.split(",")}) > 1 else even
    return F.when(mixed(motif), general()).otherwise(even)


_RUNS = "array<struct<start:int,motif:string,copies:int,bp:int>>"


def _scanned(seq: Column, motif) -> Column:
    """Maximal runs from the left for motifs of any lengths: at each position the
    run of most bases, then of the earlier motif."""
    n = F.length(seq)

    def run_at(i: Column) -> Column:
        rest = F.substring(seq, i + 1, n)
        # a pattern is compiled anew for each motif, so only where its run begins
        length = lambda m: F.when(F.startswith(rest, m), F.length(F.regexp_substr(rest, F.concat(F.lit("^(?:"), m, F.lit(")+")))))
        found = F.transform(F.split(_col(motif), ","), lambda m, k: F.struct(F.coalesce(length(m), F.lit(0)).alias("bp"), (-k).alias("k"), m.alias("m")))
        return F.array_max(found)

    def step(s: Column, i: Column) -> Column:
        def told(best: Column) -> Column:
            run = F.struct(i.alias("start"), best["m"].alias("motif"), (best["bp"] / F.length(best["m"])).cast("int").alias("copies"), best["bp"].alias("bp"))
            return F.when(best["bp"] > 0, F.struct((i + best["bp"]).alias("at"), F.concat(s["found"], F.array(run)).alias("found"))).otherwise(s)

        return F.when(i < s["at"], s).otherwise(let(run_at(i), told))

    state = F.struct(F.lit(0).alias("at"), F.array().cast(_RUNS).alias("found"))
    return F.aggregate(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), state, step, lambda s: s["found"])


def runs(seq: Column, motif) -> Column:
    """array<struct<start,motif,copies,bp>> of maximal motif runs, left to right."""
    k = motif_length(motif)

    def placed(found: Column, gaps: Column) -> Column:
        def one(run, i):
            before = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
            between = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x))
            return F.struct((before + between).alias("start"), F.substring(run, F.lit(1), k).alias("motif"), (F.length(run) / k).cast("int").alias("copies"), F.length(run).alias("bp"))

        return F.transform(found, one)

    pattern = run_pattern(motif)
    even = let(F.regexp_extract_all(seq, pattern, F.lit(0)), lambda f: let(F.split(seq, pattern), lambda g: placed(f, g)))
    return _either(motif, lambda: _scanned(seq, motif), even)


def longest_runs(found: Column) -> Column:
    """The runs by most copies, then start: the first is the LUS, the second the SLUS."""
    keyed = F.transform(found, lambda r: F.struct((-r["copies"]).alias("k"), r["start"].alias("s"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def lus_units(seq: Column, motif, strand="+") -> Column:
    k, turned = motif_length(motif), oriented(seq, strand)
    even = F.array_max(F.transform(F.regexp_extract_all(turned, run_pattern(motif), F.lit(0)), lambda r: (F.length(r) / k).cast("int")))
    return _either(motif, lambda: F.array_max(F.transform(_scanned(turned, motif), lambda r: r["copies"])), even)


def _island(seq: Column, motif) -> Column:
    """The core for motifs of any lengths: of islands of runs the first with most run bases."""

    def step(s: Column, r: Column) -> Column:
        near = (s["n"] > 0) & (r["start"] - s["end"] <= GAP)
        begin, bases = F.when(near, s["begin"]).otherwise(r["start"]), F.when(near, s["n"]).otherwise(0) + r["bp"]
        best = bases > s["most"]
        end = r["start"] + r["bp"]
        return F.struct(
            begin.alias("begin"), end.alias("end"), bases.alias("n"), F.greatest(s["most"], bases).alias("most"),
            F.when(best, begin).otherwise(s["from"]).alias("from"), F.when(best, end).otherwise(s["to"]).alias("to"),
        )

    state = F.struct(*(F.lit(0).alias(c) for c in ("begin", "end", "n", "most", "from", "to")))
    at = lambda s: F.when(s["most"] > 0, F.substring(seq, s["from"] + 1, s["to"] - s["from"]))
    return F.aggregate(_scanned(seq, motif), state, step, at)


def _core(seq: Column, motif) -> Column:
    pattern = run_pattern(motif)

    def heaviest(islands: Column) -> Column:
        weights = F.transform(islands, lambda g: F.length(g) - F.length(F.regexp_replace(g, pattern, F.lit(""))))
        return let(weights, lambda w: F.get(islands, F.array_position(w, F.array_max(w)).cast("int") - 1))

    even = let(F.regexp_extract_all(seq, core_pattern(motif), F.lit(0)), heaviest)
    return _either(motif, lambda: _island(seq, motif), even)


def repeat_core(seq: Column, motif, strand="+") -> Column:
    """The island of runs, gaps up to 12 bases, with most run bases; the whole sequence if it has no run."""
    return let(oriented(seq, strand), lambda s: F.coalesce(_core(s, motif), s))


def repeat_core_length(seq: Column, motif, strand="+") -> Column:
    """NULL if the sequence has no run."""
    return F.length(let(oriented(seq, strand), lambda s: _core(s, motif)))


def brackets(seq: Column, motif, strand="+") -> Column:
    """[TCTA]3 for three copies, TCTA for one, all else in lower case, by spaces.
    Verbatim if there is no motif."""
    k = motif_length(motif)
    whole = F.concat(F.lit("^(?:"), run_pattern(motif), F.lit(")$"))

    def token(t):
        run = F.when(F.length(t) == k, t).otherwise(F.concat(F.lit("["), F.substring(t, F.lit(1), k), F.lit("]"), (F.length(t) / k).cast("int").cast("string")))
        return F.when(F.regexp_like(t, whole), run).otherwise(F.lower(t))

    marked = F.regexp_replace(oriented(seq, strand), F.concat(F.lit("("), run_pattern(motif), F.lit(")")), F.lit(" $1 "))
    even = F.array_join(F.transform(F.filter(F.split(marked, " "), lambda t: t != ""), token), " ")
    whole_seq = _either(motif, lambda: let(oriented(seq, strand), lambda s: _bracketed(s, motif)), even)
    return F.when(F.coalesce(_col(motif), F.lit("")) == "", seq).when(seq == "", seq).otherwise(whole_seq)


def _bracketed(seq: Column, motif) -> Column:
    """The notation for motifs of any lengths: what lies before each run, the run, and the end."""
    between = lambda s, to: F.lower(F.substring(seq, s["at"] + 1, to - s["at"]))

    def step(s: Column, r: Column) -> Column:
        run = F.when(r["copies"] == 1, r["motif"]).otherwise(F.concat(F.lit("["), r["motif"], F.lit("]"), r["copies"].cast("string")))
        return F.struct((r["start"] + r["bp"]).alias("at"), F.concat(s["parts"], F.array(between(s, r["start"]), run)).alias("parts"))

    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(_scanned(seq, motif), state, step, lambda s: F.concat(s["parts"], F.array(between(s, F.length(seq)))))
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def repeat_summary(seq: Column, motif, strand="+") -> Column:
    """TCTAx4 + TCTGx1 (TR 64 bp)"""
    k = motif_length(motif)
    bp = F.length(seq).cast("string")
    turned = oriented(seq, strand)
    found = F.regexp_extract_all(turned, run_pattern(motif), F.lit(0))
    even = F.transform(found, lambda r: F.concat(F.substring(r, F.lit(1), k), F.lit("x"), (F.length(r) / k).cast("int").cast("string")))
    parts = _either(motif, lambda: F.transform(_scanned(turned, motif), lambda r: F.concat(r["motif"], F.lit("x"), r["copies"].cast("string"))), even)
    return (
        F.when(seq == "", F.lit(""))
        .when(F.coalesce(_col(motif), F.lit("")) == "", F.concat(bp, F.lit(" bp")))
        .when(F.size(parts) == 0, F.concat(F.lit("no motif match, "), bp, F.lit(" bp TR")))
        .otherwise(F.concat(F.array_join(parts, " + "), F.lit(" (TR "), bp, F.lit(" bp)")))
    )


def ce_from_brackets(notation: Column) -> Column:
    """Copies in brackets plus single motifs left over; NULL if there are none."""
    counted = F.aggregate(F.regexp_extract_all(notation, F.lit(r"\[[A-Z]+\](\d+)"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    single = F.regexp_count(F.regexp_replace(notation, r"\[[A-Z]+\]\d+", ""), F.lit("[A-Z]{2,}"))
    total = counted + single
    return F.when(total > 0, total.cast("double"))


def ce_from_length(bp: Column, period, corr=0) -> Column:
    """Whole repeats and left-over bases as a decimal digit: 39 bp of period 4 is 9.3."""
    n, p = bp - _col(corr), _col(period)
    return F.when(p > 0, F.round(F.floor(n / p) + F.pmod(n, p) / 10, 1).cast("double"))


def allele_numeric(bp: Column, period, corr, anchor, step, reference_ce) -> Column:
    """struct<value double, source string>"""
    ce = ce_from_length(bp, period, corr)
    units = (bp - _col(anchor)) / F.greatest(F.lit(1), _col(step))
    ref = _col(reference_ce)
    value = F.when(bp <= 0, F.lit(None)).when(_col(anchor).isNull(), F.lit(None)).when(ce.isNotNull(), ce).when(ref.isNotNull(), F.bround(ref + units, 2)).otherwise(F.bround(units, 2))
    source = F.when(bp <= 0, "deletion").when(_col(anchor).isNull(), "unavailable").when(ce.isNotNull(), "period_ce").when(ref.isNotNull(), "reference_offset").otherwise("delta_only")
    return F.struct(value.cast("double").alias("value"), source.alias("source"))


def allele_number(naming_ce, numeric, source, ce, bp) -> Column:
    """struct<number double, method string>: the first that applies of naming
    tool, calibrated number, bracket count, offset, size."""
    src = _col(source)
    kinds = [
        (naming_ce.isNotNull(), naming_ce, F.lit("strnaming")),
        (numeric.isNotNull() & src.isin("period_ce", "reference_offset"), numeric, src),
        ((src == "delta_only") & ce.isNotNull(), ce, F.lit("bracket_count")),
        (numeric.isNotNull() & (src == "delta_only"), numeric, F.lit("delta")),
        (ce.isNotNull(), ce, F.lit("bracket_count")),
        (bp > 0, bp.cast("double"), F.lit("bp_sizing")),
    ]
    number, method = F.lit(None).cast("double"), F.lit("none")
    for when, value, name in reversed(kinds):
        number, method = F.when(when, value.cast("double")).otherwise(number), F.when(when, name).otherwise(method)
    return F.struct(number.alias("number"), method.alias("method"))


def trimmed(x: Column) -> Column:
    """9.3, 14: four decimals at most, no zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x.cast("double")), "0+$", ""), r"\.$", "")


def number_label(number: Column, method: Column, notation: Column) -> Column:
    short = trimmed(number)
    return (
        F.when(number.isNull(), F.coalesce(notation, F.lit("")))
        .when(method == "delta", F.when(F.abs(number) > 1e-9, F.concat(F.lit("Δ"), short)).otherwise(short))
        .when(method == "bp_sizing", F.concat(number.cast("int").cast("string"), F.lit(" bp TR")))
        .otherwise(short)
    )


def identity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 0 if either is empty, 1 if equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def display_parts(seq: Column, motif, strand="+", flank: int = 12) -> Column:
    """struct<left, core, right>: the core and up to ``flank`` bases around it."""
    def cut(s: Column) -> Column:
        def around(core: Column) -> Column:
            at = F.position(core, s)
            left, right = F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(core), F.length(s))
            short_left = F.when(F.length(left) > flank, F.concat(F.lit("…"), F.right(left, F.lit(flank)))).otherwise(left)
            short_right = F.when(F.length(right) > flank, F.concat(F.left(right, F.lit(flank)), F.lit("…"))).otherwise(right)
            return F.struct(short_left.alias("left"), core.alias("core"), short_right.alias("right"))
        return let(F.coalesce(_core(s, motif), s), around)
    return let(oriented(seq, strand), cut)
