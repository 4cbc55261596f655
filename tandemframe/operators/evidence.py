"""Evidence: reads on windows, why reads are rejected, clusters of observations.

All of it is keyed by (sample_id, marker); the panel is broadcast where its size,
which is checked, allows it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvidenceError
from ..functions import sequence as S
from ..functions.scan import averaged, find_runs, located
from ..params import FETCH_MARGIN, GAP, REFINE_PASSES, Settings
from ..schemas import CLUSTERS, REASONS
from .consensus import Backend, by_counts, consensus_of, consensus_of_counts
from .sizes import sent

#: A panel of more windows than this is joined by genome bin instead of broadcast.
BROADCAST_WINDOWS = 10_000
_BIN = 16_384
#: So many results of one comparison or scan are kept for the loci after it.
KEPT = 50_000
#: The consensus method of a locus whose clustering failed.
FAILED = "failed"


def windows(panel: DataFrame) -> DataFrame:
    """One row for each window (half-open, from 0): a marker's own and, for sex markers, that on Y."""
    own = panel.select(F.col("name").alias("marker"), "marker_ord", F.lit("own").alias("window"), F.col("chromosome").alias("w_chrom"), (F.col("ref_start") - 1).alias("start0"), F.col("ref_end").alias("end0"))
    y = panel.where("y_chromosome is not null and y_ref_start is not null and y_ref_end is not null").select(
        F.col("name").alias("marker"), "marker_ord", F.lit("y").alias("window"), F.col("y_chromosome").alias("w_chrom"), (F.col("y_ref_start") - 1).alias("start0"), F.col("y_ref_end").alias("end0")
    )
    return own.unionByName(y)


def fetched(reads: DataFrame, spans: DataFrame, n_windows: int | None = None, margin: int = FETCH_MARGIN) -> DataFrame:
    """Reads that overlap a window widened by ``margin``: the range join.

    Contig equality is the hash key, the bounds are the residual condition. A
    panel of more than ``BROADCAST_WINDOWS`` windows is joined by (contig,
    16 kb bin) instead: both sides shuffle on the bin, every pair is met in the
    first bin that both cover.
    """
    low, high = F.greatest(F.lit(0), F.col("start0") - margin), F.col("end0") + margin
    end = F.coalesce(F.col("ref_end"), F.col("ref_start") + 1)
    overlap = (F.col("ref_start") < high) & (end > low)
    if (n_windows if n_windows is not None else spans.count()) <= BROADCAST_WINDOWS:
        return reads.join(F.broadcast(spans), (F.col("chrom") == F.col("w_chrom")) & overlap)
    binned = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(F.floor(a / _BIN), F.floor(F.greatest(a, b - 1) / _BIN))))
    left = binned(reads, F.col("ref_start"), end)
    right = binned(spans, low, high).withColumnRenamed("bin", "w_bin")
    first = F.greatest(F.floor(F.col("ref_start") / _BIN), F.floor(low / _BIN))
    return left.join(right, (F.col("chrom") == F.col("w_chrom")) & (F.col("bin") == F.col("w_bin")) & (F.col("bin") == first) & overlap).drop("bin", "w_bin")


def reject_reason(params: Settings) -> Column:
    """The first gate a fetched read fails, all but the last; NULL if it passes."""
    anchor = params["flank_anchor"]
    return (
        F.when(F.col("flag").bitwiseAND(F.lit(0x904)) != 0, "not_primary")
        .when(F.col("mapq") < params["min_mapq"], "low_mapq")
        .when(F.col("ref_end").isNull(), "no_alignment_end")
        .when(F.col("ref_start") > F.col("start0") - anchor, "left_flank_short")
        .when(F.col("ref_end") < F.col("end0") + anchor, "right_flank_short")
        .when(F.coalesce(F.length("seq"), F.lit(0)) == 0, "no_sequence")
    )


def window_on_read(cigar: Column, ref_start: Column, start: Column, end: Column) -> Column:
    """struct<from, to> in the read of reference window [start, end): from the first
    aligned base at or after start to the base at end, or past the last aligned one
    before it; NULL if there are none. ``scan.locate_window`` by batches of reads."""
    return located()(cigar, ref_start.cast("int"), start.cast("int"), end.cast("int"))


def gated(reads: DataFrame, panel: DataFrame, params: Settings, n_windows: int | None = None) -> DataFrame:
    """Fetched reads with reason and, of those that pass, the window's sequence and mean quality.

    Every fetched read that passes the cheap gates is walked, whatever is filtered
    afterwards: a caller that needs some markers gives their part of the panel.
    """
    found = fetched(reads, windows(panel), n_windows).withColumn("reason", reject_reason(params))

    # only reads that passed the cheap gates have their alignment walked
    walked = window_on_read(F.when(F.col("reason").isNull(), F.col("cigar")), F.col("ref_start"), F.col("start0"), F.col("end0"))
    found = found.withColumn("at", walked)
    lost = F.col("reason").isNull() & F.col("at.from").isNull()
    found = found.withColumn("reason", F.when(lost, "window_unlocatable").otherwise(F.col("reason")))
    passed = F.col("reason").isNull()
    size = F.col("at.to") - F.col("at.from")
    mean = averaged()(F.when(passed, F.slice("qual", F.col("at.from") + 1, size)))
    return found.withColumns({
        "sequence": F.when(passed, F.upper(F.substring("seq", F.col("at.from") + 1, size))),
        "mean_qual": F.when(passed, F.coalesce(mean, F.lit(0.0))),
    }).drop("at")


def funnel(gate: DataFrame, keys=("sample_id", "marker")) -> DataFrame:
    """Reads by reject reason, zeros included, with ``kept`` beside the reasons:
    one aggregate, whose columns become rows."""
    names = ("kept", *REASONS)
    reason = F.coalesce("reason", F.lit("kept"))
    counts = gate.groupBy(*keys).agg(*(F.count_if(reason == r).alias(f"_{k}") for k, r in enumerate(names)))
    told = F.array(*(F.struct(F.lit(k).alias("reason_ord"), F.lit(r).alias("reason"), F.col(f"_{k}").alias("n")) for k, r in enumerate(names)))
    return counts.select(*keys, F.explode(told).alias("f")).select(*keys, "f.*")


def observations(gate: DataFrame) -> DataFrame:
    tagged = F.when(F.col("hp").isin(1, 2), F.col("hp"))
    return gate.where("reason is null and window = 'own'").select(
        "sample_id", "marker", "read_ord", F.col("qname").alias("read_id"), "sequence", tagged.alias("hp"),
        F.when(tagged.isNotNull(), F.col("ps")).alias("ps"), "mean_qual", F.when(F.col("flag").bitwiseAND(F.lit(0x10)) != 0, "-").otherwise("+").alias("strand"),
    )


def sequence_counts(obs: DataFrame, *more: Column) -> DataFrame:
    """One row for each distinct sequence of a locus, an empty one for each read:
    reads by tag and strand, the sum of their quality, phase blocks of tagged ones.
    Counted by block first, where plain sums do; ``more`` are aggregates with a
    name that starts with _ids, whose arrays are put together."""
    block = F.when(F.col("hp").isNotNull(), F.col("ps"))
    alone = F.when(F.col("sequence") == "", F.col("read_ord"))
    keys = ("sample_id", "marker", "sequence", "_alone")
    counted = obs.withColumns({"_block": block, "_alone": alone}).groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("read_ord").alias("first_ord"), F.count_if(F.col("hp") == 1).alias("hp1"), F.count_if(F.col("hp") == 2).alias("hp2"),
        F.count_if(F.col("hp").isNull()).alias("hp0"), F.count_if(F.col("strand") == "+").alias("fwd"), F.count_if(F.col("strand") == "-").alias("rev"),
        F.sum("mean_qual").alias("q"), *more,
    )
    joined = [F.flatten(F.collect_list(c)).alias(c) for c in counted.columns if c.startswith("_ids")]
    return counted.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("n", "hp1", "hp2", "hp0", "fwd", "rev", "q")), F.min("first_ord").alias("first_ord"), F.collect_set("_block").alias("blocks"), *joined,
    ).drop("_alone")


def quick_clusters(obs: DataFrame, motif: Column | str, marker_strand: Column | str = "+") -> DataFrame:
    """Clusters by repeat-core length alone, each with its most frequent sequence
    (first read on a tie) as consensus: exact where reads differ only in copies.

    Reads are counted by sequence first, so that a sequence's core is looked for
    once a locus. One exchange by locus; the bins, their order and all later
    windows reuse it.
    """
    by_seq = sequence_counts(obs).withColumn("bin", F.coalesce(S.repeat_core_length(F.col("sequence"), motif, marker_strand), F.length("sequence")))
    merged = by_seq.groupBy("sample_id", "marker", "bin").agg(
        F.max_by("sequence", F.struct("n", (-F.col("first_ord")).alias("o"))).alias("consensus"), F.min("first_ord").alias("first_ord"),
        *(F.sum(c).cast("int").alias(name) for c, name in (("n", "n_reads"), ("hp1", "n_hp1"), ("hp2", "n_hp2"), ("hp0", "n_hp_none"), ("fwd", "n_forward"), ("rev", "n_reverse"))),
        (F.sum("q") / F.sum("n")).alias("mean_qual"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"),
    )
    order = Window.partitionBy("sample_id", "marker").orderBy(F.desc("n_reads"), "first_ord")
    return merged.select(
        "sample_id", "marker", (F.row_number().over(order) - 1).alias("cluster_index"), "consensus", F.when(F.col("n_reads") == 1, "single").otherwise("mode").alias("consensus_method"),
        "n_reads", "n_hp1", "n_hp2", "n_hp_none", "n_forward", "n_reverse", "mean_qual", F.when(F.size("blocks") == 1, F.get("blocks", 0)).alias("phase_set"), F.size("blocks").alias("n_phase_sets"),
    )


def core_length(seq: str, motifs: list[str], strand: str) -> int | None:
    """Length of the heaviest island of motif runs, for motifs of any lengths."""
    if strand == "-":
        seq = seq[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    best, island = (0, None), None
    for start, _, _, bp in find_runs(seq, motifs):
        if island and start - island[1] <= GAP:
            island = (island[0], start + bp, island[2] + bp)
        else:
            island = (start, start + bp, bp)
        if island[2] > best[0]:
            best = (island[2], island)
        elif best[1] and best[1][0] == island[0]:
            best = (island[2], island)
    return None if best[1] is None else best[1][1] - best[1][0]


def edits(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; anything above ``most`` if it is more than that. A
    column of the table is a pair of bit vectors, moved by whole-number arithmetic."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not a or most is not None and len(b) - len(a) > most:
        return len(b)
    at: dict[str, int] = {}
    for k, base in enumerate(a):
        at[base] = at.get(base, 0) | 1 << k
    mask, top, distance, left = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a), len(b)
    up, down = mask, 0  # rows where the column grows, or falls, by one
    for base in b:
        same = at.get(base, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, back = (down | ~(diagonal | up)) & mask, up & diagonal
        distance += bool(right & top) - bool(back & top)
        left -= 1
        if most is not None and distance - left > most:
            return most + 1
        right = right << 1 | 1
        back <<= 1
        settled = same | down
        up, down = (back | ~(settled | right)) & mask, right & settled & mask
    return distance


def likeness(a: str, b: str, least: float = 0.0) -> float:
    """1 - edits / longer length; some value below ``least`` if it is less than that."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b))
    return 1.0 if a == b else 1 - edits(a, b, int((1 - least) * longer) + 1) / longer


class LocusClusterer:
    """Reads of one locus, in read order, into clusters.

    Bins of one repeat-core length; in a bin, reads join the first remaining
    read they are alike enough with, and move to that cluster of their bin whose
    consensus they are nearest to, for a few passes. So a read of another length
    is never absorbed. Clusters of one consensus merge, whatever their bin.
    """

    def __init__(self, motifs: list[str], strand: str, threshold: float, tolerance: int, backend: Backend):
        if not 0 < threshold <= 1:
            raise EvidenceError("identity_threshold must be within 0 and 1")
        if tolerance < 0:
            raise EvidenceError("len_tolerance_bp must not be negative")
        self.motifs, self.strand, self.threshold, self.tolerance, self.backend = motifs, strand, threshold, tolerance, backend
        self._alike: dict[tuple[str, str], float] = {}
        self._cores: dict[str, int | None] = {}

    def alike(self, a: str, b: str) -> float:
        key = (a, b) if a <= b else (b, a)
        found = self._alike.get(key)
        if found is None:
            if len(self._alike) >= KEPT:
                self._alike.clear()
            found = self._alike[key] = likeness(a, b, self.threshold)
        return found

    def core(self, seq: str) -> int | None:
        if seq not in self._cores:
            if len(self._cores) >= KEPT:
                self._cores.clear()
            self._cores[seq] = core_length(seq, self.motifs, self.strand)
        return self._cores[seq]

    def bins(self, seqs: list[str]) -> list[list[int]]:
        keyed: dict[int, list[int]] = {}
        for i, s in enumerate(seqs):
            core = self.core(s) if self.motifs else None
            keyed.setdefault(len(s) if core is None else core, []).append(i)
        if not self.tolerance:
            return list(keyed.values())
        merged: list[list[int]] = []
        anchor = None
        for key in sorted(keyed):
            if anchor is not None and key <= anchor + self.tolerance:
                merged[-1] = sorted(merged[-1] + keyed[key])
            else:
                merged.append(keyed[key])
                anchor = key
        return merged

    def seeded(self, own: list[int], seqs: list[str]) -> list[list[int]]:
        out = []
        while own:
            seed = seqs[own[0]]
            near = [i for i in own if i == own[0] or self.alike(seed, seqs[i]) >= self.threshold]
            out.append(near)
            taken = set(near)
            own = [i for i in own if i not in taken]
        return out

    def refined(self, clusters, seqs, counts, polished):
        """(members, consensus, method) of a bin after moving reads to nearer
        consensuses. Only clusters of two reads and more attract, the larger one on a
        tie; a read that is alike enough to none stays."""
        if len(clusters) < 2:
            return clusters
        reads = lambda c: sum(counts[i] for i in c[0])
        for _ in range(REFINE_PASSES):
            attractors = sorted((k for k, c in enumerate(clusters) if reads(c) >= 2 and c[1]), key=lambda k: -reads(clusters[k]))
            if not attractors:
                break
            home = {i: k for k, c in enumerate(clusters) for i in c[0]}
            target = {}
            for i, own in home.items():
                best, at = max(((self.alike(seqs[i], clusters[k][1]), -n) for n, k in enumerate(attractors)))
                target[i] = attractors[-at] if best >= self.threshold else own
            if target == home:
                break
            members: dict[int, list[int]] = {}
            for i in sorted(target):
                members.setdefault(target[i], []).append(i)
            clusters = [clusters[k] if clusters[k][0] == own else (own, *polished(own)) for k, own in sorted(members.items())]
        return clusters

    def __call__(self, seqs: list[str], counts: list[int] | None = None, reads: list[list[int]] | None = None) -> list[tuple[list[int], str, str]]:
        """(members, consensus, method), the cluster of most reads first. With
        ``counts``, ``seqs`` are distinct (but for empty ones), in the order of
        their first reads, and members are places in ``seqs``; ``reads`` are then
        the ordinals of each one's reads, for backends that go by every read."""
        if counts is None:
            at: dict = {}
            for i, s in enumerate(seqs):
                at.setdefault(s or i, []).append(i)
            groups = list(at.values())
            found = self([seqs[g[0]] for g in groups], [len(g) for g in groups], groups)
            return [(sorted(i for k in members for i in groups[k]), consensus, method) for members, consensus, method in found]

        def polished(own: list[int]) -> tuple[str, str]:
            if by_counts(self.backend):
                return consensus_of_counts({seqs[k]: counts[k] for k in own}, self.backend)
            return consensus_of([seqs[k] for _, k in sorted((i, k) for k in own for i in reads[k])], self.backend)

        clusters = []
        for own in self.bins(seqs):
            split = [(g, *polished(g)) for g in self.seeded(own, seqs)]
            clusters += self.refined(split, seqs, counts, polished)
        by_consensus: dict = {}
        for n, c in enumerate(clusters):
            key = c[1] if c[1] else n  # empty ones never merge
            if key in by_consensus:
                old = by_consensus[key]
                by_consensus[key] = (sorted(old[0] + c[0]), old[1], old[2])
            else:
                by_consensus[key] = c
        return sorted(by_consensus.values(), key=lambda c: -sum(counts[i] for i in c[0]))


def full_clusters(obs: DataFrame, panel: DataFrame, params: Settings, backend: Callable[[], Backend] | None = None, strict: bool = True) -> DataFrame:
    """Clusters of every locus by ``LocusClusterer``, from its distinct sequences and
    their counts; Python sees nothing else of the reads.

    A locus whose clustering fails ends the job, with its name. If not ``strict``
    the run goes on: the failure is logged where it happened, and the locus has
    one row without consensus and reads whose method is ``failed``.
    """
    threshold, tolerance = params["identity_threshold"], params["len_tolerance_bp"]
    backend = backend or Backend
    tried = backend()
    LocusClusterer([], "+", threshold, tolerance, tried)  # what is wrong with the settings fails here
    every_read = not by_counts(tried)
    made: dict = {}

    def of_locus(sample, marker, motif, strand, own_tolerance, seqs, counts, reads=None):
        try:
            key = (motif, strand, own_tolerance)
            if key not in made:
                made[key] = LocusClusterer([m for m in (motif or "").split(",") if m], strand, threshold, int(own_tolerance or 0) or tolerance, backend())
            return [(k, consensus, method, members) for k, (members, consensus, method) in enumerate(made[key](seqs, counts, reads))]
        except Exception as e:
            if strict:
                raise EvidenceError(f"sample {sample}, marker {marker}: clustering failed, {type(e).__name__}: {e}") from e
            logging.getLogger("tandemframe").exception("sample %s, marker %s: clustering failed", sample, marker)
            return [(0, None, FAILED, [])]

    found = F.udf(of_locus, "array<struct<index:int,consensus:string,method:string,members:array<int>>>", useArrow=False)
    # what nothing uses, as a rule the reads' names, is pruned from the aggregates
    by_seq = sequence_counts(obs, F.collect_list(F.struct("read_ord", "read_id")).alias("_ids"), F.collect_list("read_ord").alias("_ids_ord"))
    sums = ("n", "hp1", "hp2", "hp0", "fwd", "rev", "q")
    gathered = lambda *c: F.sort_array(F.collect_list(F.struct("first_ord", "sequence", *c)))
    loci = by_seq.groupBy("sample_id", "marker").agg(gathered(*sums, "blocks").alias("s"), gathered("_ids").alias("ids"), gathered("_ids_ord").alias("ords"))
    columns = panel.select(F.col("name").alias("marker"), "motif", F.col("strand").alias("marker_strand"), "ont_len_tolerance")
    loci = loci.join(sent(columns, panel), "marker")
    given = ["sample_id", "marker", "motif", "marker_strand", "ont_len_tolerance", F.col("s.sequence"), F.col("s.n").cast("array<int>"), *([F.col("ords._ids_ord")] if every_read else [])]
    rows = loci.select("sample_id", "marker", "s", "ids", F.explode(found(*given)).alias("c"))
    own = F.transform("c.members", lambda i: F.get("s", i))
    total = F.aggregate(
        own, F.struct(*(F.lit(0.0 if k == "q" else 0).cast("double" if k == "q" else "long").alias(k) for k in sums)),
        lambda a, x: F.struct(*((a[k] + x[k]).alias(k) for k in sums)),
    )
    blocks = F.array_distinct(F.flatten(F.transform(own, lambda x: x["blocks"])))
    ids = F.flatten(F.transform("c.members", lambda i: F.get("ids", i)["_ids"]))
    rows = rows.withColumns({"t": total, "b": blocks})
    told = {
        "cluster_index": F.col("c.index"), "consensus": F.col("c.consensus"), "consensus_method": F.col("c.method"), "n_reads": F.col("t.n"), "n_hp1": F.col("t.hp1"), "n_hp2": F.col("t.hp2"), "n_hp_none": F.col("t.hp0"),
        "n_forward": F.col("t.fwd"), "n_reverse": F.col("t.rev"), "mean_qual": F.when(F.col("t.n") > 0, F.col("t.q") / F.col("t.n")), "phase_set": F.when(F.size("b") == 1, F.get("b", 0)), "n_phase_sets": F.size("b"),
        "read_ids": F.transform(F.sort_array(ids), lambda x: x["read_id"]),
    }
    return rows.select(*(told.get(c, F.col(c)).cast(kind).alias(c) for c, kind in (x.split() for x in CLUSTERS.split(", "))))
