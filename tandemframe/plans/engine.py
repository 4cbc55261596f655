"""The whole analysis as one lazy plan: reads and a panel in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import interpretation as I
from ..operators import quality as Q
from ..operators.consensus import Backend
from ..operators.sizes import sent
from ..params import Settings, StutterModel

#: The contigs of at most so many sex markers' windows become a filter on the reads.
SEX_CONTIGS = 100


@dataclass
class RunFrames:
    gate: DataFrame | None
    observations: DataFrame
    clusters: DataFrame
    alleles: DataFrame
    loci: DataFrame
    sex: DataFrame | None = None


def interpret(clusters: DataFrame, panel: DataFrame, params: Settings = Settings(), model: StutterModel = StutterModel(), catalog: DataFrame | None = None, ranges: DataFrame | None = None, namer=None) -> DataFrame:
    """Cluster rows with everything that is decided about them and their locus.
    Order: name, stutter, status, phantoms, catalog, call."""
    rows = I.with_fraction(I.named(clusters, panel, ranges, namer))
    rows = I.with_stutter(rows, model).withColumn("status", I.status(params))
    rows = I.annotated(I.suppress_phantoms(rows), catalog)
    return I.called_alleles(rows, params)


def all_loci(loci: DataFrame, samples: DataFrame, panel: DataFrame) -> DataFrame:
    """Every sample at every marker of the panel: loci without reads come back as no_data."""
    markers = panel.select(F.col("name").alias("marker"), F.col("marker_ord").alias("_ord"), F.col("category").alias("_cat"), F.col("kit_nomenclature_note").alias("_note"))
    grid = samples.crossJoin(sent(markers, panel))
    kind = loci.schema["alleles_called"].dataType.simpleString()
    rows = grid.join(loci, ["sample_id", "marker"], "left")
    return rows.withColumns({
        "marker_ord": F.col("_ord"), "category": F.col("_cat"), "kit_nomenclature_note": F.col("_note"), "call_rule": F.coalesce("call_rule", F.lit("no_data")), "tri_type": F.coalesce("tri_type", F.lit("")),
        "alleles_called": F.coalesce("alleles_called", F.array().cast(kind)), **{c: F.coalesce(c, F.lit(0)) for c in ("total_reads", "called_reads", "n_phantoms", "n_split", "n_failed")},
    }).drop("_ord", "_cat", "_note")


def run(reads: DataFrame, panel: DataFrame, params: Settings = Settings(), model: StutterModel = StutterModel(), catalog: DataFrame | None = None, ranges: DataFrame | None = None, backend=Backend, samples: DataFrame | None = None, namer=None, strict: bool = False) -> RunFrames:
    """Nothing is computed until a table of the result is used.

    One sample failing to be read is the source's concern: it hands on what it
    could read. A sample given in ``samples`` without reads has no_data throughout.
    A locus whose clustering fails ends the job if ``strict``; else it has no call,
    a cluster row of the method ``failed``, n_failed of 1 and a flag that says so.
    """
    n_windows = E.windows(panel).count()
    sexed = panel.where("marker_type = 'amel'")
    contigs = [r.w_chrom for r in E.windows(sexed).select("w_chrom").distinct().limit(SEX_CONTIGS + 1).collect()]
    near = reads.where(F.col("chrom").isin(contigs)) if len(contigs) <= SEX_CONTIGS else reads  # told before the join, so that no other read is put together for it
    gate, repeats, letters = (E.gated(rows, part, params, n_windows) for rows, part in ((reads, panel), (reads, panel.where("marker_type <> 'amel'")), (near, sexed)))
    obs = E.observations(repeats)
    clusters = E.full_clusters(obs, panel, params, backend, strict)
    alleles = interpret(clusters, panel, params, model, catalog, ranges, namer)
    samples = reads.select("sample_id").distinct() if samples is None else samples
    sex = I.sex_calls(letters, panel, samples)
    if contigs:  # the sex marker is a locus like any other in all that follows
        alleles = alleles.unionByName(I.sex_alleles(sex, alleles))
    loci = Q.flagged(all_loci(Q.locus_summary(alleles), samples, panel), params)
    return RunFrames(gate, obs, clusters, alleles, loci, sex)
