"""Command line: python -m tandemframe <command>. Status 2 for an error of input, 1 if some samples failed."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params as P
from .errors import SourceError, TandemError
from .operators import cohort as C
from .operators import evidence as E
from .operators import interpretation as I
from .operators import quality as Q
from .operators.consensus import Backend
from .plans import engine
from .sinks import exports, report
from .sources import bam, tables


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tandemframe").getOrCreate()
    bam.register(spark)
    return spark


def _panel(spark: SparkSession, path: str, coords: str = "bed0") -> DataFrame:
    return tables.load_panel_bed(spark, path, coords)[0] if path.endswith(".bed") else tables.load_panel(spark, path)


def _reads(spark: SparkSession, paths: list[str], panel: DataFrame, margin: int = P.FETCH_MARGIN, samples: dict[str, str] | None = None) -> DataFrame:
    """Reads of the panel's windows in one scan of all files; a panel's regions are
    pushed into the source. ``samples`` gives the sample id of a path."""
    spans = E.windows(panel).collect()
    regions = ",".join(f"{s.w_chrom}:{max(0, s.start0 - margin)}-{s.end0 + margin}" for s in spans)
    return spark.read.format("alignments").option("path", ",".join(paths)).option("regions", regions).option("samples", json.dumps(samples or {})).load()


def _params(args) -> P.Settings:
    return P.Settings(**{n: getattr(args, n, None) for n in P.THRESHOLDS})


def _run(spark, args, paths, samples=None, params=None) -> tuple[engine.RunFrames, DataFrame]:
    panel = _panel(spark, args.panel)
    catalog = tables.load_catalog(spark, args.catalog) if getattr(args, "catalog", None) else None
    ranges = tables.load_ranges(spark, args.ranges) if getattr(args, "ranges", None) else None
    model = exports.load_model(args.stutter_model) if getattr(args, "stutter_model", None) else P.StutterModel()
    reads = _reads(spark, paths, panel)
    return engine.run(reads, panel, params or _params(args), model, catalog, ranges, Backend, samples), panel


def interpret(spark, args) -> int:
    frames, panel = _run(spark, args, [args.bam])
    print(_params(args).text())
    for r in C.profile_rows(frames.loci).orderBy("sample", "marker_ord").toLocalIterator():
        print(f"{r.sample}\t{r.marker}\t{r.genotype}\t{r.call_rule}\t{r.called_reads}/{r.total_reads}\t{r.flags}")
    if args.trace:
        report.write_traces(report.trace(frames.alleles, E.funnel(frames.gate)), args.trace)
    for r in I.naming_fallbacks(frames.alleles).where("level = 'warning'").toLocalIterator():
        logging.getLogger("tandemframe").warning("a called number is not the naming tool's", extra=r.asDict())
    if args.out:
        exports.write_json(_records(frames, panel, args, _params(args)), args.out)
        if args.pretty:
            exports.write_pretty(spark.read.json(args.out), args.pretty)
    return 0


def _records(frames, panel, args, params) -> DataFrame:
    """Run records with the marker definitions, thresholds, audit, and digests of what was read."""
    inputs = [(role, path, Q.file_sha256(path)) for role, path in (("bam", args.bam), ("panel", args.panel), ("catalog", getattr(args, "catalog", None))) if path and os.path.exists(path)]
    return exports.run_records(frames.loci, frames.alleles, {"run_id": "", "poa_backend": Backend.name}, panel, params, inputs)


def evidence(spark, args) -> int:
    frames, _ = _run(spark, args, [args.bam])
    exports.write_csv(exports.evidence_table(frames.alleles), args.out)
    return 0


def export(spark, args) -> int:
    frames, panel = _run(spark, args, [args.bam])
    out = exports.ensure_folder(args.out)
    kinds = args.formats.split(",")
    if "json" in kinds:
        exports.write_json(_records(frames, panel, args, P.Settings()), f"{out}/json")
    if "csv" in kinds:
        exports.write_csv(exports.profile_table(frames.loci, panel), f"{out}/profile")
        exports.write_csv(exports.evidence_table(frames.alleles), f"{out}/evidence")
        exports.write_csv(exports.sequence_table(frames.alleles), f"{out}/sequences")
    if "xlsx" in kinds:
        exports.write_xlsx(f"{out}/run.xlsx", exports.run_sheets(frames.loci, frames.alleles, Q.audit_frame(frames.loci, P.Settings())))
    if "vcf" in kinds:
        if not args.reference:
            raise SourceError("a VCF needs --reference")
        contigs = fasta(args.reference)
        rows = [(p.name, k, contigs[p.chromosome][p.ref_start - 1 : p.ref_end]) for p in panel.collect() for k, c in enumerate(contigs) if c == p.chromosome]
        refs = spark.createDataFrame(rows, "marker string, contig_ord int, ref string")
        for s in frames.loci.select("sample_id").distinct().collect():
            exports.write_vcf(exports.vcf_rows(frames.loci, panel, refs), s.sample_id, [(c, len(x)) for c, x in contigs.items()], f"{out}/{s.sample_id}.vcf")
    return 0


def fasta(path: str) -> dict[str, str]:
    out: dict[str, list[str]] = {}
    name = None
    for line in tables.read_text(path).splitlines():
        if line.startswith(">"):
            name = line[1:].split()[0]
            out[name] = []
        elif name is not None:
            out[name].append(line.strip().upper())
    return {k: "".join(v) for k, v in out.items()}


def make_report(spark, args) -> int:
    frames, _ = _run(spark, args, [args.bam])
    sample = frames.loci.select("sample_id").head()
    if sample is None:
        raise SourceError("no reads")
    with open(args.out, "w", encoding="utf-8") as f:
        f.write(report.sample_report(frames.loci, sample.sample_id))
    return 0


def batch(spark, args) -> int:
    """All samples of a manifest in one plan; a file that can't be read fails alone."""
    manifest = tables.load_manifest(spark, args.manifest).collect()
    good, status = [], []
    def problem(path: str) -> str:
        try:
            if tables.detect(path)["kind"] != "bam":
                raise SourceError(f"{path}: not BAM")
            tables.checked_header(path)
        except (TandemError, OSError) as e:
            return str(e)
        return ""

    with ThreadPoolExecutor(bam.PLANNERS) as pool:  # headers only; no job is run for a file
        found = list(pool.map(problem, [m.bam for m in manifest]))
    for m, error in zip(manifest, found, strict=True):
        status.append((m.sample_id, m.role, "error" if error else "ok", error))
        good += [] if error else [m]
    out = exports.ensure_folder(args.out)
    states = spark.createDataFrame(status, "sample_id string, role string, status string, error string")
    if good:
        samples = spark.createDataFrame([(m.sample_id,) for m in good], "sample_id string")
        panel = _panel(spark, args.panel)
        # the manifest decides the sample here, not the read groups
        reads = _reads(spark, [m.bam for m in good], panel, samples={m.bam: m.sample_id for m in good})
        frames = engine.run(reads, panel, _params(args), samples=samples)
        loci = frames.loci.cache()
        markers = [r.name for r in panel.orderBy("marker_ord").collect()]
        exports.write_csv(states.join(C.batch_summary(loci, markers), "sample_id", "left").orderBy("sample_id").coalesce(1), f"{out}/batch_summary")
        exports.write_tidy(C.tidy(loci), f"{out}/tidy")
        exports.write_json(exports.run_records(loci, frames.alleles, panel=panel, params=_params(args)), f"{out}/json")
        if len(good) >= 2:
            exports.write_xlsx(f"{out}/cohort.xlsx", exports.cohort_sheets(loci))
            with open(f"{out}/cohort.html", "w", encoding="utf-8") as f:
                f.write(report.cohort_report(loci))
    return 1 if any(s[2] == "error" for s in status) else 0


def tidy(spark, args) -> int:
    records = spark.read.json(args.runs)
    if "results" not in records.columns:
        raise SourceError(f"{args.runs}: no run records")
    loci = records.select("sample_id", F.explode("results").alias("r")).select("sample_id", "r.*").withColumn("needs_review", F.exists("flags", lambda f: f["severity"].isin("warn", "error")))
    exports.write_tidy(C.tidy(loci), args.out, "csv" if args.out.endswith(".csv") else "parquet")
    return 0


def inspect(spark, args) -> int:
    for k, v in tables.detect(args.path).items():
        print(f"{k}\t{v}")
    return 0


def doctor(spark, args) -> int:
    """Environment; with a file, phasing of the first loci and coverage by marker."""
    print(f"spark\t{spark.version}\npython\t{sys.version.split()[0]}\nconsensus\t{Backend.name}")
    for name in ("yaml", "numpy", "pandas", "pyarrow"):
        print(f"{name}\t{'yes' if __import__('importlib.util').util.find_spec(name) else 'missing'}")
    if args.bam and args.panel:
        panel = _panel(spark, args.panel)
        contigs = spark.createDataFrame([(n,) for n, _ in bam.header(args.bam)[1]], "name string")
        for r in tables.missing_contigs(panel, contigs).orderBy("chromosome").collect():
            print(f"contig that the file lacks\t{r.chromosome}\tother prefix: {r.other_prefix}")
        gate = E.gated(_reads(spark, [args.bam], panel), panel, P.Settings())
        low = P.Settings()["min_mapq"]
        per = gate.groupBy("marker", "marker_ord").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("mapq") >= low).alias("n"), F.count_if(F.col("hp").isNotNull()).alias("hp"), F.count_distinct("ps").alias("ps"))
        for r in panel.select(F.col("name").alias("marker")).join(per, "marker", "left").orderBy("marker_ord").collect():
            n = r.n or 0
            print(f"{r.marker}\t{r['all'] or 0}\t{n}\tHP {r.hp or 0}\tPS {r.ps or 0}\t{'no reads' if not n else 'low cov' if n < 10 else 'ok'}")
    return 0


def calibrate_stutter(spark, args) -> int:
    frames, _ = _run(spark, args, args.bams)
    obs = C.stutter_observations(frames.alleles).cache()
    for r in C.stutter_summary(obs).orderBy("level", "key").collect():
        print(f"{r.level}\t{r.key}\t{r.n}\t{r.ratio}\t{r.n_zero}")
    model = C.fitted_model(obs)
    print(model.describe())
    exports.dump_model(model, args.out)
    return 0


def calibrate_panel(spark, args) -> int:
    """Repeats that a bracket count has to leave out, by the reference."""
    contigs = spark.createDataFrame(list(fasta(args.reference).items()), "name string, seq string")
    for r in C.calibrated_panel(_panel(spark, args.panel), contigs).orderBy("marker_ord").collect():
        print(f"{r.name}\t{r.corr_value}\t{r.core_units}\t{r.raw_ce}\t{r.ref_isfg}")
    return 0


def cohort(spark, args) -> int:
    """Chosen alignment of each wanted sample of a listing, a manifest and windows to fetch."""
    listing = spark.read.text(args.listing).select(F.col("value").alias("path")).where("path <> ''")
    wanted = spark.read.text(args.samples).select(C.canonical_sample_id(F.col("value")).alias("sample_id")).where("sample_id <> ''")
    chosen, missing = C.select_cohort(listing, wanted)
    out = exports.ensure_folder(args.out)
    with open(f"{out}/manifest.tsv", "w", encoding="utf-8") as f:
        f.write("sample_id\tbam\n" + "".join(f"{r.sample_id}\t{r.path}\n" for r in chosen.orderBy("sample_id").toLocalIterator()))
    with open(f"{out}/slices.bed", "w", encoding="utf-8") as f:
        f.write("".join(f"{r.chrom}\t{r.start}\t{r.end}\t{r.name}\n" for r in exports.slice_bed(_panel(spark, args.panel)).orderBy("marker_ord", "name").toLocalIterator()))
    for r in missing.orderBy("sample_id").collect():
        print(f"missing\t{r.sample_id}")
    return 0


def compare(spark, args) -> int:
    summary = spark.read.option("header", True).csv(args.summary).where("status = 'ok'")
    markers = [c for c in summary.columns if c not in ("sample_id", "role", "status", "error")]
    called = C.called_long(summary.select("sample_id", *markers), markers)
    rows = C.compare(called, tables.load_truth(spark, args.truth), args.technology).cache()
    for r in C.concordance(rows).orderBy(F.col("marker").isNull(), "marker").collect():
        print(f"{r.marker or 'TOTAL'}\t{r['match']}\t{r.mismatch}\t{r.no_call}\t{r.no_truth}\t{'' if r.concordance is None else f'{r.concordance:.3f}'}")
    for r in C.discordances(rows, args.show).collect():
        print(f"{r.sample_id}\t{r.marker}\t{'/'.join(r.called or []) or '—'}\t{'/'.join(r.truth or []) or '—'}\t{r.verdict}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tandemframe")
    commands = top.add_subparsers(required=True)

    def command(name, run, *positional):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for p in positional:
            c.add_argument(p, nargs="+" if p in ("bams", "runs") else None)
        return c

    def inputs(c, one: bool = True):
        if one:
            c.add_argument("--bam", required=True)
        c.add_argument("--panel", required=True)
        c.add_argument("--catalog")
        c.add_argument("--ranges")
        c.add_argument("--stutter-model")
        return c

    def tuned(c):
        for name, rule in P.THRESHOLDS.items():
            c.add_argument(f"--{name.replace('_', '-')}", type=type(rule.default), help=f"{rule.about} ({rule.default}, {rule.basis})")
        return c

    command("inspect", inspect, "path")
    c = tuned(inputs(command("interpret", interpret)))
    c.add_argument("--out")
    c.add_argument("--pretty")
    c.add_argument("--trace")
    inputs(command("evidence", evidence)).add_argument("--out", required=True)
    c = inputs(command("export", export))
    c.add_argument("--out", required=True)
    c.add_argument("--formats", default="json,csv")
    c.add_argument("--reference")
    inputs(command("report", make_report)).add_argument("--out", required=True)
    c = tuned(command("batch", batch, "manifest"))
    c.add_argument("--panel", required=True)
    c.add_argument("--out", required=True)
    c = command("tidy", tidy, "runs")
    c.add_argument("--out", required=True)
    c = command("doctor", doctor)
    c.add_argument("--bam")
    c.add_argument("--panel")
    c = inputs(command("calibrate-stutter", calibrate_stutter, "bams"), one=False)
    c.add_argument("--out", required=True)
    c = command("calibrate-panel", calibrate_panel)
    c.add_argument("--panel", required=True)
    c.add_argument("--reference", required=True)
    c = command("cohort", cohort)
    for name in ("listing", "samples", "panel", "out"):
        c.add_argument(f"--{name}", required=True)
    c = command("compare", compare, "summary", "truth")
    c.add_argument("--technology", default="ILLUMINA")
    c.add_argument("--show", type=int, default=20)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(session(), args)
    except (TandemError, OSError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    os._exit(main())
