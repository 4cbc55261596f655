"""Records, tables and variants written from a run's frames."""

from __future__ import annotations

import json
import os
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ReportError
from ..operators import cohort as C
from ..operators import quality as Q
from ..operators.sizes import sent
from ..params import Settings

LOCUS = ("sample_id", "marker")


def run_records(
    loci: DataFrame, alleles: DataFrame, run: dict[str, str] | None = None, panel: DataFrame | None = None, params: Settings | None = None, inputs: list[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """One nested record for each sample: meta, summary, QC, audit, results with alleles.

    With ``panel`` each result has its marker's definition, with ``params`` its
    thresholds, and the record the audit of its flags; ``inputs`` are (role,
    path, digest) of the files that the run was made from.
    """
    run = run or {}
    evidence = alleles.groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct(
        "cluster_index", "status", "isfg", "repeat_label", "number", "number_label", "number_method", "consensus", "length_bp", "bp_diff", "n_reads", "n_hp1", "n_hp2", "n_hp_none", "n_forward", "n_reverse",
        F.bround("mean_qual", 2).alias("mean_qual"), F.bround("expected_stutter", 3).alias("expected_stutter"), F.bround("fraction", 4).alias("fraction"), "is_called",
    ))).alias("alleles"))
    rows = loci.join(evidence, list(LOCUS), "left").join(C.sequence_panel(alleles).withColumnRenamed("rows", "ngs_panel"), list(LOCUS), "left")
    fields = ["marker_ord", "marker", "call_rule", "tri_type", "total_reads", "called_reads", "discarded_reads", "allele_balance", "alleles_called", "alleles", "flags", "ngs_panel"]
    if panel is not None:
        system = F.struct(*(F.col(c) for c in _SYSTEM))
        rows = rows.join(sent(panel.select(F.col("name").alias("marker"), system.alias("system")), panel), "marker", "left")
        fields.append("system")
    if params is not None:
        rows = rows.withColumn("thresholds", F.struct(*(F.lit(params[n]).alias(n) for n in ("analytical_thresh", "calling_thresh"))))
        fields.append("thresholds")
    called = lambda rule: F.count_if(F.col("call_rule") == rule)
    results = rows.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("results"),
        F.struct(
            F.count(F.lit(1)).alias("n_markers"), (F.count(F.lit(1)) - called("no_data")).alias("n_called"), called("homozygous").alias("n_homozygous"), called("heterozygous").alias("n_heterozygous"),
            F.count_if(F.size("flags") > 0).alias("n_flagged"), F.sum(F.size("flags")).alias("n_flags"),
        ).alias("summary"),
        F.struct(F.avg("total_reads").alias("mean_reads"), F.min("total_reads").alias("min_reads"), F.max("total_reads").alias("max_reads")).alias("qc"),
    )
    meta = F.struct(*(F.lit(v).alias(k) for k, v in run.items())) if run else F.lit(None).cast("struct<run_id:string>")
    files = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("role", "path", "sha256"), given, strict=True))) for given in inputs or [])).cast("array<struct<role:string,path:string,sha256:string>>")
    records = results.withColumns({"schema_version": F.lit("2.0"), "meta": meta, "inputs": files})
    shown = ["schema_version", "sample_id", "meta", "inputs", "summary", "qc", "results"]
    if params is not None:
        audit = Q.audit_frame(loci, params, run.get("poa_backend", "poa_native"), run.get("stutter_model", "default"), run.get("run_id", ""))
        records = records.join(audit.select("sample_id", F.struct(*(c for c in audit.columns if c != "sample_id")).alias("audit")), "sample_id", "left")
        shown.insert(-1, "audit")
    return records.select(*shown)


#: What a record tells of a marker's definition.
_SYSTEM = (
    "codis_name", "chromosome", "ref_start", "ref_end", "motif", "period", "corr_value", "reference_ce", "allele_bp_step", "category", "strand", "marker_type", "allow_triallelic",
)


def write_json(records: DataFrame, path: str) -> None:
    """One line for each sample; partitioned by nothing, so that many samples are many files."""
    records.write.mode("overwrite").json(path)


def write_pretty(records: DataFrame, folder: str) -> None:
    """A file for each sample, indented, for people; streamed to the driver one by one."""
    out = ensure_folder(folder)
    for name, text in ((r.sample_id, r.text) for r in records.select("sample_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("text")).toLocalIterator()):
        with open(os.path.join(out, f"{re.sub(r'[^A-Za-z0-9._-]', '_', name)}.json"), "w", encoding="utf-8") as f:
            json.dump(json.loads(text), f, indent=2, ensure_ascii=False)
            f.write("\n")


def profile_table(loci: DataFrame, panel: DataFrame) -> DataFrame:
    where = sent(panel.select(F.col("name").alias("marker"), F.col("chromosome").alias("chrom"), "ref_start", "ref_end", "motif"), panel)
    rows = C.profile_rows(loci).join(where, "marker")
    slots = [f"allele{k}_{c}" for k in (1, 2, 3) for c in ("isfg", "repeat_summary", "ce", "bp_diff", "cov", "hp1", "hp2", "seq")]
    return rows.select("sample", "marker", "chrom", "ref_start", "ref_end", "motif", "call_rule", "tri_type", "status_chip", "total_reads", *slots)


def evidence_table(alleles: DataFrame, *more: str) -> DataFrame:
    """A row for each cluster; ``more`` are columns of ``alleles`` that follow under their own names."""
    return alleles.select(
        F.col("sample_id").alias("sample"), "marker", "cluster_index", "status", "isfg", F.col("repeat_label_source").alias("isfg_source"), F.col("repeat_summary").alias("motif_repeat_summary"), "consensus", "length_bp", "ce",
        "allele_numeric", "allele_numeric_source", "bp_diff", "is_deletion", F.col("n_reads").alias("n_reads_total"), F.col("n_hp1").alias("n_reads_hp1"), F.col("n_hp2").alias("n_reads_hp2"), F.col("n_hp_none").alias("n_reads_hp_none"),
        "n_forward", "n_reverse", F.bround("mean_qual", 2).alias("mean_qual"), F.bround("expected_stutter", 3).alias("expected_stutter"), F.bround("fraction", 4).alias("fraction"), *more,
    )


def sequence_table(alleles: DataFrame) -> DataFrame:
    return alleles.where("is_called").select(
        F.col("sample_id").alias("sample"), "marker", "allele_index", "isfg", F.col("repeat_label_source").alias("isfg_source"), F.col("repeat_summary").alias("motif_repeat_summary"), "ce", "allele_numeric", "allele_numeric_source",
        "length_bp", "bp_diff", "consensus", "consensus_method", F.col("n_reads").alias("n_reads_total"), F.col("n_hp1").alias("n_reads_hp1"), F.col("n_hp2").alias("n_reads_hp2"), "status",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def write_tidy(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "parquet":
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)
    else:
        raise ReportError(f"unknown kind: {kind}")


# variants

_ESCAPES = [("%", "%25"), (":", "%3A"), (";", "%3B"), ("=", "%3D"), (",", "%2C"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")]


def vcf_encode(c: Column) -> Column:
    """Nine characters percent-encoded; empty is a dot."""
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.when(F.coalesce(c, F.lit("")) == "", ".").otherwise(c)


def vcf_decode(c: Column) -> Column:
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(b), F.lit(a))
    return F.when(c == ".", "").otherwise(c)


def vcf_rows(loci: DataFrame, panel: DataFrame, references: DataFrame) -> DataFrame:
    """sample_id, contig_ord, pos, line; ``references`` has marker, contig_ord, ref (the window's bases).

    Sex markers and loci without reads are left out. A call equal to the
    reference has index 0; per-allele fields follow the order of the indexes, a
    dot where that allele isn't called.
    """
    where = panel.where("marker_type <> 'amel'").select(F.col("name").alias("marker"), "chromosome", "ref_start", "ref_end", "motif", "period", F.col("strand").alias("marker_strand"))
    rows = loci.where("total_reads > 0").join(sent(where.join(references, "marker"), panel), "marker")
    shown = lambda a: F.when(a["consensus"] == "", F.lit("<DEL>")).otherwise(a["consensus"])
    called = F.transform("alleles_called", shown)
    alts = F.array_distinct(F.filter(called, lambda s: s != F.col("ref")))
    rows = rows.withColumns({"seqs": called, "alts": alts}).withColumn("all_alleles", F.concat(F.array("ref"), "alts"))
    at = F.transform("seqs", lambda s: F.array_position(F.col("all_alleles"), s) - 1)
    rows = rows.withColumn("gt", at)
    per = lambda fn: F.array_join(F.transform("all_alleles", lambda s: F.coalesce(F.get(F.transform(F.filter("alleles_called", lambda a: shown(a) == s), fn), 0), F.lit("."))), ",")
    text = lambda f: (lambda a: vcf_encode(a[f].cast("string")))
    depth = F.array_join(F.transform("all_alleles", lambda s: F.aggregate(F.filter("alleles_called", lambda a: shown(a) == s), F.lit(0), lambda x, a: x + a["n_reads"]).cast("string")), ",")
    severe = F.array_sort(F.array_distinct(F.transform(F.filter("flags", lambda f: f["severity"].isin("warn", "error")), lambda f: f["code"])))
    notes = F.array_sort(F.array_distinct(F.transform(F.filter("flags", lambda f: f["severity"] == "info"), lambda f: f["code"])))
    gt = F.when(F.size("gt") == 0, "./.").when(F.size("gt") == 1, F.concat(F.get("gt", 0).cast("string"), F.lit("/"), F.get("gt", 0).cast("string"))).otherwise(F.array_join(F.transform(F.array_sort("gt"), lambda i: i.cast("string")), "/"))
    info = F.concat_ws(";", F.concat(F.lit("END="), F.col("ref_end")), F.concat(F.lit("MARKER="), vcf_encode(F.col("marker"))), F.concat(F.lit("MOTIF="), vcf_encode(F.col("motif"))), F.concat(F.lit("PERIOD="), F.col("period")), F.concat(F.lit("STRAND="), F.col("marker_strand")), F.when(F.size(notes) > 0, F.concat(F.lit("NOTE="), F.array_join(notes, ","))))
    strands = lambda a: F.concat(a["n_forward"].cast("string"), F.lit("|"), a["n_reverse"].cast("string"))
    phases = lambda a: F.concat(a["n_hp1"].cast("string"), F.lit("|"), a["n_hp2"].cast("string"))
    values = F.concat_ws(":", gt, F.col("total_reads").cast("string"), depth, per(text("length_bp")), per(text("number_label")), per(text("number_method")), per(text("isfg")), per(text("iso_suffix")), per(phases), per(strands), per(text("consensus_method")))
    line = F.concat_ws("\t", "chromosome", F.col("ref_start").cast("string"), "marker", "ref", F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."), F.lit("."), F.when(F.size(severe) > 0, F.array_join(severe, ";")).otherwise("PASS"), info, F.lit("GT:DP:AD:AL:MC:MM:ISFG:ISO:HP:SB:CM"), values)
    return rows.select("sample_id", "contig_ord", F.col("ref_start").alias("pos"), line.alias("line"))


def vcf_header(contigs: list[tuple[str, int]], sample: str, codes: list[str]) -> list[str]:
    numbers = [("DP", "1", "Integer"), ("AD", "R", "Integer"), ("AL", "R", "Integer"), ("MC", "R", "String"), ("MM", "R", "String"), ("ISFG", "R", "String"), ("ISO", "R", "String"), ("HP", "R", "String"), ("SB", "R", "String"), ("CM", "R", "String")]
    about = {"DP": "Reads at the locus", "AD": "Reads of each allele", "AL": "Length", "MC": "Allele number", "MM": "Method of the number", "ISFG": "Notation", "ISO": "Iso-allele suffix", "HP": "Reads of haplotype 1 and 2", "SB": "Reads by strand", "CM": "Consensus method"}
    out = ["##fileformat=VCFv4.3", *(f"##contig=<ID={n},length={length}>" for n, length in contigs), *(f'##FILTER=<ID={c},Description="{c}">' for c in codes)]
    out += [f'##INFO=<ID={k},Number=1,Type={t},Description="{k.lower()}">' for k, t in (("END", "Integer"), ("MARKER", "String"), ("MOTIF", "String"), ("PERIOD", "Integer"), ("STRAND", "String"))] + ['##INFO=<ID=NOTE,Number=.,Type=String,Description="informational flags">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    return out + [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{about[k]}">' for k, n, t in numbers] + ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def write_vcf(rows: DataFrame, sample: str, contigs: list[tuple[str, int]], path: str) -> None:
    """One sample's file: a panel's worth of lines, streamed to the driver in order."""
    codes = sorted(c for c, (s, _) in Q.FLAGS.items() if s != "info")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(vcf_header(contigs, sample, codes)) + "\n")
        for r in rows.where(F.col("sample_id") == sample).orderBy("contig_ord", "pos").toLocalIterator():
            f.write(r.line + "\n")


# windows


def panel_bed(panel: DataFrame, coords: str = "bed0") -> DataFrame:
    """Five columns; bed0 counts from 0, panel1 as the panel does."""
    start = F.col("ref_start") - (1 if coords == "bed0" else 0)
    return panel.orderBy("chromosome", "ref_start").select(F.concat_ws("\t", "chromosome", start.cast("string"), F.col("ref_end").cast("string"), "motif", "name").alias("value"))


def write_panel_bed(panel: DataFrame, path: str, coords: str = "bed0") -> None:
    if panel.head() is None:
        raise ReportError("an empty panel")
    panel_bed(panel, coords).coalesce(1).write.mode("overwrite").text(path)


def write_panel_by_chromosome(panel: DataFrame, path: str) -> None:
    start = F.col("ref_start") - 1
    lines = panel.select("chromosome", F.concat_ws("\t", "chromosome", start.cast("string"), F.col("ref_end").cast("string"), "motif", "name").alias("value"))
    lines.sortWithinPartitions("value").write.mode("overwrite").partitionBy("chromosome").text(path)


def slice_bed(panel: DataFrame, pad: int = 10_000) -> DataFrame:
    """Windows widened for fetching, the sex marker's on Y as a row of its own."""
    row = lambda c, a, b, n: F.struct(c.alias("chrom"), F.greatest(F.lit(0), a - 1 - pad).alias("start"), (b + pad).alias("end"), n.alias("name"))
    both = F.array(row(F.col("chromosome"), F.col("ref_start"), F.col("ref_end"), F.col("name")), F.when(F.col("y_chromosome").isNotNull(), row(F.col("y_chromosome"), F.col("y_ref_start"), F.col("y_ref_end"), F.concat("name", F.lit("_Y")))))
    return panel.select("marker_ord", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("marker_ord", "x.*")


# workbooks


def write_xlsx(path: str, sheets: dict[str, DataFrame], most_rows: int = 1_000_000) -> None:
    """Sheets of plain cells, header row first; rows are streamed, not collected."""
    if len(sheets) == 0:
        raise ReportError("a workbook without sheets")

    def letters(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, rest = divmod(k - 1, 26)
            out = chr(65 + rest) + out
        return out

    def cell(r: int, k: int, v) -> str:
        ref = f"{letters(k)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool) or not isinstance(v, int | float):
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    names = [re.sub(r"[\\/*?:\[\]]", "_", n)[:31] for n in sheets]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", head + f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write((head + f'<worksheet xmlns="{main}"><sheetData>').encode())
                f.write(("<row r=\"1\">" + "".join(cell(1, j, c) for j, c in enumerate(df.columns)) + "</row>").encode())
                for r, row in enumerate(df.toLocalIterator(), 2):
                    if r > most_rows:
                        raise ReportError(f"more than {most_rows} rows in a sheet; write this table as Parquet or CSV")
                    f.write((f'<row r="{r}">' + "".join(cell(r, j, v) for j, v in enumerate(row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")


def run_sheets(loci: DataFrame, alleles: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    called = evidence_table(alleles).withColumn("called", F.lit(None)).drop("called")
    order = Window.partitionBy("sample_id").orderBy("severity_rank", "marker_ord", "code")
    qc = Q.flag_rows(loci).withColumn("_o", F.row_number().over(order)).orderBy("sample_id", "_o").drop("_o", "severity_rank", "marker_ord")
    flat = audit.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in audit.dtypes))
    return {"Profile": C.profile_rows(loci).orderBy("sample", "marker_ord"), "Sequences": sequence_table(alleles).orderBy("sample", "marker", "allele_index"), "Evidence": called.orderBy("sample", "marker", "cluster_index"), "QC": qc, "Audit": flat}


def cohort_sheets(loci: DataFrame) -> dict[str, DataFrame]:
    margin = C.margins(loci)
    return {"Calls": C.profile_rows(loci).orderBy("marker_ord", "sample"), "Markers": margin.where("level = 'marker'").orderBy("key"), "Samples": margin.where("level = 'sample'").orderBy("key")}


# artefacts


def dump_catalog(catalog: DataFrame, path: str) -> None:
    entries = [r.asDict() for r in catalog.orderBy("entry_ord").drop("entry_ord").toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"entries": entries}, f, indent=2, ensure_ascii=False)


def dump_ranges(ranges: DataFrame, path: str) -> None:
    names = "name chromosome start end ref_ce options slice_start slice_seq".split()
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(names) + "\n")
        for r in ranges.select(*names).toLocalIterator():
            f.write("\t".join("" if v is None else str(v) for v in r) + "\n")


def dump_model(model, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model.__dict__ | {"step_factors": {str(k): v for k, v in model.step_factors.items()}}, f, indent=2)


def load_model(path: str):
    from ..params import StutterModel

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return StutterModel(**(d | {"step_factors": {int(k): v for k, v in d["step_factors"].items()}}))


def ensure_folder(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path
