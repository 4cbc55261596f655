"""Panels, catalogs, ranges, manifests, truth sheets, run records."""

from __future__ import annotations

import gzip
import json
import os
import re
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PanelError, SourceError
from ..params import ANCHOR_BP
from ..schemas import CATALOG, MANIFEST, PANEL, RANGES, TRUTH

CATEGORIES = ("autosomal", "y_chromosomal", "x_chromosomal", "mitochondrial")
ROLES = ("sample", "control", "reference", "blank")
_DEFAULTS = {
    "codis_name": None, "period": -1, "corr_value": 0, "category": "autosomal", "reference_ce": None, "allele_bp_step": 4, "kit_nomenclature_note": None, "min_mapq": None, "min_mean_qual": None,
    "max_tr_len": 1000, "allow_triallelic": False, "tri_balanced_thr": None, "min_reads_third": 5, "ont_len_tolerance": 0, "stutter_overrides": None, "marker_type": "str", "strand": "+",
    "y_chromosome": None, "y_ref_start": None, "y_ref_end": None, "motif": "",
}
_MOTIF = re.compile(r"[ACGT]+(?:,[ACGT]+)*")
_ORDER = [c.strip().split()[0] for c in re.split(r",(?![a-z]+>)", PANEL)]


def checked_panel(spark: SparkSession, systems: list[dict]) -> DataFrame:
    """Validated systems in panel order as a table."""
    rows, seen = [], set()
    for k, given in enumerate(systems):
        s = _DEFAULTS | {x: v for x, v in given.items() if x in {*_DEFAULTS, "name", "chromosome", "ref_start", "ref_end"}}
        for need in ("name", "chromosome", "ref_start", "ref_end"):
            if s.get(need) is None:
                raise PanelError(f"system {k + 1}: {need} is missing")
        if s["name"] in seen:
            raise PanelError(f"{s['name']}: listed twice")
        seen.add(s["name"])
        problems = {
            "ends before it starts": s["ref_end"] < s["ref_start"], "unknown category": s["category"] not in CATEGORIES, "strand is neither + nor -": s["strand"] not in "+-",
            "unknown marker type": s["marker_type"] not in ("str", "amel"), "motif is not of ACGT": bool(s["motif"]) and not _MOTIF.fullmatch(s["motif"]), "no motif": s["marker_type"] == "str" and not s["motif"],
            "period below -1": s["period"] < -1, "step below 1": s["allele_bp_step"] < 1, "negative read floor": (s["min_reads_third"] or 0) < 0,
        }
        for what, wrong in problems.items():
            if wrong:
                raise PanelError(f"{s['name']}: {what}")
        overrides = s["stutter_overrides"]
        s |= {"marker_ord": k, "stutter_overrides": {str(a): float(b) for a, b in overrides.items()} if overrides else None}
        s |= {c: float(s[c]) for c in ("reference_ce", "tri_balanced_thr") if s[c] is not None}
        rows.append(tuple(s[c] for c in _ORDER))
    if not rows:
        raise PanelError("a panel without systems")
    return spark.createDataFrame(rows, PANEL).coalesce(1)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)
    if not isinstance(doc, dict) or "systems" not in doc:
        raise PanelError(f"{path}: no systems")
    return checked_panel(spark, doc["systems"])


def load_panel_bed(spark: SparkSession, path: str, coords: str = "bed0") -> tuple[DataFrame, list[str]]:
    """(panel, warnings). Column 4 is a motif or a name; a name needs a motif in column 5."""
    if coords not in ("bed0", "panel1"):
        raise PanelError(f"coords: {coords}")
    systems, warnings = [], []
    with open(path, encoding="utf-8") as f:
        lines = [x.rstrip("\n") for x in f]
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.startswith(("#", "track", "browser")):
            continue
        cells = line.split("\t") if "\t" in line else line.split()
        try:
            start, end = int(cells[1]), int(cells[2])
        except (IndexError, ValueError):
            raise PanelError(f"{path}:{n}: no start and end") from None
        words = cells[3:5]
        motif = next((w for w in words if _MOTIF.fullmatch(w)), None)
        if motif is None:
            raise PanelError(f"{path}:{n}: no motif")
        name = next((w for w in words if w is not motif), None)
        start1 = start + 1 if coords == "bed0" else start
        if end < start1:
            raise PanelError(f"{path}:{n}: ends before it starts")
        note = None
        if name is None:
            name = f"{cells[0]}_{start}"
            note = "unnamed window: numbers are counted in the sequence"
            warnings.append(f"{name}: {note}")
        systems.append({"name": name, "chromosome": cells[0], "ref_start": start1, "ref_end": end, "motif": motif, "period": -1, "kit_nomenclature_note": note})
    return checked_panel(spark, systems), warnings


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema("entries array<struct<marker:string,ce:double,suffix:string,source:string,sequence:string,isfg:string>>").json(path)
    rows = raw.select(F.posexplode("entries").alias("entry_ord", "e")).select(F.col("entry_ord").cast("long"), "e.marker", "e.ce", "e.suffix", "e.source", F.upper("e.sequence").alias("sequence"), "e.isfg")
    bad = rows.where(~F.coalesce(F.col("sequence").rlike("^[ACGT]+$"), F.lit(False))).select("marker").head()
    if bad is not None:
        raise PanelError(f"{path}: {bad.marker} has a sequence that is not of ACGT")
    return rows


def build_catalog(records: DataFrame) -> DataFrame:
    """The first record of each marker and sequence."""
    seq = F.upper("sequence")
    first = F.row_number().over(Window.partitionBy("marker", seq).orderBy("entry_ord")) == 1
    return records.withColumn("_k", first).where("_k").drop("_k").withColumn("sequence", seq)


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Reporting ranges with the anchors left and right of them; a range that runs
    backwards is on the minus strand. The option ``limit`` is dropped."""
    r = spark.read.option("sep", "\t").option("header", True).option("comment", "#").schema(RANGES).csv(path)
    low, high = F.least("start", "end"), F.greatest("start", "end")
    at = low - F.col("slice_start")
    past = high - F.col("slice_start") + 1
    kept = F.filter(F.split(F.coalesce("options", F.lit("")), "[;, ]+"), lambda o: (o != "") & ~o.startswith("limit="))
    return r.withColumns({
        "minus": F.col("start") > F.col("end"), "left_anchor": F.substring("slice_seq", F.greatest(at - ANCHOR_BP, F.lit(0)) + 1, F.least(at, F.lit(ANCHOR_BP))),
        "right_anchor": F.substring("slice_seq", past + 1, F.lit(ANCHOR_BP)), "options": F.array_join(kept, ";"),
    })


def load_range_table(spark: SparkSession, path: str) -> DataFrame:
    """A naming tool's own range table (name, chromosome, start, end, ref_ce,
    options; tab-separated, a header line): what ``build_ranges`` takes as known.
    A start above its end is a range on the minus strand."""
    kind = "name string, chromosome string, start int, end int, ref_ce double, options string"
    rows = spark.read.option("sep", "\t").option("header", True).schema(kind).csv(path).where("name is not null and trim(name) <> ''")
    if rows.where("start is null or end is null").head() is not None:
        raise PanelError(f"{path}: a range without start or end")
    return rows.withColumns({"options": F.coalesce("options", F.lit("")), "slice_start": F.lit(None).cast("int"), "slice_seq": F.lit(None).cast("string")})


def missing_contigs(panel: DataFrame, contigs: DataFrame) -> DataFrame:
    """chromosome, other_prefix of the panel's contigs that a file (``contigs``: name)
    lacks; the latter if it has them with, or without, the prefix chr."""
    wanted = panel.select("chromosome").unionByName(panel.where("y_chromosome is not null").select(F.col("y_chromosome").alias("chromosome"))).distinct()
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    lost = wanted.join(contigs.select(F.col("name").alias("chromosome")), "chromosome", "left_anti")
    named = contigs.select(bare(F.col("name")).alias("bare")).distinct().withColumn("other_prefix", F.lit(True))
    return lost.join(named, bare(F.col("chromosome")) == F.col("bare"), "left").select("chromosome", F.coalesce("other_prefix", F.lit(False)).alias("other_prefix"))


def build_ranges(panel: DataFrame, known: DataFrame, contigs: DataFrame, pad: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) for the markers of a panel: slices of ``contigs`` (name, seq), chrN or N."""
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    rows = panel.select("name").join(known.drop("slice_start", "slice_seq"), "name").join(contigs.select(bare(F.col("name")).alias("_c"), "seq"), bare(F.col("chromosome")) == F.col("_c"))
    start = F.greatest(F.least("start", "end") - pad, F.lit(1))
    rows = rows.withColumns({"slice_start": start, "slice_seq": F.upper(F.substring("seq", start, F.greatest("start", "end") + pad - start + 1))}).drop("_c", "seq")
    return rows, panel.select("name").join(rows.select("name"), "name", "left_anti")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        lines = [x.rstrip("\n").split("\t") for x in f if x.strip() and not x.startswith("#")]
    if not lines or not {"sample_id", "bam"} <= set(lines[0]):
        raise SourceError(f"{path}: columns sample_id and bam are needed")
    rows, seen = [], set()
    for cells in lines[1:]:
        r = dict(zip(lines[0], (c.strip() for c in cells), strict=False))
        role = r.get("role") or "sample"
        if not r.get("sample_id") or not r.get("bam"):
            raise SourceError(f"{path}: a row without sample_id or bam")
        if role not in ROLES:
            raise SourceError(f"{path}: {role} is no role")
        if r["sample_id"] in seen:
            raise SourceError(f"{path}: {r['sample_id']} twice")
        seen.add(r["sample_id"])
        rows.append((r["sample_id"], r["bam"], role))
    if not rows:
        raise SourceError(f"{path}: no samples")
    return spark.createDataFrame(rows, MANIFEST)


def load_runs(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Run records; a file that is none is an error."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(paths)
    if rows.where("sample_id IS NULL").head() is not None:
        raise SourceError("a file that is no run record")
    return rows


# spreadsheets


def read_xlsx(path: str) -> list[list[str]]:
    """Cells of the first sheet as text, merged ones empty but the first."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    rows: list[list[str]] = []
    for r in sheet.iter(f"{{{ns['m']}}}row"):
        cells: list[str] = []
        for c in r.findall("m:c", ns):
            letters = re.match("[A-Z]+", c.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            cells += [""] * (at - len(cells))
            v, kind = c.find("m:v", ns), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else "" if v is None else v.text or ""
            cells[at - 1] = shared[int(text)] if kind == "s" and text else text
        at = int(r.get("r", len(rows) + 1))
        rows += [[] for _ in range(at - len(rows))]
        rows[at - 1] = cells
    return rows


def carried(name: str, order: Window) -> Column:
    """The last value up to each row of ``order`` that isn't null or empty: merged cells have it in the first only."""
    seen = F.col(name)
    return F.last(F.when(seen != "", seen), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def truth_from_cells(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """A sheet whose first three rows are marker, technology and field (A1, A2,
    COBERTURA, COB A1, COB A2), merged ones filled to the right; samples below."""
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    if len(rows) < 3:
        raise SourceError("a truth sheet has three header rows")
    cells = [(i, j, v.strip()) for i, r in enumerate(rows) for j, v in enumerate(r)]
    df = spark.createDataFrame(cells, "i int, j int, v string")
    head = df.where("i < 3").groupBy("j").pivot("i", [0, 1, 2]).agg(F.first("v")).toDF("j", "m", "t", "f")
    left = Window.partitionBy(F.lit(0)).orderBy("j")  # a header is some hundred cells
    head = head.where("j > 0").select("j", carried("m", left).alias("marker"), carried("t", left).alias("technology"), F.upper("f").alias("field"))
    names = df.where("i >= 3 and j = 0 and v <> ''").select("i", F.col("v").alias("sample_id"))
    long = df.where("i >= 3").join(F.broadcast(head), "j").join(names, "i")
    wide = long.groupBy("sample_id", "marker", "technology").pivot("field", ["A1", "A2", "COBERTURA", "COB A1", "COB A2"]).agg(F.first("v"))
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    cover = F.coalesce(number(F.col("COBERTURA")), number(F.col("`COB A1`")) + number(F.col("`COB A2`")))
    return wide.select("sample_id", "marker", "technology", F.col("A1").alias("allele1"), F.col("A2").alias("allele2"), cover.alias("coverage"))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".xlsx"):
        return truth_from_cells(spark, read_xlsx(path))
    return spark.read.option("sep", "\t").option("header", True).schema(TRUTH).csv(path)


# sniffing and validation


def detect(path: str) -> dict:
    """kind (bam, cram, fastq, fasta), gzipped, aligned, size; by the first bytes."""
    from .bam import exists, opened

    if not exists(path):
        raise SourceError(f"no such file: {path}")
    with opened(path) as f:
        size = f.size()
        if not size:
            raise SourceError(f"empty file: {path}")
        head = f.read(1 << 16)
    found = {"gzipped": False, "aligned": None, "size": size}
    if head[:4] == b"CRAM":
        return found | {"kind": "cram"}
    if head[:2] == b"\x1f\x8b":
        found["gzipped"] = True
        try:
            inner = zlib.decompressobj(31).decompress(head, 64)
        except zlib.error as e:
            raise SourceError(f"{path}: damaged gzip") from e
        if inner[:4] == b"BAM\1":
            return found | {"kind": "bam", "aligned": _first_is_mapped(path)}
        head = inner
    if head[:1] == b"@":
        return found | {"kind": "fastq", "aligned": False}
    if head[:1] == b">":
        return found | {"kind": "fasta", "aligned": False}
    raise SourceError(f"{path}: unknown kind of file")


def _first_is_mapped(path: str) -> bool:
    from .bam import Blocks, read_header

    blocks = Blocks(path)
    try:
        refs = read_header(blocks)[1]
        head = blocks.read(4)
        if len(head) < 4 or not refs:
            return False
        raw = blocks.read(int.from_bytes(head, "little"))
        return not int.from_bytes(raw[14:16], "little") & 4
    finally:
        blocks.close()


def checked_header(path: str) -> tuple[list[dict[str, str]], list[tuple[str, int]]]:
    """(read groups, contigs); a read group without sample name is an error."""
    from .bam import header, read_groups

    text, refs = header(path)
    groups = read_groups(text)
    if not groups or any(not g.get("SM") for g in groups):
        raise SourceError(f"{path}: every read group needs a sample name")
    return groups, refs


def validate(spark: SparkSession, path: str, sample_reads: int = 10_000) -> dict:
    """Read groups with sample names (fatal), contigs, upper median MAPQ of the mapped among the first reads."""
    from ..functions.stats import upper_median
    from .bam import register

    groups, refs = checked_header(path)
    register(spark)
    first = spark.read.format("alignments").option("path", path).load().select("read_ord", "flag", "mapq").orderBy("read_ord").limit(sample_reads)
    row = first.where(F.col("flag").bitwiseAND(F.lit(4)) == 0).agg(upper_median(F.collect_list("mapq")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    warnings = [f"median MAPQ {row.m} is below 10"] if row.m is not None and row.m < 10 else []
    return {"samples": sorted({g["SM"] for g in groups}), "contigs": [n for n, _ in refs], "median_mapq": row.m, "n_reads": row.n, "warnings": warnings}


def read_text(path: str) -> str:
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt", encoding="utf-8") as f:
        return f.read()


def dump_json(path: str, doc) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
        f.write("\n")
