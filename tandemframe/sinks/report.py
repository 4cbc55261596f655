"""Self-contained pages and plain-text traces, streamed from the run's tables."""

from __future__ import annotations

import hashlib
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import runs
from ..operators import cohort as C

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}.warn{background:#fff3d6}.error{background:#fdd}mark{background:#cfe8ff}"
_SCRIPT = """
function keep(){var q=document.getElementById('q').value.toLowerCase(),s=document.getElementById('s').value,f=document.getElementById('f').checked;
document.querySelectorAll('tbody tr').forEach(function(r){var ok=r.textContent.toLowerCase().includes(q)&&(!s||r.dataset.status===s)&&(!f||r.dataset.flagged==='1');r.style.display=ok?'':'none'})}
document.querySelectorAll('th').forEach(function(h,i){var up=true;h.onclick=function(){var b=h.closest('table').tBodies[0];var n=function(r){var t=r.cells[i].textContent,x=parseFloat(t);return isNaN(x)?t:x};
Array.from(b.rows).sort(function(a,c){var x=n(a),y=n(c);return (x<y?-1:x>y?1:0)*(up?1:-1)}).forEach(function(r){b.appendChild(r)});up=!up}})
"""


def highlight(seq: str, motifs: list[str]) -> str:
    """The sequence escaped, motif runs marked."""
    from ..functions.scan import find_runs

    out, at = [], 0
    for start, _, _, bp in find_runs(seq, motifs):
        out += [escape(seq[at:start]), "<mark>", escape(seq[start : start + bp]), "</mark>"]
        at = start + bp
    return "".join([*out, escape(seq[at:])])


def bars(values: list[tuple[str, float]], floor: float | None = None, width: int = 640, height: int = 160) -> str:
    """A bar for each value as SVG, with a line at ``floor``."""
    if not values:
        return f'<svg width="{width}" height="40"><text x="8" y="24">no data</text></svg>'
    top = C.nice_axis_max(max(v for _, v in values))
    step = width / len(values)
    parts = [f'<svg width="{width}" height="{height + 40}" role="img">']
    for k, (name, v) in enumerate(values):
        h = height * v / top
        parts.append(f'<rect x="{k * step + 2:.1f}" y="{height - h:.1f}" width="{max(1, step - 4):.1f}" height="{h:.1f}" fill="#4878a8"><title>{escape(name)}: {v:g}</title></rect>')
    if floor:
        y = height - height * min(floor, top) / top
        parts.append(f'<line x1="0" x2="{width}" y1="{y:.1f}" y2="{y:.1f}" stroke="#b33"/>')
    return "".join([*parts, f'<text x="2" y="12">{top}</text></svg>'])


def haplotype_bars(called: list[tuple[str, int, int, int]], width: int = 320) -> str:
    """Reads of haplotype 1, 2 and none of each called allele, side by side."""
    total = max((a + b + c for _, a, b, c in called), default=0)
    if not total:
        return bars([])
    parts = [f'<svg width="{width}" height="{24 * len(called)}">']
    for k, (name, *counts) in enumerate(called):
        x = 60.0
        parts.append(f'<text x="0" y="{24 * k + 16}">{escape(name)}</text>')
        for n, colour in zip(counts, ("#4878a8", "#d58a3b", "#aaa"), strict=True):
            w = (width - 60) * n / total
            parts.append(f'<rect x="{x:.1f}" y="{24 * k + 4}" width="{w:.1f}" height="16" fill="{colour}"/>')
            x += w
    return "".join([*parts, "</svg>"])


def page(title: str, body: str) -> str:
    """A page that carries the SHA-256 of itself without that line."""
    text = (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>'
        '<p><input id="q" placeholder="search" oninput="keep()"> <select id="s" onchange="keep()"><option value="">any</option><option>ok</option><option>review</option><option>no_data</option></select> <label><input id="f" type="checkbox" onchange="keep()"> flagged</label></p>'
        f"{body}<script>{_SCRIPT}</script></body></html>\n"
    )
    return text.replace("</head>", f'<meta name="content-sha256" content="{hashlib.sha256(text.encode()).hexdigest()}"></head>')


def verify_page(text: str) -> bool:
    head, mark, rest = text.partition('<meta name="content-sha256" content="')
    return bool(mark) and hashlib.sha256((head + rest[66:]).encode()).hexdigest() == rest[:64]


def sample_report(loci: DataFrame, sample: str, low: int = 20) -> str:
    """One sample's page: a panel's worth of rows."""
    rows = list(C.profile_rows(loci.where(F.col("sample_id") == sample)).orderBy("marker_ord").toLocalIterator())
    cells = "".join(f'<tr class="{r.worst_severity}" data-status="{r.status_chip}" data-flagged="{int(bool(r.flags))}">' + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in (r.marker, r.genotype, r.allele1_isfg, r.allele2_isfg, r.called_reads, r.total_reads, r.allele_balance, r.flags, r.status_chip)) + "</tr>" for r in rows)
    table = "<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in ("marker", "genotype", "allele 1", "allele 2", "called reads", "reads", "balance", "flags", "status")) + f"</tr></thead><tbody>{cells}</tbody></table>"
    return page(sample, bars([(r.marker, float(r.called_reads or r.total_reads or 0)) for r in rows], low) + table)


def cohort_report(loci: DataFrame, hrefs: dict[str, str] | None = None) -> str:
    hrefs = hrefs or {}
    body = []
    for r in C.profile_rows(loci).orderBy("marker_ord", "sample").select("sample", "marker", "genotype", "called_reads", "flags", "status_chip", "worst_severity").toLocalIterator():
        name = f'<a href="{escape(hrefs[r.sample])}">{escape(r.sample)}</a>' if r.sample in hrefs else escape(r.sample)
        body.append(f'<tr class="{r.worst_severity}" data-status="{r.status_chip}" data-flagged="{int(bool(r.flags))}"><td>{escape(r.marker)}</td><td>{name}</td><td>{escape(r.genotype)}</td><td>{r.called_reads}</td><td>{escape(r.flags)}</td></tr>')
    return page("Cohort", "<table><thead><tr><th>marker</th><th>sample</th><th>genotype</th><th>reads</th><th>flags</th></tr></thead><tbody>" + "".join(body) + "</tbody></table>")


def trace(alleles: DataFrame, funnel: DataFrame | None = None) -> DataFrame:
    """sample_id, marker_ord, text: how each locus came to its call, as lines; written
    by sample with partitionBy."""
    why = (
        F.when(F.col("status") == "stutter", F.format_string("%d reads, at most the %.2f that slippage explains", "n_reads", "expected_stutter"))
        .when(F.col("status") == "noise", F.format_string("%.1f %% of the locus, below the analytical threshold", F.col("fraction") * 100))
        .when(F.col("status") == "artefact", F.format_string("%.1f %% of the locus, below the calling threshold", F.col("fraction") * 100))
        .when(F.col("status") == "hp_phantom", F.lit("close to a stronger candidate of its haplotype"))
        .when(F.col("is_called"), F.format_string("called as allele %d", "allele_index")).otherwise(F.lit("candidate, not called"))
    )
    row = F.format_string("  cluster %d: %s, %d bp, %d reads (+%d -%d; HP1 %d, HP2 %d), %s: %s; %s", "cluster_index", "number_label", "length_bp", "n_reads", "n_forward", "n_reverse", "n_hp1", "n_hp2", "consensus_method", "status", why)
    per = alleles.groupBy("sample_id", "marker").agg(F.first("marker_ord").alias("marker_ord"), F.first("call_rule").alias("rule"), F.first("total_reads").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_index", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    if funnel is not None:
        gates = funnel.where("n > 0").groupBy("sample_id", "marker").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), "reason"))), ", ").alias("gates"))
        per = per.join(gates, ["sample_id", "marker"], "left")
    else:
        per = per.withColumn("gates", F.lit(None).cast("string"))
    head = F.concat(F.col("marker"), F.lit(": "), F.col("rule"), F.lit(", "), F.col("total").cast("string"), F.lit(" reads"), F.coalesce(F.concat(F.lit(" ("), F.col("gates"), F.lit(")")), F.lit("")))
    return per.select("sample_id", "marker_ord", F.concat(head, F.lit("\n"), F.col("rows")).alias("text"))


def write_traces(rows: DataFrame, path: str) -> None:
    rows.repartition("sample_id").sortWithinPartitions("sample_id", "marker_ord").select("sample_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("sample_id").text(path)


__all__ = ["bars", "cohort_report", "haplotype_bars", "highlight", "page", "runs", "sample_report", "trace", "verify_page", "write_traces"]
