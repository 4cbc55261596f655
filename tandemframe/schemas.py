"""Fixed schemas of the engine's tables."""

from __future__ import annotations

PANEL = (
    "marker_ord int, name string, codis_name string, chromosome string, ref_start int, ref_end int, motif string, period int, corr_value int, "
    "category string, reference_ce double, allele_bp_step int, kit_nomenclature_note string, min_mapq int, min_mean_qual int, max_tr_len int, "
    "allow_triallelic boolean, tri_balanced_thr double, min_reads_third int, ont_len_tolerance int, stutter_overrides map<string,double>, "
    "marker_type string, strand string, y_chromosome string, y_ref_start int, y_ref_end int"
)
CIGAR = "array<struct<op:tinyint,len:int>>"
READS = (
    "sample_id string, read_ord long, qname string, flag int, chrom string, ref_start int, ref_end int, mapq int, "
    f"cigar {CIGAR}, seq string, qual array<tinyint>, hp int, ps int"
)
OBSERVATIONS = (
    "sample_id string, marker string, read_ord long, read_id string, sequence string, hp int, ps int, mean_qual double, strand string"
)
CLUSTERS = (
    "sample_id string, marker string, cluster_index int, consensus string, consensus_method string, n_reads int, n_hp1 int, n_hp2 int, "
    "n_hp_none int, n_forward int, n_reverse int, mean_qual double, phase_set int, n_phase_sets int, read_ids array<string>"
)
CATALOG = "entry_ord long, marker string, ce double, suffix string, source string, sequence string, isfg string"
RANGES = "name string, chromosome string, start int, end int, ref_ce double, options string, slice_start int, slice_seq string"
TRUTH = "sample_id string, marker string, technology string, allele1 string, allele2 string, coverage double"
MANIFEST = "sample_id string, bam string, role string"
#: Reject reasons in the order in which a read meets them.
REASONS = ("not_primary", "low_mapq", "no_alignment_end", "left_flank_short", "right_flank_short", "no_sequence", "window_unlocatable")
