"""What a run can be told, each with its bounds, and the constants that it can't."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .errors import ParameterError


class Rule(NamedTuple):
    """A threshold: its default, what that rests on, the least and greatest value, what it does."""

    default: int | float
    basis: str
    low: float
    high: float
    about: str

    def checked(self, name: str, value: int | float) -> int | float:
        kind = type(self.default)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or kind(value) != value:
            raise ParameterError(f"{name}: {value!r} is no {'whole number' if kind is int else 'number'}")
        if not self.low <= value <= self.high:
            raise ParameterError(f"{name}: {value} is not within {self.low:g} and {self.high:g}")
        return kind(value)


_ANY = float("inf")
#: Names, defaults and what a default rests on.
THRESHOLDS = {
    "min_mapq": Rule(20, "chosen", 0, 255, "reads mapped with less are rejected"),
    "flank_anchor": Rule(20, "chosen", 0, _ANY, "aligned bases required on both sides of a window"),
    "identity_threshold": Rule(0.97, "chosen", 1e-9, 1, "identity at which a read joins a cluster"),
    "len_tolerance_bp": Rule(0, "derived", 0, _ANY, "merges neighbouring length bins; above 0 it merges microvariants"),
    "analytical_thresh": Rule(0.02, "chosen", 0, 1, "below this share of the locus a cluster is noise"),
    "calling_thresh": Rule(0.10, "chosen", 0, 1, "below this share it is an artefact"),
    "min_phr_for_het": Rule(0.4, "convention", 0, 1, "minor to major ratio at which a heterozygote is called on counts"),
    "min_reads_third": Rule(5, "derived", 0, _ANY, "reads without which a third candidate is ignored"),
    "low_coverage_reads": Rule(20, "derived", 0, _ANY, "called reads below which a locus is flagged"),
    "balanced_ab_max": Rule(0.65, "chosen", 0, 1, "allele balance above which a heterozygote is flagged"),
}

#: What is no threshold of a run.
FETCH_MARGIN = 200
GAP = 12
REFINE_PASSES = 3
PARENT_FRACTION = 0.20
MAX_PHANTOM_BP, HP_PURITY, MIN_TAGGED = 2, 0.8, 3
TRI_BALANCED, TRI_LOW = 0.6, 0.3
CATALOG_DISTANCE, CATALOG_LENGTH_WINDOW = 2, 6
ANCHOR_BP, MAX_ANCHOR_EDIT = 30, 0.25
SEX_MIN_READS = 3
STRAND_P, STRAND_MIN_READS = 0.01, 10
CALIBRATION_SEPARATION, CALIBRATION_PARENT_READS, CALIBRATION_BIN = 3, 8, 7
STUTTER_STEPS = (-1, -2, 1)


class Settings(Mapping[str, int | float]):
    """A value for each of ``THRESHOLDS``, in their order. What isn't given, or is
    given as None, has its default; a name that is none of them is a KeyError."""

    def __init__(self, **given: int | float | None):
        self._given = {name: THRESHOLDS[name].checked(name, value) for name, value in given.items() if THRESHOLDS[name] and value is not None}

    def __getitem__(self, name: str) -> int | float:
        return self._given.get(name, THRESHOLDS[name].default)

    def __iter__(self) -> Iterator[str]:
        return iter(THRESHOLDS)

    def __len__(self) -> int:
        return len(THRESHOLDS)

    def changed(self, basis: str | None = None) -> list[str]:
        """Names whose value isn't the default, in order; of one ``basis`` if given."""
        return [n for n, r in THRESHOLDS.items() if self[n] != r.default and basis in (None, r.basis)]

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each threshold; a local relation, so that reading it runs no job."""
        columns = "name string, value string, default string, provenance string, is_default boolean, note string"
        return spark.createDataFrame([(n, str(self[n]), str(r.default), r.basis, n not in self.changed(), r.about) for n, r in THRESHOLDS.items()], columns)

    def text(self) -> str:
        """A line for each threshold; changed ones are starred and name their default."""
        changed = set(self.changed())
        return "\n".join(f"* {n} = {v} (default {THRESHOLDS[n].default}, {THRESHOLDS[n].basis})" if n in changed else f"  {n} = {v}" for n, v in self.items())


#: Severity and short code of each flag.
FLAGS = {
    "low_coverage": ("warn", "LC"),
    "dropout": ("warn", "DO"),
    "strand_bias": ("warn", "SB"),
    "triallelic": ("info", "TRI"),
    "mixture_suspected": ("warn", "MIX"),
    "longtr_discordant": ("warn", "LTD"),
    "inexact_allele": ("info", "IA"),
    "isoallele": ("info", "ISO"),
    "ce_nomenclature_offset": ("warn", "CNO"),
    "consensus_fallback": ("warn", "CF"),
    "hp_phantom_collapsed": ("info", "HPC"),
    "hp_rescued_het": ("info", "HPR"),
    "phase_block_split": ("warn", "PBS"),
    "allele_imbalance": ("warn", "AI"),
    "non_default_threshold": ("warn", "NDT"),
}


@dataclass(frozen=True)
class StutterModel:
    """log rate = intercept + slope * LUS within [lus_min, lus_max], times a step's factor."""

    version: str = "default"
    log_intercept: float = -12.1125
    log_slope: float = 0.7159
    lus_min: int = 10
    lus_max: int = 14
    step_factors: dict[int, float] = field(default_factory=lambda: {-1: 1.0, -2: 0.242, 1: 0.726})
    slus_factor: float = 1.0
    n_observations: int = 0
    n_loci: int = 0
    r_squared: float | None = None

    def describe(self) -> str:
        steps = ", ".join(f"{k:+d}: {v:g}" for k, v in sorted(self.step_factors.items()))
        return f"{self.version}: exp({self.log_intercept:g} + {self.log_slope:g} LUS), LUS {self.lus_min} to {self.lus_max}; {steps}"
