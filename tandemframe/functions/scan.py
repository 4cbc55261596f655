"""General scans that Column expressions don't cover, or walk element by element
in interpreted lambdas, as pandas and Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..params import ANCHOR_BP, MAX_ANCHOR_EDIT


def find_runs(seq: str, motifs: list[str]) -> list[tuple[int, str, int, int]]:
    """Maximal runs, greedily from the left. Where several motifs start a run the
    one with most bases wins, then the earlier motif."""
    out, at, n = [], 0, len(seq)
    while at < n:
        best = (0, "", 0)
        for m in motifs:
            end = at
            while seq.startswith(m, end):
                end += len(m)
            if end - at > best[0]:
                best = (end - at, m, (end - at) // len(m))
        if best[0]:
            out.append((at, best[1], best[2], best[0]))
        at += best[0] or 1
    return out


def infix(anchor: str, target: str) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of all of ``anchor`` somewhere in
    ``target``: least edits, then the first end, then the longest start-to-end."""
    a, t = np.frombuffer(anchor.encode(), np.uint8), np.frombuffer(target.encode(), np.uint8)
    row = np.zeros(len(t) + 1, np.int64)
    start = np.arange(len(t) + 1)
    for i, base in enumerate(a, 1):
        diagonal = row[:-1] + (t != base)
        above = row[1:] + 1
        take = np.concatenate([[i], np.where(diagonal <= above, diagonal, above)])
        origin = np.concatenate([[0], np.where(diagonal <= above, start[:-1], start[1:])])
        # the left neighbour costs one more per step: a running minimum of cost minus position, the latest on a tie
        steps = np.arange(len(take))
        low = np.minimum.accumulate(take - steps)
        at = np.maximum.accumulate(np.where(take - steps == low, steps, 0))
        row, start = low + steps, origin[at]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def between_anchors(seq: str, left: str, right: str) -> tuple[str | None, str]:
    """What lies between two anchors and how that went: ok, no_anchor, anchor_mismatch, crossed."""
    if not seq or not left or not right:
        return None, "no_anchor"
    a, b = infix(left, seq), infix(right, seq)
    if a[0] > MAX_ANCHOR_EDIT * len(left) or b[0] > MAX_ANCHOR_EDIT * len(right):
        return None, "anchor_mismatch"
    if b[1] < a[2]:
        return None, "crossed"
    return seq[a[2] : b[1]], "ok"


def reporting_range():
    """The function (sequence, left anchor, right anchor) -> (range_seq, range_status)."""

    @F.pandas_udf("range_seq string, range_status string")
    def ranged(seq: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for key in zip(seq, left, right, strict=True):
            if key not in known:
                known[key] = between_anchors(*(x or "" for x in key))
            rows.append(known[key])
        return pd.DataFrame(rows, columns=["range_seq", "range_status"])

    return ranged


def locate_window(cigar: list[tuple[int, int]], ref_start: int, start: int, end: int) -> tuple[int, int] | None:
    """Query coordinates of reference window [start, end): from the first aligned
    base at or after start to the base at end, or past the last aligned one before it.
    ``cigar`` has (operation, length) by the codes of the alignment format."""
    r, q, first, last, stop = ref_start, 0, None, None, None
    for op, n in cigar:
        if op in (0, 7, 8):
            if first is None and r + n > start:
                first = q + max(0, start - r)
            if stop is None and r <= end < r + n:
                stop = q + end - r
            if r < end:
                last = q + min(n, end - r) - 1
            r, q = r + n, q + n
        elif op in (2, 3):
            r += n
        elif op in (1, 4):
            q += n
    if stop is None:
        stop = None if last is None else last + 1
    if first is None or stop is None or stop <= first:
        return None
    return first, stop


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists and where each list starts among them; NULL has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _whole(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _before(steps: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sum of the steps before each element, from the start of its list."""
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[:-1] - total[at[:-1]][row]


def locate_windows(cigar: pa.Array, ref_start: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    """``locate_window`` of every row of a batch, all operations of the batch at once."""
    ops, at = _flat(cigar)
    code, n = (_whole(x, null) for x, null in zip((ops.flatten()[ops.type.get_field_index(f)] for f in ("op", "len")), (-1, 0), strict=True))
    row = np.repeat(np.arange(len(cigar)), np.diff(at))
    a, b = _whole(start)[row], _whole(end)[row]
    aligned = np.isin(code, (0, 7, 8))
    r = _whole(ref_start)[row] + _before(np.where(aligned | np.isin(code, (2, 3)), n, 0), at, row)
    q = _before(np.where(aligned | np.isin(code, (1, 4)), n, 0), at, row)

    def told(which: np.ndarray, value: np.ndarray, latest: bool = False) -> np.ndarray:
        """The value of each row's first operation of those, or its latest; -1 without one."""
        found, k = np.full(len(cigar), -1, np.int64), np.flatnonzero(which)
        k = k if latest else k[::-1]
        found[row[k]] = value[k]  # the last one written stays
        return found

    first = told(aligned & (r + n > a), q + np.maximum(0, a - r))
    last = told(aligned & (r < b), q + np.minimum(n, b - r) - 1, latest=True)
    stop = told(aligned & (r <= b) & (b < r + n), q + b - r)
    to = np.where(stop >= 0, stop, last + 1)
    known = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (ref_start, start, end)])
    none = ~(known & (first >= 0) & ((stop >= 0) | (last >= 0)) & (to > first))
    fields = [pa.array(x.astype(np.int32)) for x in (first, to)]
    return pa.StructArray.from_arrays(fields, names=["from", "to"], mask=pa.array(none))


def means(lists: pa.Array) -> pa.Array:
    """The mean of each list of whole numbers; NULL of one that is empty or has a NULL."""
    values, at = _flat(lists)
    total, gaps = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (_whole(values), values.is_null().to_numpy(zero_copy_only=False)))
    size, summed = np.diff(at), np.diff(total[at])
    none = (size == 0) | (np.diff(gaps[at]) > 0)
    return pa.array(summed / np.maximum(size, 1), pa.float64(), mask=none)


def located():
    """The function (cigar, ref_start, start, end) -> struct<from, to>. It passes for
    nondeterministic, as the optimizer repeats any other one in each filter on
    what was found, and moves it into joins."""

    @F.arrow_udf("from int, to int")
    def walked(cigar: pa.Array, ref_start: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        return locate_windows(cigar, ref_start, start, end)

    return walked.asNondeterministic()


def averaged():
    """The function array of whole numbers -> mean."""

    @F.arrow_udf("double")
    def mean(lists: pa.Array) -> pa.Array:
        return means(lists)

    return mean


__all__ = ["ANCHOR_BP", "averaged", "between_anchors", "find_runs", "infix", "locate_window", "locate_windows", "located", "means", "reporting_range"]
