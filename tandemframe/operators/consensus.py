"""Consensus of a cluster's sequences by partial-order alignment.

The graph follows the published method (Lee, Grasso and Sharlow 2002): each
sequence is aligned globally to the graph of those before it and woven in; the
consensus is the heaviest path (Lee 2003).
"""

from __future__ import annotations

from collections import Counter

import numpy as np

_MATCH, _MISMATCH, _GAP = 5, -4, -8
#: Graphs of at most so many bases are kept, and at most so many of them.
_KEPT_BASES, _KEPT_GRAPHS = 2_000, 500


def most_frequent(seqs: list[str]) -> str:
    """The first seen among the most frequent."""
    return Counter(seqs).most_common(1)[0][0]


class Backend:
    """Builds a consensus of two sequences or more; another may be plugged in."""

    name = "poa_native"

    def consensus(self, seqs: list[str]) -> str:
        return self.weighted(Counter(seqs))

    def weighted(self, counts: dict[str, int]) -> str:
        """Of distinct sequences in the order in which they were seen, with their
        counts. Alignments don't depend on the counts, so the graphs of short
        sequences are kept for the next locus that has the same ones."""
        seqs = tuple(counts)
        if len(seqs) == 1:
            return seqs[0]
        kept: dict[tuple[str, ...], Graph] = self.__dict__.setdefault("_graphs", {})
        graph = kept.get(seqs)
        if graph is not None:
            graph.weigh(list(counts.values()))
            return graph.heaviest()
        graph = Graph(seqs[0], counts[seqs[0]])
        for s in seqs[1:]:
            graph.add(s, counts[s])
        if sum(map(len, seqs)) <= _KEPT_BASES:
            if len(kept) >= _KEPT_GRAPHS:
                kept.clear()
            kept[seqs] = graph
        return graph.heaviest()


class NoBackend(Backend):
    """As if there were none: callers fall back to the most frequent sequence."""

    name = "none"

    def consensus(self, seqs: list[str]) -> str:
        raise NotImplementedError


class Abpoa(Backend):
    """The public library pyabpoa, where it is installed."""

    name = "poa_abpoa"

    def __init__(self):
        import pyabpoa

        self.aligner = pyabpoa.msa_aligner()

    def consensus(self, seqs: list[str]) -> str:
        return self.aligner.msa(seqs, out_cons=True, out_msa=False).cons_seq[0]


class Spoa(Backend):
    """The public library spoa, where it is installed; global alignment."""

    name = "poa_spoa"

    def __init__(self):
        import spoa

        self.poa = spoa.poa

    def consensus(self, seqs: list[str]) -> str:
        return self.poa(seqs, algorithm=1, genmsa=False)[0]


def preferred(kinds: tuple[type[Backend], ...] = (Abpoa, Spoa, Backend)) -> Backend:
    """The first of ``kinds`` that can be made; one that is never there comes last."""
    for kind in kinds:
        try:
            return kind()
        except ImportError:
            continue
    return NoBackend()


class Graph:
    def __init__(self, seq: str, weight: int):
        self.bases: list[str] = []
        self.after: list[dict[int, int]] = []
        self.before: list[list[int]] = []
        self.ring: list[set[int]] = []  # aligned nodes of other bases
        self.starts: Counter = Counter()
        self.ends: Counter = Counter()
        self.paths: list[list[int]] = []  # nodes of each sequence
        self._weave([(None, b) for b in seq], weight)

    def _node(self, base: str) -> int:
        self.bases.append(base)
        self.after.append({})
        self.before.append([])
        self.ring.append(set())
        return len(self.bases) - 1

    def _weave(self, steps, weight: int) -> None:
        last, path = None, []
        for node, base in steps:
            if node is None:
                node = self._node(base)
            elif self.bases[node] != base:
                twin = next((x for x in self.ring[node] if self.bases[x] == base), None)
                if twin is None:
                    twin = self._node(base)
                    group = {node, *self.ring[node]}
                    for x in group:
                        self.ring[x].add(twin)
                    self.ring[twin] = group
                node = twin
            if last is None:
                self.starts[node] += weight
            else:
                if node not in self.after[last]:
                    self.after[last][node] = 0
                    self.before[node].append(last)
                self.after[last][node] += weight
            last = node
            path.append(node)
        if last is not None:
            self.ends[last] += weight
        self.paths.append(path)

    def weigh(self, weights: list[int]) -> None:
        """Other weights for the sequences, in the order in which they were woven in."""
        for edges in self.after:
            for node in edges:
                edges[node] = 0
        self.starts.clear()
        self.ends.clear()
        for path, weight in zip(self.paths, weights, strict=True):
            if path:
                self.starts[path[0]] += weight
                self.ends[path[-1]] += weight
            for a, b in zip(path, path[1:]):
                self.after[a][b] += weight

    def order(self) -> list[int]:
        left = [len(b) for b in self.before]
        ready = [i for i, n in enumerate(left) if not n][::-1]
        out = []
        while ready:
            i = ready.pop()
            out.append(i)
            for j in self.after[i]:
                left[j] -= 1
                if not left[j]:
                    ready.append(j)
        return out

    def add(self, seq: str, weight: int) -> None:
        order = self.order()
        at = {n: k + 1 for k, n in enumerate(order)}
        s = np.frombuffer(seq.encode(), np.uint8)
        n, steps = len(s), np.arange(len(s) + 1)
        score = np.full((len(order) + 1, n + 1), -(10**9), np.int64)
        score[0] = steps * _GAP
        for k, node in enumerate(order, 1):
            rows = [at[p] for p in self.before[node]] or [0]
            best = score[rows].max(0)
            match = np.where(s == ord(self.bases[node]), _MATCH, _MISMATCH)
            row = best + _GAP
            row[1:] = np.maximum(row[1:], best[:-1] + match)
            score[k] = np.maximum.accumulate(row - steps * _GAP) + steps * _GAP
        sinks = [at[i] for i in order if not self.after[i]]
        k = max(sinks, key=lambda r: score[r, n])
        j, path = n, []
        while k or j:
            if k:
                node = order[k - 1]
                rows = [at[p] for p in self.before[node]] or [0]
                gain = (_MATCH if j and seq[j - 1] == self.bases[node] else _MISMATCH) if j else 0
                diagonal = next((r for r in rows if j and score[r, j - 1] + gain == score[k, j]), None)
                if diagonal is not None:
                    path.append((node, seq[j - 1]))
                    k, j = diagonal, j - 1
                    continue
                up = next((r for r in rows if score[r, j] + _GAP == score[k, j]), None)
                if up is not None:
                    k = up
                    continue
            path.append((None, seq[j - 1]))
            j -= 1
        self._weave(path[::-1], weight)

    def heaviest(self) -> str:
        """The path of greatest summed weight, where a path that most sequences
        leave early doesn't gain by going on: every edge counts its weight less
        half of what passes its columns."""
        total = sum(self.starts.values())
        best: dict[int, tuple[float, int | None]] = {}
        for i in self.order():
            options = [(best[p][0] + self.after[p][i] - total / 2, p) for p in self.before[i]]
            options.append((self.starts[i] - total / 2 if self.starts[i] else -1e9, None))
            best[i] = max(options, key=lambda o: o[0])
        node = max(best, key=lambda i: best[i][0] + (self.ends[i] - total / 2 if self.ends[i] else -1e9))
        out = []
        while node is not None:
            out.append(self.bases[node])
            node = best[node][1]
        return "".join(out[::-1])


def by_counts(backend: Backend) -> bool:
    """Does it need distinct sequences and their counts only? Others get every read, in order."""
    return type(backend).consensus is Backend.consensus


def consensus_of(seqs: list[str], backend: Backend) -> tuple[str, str]:
    """(consensus, method): empty, single, the backend's name, or mode if it fails."""
    seqs = [s for s in seqs if s]
    if not seqs:
        return "", "empty"
    if len(seqs) == 1:
        return seqs[0], "single"
    if by_counts(backend):
        return consensus_of_counts(Counter(seqs), backend)
    return _polished(seqs, lambda: backend.consensus(seqs), backend)


def consensus_of_counts(counts: dict[str, int], backend: Backend) -> tuple[str, str]:
    """The same of distinct sequences in the order in which they were seen, for backends that go ``by_counts``."""
    counts = {s: n for s, n in counts.items() if s}
    if not counts:
        return "", "empty"
    if sum(counts.values()) == 1:
        return next(iter(counts)), "single"
    return _polished(counts, lambda: backend.weighted(counts), backend)


def _polished(seqs, consensus, backend: Backend) -> tuple[str, str]:
    try:
        found = consensus()
        if found:
            return found, backend.name
    except Exception:  # noqa: BLE001 - any failure of a plug-in has the same answer
        pass
    return most_frequent(seqs), "mode"
