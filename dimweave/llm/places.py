"""What links in a meeting place: sets of shingles, compared by exact Jaccard similarity within one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows (`columns`, after the values of `by`) of each group of equal `by`, of rows that come sorted by it; a group may span batches."""
    here, held = None, []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*by, *columns)]
        for row in zip(*cols, strict=True):
            if row[: len(by)] != here:
                if held:
                    yield held
                here, held = row[: len(by)], []
            held.append(row)
    if held:
        yield held


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    """Links as a batch (u, v), the smaller id first."""
    p = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(p.min(axis=1)), pa.array(p.max(axis=1))], names=["u", "v"])


class Place:
    """Sets (sorted distinct hashes) that meet, of one block or of two, and what is known to link.

    Two link if their Jaccard similarity is at least `percent` / 100.
    """

    def __init__(self, blocks: Sequence[int], ids: Sequence[int], sets: Sequence[np.ndarray], percent: int):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.blocks, self.ids = np.array(blocks, np.int64)[order], np.array(ids, np.int64)[order]
        self.sets, self.percent = [sets[i] for i in order], percent
        self.sizes = np.array(list(map(len, self.sets)), np.int64)
        self.parent, self.links = list(range(len(order))), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        if a != b:
            self.parent[b] = a
            self.links.append((int(self.ids[i]), int(self.ids[j])))

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that link with set i."""
        sizes, own = self.sizes[others], self.sets[i]
        fits = 100 * np.minimum(sizes, len(own)) >= self.percent * np.maximum(sizes, len(own))
        if not fits.all():
            others, sizes = others[fits], sizes[fits]
        if not len(others):
            return others
        flat = np.concatenate([self.sets[j] for j in others])
        hit = own[np.minimum(own.searchsorted(flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        return others[100 * both >= self.percent * (len(own) + sizes - both)]

    def hubs(self, most: int, named: int | None = None) -> bool:
        """Compares up to `most` hubs, the set `named` first if it is here, with what no hub has linked yet; whether several components are left to compare."""
        n = len(self.ids)
        # the round that made a set a hub, and the last one that it was compared in
        self.hub, self.until = np.full(n, n + 1), np.full(n, n)
        left, here = np.arange(n), np.ones(n, bool)
        for k in range(most):
            if len(left) < 2:
                break
            hub = int(left[len(left) // 2])
            if k == 0 and named is not None and (self.ids == named).any():
                hub = int(np.flatnonzero(self.ids == named)[0])
            here[hub] = False
            self.hub[hub] = self.until[hub] = k
            near = self.near(hub, left[here[left]])
            for i in near.tolist():
                self.link(hub, i)
            here[near], self.until[near] = False, k
            left = left[here[left]]
        if len(left) < 2 and len(self.links) in (0, n - 1):
            return False  # all linked, or all compared
        return any(self.root(i) != self.root(0) for i in range(n))

    def rest(self) -> None:
        """Compares all outside the largest component with all other components, but for what a hub was compared with."""
        roots = np.array([self.root(i) for i in range(len(self.ids))])
        main = np.bincount(roots).argmax()
        for i in np.flatnonzero(roots != main).tolist():
            others = np.flatnonzero((self.hub > self.until[i]) & (self.until < self.hub[i]) & (roots != roots[i]))
            for j in self.near(i, others).tolist():
                self.link(i, j)
