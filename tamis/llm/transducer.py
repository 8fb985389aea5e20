"""Sorted sequences with counts as weighted acyclic automata.

An automaton reads a sequence of symbols and gives its count: the weight of the
last arc of the path, 0 where the sequence was not counted itself. It is built
in one sweep over sorted sequences; a state is finished when the sweep leaves
its prefix, and states with the same arcs are one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

NONE = 0  # symbol number that fills up sequences shorter than the longest


def folded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    return rows[first], np.add.reduceat(counts, first)


class Level(NamedTuple):
    """Nodes of one depth in the order of their sequences."""

    node: np.ndarray  # of each row, -1 where the row is shorter
    first: np.ndarray  # the first row below each node
    parent: np.ndarray
    weight: np.ndarray


def levels(rows: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The nodes above sorted distinct rows, depth by depth."""
    out, new, above = [], np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    new[:1] = True
    for d in range(rows.shape[1]):
        there = rows[:, d] != NONE
        new[1:] |= rows[1:, d] != rows[:-1, d]
        first = np.flatnonzero(new & there)
        node = np.where(there, np.cumsum(new & there) - 1, -1)
        ends = there & (rows[:, d + 1] == NONE) if d + 1 < rows.shape[1] else there
        weight = np.zeros(len(first), np.int64)
        weight[node[ends]] = counts[ends]
        out.append(Level(node, first, above[first], weight))
        above = node
    return out


class Transducer(NamedTuple):
    """State ``s`` has the arcs from ``start[s]`` to ``start[s + 1]``; state 0 has none."""

    words: list[bytes]  # sorted; symbol i stands for words[i - 1]
    start: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    root: int

    @classmethod
    def build(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From sorted distinct rows of symbols; only the words that occur are kept."""
        used = np.unique(rows)
        used = used[used != NONE]
        rows = np.where(rows == NONE, 0, np.searchsorted(used, rows) + 1)
        register: dict[bytes, int] = {b"": 0}
        nodes = levels(rows, counts)
        state = np.zeros(len(nodes[-1].first), np.int64)
        for d in reversed(range(len(nodes))):
            arcs = np.stack((rows[nodes[d].first, d], nodes[d].weight, state), 1)
            state = np.zeros(len(nodes[d - 1].first) if d else 1, np.int64)
            cuts = np.searchsorted(nodes[d].parent, np.arange(len(state) + 1))
            above = np.flatnonzero(cuts[1:] > cuts[:-1])
            for s, begin, end in zip(above.tolist(), cuts[above].tolist(), cuts[above + 1].tolist(), strict=True):
                state[s] = register.setdefault(arcs[begin:end].tobytes(), len(register))
        flat = np.frombuffer(b"".join(register), np.int64).reshape(-1, 3)
        start = np.cumsum([0, *(len(k) // 24 for k in register)])
        return cls([words[i - 1] for i in used.tolist()], start, flat[:, 0], flat[:, 1], flat[:, 2], int(state[0]))

    def rows(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """All counted sequences and their counts, ``depth`` symbols at most."""
        found, counts = [np.zeros((0, depth), np.int64)], [np.zeros(0, np.int64)]
        states, before = np.array([self.root]), np.zeros((1, 0), np.int64)
        for d in range(depth):
            size = self.start[states + 1] - self.start[states]
            arc = np.repeat(self.start[states] - np.cumsum(size) + size, size) + np.arange(size.sum())
            before = np.concatenate((np.repeat(before, size, axis=0), self.label[arc][:, None]), axis=1)
            own = self.weight[arc] > 0
            found.append(np.pad(before[own], ((0, 0), (0, depth - d - 1))))
            counts.append(self.weight[arc][own])
            states = self.target[arc]
        return np.concatenate(found), np.concatenate(counts)

    def dump(self) -> bytes:
        """States, arcs and words are numbered in 32 bits; weights take 64 where one needs them."""
        heavy = np.int64 if len(self.weight) and self.weight.max() > np.iinfo(np.int32).max else np.int32
        head = np.array([len(self.words), len(self.start), len(self.label), self.root, np.dtype(heavy).itemsize], np.int64)
        sizes = np.array([len(w) for w in self.words], np.int32)
        numbers = (np.ascontiguousarray(x, np.int32).tobytes() for x in (sizes, self.start, self.label, self.target))
        return b"".join((head.tobytes(), *numbers, np.ascontiguousarray(self.weight, heavy).tobytes(), *self.words))

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        n_words, n_starts, n_arcs, root, wide = np.frombuffer(raw, np.int64, 5).tolist()
        cuts = np.cumsum([n_words, n_starts, n_arcs, n_arcs])
        numbers = np.frombuffer(raw, np.int32, cuts[-1], 40).astype(np.int64)
        sizes, start, label, target = np.split(numbers, cuts[:-1])
        at = 40 + 4 * int(cuts[-1])
        weight = np.frombuffer(raw, np.int64 if wide == 8 else np.int32, n_arcs, at).astype(np.int64)
        ends = (np.cumsum(sizes) + at + wide * n_arcs).tolist()
        return cls([raw[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)], start, label, weight, target, root)


def union(parts: list[Transducer], depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All sequences of the automata with the sums of their counts: words, sorted rows, counts."""
    words = sorted({w for p in parts for w in p.words})
    number = {w: i for i, w in enumerate(words, 1)}
    rows, counts = [np.zeros((0, depth), np.int64)], [np.zeros(0, np.int64)]
    for p in parts:
        own, n = p.rows(depth)
        rows.append(np.array([NONE, *(number[w] for w in p.words)])[own])
        counts.append(n)
    return words, *folded(np.concatenate(rows), np.concatenate(counts))
