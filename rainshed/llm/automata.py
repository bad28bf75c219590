"""Weighted acyclic automata over words: counts of word sequences, shared prefixes and suffixes stored once.

States are numbered in the order they were closed, so every arc leads to a smaller number and the root is the last.  A
state's weight is the count of the sequence that ends in it.  All sequences of an automaton have the same length.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from rainshed.llm.packing import pack, pack_bytes, unpack, unpack_bytes

HEAD = struct.Struct("<5Q")  # bytes of the weights, sizes of states, labels and targets of arcs, words


@dataclass
class Automaton:
    labels: list[bytes]  #: ascending; none holds a line feed
    weight: np.ndarray  #: int64, of each state
    first: np.ndarray  #: int64, states + 1: where a state's arcs begin
    label: np.ndarray  #: int32, of each arc, ascending within a state
    target: np.ndarray  #: int32, of each arc

    @classmethod
    def build(cls, labels: Sequence[bytes], rows: np.ndarray, weights: np.ndarray) -> Automaton:
        """Incrementally from ascending, distinct ``rows`` (m, n) of label numbers with positive weights.

        Sequences with the same prefix lie together; from the longest prefixes to the shortest, each in order, the state
        behind a prefix is closed: if a state with the same arcs is registered, that one stands for it.  Labels that no row
        uses are dropped.
        """
        used = np.unique(rows)
        labels = [labels[i] for i in used.tolist()]
        rows = np.searchsorted(used, rows).astype(np.int32)
        weight, child = np.unique(weights, return_inverse=True)
        states, sizes, arcs = len(weight), [np.zeros(len(weight), dtype=np.int64)], [np.zeros((0, 2), dtype=np.int32)]
        for depth in range(rows.shape[1] - 1, -1, -1):
            out = np.column_stack([rows[:, depth], child]).astype(np.int32)
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], len(rows)] if len(begin) else begin
            data, register, state, fresh = out.tobytes(), {}, [], []
            for i, (x, y) in enumerate(zip((8 * begin).tolist(), (8 * end).tolist())):
                key = data[x:y]
                at = register.get(key)
                if at is None:
                    at = register[key] = states + len(fresh)
                    fresh.append(i)
                state.append(at)
            states += len(fresh)
            size = end - begin
            closed = np.zeros(len(begin), dtype=bool)
            closed[fresh] = True
            sizes.append(size[fresh])
            arcs.append(out[np.repeat(closed, size)])
            rows, child = rows[begin, :depth], np.array(state, dtype=np.int64)
        if not len(child):  # no sequences: the root alone
            states, sizes = 1, [np.zeros(1, dtype=np.int64)]
        flat = np.concatenate(arcs)
        every = np.zeros(states, dtype=np.int64)
        every[: len(weight)] = weight
        return cls(labels, every, np.r_[0, np.cumsum(np.concatenate(sizes), dtype=np.int64)], flat[:, 0].copy(), flat[:, 1].copy())

    @property
    def root(self) -> int:
        return len(self.weight) - 1

    def _arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``states``, arc) for every arc out of them, in order."""
        sizes = self.first[states + 1] - self.first[states]
        who = np.repeat(np.arange(len(states)), sizes)
        begin = np.cumsum(sizes) - sizes
        return who, np.arange(len(who)) - begin[who] + self.first[states][who]

    def rows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of length ``n``, ascending, as label numbers (m, n), and their weights."""
        states, out = np.array([self.root]), np.zeros((1, 0), dtype=np.int64)
        for _ in range(n):
            who, arc = self._arcs(states)
            states, out = self.target[arc].astype(np.int64), np.column_stack([out[who], self.label[arc]])
        ends = self.weight[states]
        return out[ends > 0], ends[ends > 0]

    @cached_property
    def _keys(self) -> np.ndarray:
        state = np.repeat(np.arange(len(self.weight)), np.diff(self.first))
        return state * max(len(self.labels), 1) + self.label

    def compose(self, other: Automaton, n: int) -> np.ndarray:
        """The weight in ``other`` of each of this automaton's sequences of length ``n``, in order; 0 where it has none.

        Both are walked together, a level of pairs of states at a time.
        """
        at = {x: i for i, x in enumerate(other.labels)}
        theirs = np.array([at.get(x, -1) for x in self.labels], dtype=np.int64)
        mine, found = np.array([self.root]), np.array([other.root])
        for _ in range(n):
            who, arc = self._arcs(mine)
            mine, label, state = self.target[arc].astype(np.int64), theirs[self.label[arc]], found[who]
            key = state * max(len(other.labels), 1) + label
            place = np.minimum(np.searchsorted(other._keys, key), max(len(other._keys) - 1, 0))
            hit = (state >= 0) & (label >= 0)
            hit &= other._keys[place] == key if len(other._keys) else False
            found = np.where(hit, other.target[place], -1).astype(np.int64) if len(other._keys) else np.full(len(key), -1)
        ends = np.where(found >= 0, other.weight[found], 0)
        return ends[self.weight[mine] > 0]

    def dumps(self) -> bytes:
        delta = np.diff(self.label, prepend=np.int32(0))  # labels ascend within a state
        parts = [pack(self.weight), pack(np.diff(self.first)), pack(delta), pack(self.target), pack_bytes(b"\n".join(self.labels))]
        return HEAD.pack(*map(len, parts)) + b"".join(parts)

    @classmethod
    def loads(cls, data: bytes) -> Automaton:
        at, parts = HEAD.size, []
        for size in HEAD.unpack_from(data):
            parts.append(data[at : at + size])
            at += size
        weight, sizes, delta, target = map(unpack, parts[:4])
        text = unpack_bytes(parts[4])
        return cls(text.split(b"\n") if len(delta) else [], weight, np.r_[0, np.cumsum(sizes)], np.cumsum(delta).astype(np.int32), target.astype(np.int32))


def union(parts: Sequence[Automaton], n: int, least: int = 1) -> tuple[Automaton, list[np.ndarray]]:
    """Sequences of length ``n`` of all ``parts``, weights summed; those below ``least`` are left out.  With it, for each
    part, which of its sequences are in the union."""
    labels = sorted(set().union(*[p.labels for p in parts]))
    at = dict(zip(labels, range(len(labels))))
    rows, weights = [np.zeros((0, n), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for p in parts:
        r, w = p.rows(n)
        to = np.fromiter(map(at.__getitem__, p.labels), dtype=np.int32, count=len(p.labels))
        rows.append(to[r] if len(r) else r.astype(np.int32))
        weights.append(w)
    every, weight = np.concatenate(rows), np.concatenate(weights)
    order = np.lexsort(every.T[::-1])
    sorted_ = every[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    begin = np.flatnonzero(new)
    sums = np.add.reduceat(weight[order], begin) if len(begin) else weight
    keep = sums >= least
    live = np.zeros(len(every), dtype=bool)
    live[order] = keep[np.cumsum(new) - 1] if len(every) else False
    whole = Automaton.build(labels, sorted_[begin[keep]], sums[keep])
    return whole, np.split(live, np.cumsum([len(w) for w in weights[1:]])[:-1]) if parts else []
