"""Weighted acyclic automata over sequences of 64-bit labels: each accepted sequence has a positive whole weight.

Built from sorted sequences, level by level: sequences that begin alike share states, as they are neighbours, and from the last
level up states with equal arcs, outputs and ends are made one. An arc's output is what all sequences through it have at
least beyond the arcs before it, so equal endings are shared even where weights differ.
"""

from __future__ import annotations

import numpy as np

from panelspark.llm.common import mix, within


class Transducer:
    """depth d has states 0..n; first, label, output and target are their arcs to depth d + 1; final is what is added at an end, or -1."""

    def __init__(self, first: list, label: list, output: list, target: list, final: list):
        self.first, self.label, self.output, self.target, self.final = first, label, output, target, final

    @classmethod
    def build(cls, paths: np.ndarray, weight: np.ndarray) -> Transducer:
        """Of distinct rows of labels in ascending order; shorter ones end in zeros."""
        n, depth = paths.shape
        length = (paths != 0).sum(axis=1)
        differs = np.ones((n, depth), bool)
        if n:
            differs[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        starts, lows = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        parents, nodes = [], np.zeros(n, np.int64)
        finals = [np.full(1, -1, np.int64)]
        for d in range(1, depth + 1):
            new = differs[:, d - 1] & (length >= d)
            at = np.flatnonzero(new)
            low = np.minimum.reduceat(np.where(length >= d, weight, np.iinfo(np.int64).max), at) if len(at) else np.zeros(0, np.int64)
            parents.append(nodes[at])
            nodes = np.cumsum(new) - 1
            starts.append(at)
            lows.append(low)
            finals.append(np.where(length[at] == d, weight[at] - low, -1))
        first, label, output, target, final = [], [], [], [], [finals[depth][:1]]
        of = np.zeros(len(starts[depth]), np.int64)  # on the last level all that is left to add is nothing
        for d in range(depth - 1, -1, -1):
            parent, at = parents[d], starts[d + 1]
            lab, out = paths[at, d], lows[d + 1] - lows[d][parent]
            begin = np.searchsorted(parent, np.arange(len(starts[d]) + 1))
            keep, own = _same(begin, lab, out, of, finals[d])
            count = np.diff(begin)[keep]
            arcs = np.repeat(begin[keep], count) + within(count)
            first.append(np.concatenate([[0], np.cumsum(count)]))
            label.append(lab[arcs])
            output.append(out[arcs])
            target.append(of[arcs])
            final.append(finals[d][keep])
            of = own
        return cls(*(x[::-1] for x in (first, label, output, target, final)))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences in ascending order, and their weights."""
        depth = len(self.first)
        state, total, row = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, depth), np.uint64)
        rows, weights = [], []
        for d in range(depth + 1):
            if len(self.final[d]):
                end = self.final[d][state]
                rows.append(row[end >= 0])
                weights.append((total + end)[end >= 0])
            if d == depth:
                break
            count = np.diff(self.first[d])[state]
            arcs = np.repeat(self.first[d][state], count) + within(count)
            row, total = np.repeat(row, count, axis=0), np.repeat(total, count) + self.output[d][arcs]
            row[:, d] = self.label[d][arcs]
            state = self.target[d][arcs]
        rows, weights = np.concatenate(rows), np.concatenate(weights)
        order = np.lexsort(rows.T[::-1])
        return rows[order], weights[order]

    def compose(self, asked: np.ndarray) -> np.ndarray:
        """The weight of each row of labels, 0 where it is not accepted: all rows go through the arcs side by side."""
        n, width = asked.shape
        length = (asked != 0).sum(axis=1)
        state, total, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), length <= len(self.first)
        out = np.zeros(n, np.int64)
        for d in range(min(width, len(self.first)) + 1):
            ends = np.flatnonzero(alive & (length == d))
            if len(ends) and len(self.final[d]):
                end = self.final[d][state[ends]]
                out[ends] = np.where(end >= 0, total[ends] + end, 0)
            go = np.flatnonzero(alive & (length > d))
            if not len(go) or d == len(self.first):
                break
            lo, hi, want = self.first[d][state[go]], self.first[d][state[go] + 1], asked[go, d]
            stop, label = hi.copy(), self.label[d]
            while (open_ := lo < hi).any():  # labels of a state are in order
                mid = (lo + hi) >> 1
                less = open_ & (label[np.minimum(mid, len(label) - 1)] < want)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            found = lo < stop
            found[found] = label[lo[found]] == want[found]
            alive[go[~found]] = False
            arc = lo[found]
            total[go[found]] += self.output[d][arc]
            state[go[found]] = self.target[d][arc]
        return out

    def pack(self) -> bytes:
        shape = np.array([len(self.first), *map(len, self.first), *map(len, self.label), *map(len, self.final)], np.int64)
        parts = [shape, *self.first, *self.label, *self.output, *self.target, *self.final]
        return b"".join(p.astype(np.int64, copy=False).tobytes() if p.dtype != np.uint64 else p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, body: bytes) -> Transducer:
        a = np.frombuffer(body, np.int64)
        k = int(a[0])
        firsts, arcs, finals = a[1 : k + 1].tolist(), a[k + 1 : 2 * k + 1].tolist(), a[2 * k + 1 : 3 * k + 2].tolist()
        at, out = 3 * k + 2, []
        for sizes in (firsts, arcs, arcs, arcs, finals):
            out.append([])
            for n in sizes:
                out[-1].append(a[at : at + n])
                at += n
        out[1] = [x.view(np.uint64) for x in out[1]]
        return cls(*out)


def _same(begin: np.ndarray, label: np.ndarray, output: np.ndarray, target: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One state of each set of equal ones, and of which of them each state is. A hash proposes, arcs and ends decide."""
    arc = mix(label ^ mix(output.astype(np.uint64) ^ mix(target.astype(np.uint64) + np.uint64(0x51ED270B))))
    sums = np.zeros(len(arc) + 1, np.uint64)
    np.cumsum(arc, out=sums[1:])
    count = np.diff(begin)
    h = mix(sums[begin[1:]] - sums[begin[:-1]] ^ mix(final.astype(np.uint64) + np.uint64(7))) + count.astype(np.uint64)
    _, keep, of = np.unique(h, return_index=True, return_inverse=True)
    like = keep[of]
    same = (final == final[like]) & (count == count[like])
    n = np.where(same, count, 0)
    a, b = np.repeat(begin[:-1], n) + within(n), np.repeat(begin[like], n) + within(n)
    odd = (label[a] != label[b]) | (output[a] != output[b]) | (target[a] != target[b])
    same[np.repeat(np.arange(len(count)), n)[odd]] = False
    alone = np.flatnonzero(~same)
    of = of.copy()
    of[alone] = len(keep) + np.arange(len(alone))
    return np.concatenate([keep, alone]), of


def summed(paths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order with the sums of their weights."""
    if not len(paths):
        return paths, weight
    order = np.lexsort(paths.T[::-1])
    paths, weight = paths[order], weight[order]
    new = np.ones(len(paths), bool)
    new[1:] = (paths[1:] != paths[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return paths[at], np.add.reduceat(weight, at)
