"""Nearest names by edit similarity: one side as a trie, searched level by level for many names at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Places of the trie that the first, quick search keeps for each name.
BEAM = 4
#: Cells of edit distances that are computed at once.
CELLS = 1 << 21


def _codes(names: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")


def _levels(names: Sequence[str], kind: type) -> list[tuple[np.ndarray, ...]]:
    """For each length of a prefix the trie's nodes in order: parent (in the level
    before), code point, the name that ends there (else -1), and of the names
    below the first one, the least and the greatest length."""
    size, flat = np.array([len(n) for n in names]), _codes(names)
    begin, order = np.cumsum(size) - size, np.array(sorted(range(len(names)), key=names.__getitem__))
    here = order[size[order] > 0]
    parent, out = np.zeros(len(here), int), []
    while len(here):
        code = flat[begin[here] + len(out)]
        fresh = np.r_[True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])]
        first, node, ends = np.flatnonzero(fresh), np.cumsum(fresh) - 1, size[here] == len(out) + 1
        end = np.full(len(first), -1)
        end[node[ends]] = here[ends]
        lengths = size[here].astype(kind)
        out.append((parent[first], code[first], end, np.minimum.reduceat(here, first), np.minimum.reduceat(lengths, first), np.maximum.reduceat(lengths, first)))
        here, parent = here[~ends], node[~ends]
    return out


def nearest(lefts: Sequence[str], rights: Sequence[str]) -> np.ndarray:
    """For each left name the place of the right name with the greatest similarity,
    1 - distance / longer length; of equal ones the first. Where all are 0 that is place 0.

    A place of the trie is left only if no name below it can beat the best one
    found so far, so the result is that of comparing all pairs. A quick search along
    few places finds a good name first. Both hold at most some CELLS at once."""
    size = np.array([len(n) for n in lefts], int)
    kind = np.int16 if max([*size, *map(len, rights)], default=0) < 1 << 14 else np.int32
    tree, best = _levels(rights, kind), np.zeros(len(size), int)
    for m in np.unique(size[size > 0]):
        those = np.flatnonzero(size == m)
        for part in np.array_split(those, -(-len(those) * (m + 1) // CELLS)):
            best[part] = _search(_codes([lefts[i] for i in part]).reshape(-1, m).T.copy(), tree, kind)
    return best


def _search(names: np.ndarray, tree: list[tuple[np.ndarray, ...]], kind: type) -> np.ndarray:
    """As nearest(), for names of one length, given as their code points (place in the name, name)."""
    m, n = names.shape
    best, far, longest = np.zeros(n, int), np.ones(n, int), np.ones(n, int)  # far / longest: the best distance by length

    def step(depth: int, who: np.ndarray, old: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distances of all prefixes of the names to each child, and the least distance that a name below it can have."""
        _, codes, ends, first, short, long = tree[depth]
        new, code = np.empty_like(old), codes[child]
        new[0] = old[0] + kind(1)
        least, most = short[child] - kind(depth + 1), long[child] - kind(depth + 1)
        bound = new[0] + np.maximum(np.maximum(kind(m) - most, least - kind(m)), kind(0))
        for i in range(1, m + 1):
            np.minimum(np.minimum(old[i], new[i - 1]) + kind(1), old[i - 1] + (names[i - 1][who] != code), out=new[i])
            rest = kind(m - i)
            np.minimum(bound, new[i] + np.maximum(np.maximum(rest - most, least - rest), kind(0)), out=bound)
        done = np.flatnonzero(ends[child] >= 0)
        if len(done):  # the nearest of each name's ends, if it beats what is known
            by = np.lexsort((ends[child[done]], new[m][done], who[done]))
            done = done[by][np.r_[True, np.diff(who[done][by]) > 0]]
            w, d, e, size = who[done], new[m][done].astype(int), ends[child[done]], max(m, depth + 1)
            wins = (d * longest[w] < far[w] * size) | ((d * longest[w] == far[w] * size) & (e < best[w]))
            best[w[wins]], far[w[wins]], longest[w[wins]] = e[wins], d[wins], size
        a, b = bound * longest[who], far[who] * np.maximum(long[child], m)
        keep = (long[child] > depth + 1) & ((a < b) | ((a == b) & (first[child] < best[who])))
        return who[keep], child[keep], new[:, keep], bound[keep]

    for quick in (True, False):
        stack = [(0, np.arange(n), np.zeros(n, int), np.repeat(np.arange(m + 1, dtype=kind)[:, None], n, 1))]
        while stack:
            depth, who, node, rows = stack.pop()
            if depth == len(tree) or not len(node):
                continue
            begin = np.searchsorted(tree[depth][0], node)
            many = np.searchsorted(tree[depth][0], node, "right") - begin
            if many.sum() * (m + 1) > CELLS and len(node) > 1:
                half = len(node) // 2
                stack += [(depth, who[half:], node[half:], rows[:, half:]), (depth, who[:half], node[:half], rows[:, :half])]
                continue
            up = np.repeat(np.arange(len(node)), many)
            child = np.arange(len(up)) + np.repeat(begin - np.cumsum(many) + many, many)
            who, node, rows, bound = step(depth, who[up], rows[:, up], child)
            if quick and len(node):
                by = np.lexsort((bound, who))
                starts = np.flatnonzero(np.r_[True, np.diff(who[by]) > 0])
                by = by[np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)])) < BEAM]
                who, node, rows = who[by], node[by], rows[:, by]
            stack.append((depth + 1, who, node, rows))
    return best


def tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """The nearest _name of the right table, with its _id, for each _left (ties: smallest _id)."""
    right = right.sort_by("_id")
    left = left.slice(0, len(left) if len(right) else 0)
    found = right.take(pa.array(nearest(left["_left"].to_pylist(), right["_name"].to_pylist()), pa.int64()))
    return pa.table({"_block": left["_block"], "_left": left["_left"], "_name": found["_name"], "_id": found["_id"]})
