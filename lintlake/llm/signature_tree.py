"""Signature trees over token sets: nodes hold OR-combined token bitmaps and size ranges.

A dual traversal of the tree with itself visits pairs of nodes and prunes a pair when no two
members can be similar enough: the tokens of ``a`` that fall on bits of a bitmap ``B`` are at
most ``|bits(a) & B|`` plus the tokens of ``a`` that share a bit with another one, so node pairs
have an upper bound on the overlap of any two members.  Pairs whose members are already linked
with each other are pruned too, as only the groups are wanted.  Surviving pairs of sets are
compared exactly.
"""

from __future__ import annotations

import numpy as np

from lintlake.llm.common import pow2_at_least

FAN = 8
PAIRS_AT_ONCE = 1 << 15


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


class _Tree:
    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        bits = min(max(pow2_at_least(2 * int(sizes.max())), 256), 16384)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        words = np.zeros((len(sizes), bits // 8), np.uint8)
        for at in range(0, len(sizes), 512):  # bounded scratch
            mine = slice(*np.searchsorted(rows, [at, at + 512]))
            m = np.zeros((min(512, len(sizes) - at), bits), bool)
            m[rows[mine] - at, (flat[mine] & np.uint64(bits - 1)).astype(np.int64)] = True
            words[at:at + 512] = np.packbits(m, axis=1)
        maps = words.view(np.uint64)
        extra = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, extra)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex = self.levels[-1]
            cut = np.arange(0, len(m), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))

    def may_link(self, level: int, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        maps, lo, hi, extra = self.levels[level]
        common = np.bitwise_count(maps[u] & maps[v]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(extra[u], extra[v]), np.minimum(hi[u], hi[v]))
        fits = (100 * hi[u] >= percent * lo[v]) & (100 * hi[v] >= percent * lo[u])
        return fits & ((100 + percent) * most >= percent * (lo[u] + lo[v]))


def _children(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    a = (u[:, None] * FAN + np.arange(FAN)).repeat(FAN, axis=1).ravel()
    b = np.tile(v[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
    ok = (a <= b) & (b < n)
    return a[ok], b[ok]


def linked_groups(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """A group number for each sorted, non-empty set; sets in one group are reachable by links.

    Two sets link when ``100 * |both| >= percent * |either|``.  ``known`` gives groups found
    earlier.  With ``side`` only pairs of different sides are compared.
    """
    m = len(sets)
    group = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    if m < 2 or (group == group[0]).all():
        return group
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.array([s[0] for s in sets]), sizes))
    sets, sizes, group = [sets[i] for i in order], sizes[order], group[order]
    side = None if side is None else side[order]
    flat = np.concatenate(sets)
    first = np.cumsum(sizes) - sizes

    def join(i: int, others: np.ndarray) -> None:
        group[np.isin(group, group[others])] = group[i]

    # one set against all, so that a group of near copies becomes one before any pairs are made
    hub = int(np.flatnonzero(group == np.bincount(group).argmax())[0])
    at = np.searchsorted(sets[hub], flat)
    at[at == sizes[hub]] = sizes[hub] - 1
    both = np.add.reduceat((sets[hub][at] == flat).astype(np.int64), first)
    hits = (100 + percent) * both >= percent * (sizes + sizes[hub])
    if side is not None:
        hits &= side != side[hub]
    if hits.any():
        join(hub, np.flatnonzero(hits))

    tree = _Tree(flat, sizes)
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, u, v = stack.pop()
        if len(u) > PAIRS_AT_ONCE:
            stack.append((level, u[PAIRS_AT_ONCE:], v[PAIRS_AT_ONCE:]))
            u, v = u[:PAIRS_AT_ONCE], v[:PAIRS_AT_ONCE]
        cut = np.arange(0, m, FAN ** level)
        low, high = np.minimum.reduceat(group, cut), np.maximum.reduceat(group, cut)
        open_ = ~((low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v]))
        u, v = u[open_], v[open_]
        keep = tree.may_link(level, u, v, percent)
        u, v = u[keep], v[keep]
        if level:
            if len(u):
                stack.append((level - 1, *_children(u, v, len(tree.levels[level - 1][0]))))
            continue
        if side is not None:
            across = side[u] != side[v]
            u, v = u[across], v[across]
        for i, j in zip(u.tolist(), v.tolist()):
            if group[i] != group[j] and (100 + percent) * _overlap(sets[i], sets[j]) >= percent * (sizes[i] + sizes[j]):
                join(i, np.array([j]))
    out = np.empty(m, np.int64)
    out[order] = group
    return out
