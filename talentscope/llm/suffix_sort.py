"""Deep-shallow ordering of suffixes by their first ``depth`` bytes."""

from __future__ import annotations

import numpy as np

SHALLOW = 24                     # bytes ordered by multikey quicksort, eight at a time


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes only know the depth and
    the branching byte; one full comparison per inserted string finds its place."""

    def __init__(self):
        self.root = None         # ("leaf", string, members) or ["node", depth, {byte: child}]

    def insert(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = ("leaf", s, [member])
            return
        node, path = self.root, []
        while node[0] == "node":                       # blind descent
            path.append(node)
            child = node[2].get(s[node[1]])
            node = child if child is not None else next(iter(node[2].values()))
        t = node[1]
        if t == s:
            node[2].append(member)
            return
        lcp = next(i for i, (x, y) in enumerate(zip(s, t)) if x != y)
        parent = None
        here = self.root
        while here[0] == "node" and here[1] < lcp:
            parent, here = here, here[2][s[here[1]]]
        leaf = ("leaf", s, [member])
        if here[0] == "node" and here[1] == lcp:
            here[2][s[lcp]] = leaf
            return
        new = ["node", lcp, {t[lcp]: here, s[lcp]: leaf}]
        if parent is None:
            self.root = new
        else:
            parent[2][s[parent[1]]] = new

    def ordered(self):
        """Member lists of the distinct strings in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == "leaf":
                yield node[2]
            else:
                stack.extend(c for _, c in sorted(node[2].items(), reverse=True))


def big_endian(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that orders like them."""
    rows = np.lib.stride_tricks.sliding_window_view(raw, 8)[at]
    return np.ascontiguousarray(rows).view(">u8").ravel().astype(np.uint64)


def deep_shallow(raw: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at ``starts`` in order of their first ``depth``
    bytes, and for each of the ordered suffixes the number of its group of equal
    strings. All suffixes have ``depth`` bytes.

    Multikey quicksort to ``SHALLOW`` bytes: each step orders all open groups by
    their next eight bytes and splits them; groups of one are done. What is still
    together is ordered by a blind trie per group, unless all its strings are
    equal already."""
    n = len(starts)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)
    at = 0
    while at < min(SHALLOW, depth - 7) and n:
        size = np.bincount(group)
        open_ = np.flatnonzero(size[group] > 1)          # positions of groups with company
        if not len(open_):
            break
        key = big_endian(raw, starts[order[open_]] + at)
        rank = np.lexsort((key, group[open_])) if at else np.argsort(key, kind="stable")
        order[open_] = order[open_[rank]]
        full = np.zeros(n, dtype=np.uint64)
        full[open_] = key[rank]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (full[1:] != full[:-1])
        group = np.cumsum(fresh) - 1
        at += 8
    if not n:
        return order, group
    size = np.bincount(group)
    first = np.concatenate([[0], np.cumsum(size)])
    split = np.zeros(n, dtype=bool)                       # a new string begins here
    split[first[:-1]] = True
    deep = np.flatnonzero(size > 1)
    if len(deep):
        inside = np.flatnonzero(size[group] > 1)
        heads = starts[order[first[group[inside]]]]
        same = np.ones(len(inside), dtype=bool)
        mine = starts[order[inside]]
        for i in [*range(at, depth - 8, 8), depth - 8]:
            same &= big_endian(raw, mine + i) == big_endian(raw, heads + i)
        uneven = np.unique(group[inside[~same]])
        for g in uneven.tolist():
            lo, hi = first[g], first[g + 1]
            trie = BlindTrie()
            for m in order[lo:hi].tolist():
                s = int(starts[m])
                trie.insert(raw[s + at:s + depth].tobytes(), m)
            out = lo
            for members in trie.ordered():
                split[out] = True
                order[out:out + len(members)] = members
                out += len(members)
    return order, np.cumsum(split) - 1
