"""CF-tree: cluster features under a bounded branching factor (Zhang et al. 1996)."""

from __future__ import annotations

import numpy as np


class _Node:
    """Up to ``width`` entries; ``below`` holds child nodes, or subcluster numbers in a leaf."""

    __slots__ = ("n", "ls", "ss", "mean", "below", "leaf")

    def __init__(self, width: int, d: int, leaf: bool):
        # one entry more than allowed: a full node is split right after it was added
        self.n, self.ss = np.zeros(width + 1), np.zeros(width + 1)
        self.ls, self.mean = np.zeros((width + 1, d)), np.zeros((width + 1, d))
        self.below: list = []
        self.leaf = leaf

    def put(self, at: int, n: float, ls: np.ndarray, ss: float) -> None:
        self.n[at], self.ls[at], self.ss[at] = n, ls, ss
        self.mean[at] = ls / n

    def append(self, n: float, ls: np.ndarray, ss: float, below) -> None:
        self.put(len(self.below), n, ls, ss)
        self.below.append(below)

    def closest(self, mean: np.ndarray) -> int:
        return int(np.argmin(((self.mean[: len(self.below)] - mean) ** 2).sum(axis=1)))

    def total(self) -> tuple[float, np.ndarray, float]:
        k = len(self.below)
        return float(self.n[:k].sum()), self.ls[:k].sum(axis=0), float(self.ss[:k].sum())


class CFTree:
    """Features are put in one after the other; ``insert`` returns the number of the subcluster.

    A feature goes down to the closest entry of each node. The closest leaf entry
    absorbs it if the radius of both stays within ``threshold``; otherwise it
    becomes an entry. A node of more than ``branching_factor`` entries is split
    around its farthest pair. Memory follows the subclusters, not what they absorbed.
    """

    def __init__(self, threshold: float, branching_factor: int, d: int):
        if branching_factor < 2:
            raise ValueError("branching_factor must be at least 2")
        self.bound, self.width, self.d = threshold * threshold, branching_factor, d
        self.root = _Node(branching_factor, d, leaf=True)
        self.count = 0

    def insert(self, n: float, ls: np.ndarray, ss: float) -> int:
        number, halves = self._insert(self.root, n, ls, ss)
        if halves:
            self.root = _Node(self.width, self.d, leaf=False)
            for half in halves:
                self.root.append(*half.total(), half)
        return number

    def _insert(self, node: _Node, n, ls, ss):
        near = node.closest(ls / n) if node.below else -1
        if node.leaf:
            if near >= 0:
                tn, tl, ts = node.n[near] + n, node.ls[near] + ls, node.ss[near] + ss
                if ts / tn - float((tl / tn) @ (tl / tn)) <= self.bound:
                    node.put(near, tn, tl, ts)
                    return node.below[near], None
            number = self.count
            self.count += 1
            node.append(n, ls, ss, number)
        else:
            number, halves = self._insert(node.below[near], n, ls, ss)
            if not halves:
                node.put(near, node.n[near] + n, node.ls[near] + ls, node.ss[near] + ss)
            else:
                node.below[near] = halves[0]
                node.put(near, *halves[0].total())
                node.append(*halves[1].total(), halves[1])
        return number, self._split(node) if len(node.below) > self.width else None

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        k = len(node.below)
        apart = ((node.mean[:k, None, :] - node.mean[None, :k, :]) ** 2).sum(axis=2)
        a, b = np.unravel_index(int(np.argmax(apart)), apart.shape)
        halves = _Node(self.width, self.d, node.leaf), _Node(self.width, self.d, node.leaf)
        for i in range(k):
            # equal means have no farthest pair; both halves still get an entry
            second = bool(i == k - 1 if a == b else i != a and (i == b or apart[i, b] < apart[i, a]))
            halves[second].append(node.n[i], node.ls[i], node.ss[i], node.below[i])
        return halves
