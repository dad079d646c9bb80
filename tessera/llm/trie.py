"""Prefix tree over ordered sets, and the search of it for sets with a large overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class PrefixTree:
    """Compact trie of sets whose keys are in one global order.

    ``sets`` come sorted, so the sets below a node are a range of them. A node holds the depth down to which its sets
    agree, that range, the sizes of its smallest and largest set, and its children; sets that end at a node's
    depth are leaves of their own.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shared = np.zeros(len(sets), np.int64)  # with the set before
        for i in range(1, len(sets)):
            m = min(len(sets[i - 1]), len(sets[i]))
            differ = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
            shared[i] = differ[0] if len(differ) else m
        self.nodes: list[tuple[int, int, int, int, int]] = []  # depth, first, end, smallest, largest
        self.children: list[list[int]] = []
        # ranges of sets that share a prefix, split where they share least
        waiting = [(0, len(sets), -1)] if sets else []
        while waiting:
            first, end, parent = waiting.pop()
            inner = shared[first + 1 : end]
            depth = int(inner.min()) if end - first > 1 else int(self.sizes[first])
            node = len(self.nodes)
            self.nodes.append((depth, first, end, int(self.sizes[first:end].min()), int(self.sizes[first:end].max())))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if end - first > 1:
                if depth == int(self.sizes[first:end].min()) == int(self.sizes[first:end].max()):
                    continue  # equal sets
                cuts = [first, *(first + 1 + np.flatnonzero(inner == depth)).tolist(), end]
                waiting += [(a, b, node) for a, b in zip(cuts, cuts[1:])]

    def similar(self, own: np.ndarray, percent: int) -> Iterator[int]:
        """Numbers of the sets whose Jaccard similarity with ``own`` is ``percent`` or more.

        The overlap with a shared prefix is counted once for all sets below it; a subtree is left as soon as its
        sizes and what remains of either set cannot reach the overlap that is needed.
        """
        waiting = [(0, 0, 0)] if self.nodes else []  # node, depth and overlap at its parent
        while waiting:
            node, depth, overlap = waiting.pop()
            to, first, end, smallest, largest = self.nodes[node]
            path = self.sets[first]
            while True:
                needed = -(-percent * (len(own) + smallest) // (100 + percent))
                left = min(largest - depth, len(own) - overlap)
                if overlap + left < needed or depth == to:
                    break
                part = path[depth : min(to, depth + 256)]
                place = np.minimum(np.searchsorted(own, part), len(own) - 1)
                overlap += int((own[place] == part).sum())
                depth += len(part)
            if depth < to or overlap + left < needed:
                continue
            if not self.children[node]:
                yield from range(first, end)
            waiting += [(child, depth, overlap) for child in self.children[node]]
