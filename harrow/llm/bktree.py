"""A BK-tree under the Levenshtein metric, searched by whole batches of queries at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def encode(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, padded with 0, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def distances(word: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Levenshtein distances of ``word`` to every row of ``codes``: one dynamic-programming row a letter, all rows at once."""
    width = int(lengths.max(initial=0))
    kind = np.int8 if width + len(word) < 120 else np.int16 if width + len(word) < 30_000 else np.int32
    steps = np.arange(width + 1, dtype=kind)
    row = np.broadcast_to(steps, (len(codes), width + 1)).copy()
    codes = codes[:, :width]
    for i, letter in enumerate(word, 1):
        best = np.empty_like(row)
        best[:, 0] = i
        np.minimum(row[:, :-1] + (codes != ord(letter)), row[:, 1:] + 1, out=best[:, 1:], casting="unsafe")
        # an insertion costs one a step: a running minimum of best[j] - j
        best -= steps
        np.minimum.accumulate(best, axis=1, out=best)
        best += steps
        row = best
    return row[np.arange(len(codes)), lengths].astype(np.int64)


BINS = 32
LEAF = 16  # subtrees up to this size are kept as one leaf


def letters(codes: np.ndarray) -> np.ndarray:
    """How often each word has letters of each of ``BINS`` classes."""
    out = np.zeros((len(codes), BINS), np.uint8)
    if codes.size:
        bins = ((codes * np.uint32(2654435761)) >> np.uint32(27)).astype(np.int64)
        flat = np.arange(len(codes))[:, None] * BINS + bins
        counts = np.bincount(flat[codes > 0], minlength=len(codes) * BINS).reshape(len(codes), BINS)
        out = np.minimum(counts, 255).astype(np.uint8)
    return out


def at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the distances between words with letter counts ``a`` and ``b`` (broadcast against each other)."""
    top = np.maximum(a, b)
    return np.maximum((top - a).sum(-1, dtype=np.int32), (top - b).sum(-1, dtype=np.int32))


class BKTree:
    """Entries are (word, value); words may repeat.  ``search`` returns every entry within each query's radius.

    Small subtrees are leaves whose words are all tried; a bound from letter counts spares most of their distances.
    """

    def __init__(self, entries: Sequence[tuple[str, int]]):
        self.words: list[str] = []
        self.values: list[list[int]] = []
        self.children: dict[int, list[tuple[int, int]]] = {}  # of inner nodes: (distance, node)
        self.leaves: dict[int, list[tuple[int, np.ndarray]]] = {}  # and (distance, words of a leaf)
        self.exact: dict[str, int] = {}
        for word, value in entries:
            if word in self.exact:
                self.values[self.exact[word]].append(value)
            else:
                self.exact[word] = len(self.words)
                self.words.append(word)
                self.values.append([value])
        self.codes, self.lengths = encode(self.words) if self.words else (np.zeros((0, 0), np.uint32), np.zeros(0, np.int64))
        self.letters = letters(self.codes)
        # built level by level: all words of a subtree get their distance to its root in one go
        todo = [(0, np.arange(1, len(self.words)))] if self.words else []
        while todo:
            root, below = todo.pop()
            self.children[root], self.leaves[root] = [], []
            if not below.size:
                continue
            d = distances(self.words[root], self.codes[below], self.lengths[below])
            for edge in np.unique(d):
                group = below[d == edge]
                if group.size <= LEAF:
                    self.leaves[root].append((int(edge), group))
                else:
                    self.children[root].append((int(edge), int(group[0])))
                    todo.append((int(group[0]), group[1:]))

    def search(self, queries: Sequence[str], radius: Callable[[str], int]) -> list[list[tuple[int, int]]]:
        """For each query all (distance, value) within radius(query); subtrees are pruned by the triangle inequality."""
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not self.words or not queries:
            return found
        codes, lengths = encode(queries)
        bags = letters(codes)
        radii = np.array([radius(q) for q in queries], np.int64)

        def hit(word: int, which: np.ndarray, d: np.ndarray) -> None:
            for k in np.flatnonzero(d <= radii[which]):
                found[which[k]].extend((int(d[k]), v) for v in self.values[word])

        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, active = todo.pop()
            edges = [e for e, _ in self.children[node]] + [e for e, _ in self.leaves[node]]
            # too far from the node for it and for all below it
            near = at_least(bags[active], self.letters[node]) - radii[active] <= max(edges, default=0)
            active = active[near]
            if not active.size:
                continue
            d = distances(self.words[node], codes[active], lengths[active])
            hit(node, active, d)
            for edge, child in self.children[node]:
                below = active[np.abs(d - edge) <= radii[active]]
                if below.size:
                    todo.append((child, below))
            for edge, group in self.leaves[node]:
                below = active[np.abs(d - edge) <= radii[active]]
                if below.size:
                    close = at_least(bags[below][:, None, :], self.letters[group][None]) <= radii[below][:, None]
                    for j in np.flatnonzero(close.any(0)):
                        which = below[close[:, j]]
                        hit(int(group[j]), which, distances(self.words[group[j]], codes[which], lengths[which]))
        return found
