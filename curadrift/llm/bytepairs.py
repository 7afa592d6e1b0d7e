"""When two tokens may stand side by side: byte-pair encoding as a rule on neighbours.

A sequence of tokens is what byte-pair encoding gives for its text exactly if every two neighbours are what it gives for
theirs. So the encoding of a prefix has one last token: the one that fits its predecessor. Tokens are numbered by merge
priority, single symbols first.
"""

from __future__ import annotations

import numpy as np


class PairRule:
    """``tokens``: symbol strings (bytes or str) in merge order, single symbols first. Tokens that byte-pair encoding never
    gives are left out of ``number``."""

    def __init__(self, tokens: list):
        position = {t: n for n, t in enumerate(tokens)}
        self.left = np.arange(len(tokens) + 1)
        self.right = np.arange(len(tokens) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        dead = []
        for n, token in enumerate(tokens):
            for cut in range(1, len(token)):
                a, b = position.get(token[:cut]), position.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = n
        for n, token in enumerate(tokens):
            if len(token) > 1:
                parts = self.merged([position[token[i:i + 1]] for i in range(len(token))], n)
                if len(parts) == 2:
                    self.left[n], self.right[n] = parts
                else:
                    dead.append(n)
        gone = set(dead)
        self.number = {t: n for t, n in position.items() if n not in gone}
        self.known: dict[tuple[int, int], bool] = {}
        keys = np.array([(a << 32) | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.values = np.r_[np.array(list(self.pairs.values()), dtype=np.int64)[order], 0]

    def merged(self, parts: list[int], below: int) -> list[int]:
        """Merges of priority before ``below``, the best first, the leftmost of equals."""
        while len(parts) > 1:
            best = min(((self.pairs.get((a, b), below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] >= below:
                break
            parts[best[1]:best[1] + 2] = [best[0]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between two tokens, replayed from the last merge to the first."""
        key = (a, b)
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 4_000_000:
                self.known.clear()
            known = self.known[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        limit = len(self.left) + 1
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < limit:
                return False
            inner, outer = int(self.right[a]), int(self.left[b])
            if inner == a and outer == b:
                return True
            # the later merge is undone first; at the same priority the right one came later
            if outer == b or (inner != a and a > b):
                limit, a = a, inner
            else:
                limit, b = b + 1, outer

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for arrays."""
        out = np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), len(self.left) + 1, dtype=np.int64)
        while len(live):
            keys = (a << 32) | b
            at = np.searchsorted(self.keys, keys)
            free = ~((self.keys[at] == keys) & (self.values[at] < limit))
            inner, outer = self.right[a], self.left[b]
            done = free & (inner == a) & (outer == b)
            out[live[done]] = True
            go = free & ~done
            live, a, b, limit, inner, outer = live[go], a[go], b[go], limit[go], inner[go], outer[go]
            undo_left = (outer == b) | ((inner != a) & (a > b))
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, inner, a), np.where(undo_left, b, outer)
        return out
