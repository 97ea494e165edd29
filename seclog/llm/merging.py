"""Merging of symbols by ranked pairs (byte pair encoding), in many runs at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The rank of what never merges.
NEVER = 2**31 - 1


class Merges:
    """``pairs``: (symbol, symbol) to (rank, merged symbol). ``base``: more than any symbol."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], base: int):
        self.base = base
        keys = np.array([a * base + b for a, b in pairs], np.int64)
        rank, to = (np.array([v[j] for v in pairs.values()], np.int32) for j in (0, 1))
        by = np.argsort(keys)
        # one key more than all, so that a place is always found
        self._key, self._rank, self._to = np.append(keys[by], np.int64(2**62)), np.append(rank[by], np.int32(NEVER)), np.append(to[by], np.int32(0))

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NEVER: none) and results of neighbours."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self._key, key)
        return np.where(self._key[at] == key, self._rank[at], np.int32(NEVER)), self._to[at]

    def __call__(self, symbol: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of runs of symbols (``run``: rising numbers): in each the pair of least rank is merged, the leftmost of
        equals, until none is left. One merge in all runs at a time."""
        symbol, done, where = symbol.astype(np.int32), [], []
        if not len(run):
            return symbol, run
        last = np.append(run[1:] != run[:-1], True)
        rank, to = self.of(symbol, np.append(symbol[1:], 0))
        rank = np.where(last, np.int32(NEVER), rank)
        while len(run):
            start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            size = np.diff(np.append(start, len(run)))
            best = np.minimum.reduceat(rank, start)
            if (best == NEVER).any():
                gone = np.repeat(best == NEVER, size)
                done.append(symbol[gone])
                where.append(run[gone])
                run, symbol, rank, to = run[~gone], symbol[~gone], rank[~gone], to[~gone]
                continue
            hit = np.flatnonzero(rank == np.repeat(best, size))
            at = hit[np.append(True, run[hit[1:]] != run[hit[:-1]])]
            symbol[at] = to[at]
            keep = np.ones(len(run), bool)
            keep[at + 1] = False
            ends = np.append(run[1:] != run[:-1], True)[at + 1]  # the merged one is now its run's last
            at = at - np.arange(len(at))
            run, symbol, rank, to = run[keep], symbol[keep], rank[keep], to[keep]
            new = at[~ends]
            rank[at[ends]] = NEVER
            rank[new], to[new] = self.of(symbol[new], symbol[new + 1])
            left = at[at > 0] - 1
            left = left[run[left] == run[left + 1]]
            rank[left], to[left] = self.of(symbol[left], symbol[left + 1])
        symbol, run = np.concatenate(done), np.concatenate(where)
        by = np.argsort(run, kind="stable")
        return symbol[by], run[by]


def splits(names: dict, rank: Callable[[int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """The pairs of symbols that make up a symbol, for ``names`` (texts or bytes to symbols)."""
    found = {}
    for name, i in names.items():
        for cut in range(1, len(name)):
            if (a := names.get(name[:cut])) is not None and (b := names.get(name[cut:])) is not None:
                found[a, b] = rank(i), i
    return found
