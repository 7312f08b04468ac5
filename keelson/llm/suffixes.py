"""Suffix arrays by prefix doubling over integer sequences, in numpy.

An array holds many sequences one after another; each is closed by a symbol of its own, so no match
crosses from one to the next. Ranks are kept for each depth 1, 2, 4, ..., from which the longest
common prefix of any two suffixes follows by binary lifting.
"""

from __future__ import annotations

import numpy as np


def dense_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, each key's rank among the distinct ones, and the number of these."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = held[1:] != held[:-1]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return order, ranks, int(new.sum())


class SuffixRanks:
    """The suffix order of `symbols` (non-negative integers), compared to `depth` symbols at least.

    Only suffixes that are still tied are sorted again at each doubling. `levels[j]` ranks the
    suffixes by their first 2**j symbols; positions past the end count as smaller than any symbol.
    """

    def __init__(self, symbols: np.ndarray, depth: int, keep_levels: bool = True):
        n = len(symbols)
        self.levels: list[np.ndarray] = []
        order, ranks, distinct = dense_ranks(symbols)
        reach = 1
        first = np.empty(n, np.int64)  # rank = place of the first suffix of its tie, so that ties can be split alone
        held = ranks[order]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if n else np.zeros(0, np.int64)
        first[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
        self.levels.append(first.astype(np.int32))
        while reach < depth and distinct < n:
            rank = self.levels[-1].astype(np.int64)
            tied = np.zeros(n, bool)
            by = rank[order]
            same = by[1:] == by[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            places = np.flatnonzero(tied)
            if not len(places):
                break
            who = order[places]
            nxt = np.where(who + reach < n, rank[np.minimum(who + reach, n - 1)] + 1, 0)
            key = (rank[who] << 32) | nxt
            sub = np.argsort(key)
            order[places] = who[sub]
            key = key[sub]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.flatnonzero(new)
            fresh = self.levels[-1].copy()
            fresh[order[places]] = np.repeat(places[lead], np.diff(np.r_[lead, len(key)]))
            if not keep_levels:
                self.levels.clear()
            self.levels.append(fresh)
            reach *= 2
        self.order, self.reach = order, reach

    def neighbour_lcp(self, limit: int | None = None) -> np.ndarray:
        """Longest common prefix of each suffix in order with the one before it (0 for the first)."""
        n = len(self.order)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        a, b = self.order[:-1].astype(np.int64), self.order[1:].astype(np.int64)
        got = np.zeros(n - 1, np.int64)
        # a pair tied at the last level agrees on all of it; lower levels add what remains
        for j in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[j]
            ok = (a + got < n) & (b + got < n)
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            same = ok & (rank[x] == rank[y])
            got[same] += 1 << j
        out[1:] = got if limit is None else np.minimum(got, limit)
        return out
