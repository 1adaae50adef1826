"""Pair merging over ragged arrays of symbols, all sequences at once."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1 << 40)


class Merger:
    """symbol: id of each byte; a pair (left, right) of ids has a rank and makes an id; the lower rank merges first."""

    def __init__(self, symbol: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.symbol = symbol.astype(np.int64)
        key = left.astype(np.int64) << 20 | right
        self.bits = max(4, int(np.ceil(np.log2(4 * max(len(key), 1)))))
        size = 1 << self.bits
        self.keys, self.rank, self.made = np.full(size, -1), np.full(size, NONE), np.zeros(size, np.int64)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):  # open addressing: each slot takes one of the keys that want it, the others step on
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]
            won = self.keys[at] == key[todo]
            self.rank[at[won]], self.made[at[won]] = rank[todo[won]], made[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; one of an empty slot, where rank is NONE, for pairs that don't merge."""
        key = left << 20 | right
        at = self._slot(key)
        got = self.keys[at]
        odd = np.flatnonzero((got != key) & (got >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
            got = self.keys[at[odd]]
            odd = odd[(got != key[odd]) & (got >= 0)]
        return at

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left of all non-empty words, in order; how many each word has; words whose order of merges is in doubt.

        In a round each sequence merges its lowest-rank pair at all its places. That is the one-at-a-time order unless
        a merge makes a pair of lower rank while other places wait; such words are named as in doubt.
        """
        length = np.array([len(w) for w in words], np.int64)
        sym = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), length)
        doubt = np.zeros(len(words), bool)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        slot = self.find(sym, np.append(sym[1:], 0))
        rank = np.where(seq == np.append(seq[1:], -1), self.rank[slot], NONE)
        while len(sym):
            head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, head)
            lowest = np.repeat(low, np.diff(np.append(head, len(sym))))
            over = lowest == NONE
            if over.any():
                done.append((seq[over], sym[over]))
                stay = ~over
                sym, seq, rank, slot, lowest = sym[stay], seq[stay], rank[stay], slot[stay], lowest[stay]
                if not len(sym):
                    break
            chain = np.flatnonzero(rank == lowest)
            # where places overlap, as in aaa, every other counts, from the left
            begin = np.append(True, np.diff(chain) > 1)
            index = np.arange(len(chain))
            chain = chain[(index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0]
            merged_rank, owner = rank[chain], seq[chain]
            sym[chain] = self.made[slot[chain]]
            keep = np.ones(len(sym), bool)
            keep[chain + 1] = False
            now = chain - np.arange(len(chain))  # where the merged symbols stand afterwards
            sym, seq, rank, slot = sym[keep], seq[keep], rank[keep], slot[keep]
            at = np.concatenate((now, now[now > 0] - 1))
            follow = np.minimum(at + 1, len(sym) - 1)
            slot[at] = self.find(sym[at], sym[follow])
            rank[at] = np.where((seq[at] == seq[follow]) & (at < len(sym) - 1), self.rank[slot[at]], NONE)
            many = np.append(owner[1:] == owner[:-1], False)
            if many.any():
                lower = rank[now] < merged_rank
                lower[1:] |= (rank[now[1:] - 1] < merged_rank[1:]) & (seq[now[1:] - 1] == owner[1:])
                lower[0] |= now[0] > 0 and seq[now[0] - 1] == owner[0] and rank[now[0] - 1] < merged_rank[0]
                doubt[np.intersect1d(owner[lower], owner[many])] = True
        if not done:
            return sym, np.zeros(len(words), np.int64), doubt
        owner, left = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        order = np.argsort(owner, kind="stable")
        return left[order], np.bincount(owner, minlength=len(words)), doubt
