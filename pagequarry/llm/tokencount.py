"""Token counts by rank-synchronous merging.

Pieces that a worker has not met are held as one ragged array of symbols. In each round every sequence's lowest-rank
pair is found at once, all its places in that sequence merge, and sequences without a pair retire; what is left of
symbols is the count. A piece whose order of merges could differ from one at a time is counted again that way.
Known pieces keep their counts in a bounded cache, but for long ones.

Defined results: null and empty texts have no tokens; a special token's string inside a text is one token, as the
tokenizers library counts by default; repeated rows and null ids pass through; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts, tidied
from .merging import Merger
from .pretok import pieces

#: Pieces that a worker keeps, and the longest of them.
CACHE = 300_000
LONGEST = 64


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable bytes as themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        symbol = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            symbol[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        left, right = np.array(list(ranked), np.int64).reshape(-1, 2).T
        rank, made = np.array(list(ranked.values()), np.int64).reshape(-1, 2).T
        self.merger = Merger(symbol, left, right, rank, made)
        self.ranked, self.symbol = ranked, symbol.tolist()
        self.known: dict[bytes, int] = {}

    def _alone(self, piece: bytes) -> int:
        """Tokens of a piece, one merge after another: the lowest rank first, the leftmost of equals."""
        sym = [self.symbol[b] for b in piece]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = [(*self.ranked[p], i, p) for i, p in enumerate(zip(sym, sym[1:])) if p in self.ranked]
        heap = [(rank, i, pair, made) for rank, made, i, pair in heap]
        heapq.heapify(heap)
        n = len(sym)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = after[i]
            if j >= len(sym) or (sym[i], sym[j]) != pair:
                continue
            n -= 1
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(sym) and (sym[a], sym[b]) in self.ranked:
                    rank, made = self.ranked[sym[a], sym[b]]
                    heapq.heappush(heap, (rank, a, (sym[a], sym[b]), made))
        return n

    def _counted(self, cut: list[bytes]) -> list[int]:
        _, n, doubt = self.merger.merge(cut)
        for k in np.flatnonzero(doubt).tolist():
            n[k] = self._alone(cut[k])
        return n.tolist()

    def count(self, rows: list[bytes]) -> np.ndarray:
        """Tokens of each row."""
        parts, owner, extra = rows, None, np.zeros(len(rows), np.int64)
        for s in self.special:
            if any(s in r for r in rows):
                split = [p.split(s) if s in p else [p] for p in parts]
                own = np.repeat(np.arange(len(parts)) if owner is None else owner, [len(x) for x in split])
                extra += np.bincount(own, minlength=len(rows)) - np.bincount(np.arange(len(parts)) if owner is None else owner, minlength=len(rows))
                parts, owner = [p for x in split for p in x], own
        cut, first = pieces(parts)
        known = self.known
        new = list({p for p in cut if p not in known})
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(cut))
            known.update(zip(new, self._counted(new)))
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum([known[p] for p in cut], dtype=np.int64)))
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        n = total[first[1:]] - total[first[:-1]]
        return extra + (n if owner is None else np.bincount(owner, weights=n, minlength=len(rows)).astype(np.int64))


@lru_cache(maxsize=4)
def _loaded(path: str) -> Counter:
    with open(path, encoding="utf-8") as f:
        return Counter(json.load(f))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text); tokenizer is a .json file's path on every machine."""

    def run(batches):
        c = _loaded(tokenizer)
        for batch in batches:
            text = batch.column("text")
            size: list[int] = []
            n: list[int] = []
            for a, b in steps(text):
                rows = texts(text.slice(a, b - a))
                size += map(len, rows)
                n += c.count(rows).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
