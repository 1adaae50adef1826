"""Byte-level BPE encoding and decoding.

Boundaries come from pretok's class arrays and scans. Slices between them go through pair merging once, those that are
new in a batch together, and are then cached (a bounded number). Decoding gathers bytes from the vocabulary by its offsets.

Defined results: null and empty texts encode to nothing; very long texts and pieces are encoded whole; repeated rows
and null ids pass through; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .common import steps, texts, tidied
from .merging import Merger
from .pretok import pieces

#: Pieces that a worker keeps, and the longest of them.
CACHE = 300_000
LONGEST = 64


class Vocabulary:
    """ranks: bytes of each token to its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, bytes] = {}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, k in ranks.items():
            tokens[k] = t
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = [(a, b, k) for t, k in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.merger = Merger(np.array([ranks[bytes([b])] for b in range(256)]), left, right, made, made)

    @classmethod
    def read(cls, lines: bytes) -> "Vocabulary":
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)})

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 64:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for n log n time."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == stop):
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                k = after[i]
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, i, end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _learn(self, cut: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
        """Put pieces that are new into known; the long ones of these, which aren't to stay."""
        new = list({p for p in cut if p not in known})
        short = [p for p in new if len(p) <= LONGEST and p not in self.ranks]
        if short:
            sym, n, doubt = self.merger.merge(short)
            flat, edge = sym.astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(n)))).tolist()
            known.update(zip(short, [flat[a:b] for a, b in zip(edge, edge[1:])]))
            new = [short[k] for k in np.flatnonzero(doubt).tolist()] + [p for p in new if p not in known]
        for p in new:
            got = self.merged(p)
            known[p] = struct.pack(f"<{len(got)}I", *got)
        return [p for p in new if len(p) > LONGEST]

    def encode(self, rows: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each row."""
        cut, first = pieces(rows)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        long = self._learn(cut, known)
        ids = [known[p] for p in cut]
        for p in long:
            del known[p]
        edges = first.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(edges, edges[1:])]

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        n = self.length[at]
        skip = np.repeat(self.offset[at] - (np.cumsum(n) - n), n)
        return self.bytes[skip + np.arange(len(skip))].tobytes()

    def spans(self, ids: bytes) -> np.ndarray:
        """Byte offset of each token in the decoded text, with the end as last."""
        n = self.length[np.frombuffer(ids, "<u4").astype(np.int64)]
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))


@lru_cache(maxsize=4)
def _loaded(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary.read(f.read())


def checked(v: Vocabulary, given: list[bytes]) -> list[bytes]:
    """Each text's ids; raises where they don't decode to the text."""
    ids = v.encode(given)
    for t, x in zip(given, ids, strict=True):
        if v.decode(x) != t:
            raise ValueError(f"token ids don't give the text back: {t[:80]!r}")
    return ids


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", check: bool = False) -> DataFrame:
    """docs with ids and n_tokens added; vocabulary is a rank file's path on every machine. With check, ids are decoded and a mismatch with the text fails."""
    fields = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens")]

    def run(batches):
        v = _loaded(vocabulary)
        for batch in batches:
            text = batch.column(text_col)
            for a, b in steps(text, 4 << 20):
                ids = [x for c, d in steps(text.slice(a, b - a)) for t in [texts(text.slice(a + c, d - c))] for x in (checked(v, t) if check else v.encode(t))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in fields), listed, pa.array(n)], [*(f.name for f in fields), "ids", "n_tokens"])

    schema = StructType([*fields]).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType())
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (with an ids column) with decoded added: the text's UTF-8 bytes, from the ids alone. Null ids give no bytes."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches):
        v = _loaded(vocabulary)
        for batch in batches:
            back = [v.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(back, pa.binary())], [*(f.name for f in fields), "decoded"])

    return encoded.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(tidied(run), StructType([*fields]).add("decoded", BinaryType()))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of every row; decoded from the ids alone."""

    def run(batches):
        v = _loaded(vocabulary)
        for batch in batches:
            text = batch.column("text")
            out: list[tuple] = []
            for a, b in steps(text):
                for ids in v.encode(texts(text.slice(a, b - a))):
                    back = v.decode(ids)
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
            n, ids_sha, back_sha, size = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(size, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
