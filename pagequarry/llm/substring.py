"""Exact substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Consecutive windows that share their minimiser
(the smallest hash of MGRAM words inside) travel as one packed string to the minimiser's bucket;
there, sorting the windows counts them exactly. Words covered by a window that occurs again are removed.

Equal windows have equal minimisers, so all copies of a window meet in one bucket. Inside one packed string
no window occurs twice: its minimiser would then stand at two places, and the leftmost decides.

Skew: a first pass counts word groups in a fixed number of cells; groups in overfull cells are used as
minimisers only where a window has no other. Equal packed strings are merged before the shuffle, and again as a bucket
reads them. Buckets get no occurrences: they return the ranges of repeated strings, and a second scan joins its places
with these by the string's 128-bit name, so a passage of a third of all rows is a skewed join that can be split.
Packed strings travel compressed, with a dictionary of word parts. A bucket whose distinct strings pass BUCKET_BYTES is
not held: it returns its strings, whose windows are dealt again, each by its own 128-bit hash, and counted by an aggregation.

Defined results: null and empty texts have no words (n_words 0, the hash of the empty string); texts under
WINDOW words lose nothing; rows that repeat a document lose every word that a window covers, as each window
starts again in the other row; null ids stay null; a very long text counts whole (a task holds one such text at a time); an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, span_hashes, spill, split_by_marks, steps, texts, tidied, with_row_key

WINDOW = 35
MGRAM = 4
#: Cells of the word-group counts: a fixed 64 Ki, whatever the input.
CELLS = 1 << 16
#: A cell with so many times the mean count is hot.
HOT = 4
#: Bytes of packed strings that are merged before they are sent, and of windows sorted at once.
MERGE_BYTES = 16 << 20
SORT_BYTES = 32 << 20
#: Compressed bytes of one bucket's distinct strings that a task holds.
BUCKET_BYTES = 32 << 20

#: Bits of the bitmap of repeated strings: the bound of what is sent to every task.
BITS = 1 << 20
#: Low bits of a minimiser's order: its place in a step, so that the leftmost of equals wins.
PLACE = np.uint64((1 << 30) - 1)
#: Texts, and bytes of each, that the compression dictionary is trained on, and its size.
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 1000, 8192, 32 << 10


def _words(docs: list[bytes]):
    """Joined words of all docs, word starts and ends in it, and the first word of each doc (with the total as last)."""
    kept = [b" ".join(d.split()) for d in docs]
    first = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([x.count(b" ") + 1 if x else 0 for x in kept], out=first[1:])
    joined = b" ".join(x for x in kept if x)
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    if not joined:
        return joined, data, gaps, gaps, first
    return joined, data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)])), first


def _groups(data, starts, ends, m: int) -> np.ndarray:
    """Hash of each m consecutive words."""
    h = span_hashes(data, starts, ends)
    if len(h) < m:
        return h[:0]
    out = np.zeros(len(h) - m + 1, np.uint64)
    for k in range(m):
        out = out * np.uint64(0x9DDFEA08EB382D69) + h[k : k + len(out)]
    return mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def _count_cells(m: int, window: int):
    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            text = batch.column("text")
            for a, b in steps(text):
                _, data, starts, ends, _ = _words(texts(text.slice(a, b - a)))
                if len(starts) >= m:
                    g = _groups(data, starts, ends, m)
                    cells += np.bincount((g & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])], ["cell", "n"])

    return run


class SuperKmers:
    """Consecutive windows of one document that share their minimiser."""

    def __init__(self, m: int, window: int, hot: bytes):
        self.m, self.window = m, window
        self.demoted = np.unpackbits(np.frombuffer(hot, np.uint8), bitorder="little").astype(np.uint64)

    def of(self, docs: list[bytes]):
        """Packed string, minimiser, doc and first word in it of each super-k-mer."""
        joined, data, starts, ends, first = _words(docs)
        n = len(starts)
        if n < self.window:
            return [], [], [], []
        g = _groups(data, starts, ends, self.m)
        order = (self.demoted[(g & np.uint64(CELLS - 1)).astype(np.int64)] << np.uint64(63)) | ((g >> np.uint64(1)) & ~PLACE & np.uint64((1 << 63) - 1))
        best = (_sliding_min(order | np.arange(len(g), dtype=np.uint64), self.window - self.m + 1) & PLACE).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), np.diff(first))
        at = np.flatnonzero(doc[: n - self.window + 1] == doc[self.window - 1 :])
        if not len(at):
            return [], [], [], []
        pos, owner = best[at], doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1])
        lead = np.flatnonzero(new)
        lo, hi = at[lead], at[np.append(lead[1:], len(at)) - 1]
        packed = [joined[a:b] for a, b in zip(starts[lo].tolist(), ends[hi + self.window - 1].tolist())]
        return packed, g[pos[lead]].view(np.int64).tolist(), owner[lead], lo - first[owner[lead]]


def _dealt(kmers: SuperKmers, words: bytes):
    """mini, packed (compressed), n (1, or 2 for more) of the batches' super-k-mers, equal ones merged."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_dict_id=False).compress
        merged: dict[bytes, list[int]] = {}
        held = 0

        def flush():
            minis, n = zip(*merged.values())
            return pa.RecordBatch.from_arrays([pa.array(minis, pa.int64()), pa.array([pack(p) for p in merged], pa.binary()), pa.array(n, pa.int32())], ["mini", "packed", "n"])

        for batch in batches:
            text = batch.column("text")
            for a, b in steps(text):
                packed, mini, _, _ = kmers.of(texts(text.slice(a, b - a)))
                for p, key in zip(packed, mini):
                    if p in merged:
                        merged[p][1] = 2
                    else:
                        merged[p] = [key, 1]
                        held += len(p) + 32
                if held > MERGE_BYTES:
                    yield flush()
                    merged.clear()
                    held = 0
        if merged:
            yield flush()

    return run


def _name(packed: bytes) -> bytes:
    return xxhash.xxh3_128_digest(packed)


def _placed(kmers: SuperKmers, bitmap: bytes):
    """p1, p2 (the name), k1, k2, at of each super-k-mer that the bitmap may have."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in steps(text):
                packed, _, owner, at = kmers.of(texts(text.slice(a, b - a)))
                if not packed:
                    continue
                names = np.frombuffer(b"".join(map(_name, packed)), "<i8").reshape(-1, 2)
                own = np.flatnonzero(bits[names[:, 0] & (BITS - 1)])
                if len(own):
                    row = pa.array(a + owner[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[own, 0]), pa.array(names[own, 1]), batch.column("k1").take(row), batch.column("k2").take(row), pa.array(at[own].astype(np.int32))], ["p1", "p2", "k1", "k2", "at"]
                    )

    return run


def _edges(packed: bytes) -> tuple[list[int], list[int]]:
    gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
    return [0, *[x + 1 for x in gaps]], [*gaps, len(packed)]


def _repeated(strings: list[bytes], counts: list[int], window: int) -> list[list[int]]:
    """For each packed string, the windows in it that occur again; windows are sorted, SORT_BYTES of them at a time."""
    out: list[list[int]] = [[] for _ in strings]
    edges = [_edges(s) for s in strings]
    total = sum((len(s) * (len(e[0]) - window + 1)) * window // max(len(e[0]), 1) for s, e in zip(strings, edges))
    parts = 1 + total // SORT_BYTES
    for part in range(parts):
        windows = []
        for k, (s, (starts, ends)) in enumerate(zip(strings, edges)):
            for i in range(len(starts) - window + 1):
                w = s[starts[i] : ends[i + window - 1]]
                if parts == 1 or hash(w) % parts == part:
                    windows.append((w, k, i))
        windows.sort()
        i = 0
        while i < len(windows):
            j = i + 1
            while j < len(windows) and windows[j][0] == windows[i][0]:
                j += 1
            if j - i > 1 or counts[windows[i][1]] > 1:
                for _, k, at in windows[i:j]:
                    out[k].append(at)
            i = j
    return out


_REPEATS = "p1 long, p2 long, lo int, hi int, packed binary, n int"


def _count_windows(window: int, words: bytes, limit: int):
    """Word ranges lo, hi that windows which occur again cover, in the packed strings named p1, p2; of a bucket of more than limit
    bytes the packed strings themselves, with n, and no range."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress
        out: list[tuple[bytes, int, int]] = []
        late: list[tuple[bytes, int]] = []

        def solve(rows: dict[bytes, int]):
            if len(rows) == 1 and 1 in rows.values():
                return
            counts: dict[bytes, int] = {}
            for packed, n in rows.items():
                whole = unpack(packed)
                counts[whole] = counts.get(whole, 0) + n
            strings = list(counts)
            if len(strings) == 1:
                out.append((_name(strings[0]), 0, strings[0].count(b" ") + 1))
                return
            for packed, at in zip(strings, _repeated(strings, list(counts.values()), window)):
                if at:
                    at = np.sort(np.array(at))
                    for part in np.split(at, np.flatnonzero(np.diff(at) > window) + 1):
                        out.append((_name(packed), int(part[0]), int(part[-1]) + window))

        def flush():
            p = np.frombuffer(b"".join(o[0] for o in out) + bytes(16 * len(late)), "<i8").reshape(-1, 2)
            none = [None] * len(late)
            columns = [pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array([o[1] for o in out] + none, pa.int32()), pa.array([o[2] for o in out] + none, pa.int32())]
            columns += [pa.array([None] * len(out) + [x for x, _ in late], pa.binary()), pa.array([None] * len(out) + [n for _, n in late], pa.int32())]
            out.clear()
            late.clear()
            return pa.RecordBatch.from_arrays(columns, ["p1", "p2", "lo", "hi", "packed", "n"])

        key, rows, held, over = None, {}, 0, False
        for batch in batches:
            for mini, packed, n in zip(*(batch.column(c).to_pylist() for c in ("mini", "packed", "n"))):
                if mini != key:
                    solve(rows)
                    key, rows, held, over = mini, {}, 0, False
                    if len(out) > 50_000:
                        yield flush()
                if not over and packed not in rows:
                    held += len(packed)
                    if held > limit:
                        over = True
                        late += rows.items()
                        rows = {}
                if over:
                    late.append((packed, n))
                    if len(late) > 50_000:
                        yield flush()
                else:
                    rows[packed] = min(2, rows.get(packed, 0) + n)
        solve(rows)
        if out or late:
            yield flush()

    return run


def _dealt_again(window: int, words: bytes):
    """w1, w2 (hash of a window), n, and the packed string's name and place: the windows of packed strings."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompress
        for batch in batches:
            for packed, n in zip(batch.column("packed").to_pylist(), batch.column("n").to_pylist()):
                whole = unpack(packed)
                starts, ends = _edges(whole)
                count = len(starts) - window + 1
                w = np.frombuffer(b"".join(_name(whole[starts[i] : ends[i + window - 1]]) for i in range(count)), "<i8").reshape(-1, 2)
                p1, p2 = np.frombuffer(_name(whole), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(count, n, np.int32)), pa.array(np.full(count, p1)), pa.array(np.full(count, p2)), pa.array(np.arange(count, dtype=np.int32))], ["w1", "w2", "n", "p1", "p2", "lo"])

    return run


def _overfull(late: DataFrame, window: int, words: bytes) -> DataFrame:
    """p1, p2, lo, hi of the repeated windows of overfull buckets' packed strings: counts by window, joined back."""
    windows = spill(late.select("packed", "n").mapInArrow(tidied(_dealt_again(window, words)), "w1 long, w2 long, n int, p1 long, p2 long, lo int"), "windows")
    again = spill(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "again")
    return windows.join(again, ["w1", "w2"]).select("p1", "p2", "lo").distinct().withColumn("hi", F.col("lo") + window)


def _removed(batches):
    for batch in batches:
        n_words, n_removed, sha, kept_text = [], [], [], []
        ranges = batch.column("ranges")
        text = batch.column("text")
        for a, b in steps(text):
            for doc, cut in zip(texts(text.slice(a, b - a)), ranges.slice(a, b - a).to_pylist()):
                words = doc.split()
                n = len(words)
                gone = 0
                if cut:
                    keep = np.ones(n, bool)
                    for r in cut:
                        keep[r["lo"] : r["hi"]] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    gone = n - len(words)
                joined = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary, trained on at most SAMPLE texts of SAMPLE_BYTES at most; what it is changes no result."""
    some = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("text").cast("binary").alias("text")).limit(SAMPLE).toPandas()["text"]
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(t)[k : k + 400] for t in some for k in range(0, len(t), 400)]).as_bytes()
    except zstandard.ZstdError:  # too few texts
        return b""


def repeated_ranges(docs: DataFrame, window: int = WINDOW, mgram: int = MGRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """k1, k2 (see with_row_key), lo, hi: word ranges covered by windows that occur again. Ranges may overlap."""
    keyed = with_row_key(docs.select("doc_id", "text")).select("k1", "k2", "text")
    cells = keyed.select("text").mapInArrow(tidied(_count_cells(mgram, window)), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    kmers = SuperKmers(mgram, window, np.packbits(counts > HOT * max(1.0, counts.mean()), bitorder="little").tobytes())
    words = _dictionary(keyed)
    dealt = keyed.select("text").mapInArrow(tidied(_dealt(kmers, words)), "mini long, packed binary, n int").repartition("mini").sortWithinPartitions("mini")
    found = spill(dealt.mapInArrow(tidied(_count_windows(window, words, bucket_bytes)), _REPEATS), "repeats")
    repeats, late = found.where("packed is null").select("p1", "p2", "lo", "hi"), found.where("packed is not null")
    if late.limit(1).count():
        repeats = spill(repeats.unionByName(_overfull(late, window, words)), "repeats")
    bits = np.zeros(BITS, bool)
    bits[repeats.select(F.col("p1").bitwiseAND(F.lit(BITS - 1)).alias("cell")).distinct().toPandas()["cell"].to_numpy(np.int64)] = True  # at most BITS
    places = keyed.mapInArrow(tidied(_placed(kmers, np.packbits(bits, bitorder="little").tobytes())), "p1 long, p2 long, k1 long, k2 int, at int")
    return places.join(repeats, ["p1", "p2"]).select("k1", "k2", (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi"))


def remove_repeated(docs: DataFrame, window: int = WINDOW, mgram: int = MGRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of docs(doc_id, text)."""
    found = spill(repeated_ranges(docs, window, mgram, bucket_bytes), "ranges")
    ranges = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("ranges")
    clean, maybe = split_by_marks(with_row_key(docs.select(F.col("doc_id").cast("long"), "text")), found)
    rows = clean.select("doc_id", "text", none).unionByName(maybe.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges"))
    return rows.mapInArrow(tidied(_removed), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
