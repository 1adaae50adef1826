"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised inside a sentence) and units (behind a number) become typed placeholders; windows of WIDTH
template words are hashed, and a document's windows are joined with the benchmark's by hash. Along one alignment the same value of the item
must be the same value in the document (two values of the item may become one, as small numbers often do):
that catches questions with other parameters, and passes over text that only shares a template.
A document is contaminated by an item if consistent windows cover COVERED of the item's windows. With by_window, an alignment
in which a value maps twice keeps the windows that agree with its majority mapping and those whose values are the item's
own; without, it has no hits.

A second, exact path joins windows by the words themselves, however few are literal: windows with literal words for less
than half, items of under LEAST words, and words whose type depends on what stands before them. Coverage is taken over the
windows with literal words for at least half and over all windows, and the larger counts.

Windows are looked up in a bitmap of fixed size before they are sent, so the shuffle carries what may match; the join
itself is exact. An item of fewer words than WIDTH is one window. Values differ only in windows of LEAST words or more.

Defined results: null and empty texts and items match nothing; repeated rows of a document count once; rows that share
an id but not the text are told apart; items without an id are found like others; an empty benchmark finds nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mixed, span_hashes, spill, steps, tidied, with_row_key

WIDTH = 8
LEAST = 5
COVERED = 0.5
#: Bits of the bitmap of benchmark windows: the bound of what is sent to every task.
BITS = 1 << 20

#: Unit words.
UNITS = (
    "m mm cm km meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet ft inch inches yard yards "
    "g kg mg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees "
    "dollar dollars euro euros cent cents usd eur gbp kmh mph hz khz mhz v w kw kwh j kj pa bar"
).split()

LITERAL, NUMBER, NAME, UNIT = range(4)
#: Sets the exact path's hashes apart from the templates'.
_EXACT = np.uint64(0x5851F42D4C957F2D)
_SLOT = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)


def _hash_all(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(span_hashes(data, ends - [len(w) for w in words], ends))


_UNIT_HASHES = _hash_all(UNITS)


def canonical(column: pa.Array):
    """Of each word of the texts: its row, template hash, value hash and whether it is literal."""
    data, off = buffers(column)
    x = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    n = len(x)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    digit = (x >= 48) & (x <= 57)
    big = (x >= 65) & (x <= 90)
    prev = np.append(np.uint8(0), x[:-1])
    wide_big = (prev == 0xC3) & (x >= 0x80) & (x <= 0x9E) & (x != 0x97)
    low = np.where(big | wide_big, x + np.uint8(32), x)
    word = digit | big | ((x >= 97) & (x <= 122)) | (x >= 128)
    if n > 2:
        word[1:-1] |= ((x[1:-1] == 44) | (x[1:-1] == 46)) & digit[:-2] & digit[2:]
    row_start = np.zeros(n + 1, bool)
    row_start[off] = True
    before = np.append(False, word[:-1]) & ~row_start[:-1]
    after = np.append(word[1:], False) & ~row_start[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    row = np.searchsorted(off, starts, "right") - 1
    value = span_hashes(low, starts, ends)
    letters = np.concatenate(([0], np.cumsum(word & ~digit & (x != 44) & (x != 46))))
    digits = np.concatenate(([0], np.cumsum(digit)))
    stops = np.concatenate(([0], np.cumsum((x == 46) | (x == 33) | (x == 63) | (x == 58) | (x == 10))))
    number = (digits[ends] > digits[starts]) & (letters[ends] == letters[starts])
    capital = big[starts] | ((x[starts] == 0xC3) & wide_big[np.minimum(starts + 1, n - 1)])
    follows = np.append(False, row[1:] == row[:-1])
    inner = follows & (np.append(0, stops[starts[1:]] - stops[ends[:-1]]) == 0)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == value) & follows & np.append(False, number[:-1])
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(capital & inner, NAME, LITERAL)))
    return row, np.where(kind == LITERAL, value, _SLOT[kind]), value, kind == LITERAL


def _windows(template: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(template) - width + 1), width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + template[k : k + len(out)]
    return mixed(out)


def _slots(value, literal, at, width) -> list[list[int]]:
    """Values of the slots of the windows that start at these words."""
    signed = value.view(np.int64)
    return [signed[a : a + width][~literal[a : a + width]].tolist() for a in at.tolist()]


def _scan(widths: list[int], bitmap: bytes | None, keys: list[str]):
    """Windows of the batches' texts: of these widths, that the bitmap may have; without one, each text's own width."""
    bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in steps(text):
                row, template, value, literal = canonical(text.slice(a, b - a))
                size = np.bincount(row, minlength=b - a)
                first = np.cumsum(size) - size
                lits = np.concatenate(([0], np.cumsum(literal)))
                for width in widths:
                    h = _windows(template, width)
                    if not len(h):
                        continue
                    inside = row[: len(h)] == row[width - 1 :]
                    if bits is None:
                        inside &= (size[row[: len(h)]] == width) | (width == WIDTH)
                    literals = (2 * (lits[width:] - lits[:-width]) >= width) & (width >= LEAST)
                    for exact in (False, True):
                        if exact:
                            h = _windows(value ^ _EXACT, width)
                        at = np.flatnonzero(inside if exact else inside & literals)
                        if bits is not None:
                            for part in (0, 32):
                                at = at[bits[((h[at] >> np.uint64(part)) & np.uint64(BITS - 1)).astype(np.int64)]]
                        if not len(at):
                            continue
                        rows = row[at]
                        own = batch.slice(a, b - a).take(pa.array(rows))
                        slots = [[]] * len(at) if exact else _slots(value, literal, at, width)
                        yield pa.RecordBatch.from_arrays(
                            [*(own.column(k) for k in keys), pa.array(h[at].view(np.int64)), pa.array((at - first[rows]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), pa.array(np.full(len(at), exact)), pa.array(literals[at]), pa.array(slots, pa.list_(pa.int64()))],
                            [*keys, "h", "pos", "width", "exact", "literals", "slots"],
                        )

    return run


def consistent(windows: list[dict], by_window: bool) -> list[int]:
    """Places in the item of one alignment's windows (item_pos, exact, slots, item_slots) that count as hits."""
    votes: dict[int, Counter] = {}
    for w in windows:
        for a, b in zip(w["item_slots"], w["slots"]):
            votes.setdefault(a, Counter())[b] += 1
    to = {a: max(n, key=lambda b: (n[b], b == a, b)) for a, n in votes.items()}
    if not by_window and any(len(n) > 1 for n in votes.values()):
        return []
    return sorted({w["item_pos"] for w in windows if w["slots"] == w["item_slots"] or all(to[a] == b for a, b in zip(w["item_slots"], w["slots"]))})


def matches(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, by_window: bool = False) -> DataFrame:
    """doc_id, k1, k2, item_id, n_hit, n_windows, coverage: the pairs of a document and an item that contaminates it."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item_key"), "text")
    own = spill(items.mapInArrow(tidied(_scan(list(range(1, WIDTH + 1)), None, ["item_id", "item_key"])), "item_id long, item_key long, h long, pos int, width int, exact boolean, literals boolean, slots array<long>"), "items")
    size = own.where("exact").groupBy(F.col("item_id").alias("of_id"), F.col("item_key").alias("of_key")).agg(F.count("*").alias("n_all"), F.count_if("literals").alias("n_literal"))
    cells = own.select(F.explode(F.array(F.pmod("h", F.lit(BITS)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(BITS)))).alias("cell")).distinct().toPandas()["cell"].to_numpy(np.int64)  # at most BITS
    bits = np.zeros(BITS, bool)
    bits[cells] = True
    widths = sorted(r["width"] for r in own.select("width").distinct().collect())
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "k1", "k2", "text")
    found = keyed.mapInArrow(tidied(_scan(widths, np.packbits(bits, bitorder="little").tobytes(), ["doc_id", "k1", "k2"])), "doc_id long, k1 long, k2 int, h long, pos int, width int, exact boolean, literals boolean, slots array<long>")
    of = own.select("item_id", "item_key", "h", "width", "exact", "literals", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    pair = ["doc_id", "k1", "k2", "item_id", "item_key"]
    aligned = (
        found.drop("literals").join(of, ["h", "width", "exact"])
        .where(F.size("slots") == F.size("item_slots"))
        .groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.collect_set(F.struct("item_pos", "exact", "literals", "slots", "item_slots")).alias("windows"))
    )

    def judge(batches):
        for batch in batches:
            windows = batch.column("windows").to_pylist()
            hit = [consistent(w, by_window) for w in windows]
            literal = [[k for k in h if k in places] for h, places in zip(hit, ({x["item_pos"] for x in w if x["literals"]} for w in windows))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in pair), pa.array(hit, pa.list_(pa.int32())), pa.array(literal, pa.list_(pa.int32()))], [*pair, "hit", "literal_hit"])

    n = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    of_all, of_literal = F.col("n_hit") / F.col("n_all"), F.col("n_literal_hit") / F.nullif("n_literal", F.lit(0))
    literal = F.coalesce(of_literal >= of_all, F.lit(False))
    return (
        aligned.select(*pair, "windows")
        .mapInArrow(tidied(judge), "doc_id long, k1 long, k2 int, item_id long, item_key long, hit array<int>, literal_hit array<int>")
        .groupBy(*pair)
        .agg(n("hit").alias("n_hit"), n("literal_hit").alias("n_literal_hit"))
        .join(size, F.col("item_id").eqNullSafe(F.col("of_id")) & (F.col("item_key") == F.col("of_key")))
        .select("*", F.when(literal, F.col("n_literal")).otherwise(F.col("n_all")).alias("n_windows"), F.greatest(of_all, of_literal).alias("coverage"), F.when(literal, F.col("n_literal_hit")).otherwise(F.col("n_hit")).alias("n"))
        .where(F.col("coverage") >= covered)
        .select("doc_id", "k1", "k2", "item_id", F.col("n").alias("n_hit"), "n_windows", "coverage")
    )
