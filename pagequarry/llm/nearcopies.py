"""Near copies at a Jaccard similarity of word shingles, every group checked exactly.

Texts with equal shingle sets are one point. Points whose SimHash fingerprints the vantage-point trees link, and points
that share a band of ROWS MinHash values, fall into one candidate group: each is tied to the smallest point of its band (or
of its fingerprints' component), so no pairs are made, and the ties' components hold every such pair. The bands are there
because texts at this similarity mostly differ in more bits than trees can prune by; of two texts at similarity s,
(1 - s ** ROWS) ** BANDS share none, 5 in a million at 0.8. Inside a candidate group links come from the exact
similarities: a breadth-first search compares each point it reaches with those not reached yet. A group of over GROUP
points is dealt in blocks: each pair of blocks meets in one task, which holds about 2 * GROUP texts and returns a forest
of its links, and components of these are the groups' links.

Defined results: as in simhash; null and empty texts have no shingle and are copies of each other. first marks one row of each
component; rows that repeat its id and text have the mark too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, span_hashes, spill, split_by_marks, steps, texts, tidied, with_row_key
from .simhash import components, fingerprint, links

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 6, 40
#: Points of a candidate group that one task compares at once, or of each of two blocks of it.
GROUP = 1024
#: Shingles whose MinHash values are taken at once.
PART = 1024

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 31, ROWS * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, ROWS * BANDS, np.uint32)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, in order, of a UTF-8 text's shingles; a text of fewer words is one."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))[: max(1, len(gaps) + 2 - shingle)]
    return np.unique(span_hashes(data, starts, np.append(gaps[shingle - 1 :], len(data))))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band."""
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), PART):
        np.minimum(least, (x[None, k : k + PART] * _FACTORS[:, None] + _TERMS[:, None]).min(1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    return out


def _points(batches):
    for batch in batches:
        text, point, prints, band = batch.column("text"), [], [], []
        for a, b in steps(text):
            for t in texts(text.slice(a, b - a)):
                h = shingles(t)
                point.append(int(mixed(np.array([h.sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0]))
                prints.append(fingerprint(t, SHINGLE))
                band.append(bands(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum([len(x) for x in band]))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*band, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(point, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), listed], ["doc_id", "k1", "k2", "point", "fp", "bands"])


def link_similar(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """For each set of distinct hashes the smallest index of its group, over links at this Jaccard similarity."""
    size = np.array([len(s) for s in sets], np.int64)
    words, code = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    ends = np.cumsum(size)
    of = lambda k: code[ends[k] - size[k] : ends[k]]
    root, left = np.arange(len(sets)), np.arange(len(sets))
    flat, has = code, np.zeros(len(words), bool)
    while len(left):
        first, todo = left[0], [left[0]]
        keep = np.arange(len(left)) > 0
        flat, left = flat[np.repeat(keep, size[left])], left[keep]
        while todo and len(left):
            k = todo.pop()
            has[of(k)] = True
            inner = np.concatenate(([0], np.cumsum(has[flat])))
            has[of(k)] = False
            to = np.cumsum(size[left])
            both = inner[to] - inner[to - size[left]]
            near = both >= similar * (size[left] + size[k] - both) - 1e-9
            if near.any():
                root[left[near]] = first
                todo += left[near].tolist()
                flat, left = flat[np.repeat(~near, size[left])], left[~near]
    return root


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    blocks, pdf = int(pdf["blocks"].iloc[0]), pdf.drop_duplicates("point").sort_values("point")
    point = pdf["point"].to_numpy(np.int64)
    root = link_similar([shingles((t or "").encode()) for t in pdf["text"]])
    return pd.DataFrame({"point": point, "root": point[root], "blocks": blocks})


def _in_blocks(held: DataFrame, sizes: DataFrame, group: int) -> DataFrame:
    """held with root, a, b (one row for each task that its point takes part in): one for small groups, else one for each pair of blocks."""
    blocks = F.ceil(F.col("n") / group).cast("int")
    x = held.join(sizes.withColumn("blocks", blocks).drop("n"), "root").withColumn("own", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return x.select("root", "point", "k1", "k2", "blocks", "own", other).select("root", "point", "k1", "k2", "blocks", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def candidates(prints: DataFrame) -> DataFrame:
    """node, root: the candidate groups of the points of prints(point, fp, bands), for points that have company."""
    balls = components(links(spill(prints.select("fp").distinct(), "prints")))
    own = prints.select("point", "fp").distinct().join(balls, F.col("fp") == F.col("node"), "left")
    banded = prints.select("point", F.explode("bands").alias("band")).unionByName(own.select("point", F.xxhash64(F.coalesce("root", "fp"), F.lit("ball")).alias("band")))
    shared = banded.groupBy("band").agg(F.min("point").alias("u"), F.max("point").alias("most")).where("u < most").select("band", "u")
    return components(banded.join(shared, "band").select(F.col("point").alias("v"), "u").where("u < v").distinct())


def near_copies(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, k1, k2, component_id (smallest doc_id that links reach) and first of every row of docs(doc_id, text).

    first is true for the one text of each component that has the smallest id (nulls last, then by k1, k2).
    """
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long"), "text"))
    prints = spill(keyed.mapInArrow(tidied(_points), "doc_id long, k1 long, k2 int, point long, fp long, bands array<long>"), "points")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    groups = spill(candidates(prints), "candidates")
    least = prints.groupBy("point").agg(F.min(key).alias("least"))
    held = spill(least.join(groups, least.point == groups.node).select("point", "root", F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2")), "held")
    sizes = held.groupBy("root").agg(F.count("*").alias("n"))
    _, maybe = split_by_marks(keyed.select("k1", "k2", "text"), held)
    dealt = maybe.join(_in_blocks(held, sizes, group), ["k1", "k2"])
    parts = spill(dealt.select("root", "a", "b", "blocks", "point", "text").groupBy("root", "a", "b").applyInPandas(_links, "point long, root long, blocks int"), "linked")
    linked = parts.where("blocks = 1").select("point", "root")
    if parts.where("blocks > 1").limit(1).count():
        over = components(parts.where("blocks > 1 and point <> root").select(F.col("point").alias("u"), F.col("root").alias("v")))
        linked = linked.unionByName(over.select(F.col("node").alias("point"), "root"))
    rooted = spill(least.join(linked, "point", "left").select("point", "least", F.coalesce("root", "point").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of = spill(rooted.select("point", "root").join(named, "root").select("point", "least"), "classes")
    first = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    return prints.select("doc_id", "k1", "k2", "point").join(of, "point").select("doc_id", "k1", "k2", F.col("least.doc_id").alias("component_id"), first.alias("first"))
