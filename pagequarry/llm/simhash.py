"""SimHash near-dedup over vantage-point trees.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's shingles.
Fingerprints that differ in at most RADIUS bits are linked, exactly:

* Equal fingerprints are merged first, so a group of copies is one point.
* A vantage-point tree, built on the driver from a bounded sample, deals the points to shards by their Hamming
  distance to each vantage point; a point within half the radius of a boundary also goes to the other side
  (of two linked points on two sides, one is that near, by the triangle inequality). Shards that are still too large
  get a tree each, built in the tasks from a bounded sample of them, until all are small or none can be split.
* Each shard prunes the same way until blocks are small and compares those exactly. In a block that no vantage point
  splits, each point's neighbours are looked up instead. It returns a spanning forest of its links, never all pairs.
* Components come from alternating star contractions over tables in the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; component_id ignores null
ids (null where a component has none); repeated rows get the same result each; rows that share an id but not the text
are told apart by it, and the smaller key (k1, k2) is first among rows of one id; a very long text is fingerprinted
whole, its hashes held 64 Ki at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, spill, steps, texts, tidied, with_row_key

SHINGLE = 3
RADIUS = 2
#: Points that a shard should hold, levels of one routing tree (larger inputs get trees under its leaves), and sampled points for each leaf.
SHARD = 16_384
TREE_DEPTH = 10
#: Trees that are built and sent to the tasks at once, of at most 2 ** TREE_DEPTH nodes each.
TREES = 1024
SAMPLE = 64
#: Points compared all with all at once.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a UTF-8 text."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    h = xxhash.xxh64_intdigest
    if len(gaps) + 1 <= shingle:
        return h(joined, 42)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2 (see with_row_key), fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            text, out = batch.column("text"), []
            for a, b in steps(text):
                out += [fingerprint(t, shingle) for t in texts(text.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "k1", "k2", "fp"])

    return with_row_key(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidied(run), "doc_id long, k1 long, k2 int, fp long")


def _distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int64)


def _split(x: np.ndarray, radius: int, tries: int = 5):
    """The vantage point and boundary, of a few tried, that send the fewest points to the larger side; None if none helps."""
    best = None
    for v in x[np.linspace(0, len(x) - 1, tries).astype(int)]:
        c = np.bincount(_distance(x, v), minlength=66)
        below = np.concatenate(([0], np.cumsum(c)))  # below[m]: distance < m
        for m in range(1, 65):
            left, right = below[min(66, m + _reach(radius)[0])], len(x) - below[max(0, m - _reach(radius)[1])]
            cost = max(left, right) + 0.25 * (left + right)
            if best is None or cost < best[0]:
                best = (cost, max(left, right), v, m)
    return None if best is None or best[1] > 0.9 * len(x) else (best[2], best[3])


def _reach(radius: int) -> tuple[int, int]:
    """Boundary m: the left side holds distances < m + reach[0], the right side those >= m - reach[1]; together radius."""
    return (radius + 1) // 2, radius // 2


def build_tree(x: np.ndarray, depth: int, radius: int):
    """Nested (vantage point, boundary, left, right); a leaf is None."""
    if depth == 0 or len(x) < 2 * SAMPLE // 4:
        return None
    found = _split(x, radius)
    if found is None:
        return None
    v, m = found
    d = _distance(x, v)
    return int(v), int(m), build_tree(x[d < m], depth - 1, radius), build_tree(x[d >= m], depth - 1, radius)


def route(x: np.ndarray, tree, radius: int):
    """(leaf number, indices of the points in it), boundary points in each leaf that they may have partners in."""
    todo, near = [(tree, np.arange(len(x)), 1)], _reach(radius)
    while todo:
        node, at, number = todo.pop()
        if node is None:
            yield number, at
            continue
        v, m, left, right = node
        d = _distance(x[at], np.uint64(v))
        todo.append((left, at[d < m + near[0]], 2 * number))
        todo.append((right, at[d >= m - near[1]], 2 * number + 1))


class Forest:
    """Smallest index of each point's group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _masks(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(64), r)]


def link_neighbours(x: np.ndarray, at: np.ndarray, radius: int, groups: Forest) -> None:
    """Link the points x[at], distinct and sorted, by looking up what each could be at most radius bits away."""
    own = x[at]
    for mask in _masks(radius):
        near = own ^ np.uint64(mask)
        k = np.searchsorted(own, near)
        hit = np.flatnonzero(own[np.minimum(k, len(own) - 1)] == near)
        hit = hit[k[hit] < len(own)]
        hit = hit[k[hit] > hit]
        if len(hit):
            groups.link(at[hit], at[k[hit]])


def link_close(x: np.ndarray, radius: int) -> np.ndarray:
    """For distinct points x in order, the smallest index that each is linked to, over links among these points."""
    groups = Forest(len(x))
    todo, near = [np.arange(len(x))], _reach(radius)
    lookups = sum(comb(64, r) for r in range(1, radius + 1))
    while todo:
        at = todo.pop()
        found = _split(x[at], radius) if len(at) > BLOCK else None
        if found is not None:
            d = _distance(x[at], found[0])
            todo += [at[d < found[1] + near[0]], at[d >= found[1] - near[1]]]
            continue
        if len(at) > max(BLOCK, 2 * lookups):
            link_neighbours(x, at, radius, groups)
            continue
        for i in range(0, len(at), BLOCK):
            for j in range(i, len(at), BLOCK):
                p, q = at[i : i + BLOCK], at[j : j + BLOCK]
                a, b = np.nonzero(np.bitwise_count(x[p][:, None] ^ x[q][None, :]) <= radius)
                more = p[a] != q[b]
                if more.any():
                    groups.link(p[a][more], q[b][more])
    return groups.root


def _router(trees: dict, radius: int):
    """Deals points (shard, fp) on by their shard's tree; a shard without one keeps its points."""
    width = 1 << TREE_DEPTH + 1

    def run(batches):
        for batch in batches:
            shard, x = batch.column("shard").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                for leaf, at in route(x[own], trees[s], radius) if s in trees else [(None, np.arange(len(own)))]:
                    if len(at):
                        to = s if leaf is None else s * width + leaf  # numbers of deeper shards are larger than all above
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), to, np.int64)), pa.array(x[own[at]].view(np.int64))], ["shard", "fp"])

    return run


def _depth(n: float) -> int:
    return min(TREE_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / SHARD)))))


def _shards(points: DataFrame, radius: int) -> DataFrame:
    """shard, fp: each point in every shard that it may have partners in; shards of about SHARD points, as far as they can be split."""
    spark, n = points.sparkSession, points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE << _depth(n)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64) if _depth(n) else np.zeros(0, np.uint64)
    route_first = _router({0: build_tree(sample, _depth(n), radius)}, radius)
    shards = points.select(F.lit(0).cast("long").alias("shard"), "fp").mapInArrow(tidied(route_first), "shard long, fp long")
    if n <= SHARD << TREE_DEPTH:
        return shards
    shards = spill(shards, "shards")
    whole: list[int] = []  # shards that no tree splits, TREES a pass at most
    while True:
        large = shards.groupBy("shard").agg(F.count("*").alias("n")).where((F.col("n") > 4 * SHARD) & (F.col("shard") < 1 << 62 - TREE_DEPTH))
        sizes = {r["shard"]: r["n"] for r in large.where(~F.col("shard").isin(whole)).orderBy(F.col("n").desc(), "shard").limit(TREES).collect()}
        if not sizes:
            return shards
        # a bounded sample of each large shard, by the points' hashes
        share = spark.createDataFrame([(k, min(1.0, 2.0 * (SAMPLE << _depth(v)) / v), _depth(v)) for k, v in sizes.items()], "shard long, share double, depth int")
        drawn = shards.join(F.broadcast(share), "shard").where(F.pmod(F.xxhash64("fp", "shard"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(build_tree(x, int(pdf["depth"].iloc[0]), radius))]})

        trees = {r["shard"]: pickle.loads(r["tree"]) for r in drawn.groupBy("shard").applyInPandas(build, "shard long, tree binary").collect()}  # TREES at most
        whole += [k for k in sizes if trees.get(k) is None]
        trees = {k: t for k, t in trees.items() if t is not None}
        if trees:
            shards = spill(shards.mapInArrow(tidied(_router(trees, radius)), "shard long, fp long"), "shards")


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: a forest that connects all distinct fingerprints (column fp) at most radius bits apart, and only those."""

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        root = link_close(x, radius)
        at = np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame({"u": x[at].view(np.int64), "v": x[root[at]].view(np.int64)})

    return _shards(points, radius).groupBy("shard").applyInPandas(forest, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for the nodes on edges(u, v).

    Each round every node's larger neighbours are moved to its smallest one (large star), then every node and its
    smaller neighbours to the smallest (small star), until nothing changes. Each round's edges go to a table in the shared folder.
    """
    spark, old = edges.sparkSession, []
    with scratch() as made:
        e = spill(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, old = state, made
        with scratch() as made:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = spill(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
            e = spill(small.distinct(), "small")
        discard(spark, [*old, *made[:-1]])  # the round before, and this one's own first half


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, k1, k2, fp, component_id (smallest doc_id that links reach) and first of every row of docs(doc_id, text).

    first is true for the one text of each component that has the smallest id (nulls last, then by k1, k2).
    """
    prints = spill(fingerprints(docs, shingle), "prints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    points = spill(prints.groupBy("fp").agg(F.min(key).alias("least")), "points")
    groups = components(links(points.select("fp"), radius))
    rooted = spill(points.join(groups, points.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = spill(rooted.groupBy("root").agg(F.min("least").alias("least")), "named")
    of = spill(rooted.select("fp", "root").join(named, "root").select("fp", "least"), "classes")
    first = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    return prints.join(of, "fp").select("doc_id", "k1", "k2", "fp", F.col("least.doc_id").alias("component_id"), first.alias("first"))
