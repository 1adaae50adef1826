"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A bounded, hash-ordered sample of labelled documents (PER_CLASS of each label) is fitted on the driver: hashed byte and
character-class trigrams, weighted by rarity, then a truncated singular value decomposition. The sample's vectors are
broadcast (2 * PER_CLASS * DIMS floats at most). Every document is projected, its cosine with every labelled vector is
computed exactly, in blocks, and its NEIGHBOURS nearest vote with their similarity, each class weighted by its share
among all labelled rows. Labels, language, source and id are no inputs of a score.

Vectors are rounded to whole numbers before they are multiplied, in sums that doubles hold exactly: a text's score depends on
nothing but the text and the model, however rows are dealt to tasks.

Defined results: null and empty texts have the share of label 1 as score (the pipeline drops blank texts itself); without any
label the score is 0.5; a document with several labels has the majority's (1 on a tie); of equally near neighbours the earlier
in the sample's order votes; repeated rows and null ids pass through (a null id is never labelled); a very long text counts
whole; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import buffers, steps, tidied

#: Labelled documents of each class in the fitted sample: the bound of what is collected and broadcast.
PER_CLASS = 1500
DIMS = 64
NEIGHBOURS = 25
SHARPNESS = 12
GRAMS, SHAPES = 2048, 512
BLOCK = 512


def _shape() -> np.ndarray:
    """Character class of each byte."""
    x = np.full(256, 6, np.uint8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\t\r", b".,;:'\"?()-")):
        x[list(chars)] = k
    x[128:] = 7
    return x


_SHAPE = _shape()


def features(column: pa.Array) -> np.ndarray:
    """Logarithms of trigram counts, GRAMS hashed ones of bytes and SHAPES of character classes, a row for each text."""
    data, off = buffers(column)
    x = np.frombuffer(data, np.uint8)[off[0] : off[-1]].astype(np.uint32)
    n = len(off) - 1
    out = np.zeros((n, GRAMS + SHAPES), np.float32)
    if len(x) < 3:
        return out
    row = np.repeat(np.arange(n), np.diff(off))
    inside = np.flatnonzero(row[:-2] == row[2:])
    row = row[inside]
    code = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(21)
    out[:, :GRAMS] = np.bincount(row * GRAMS + code[inside], minlength=n * GRAMS).reshape(n, GRAMS)
    s = _SHAPE[x].astype(np.uint32)
    code = s[:-2] << np.uint32(6) | s[1:-1] << np.uint32(3) | s[2:]
    out[:, GRAMS:] = np.bincount(row * SHAPES + code[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    return _log1p(out)


_LOGS = np.log1p(np.arange(1 << 16, dtype=np.float64)).astype(np.float32)


def _log1p(counts: np.ndarray) -> np.ndarray:
    """Logarithms from a table, so that equal counts have equal ones wherever they stand; those of larger counts one by one."""
    out = _LOGS[np.minimum(counts, len(_LOGS) - 1).astype(np.int32)]
    for k in zip(*np.nonzero(counts >= len(_LOGS))):
        out[k] = np.float32(math.log1p(float(counts[k])))
    return out


#: Steps of a whole in rounded vectors: of the weighted counts, the basis and the projections.
_FINE = {"counts": 1 << 14, "basis": 1 << 18, "vector": 1 << 16}


def _whole(x: np.ndarray, of: str) -> np.ndarray:
    """x in whole steps, as doubles: products of these, summed over a few thousand places, stay under 2 ** 53 and so exact."""
    return np.rint(x.astype(np.float64) * _FINE[of])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        """x: features of labelled texts; y: their labels; share of label 1 among all labelled rows."""
        self.share = share
        present = (x > 0).sum(0)
        self.weight = np.log((1 + len(x)) / (1 + present)).astype(np.float32) + np.float32(0.1)
        a = self._weighted(x)
        rng = np.random.default_rng(7)
        dims = min(DIMS, *a.shape) if len(a) else 0
        q = rng.standard_normal((a.shape[1], dims + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _ = np.linalg.qr(a.T @ (a @ q))
        _, _, v = np.linalg.svd(a @ q, full_matrices=False)
        self.basis = (q @ v[:dims].T).astype(np.float32)
        self._basis = _whole(self.basis, "basis")
        self.vectors = self._projected(x)
        self.labels = y.astype(np.float32)
        ones = max(1.0, float(y.sum()))
        zeros = max(1.0, float(len(y) - y.sum()))
        self.votes = np.where(y > 0, share / ones, (1 - share) / zeros).astype(np.float32)
        self.votes /= max(self.votes.mean(), 1e-12) if len(y) else 1

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        x = x * self.weight
        return np.hstack([_unit(x[:, :GRAMS]), _unit(x[:, GRAMS:])])

    def _projected(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in whole steps; products of two of them are cosines, exact ones of these."""
        return _whole(_unit(_whole(self._weighted(x), "counts") @ self._basis), "vector")

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.share)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        n = len(self.labels)
        for i in range(0, len(x), BLOCK):
            cosine = self._projected(x[i : i + BLOCK]) @ self.vectors.T
            # whole numbers, with the place in the sample below them: no two are equal
            rank = cosine.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            near = np.sort(np.argpartition(rank, -k, axis=1)[:, -k:], axis=1)
            w = np.maximum(np.take_along_axis(cosine, near, axis=1) / _FINE["vector"] ** 2, 0) ** SHARPNESS * self.votes[near]
            total = w.sum(1)
            seen = total > 1e-12
            out[i : i + BLOCK][seen] = np.clip((w * self.labels[near]).sum(1)[seen] / total[seen], 0, 1)
        return out


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows that may be learnt from."""
    kept = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return kept.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    usable = learnable(labels.select("doc_id", "quality"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    drawn = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)

    def vectors(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in steps(text):
                x = features(text.slice(a, b - a)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    # the drawn rows are at most 2 * per_class
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = sample.orderBy("doc_id").select("label", "text").mapInArrow(tidied(vectors), "label int, x binary").toPandas()
    x = np.stack([np.frombuffer(r, np.float16) for r in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, GRAMS + SHAPES), np.float32)
    total = sum(counts.values())
    return Model(x, got["label"].to_numpy(np.float64), counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Every column of docs, and quality_score (0 to 1; higher: label 1 is likelier) of each row's text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    fields = [f for f in docs.schema.fields if f.name != "quality_score"]

    def run(batches):
        m = model.value
        for batch in batches:
            text = batch.column("text")
            s = [m.score(features(text.slice(a, b - a))) for a, b in steps(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], [*(f.name for f in fields), "quality_score"])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(tidied(run), StructType([*fields]).add("quality_score", DoubleType()))
