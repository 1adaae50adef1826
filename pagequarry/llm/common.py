"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at a time (a longer single text is still taken whole).
STEP_BYTES = 1 << 20
#: Rows that it holds at most, so that many short texts don't make it large.
STEP_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share, from spark.checkpoint.dir.

    A path without a scheme is one of the default file system, as Spark reads it. Where the setting is missing, a folder of this machine
    stands in for it, but only if the executors run here too: a cluster without a shared folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints"
    return qualified(spark, at).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The folder's URI in its file system, the default one where path names none; file:/x as file:///x, which every reader takes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def release() -> None:
    """Give freed memory back to the system, which the allocators of C and Arrow else keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, with freed memory given back as a task ends: its worker stays, idle, beside later tasks."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


#: Folders written since the innermost scratch() was opened.
_written: list[list[str]] = []


def spill(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors, and the reread table has no
    partitioning, so later joins get plain exchanges that adaptive execution can split when a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _written:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that spill wrote."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for at in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that are spilled inside, to be discarded once what is read from them is written elsewhere."""
    made: list[str] = []
    _written.append(made)
    try:
        yield made
    finally:
        _written[:] = [m for m in _written if m is not made]


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add k1, k2: a key that equal rows share and that null or repeated ids don't confuse."""
    null = F.col(id_col).isNull()
    return df.withColumn("k1", F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col), F.lit("no id")))).withColumn(
        "k2", F.hash(F.col(text_col), null)
    )


#: Keys are marked in so many buckets by split_by_marks; the bound of what it broadcasts.
MARKS = 1 << 18


def split_by_marks(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of keyed (with k1, k2) that no row of keys can match, and the others.

    Only the others, few where the keys are few, have to be shuffled to be joined with keys.
    """
    mark = F.pmod(F.xxhash64("k1", "k2"), F.lit(MARKS))
    marks = F.broadcast(keys.select(mark.alias("mark")).distinct())  # at most MARKS rows
    marked = keyed.withColumn("mark", mark)
    return marked.join(marks, "mark", "left_anti").drop("mark"), marked.join(marks, "mark", "left_semi").drop("mark")


def packed(df: DataFrame) -> DataFrame:
    """k1, k2 (see with_row_key), doc_id, text, and row: a struct of all columns of df, so that none clashes with an operator's own."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return with_row_key(df.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text"))


def without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keyed whose k1, k2 aren't in keys (a table that can be read twice)."""
    clean, maybe = split_by_marks(keyed, keys)
    return clean.unionByName(maybe.join(keys.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti").select(keyed.columns))


def one_of_each(keyed: DataFrame, several: DataFrame) -> DataFrame:
    """keyed (as of packed) with one row of those that share a key of several: the first by the JSON of the whole row."""
    clean, maybe = split_by_marks(keyed, several)
    return clean.select("row").unionByName(maybe.groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))


def buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets in it; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return memoryview(b""), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data if data is not None else b"").cast("B"), off


def texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; nulls count as empty."""
    data, off = buffers(column)
    edges = off.tolist()
    return [bytes(data[a:b]) for a, b in zip(edges, edges[1:])]


def steps(column: pa.Array, limit: int = STEP_BYTES):
    """Ranges of rows with about limit bytes of text each, STEP_ROWS of them at most."""
    _, off = buffers(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, min(at + STEP_ROWS, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
        yield at, to
        at = to


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, from one prefix sum over the bytes."""
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
