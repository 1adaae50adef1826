"""Record store over Parquet snapshots: upserts, slices, cascades, restore merges and sweeps as table expressions."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with these values in these columns (None for null). On a table partitioned by them only their files are read."""
    for c, v in keys.items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
    return df


def keys_of(df: DataFrame, key: str = "id", **keys) -> DataFrame:
    """Keys of the rows of lookup(); no other column is read."""
    return lookup(df, **keys).select(key)


def point(df: DataFrame, ident, key: str = "id") -> Row | None:
    return lookup(df, **{key: ident}).limit(1).first()


def for_each(df: DataFrame, visit: Callable[[Row], object], **keys) -> int:
    """Visit the rows of lookup() one after the other on the driver, which holds one partition at a time; an error of visit ends the scan. How many it was."""
    n = 0
    for row in lookup(df, **keys).toLocalIterator(prefetchPartitions=False):
        visit(row)
        n += 1
    return n


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def take(old: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rest and taken rows."""
    return delete(old, keys, key), old.join(keys.select(key), key, "left_semi")


def update(df: DataFrame, guard: Column, **columns: Column) -> DataFrame:
    """Columns change where the guard holds; other rows stay."""
    return df.withColumns({c: F.when(guard, v).otherwise(F.col(c)) for c, v in columns.items()})


def update_many(df: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Columns of delta replace those of the same key; keys that df lacks are skipped."""
    cols = [c for c in delta.columns if c != key]
    d = delta.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    return df.join(d, key, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).drop("_hit", *[f"_{c}" for c in cols])


def count_updated(df: DataFrame, delta: DataFrame, key: str = "id") -> int:
    """Rows that update_many changes."""
    return df.join(delta.select(key).distinct(), key, "left_semi").count()


def replace_slice(items: DataFrame, new: DataFrame, book: str, kind: str) -> DataFrame:
    """items with one (book_id, kind) slice swapped for new."""
    return items.where(~((F.col("book_id") == book) & (F.col("kind") == kind))).unionByName(new, allowMissingColumns=True)


def delete_book(books: DataFrame, pages: DataFrame, items: DataFrame, settings: DataFrame, book: str) -> tuple[DataFrame, ...]:
    """The four tables without a book and its rows, and with its tombstone."""
    stone = settings.sparkSession.createDataFrame([(f"cleanup:{book}",)], "id string")
    return books.where(F.col("id") != book), pages.where(F.col("book_id") != book), items.where(F.col("book_id") != book), upsert(settings, stone)


def pending_cleanup(settings: DataFrame, books: DataFrame) -> DataFrame:
    """Books with a tombstone that weren't imported again."""
    stones = settings.where(F.col("id").startswith("cleanup:")).select(F.expr("substr(id, 9)").alias("book_id"))
    return stones.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti")


def orphans(files: DataFrame, refs: DataFrame, file: str, age: Column, least_age) -> DataFrame:
    """Files that nothing refers to and that are old enough."""
    return files.where(age >= least_age).join(refs.select(file).where(F.col(file).isNotNull()).distinct(), file, "left_anti")


def merge_restored(live: DataFrame, backup: DataFrame, key: str, image: list[str], bundle: list[str], marker: str, same_regions: Column | None = None) -> DataFrame:
    """Live and backup rows as one. A backup row wins, but image columns stay live where the backup has none, and the bundle is all
    live where live has its marker, else all from the backup (stale where regions differ)."""
    cols = [c for c in live.columns if c != key]
    a = live.select(key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_live"))
    b = backup.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_backup"))
    x = a.join(b, key, "full_outer")
    from_backup = F.col("in_backup").isNotNull()
    no_image = F.col(f"b_{image[0]}").isNull() if image else F.lit(False)
    live_has = F.col(f"a_{marker}").isNotNull()

    def pick(c: str) -> Column:
        live_c, back_c = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in bundle:
            return F.when(from_backup & ~live_has, back_c).otherwise(live_c)
        if c in image:
            return F.when(from_backup & ~no_image, back_c).when(from_backup & F.col("in_live").isNull(), back_c).otherwise(live_c)
        return F.when(from_backup, back_c).otherwise(live_c)

    origin = F.when(F.col("in_live").isNull(), "backup").when(F.col("in_backup").isNull(), "live").otherwise("merged")
    out = [F.col(key), *[pick(c).alias(c) for c in cols], origin.alias("origin")]
    if same_regions is not None:
        out.append((from_backup & ~live_has & ~F.coalesce(same_regions, F.lit(False))).alias("stale"))
    return x.select(*out)


def merge_report(live: DataFrame, backup: DataFrame, key: str, image: str) -> DataFrame:
    """kept: backup rows without a picture whose live one stays; missing: rows that come in without any."""
    both = backup.select(key, F.col(image).isNull().alias("bare")).join(live.select(key, F.col(image).isNotNull().alias("has")), key, "left")
    has = F.coalesce("has", F.lit(False))
    return both.agg(F.count_if(F.col("bare") & has).alias("kept"), F.count_if(F.col("bare") & ~has).alias("missing"))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of this machine only where the executors run here too."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (at or "file:///tmp/checkpoints").rstrip("/")


STORES = ("books", "pages", "items")


def export_backup(stores: dict[str, DataFrame], path: str) -> dict[str, Row]:
    """NDJSON in order of the stores, a header first; each store is written by all tasks, in files whose names sort.

    For each store how many rows were written, and how many of them without the picture that image_ref says they have.
    """
    spark = next(iter(stores.values())).sparkSession
    header = spark.createDataFrame([(json.dumps({"format": "workbook-backup", "version": 2}),)], "value string")
    header.coalesce(1).write.text(f"{path}/0-header")
    counts = {}
    for k, name in enumerate(STORES):
        if name in stores:
            df = stores[name]
            lost = F.col("image").isNull() & F.col("image_ref").isNotNull() if {"image", "image_ref"} <= set(df.columns) else F.lit(False)
            df.select(F.to_json(F.struct(F.lit(name).alias("s"), F.struct("*").alias("v")), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/{k + 1}-{name}")
            counts[name] = df.agg(F.count("*").alias("rows"), F.count_if(lost).alias("unreadable")).first()
    return counts


def read_records(lines: DataFrame, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each known store's valid rows of backup lines (value), and the lines that can't be read. Blank lines, the header and unknown stores are skipped."""
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", "s string, v string, format string").alias("j"))
    bad = parsed.where(F.col("j").isNull() | (F.col("j.s").isNull() & F.col("j.format").isNull())).select("value")
    rows = {name: clean_records(parsed.where(F.col("j.s") == name).select(F.from_json("j.v", ddl).alias("r")).select("r.*"), name) for name, ddl in schemas.items()}
    return rows, bad


def import_backup(spark: SparkSession, path: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """read_records of a backup's files."""
    return read_records(spark.read.option("recursiveFileLookup", "true").text(path), schemas)


def import_backup_v1(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Each store's valid rows of an old backup, one JSON object with arrays of books, pages and items; ValueError for other files."""
    whole = spark.read.text(path, wholetext=True)
    arrays = whole.select(F.from_json("value", "struct<books: array<string>, pages: array<string>, items: array<string>>", {"mode": "PERMISSIVE"}).alias("j"), "value")
    other = lambda c: F.get_json_object("value", f"$.{c}").isNotNull() & F.col(f"j.{c}").isNull()
    wrong = arrays.where(F.col("j.books").isNull() | other("pages") | other("items"))
    if wrong.limit(1).count():
        raise ValueError("not a backup: an object with the arrays books, pages and items")
    return {name: clean_records(arrays.select(F.explode(f"j.{name}").alias("r")).select(F.from_json("r", ddl).alias("r")).select("r.*"), name) for name, ddl in schemas.items()}


def clean_records(rows: DataFrame, store: str) -> DataFrame:
    """Rows with an id (and a book_id, fragments); defaults for what may be missing. An inline picture must be image data: a page or
    item with another one is out; a page without any is marked."""
    ok = F.col("id").isNotNull() & (F.col("id") != "")
    if store != "books" and "book_id" in rows.columns:
        ok &= F.col("book_id").isNotNull() & (F.col("book_id") != "")
    if store == "items" and "fragments" in rows.columns:
        ok &= F.col("fragments").isNotNull()
    inline = "image" in rows.columns and dict(rows.dtypes)["image"] == "string"
    if inline and store != "books":
        ok &= F.col("image").isNull() | F.col("image").startswith("data:image/")
    rows = rows.where(ok)
    if inline and store == "books":
        rows = rows.withColumn("image", F.when(F.col("image").startswith("data:image/"), F.col("image")))
    if store == "books":
        zero = "named_struct('problem', 0, 'solution', 0)"
        defaults = {"name": "''", "created_at": "timestamp '1970-01-01 00:00:00'", "page_counts": zero}
        rows = rows.withColumns({c: F.coalesce(c, F.expr(d).cast(rows.schema[c].dataType)) for c, d in defaults.items() if c in rows.columns})
    if store == "pages" and {"image", "image_missing"} <= set(rows.columns):
        rows = rows.withColumn("image_missing", F.col("image").isNull() | F.coalesce("image_missing", F.lit(False)))
    return rows


def make_id(prefix: str, *natural: Column) -> Column:
    """A deterministic id of a natural key."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*natural)), 256), 1, 20))


REF = "struct<book:string,file:string,type:string,size:bigint>"


def _safe(name) -> str:
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]+', "_", str(name))[:80]


def place_images(rows: DataFrame, folder: str) -> DataFrame:
    """id, image_ref, error of rows(id, book_id, role, image: a data URL): each picture in a file of its own in the book's folder.

    A file never takes another's name, so a repeated task, or a change that is given up, harms no file that a record names. A picture
    that can't be read or written has an error and leaves no file.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = []
            for ident, book, role, image in zip(pdf["id"], pdf["book_id"], pdf["role"], pdf["image"]):
                ref = error = path = None
                try:
                    m = re.match(r"data:(image/[a-z+]+);base64,(.*)$", image or "", re.S)
                    if m is None:
                        raise ValueError("no picture data")
                    data = base64.b64decode(m[2], validate=True)
                    name = f"{_safe(role)}-{_safe(ident)[:40]}-{uuid.uuid4().hex}.{'jpg' if 'jp' in m[1] else 'png'}"
                    path = f"{root}/{_safe(book)}/{name}"
                    fs.create_dir(f"{root}/{_safe(book)}", recursive=True)
                    with fs.open_output_stream(path, compression=None) as f:
                        f.write(data)
                    ref = {"book": _safe(book), "file": name, "type": m[1], "size": len(data)}
                except (ValueError, OSError) as e:
                    error = str(e)[:300]
                    if path is not None and fs.get_file_info(path).type != pafs.FileType.NotFound:
                        fs.delete_file(path)
                out.append((ident, ref, error))
            yield pd.DataFrame(out, columns=["id", "image_ref", "error"])

    return rows.select("id", "book_id", "role", "image").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, image_ref {REF}, error string")


def remove_files(refs: DataFrame, folder: str) -> DataFrame:
    """book, file, removed of refs(book, file): true also where the file is gone already; false where it can't be deleted."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            done = []
            for book, file in zip(pdf["book"], pdf["file"]):
                try:
                    if fs.get_file_info(f"{root}/{_safe(book)}/{_safe(file)}").type != pafs.FileType.NotFound:
                        fs.delete_file(f"{root}/{_safe(book)}/{_safe(file)}")
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"book": pdf["book"], "file": pdf["file"], "removed": done})

    return refs.select("book", "file").mapInPandas(run, "book string, file string, removed boolean")


def movable(records: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Records whose picture is still inline; those of busy books (book_id) are left for later."""
    rows = records.where(F.col("image").isNotNull())
    return rows if busy is None else rows.join(busy.select("book_id"), "book_id", "left_anti")


def apply_moved(records: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the pictures that were moved (id, image_id: the picture that was read, image_ref), and the refs that are of no use.

    Compare and set: a record whose picture has changed since, or that is gone, keeps what it has, and the new file is to be removed.
    """
    m = moved.where(F.col("image_ref").isNotNull()).select("id", F.col("image_id").alias("_read"), F.col("image_ref").alias("_ref"))
    x = records.join(m, "id", "left")
    same = F.col("_ref").isNotNull() & F.col("image_id").eqNullSafe(F.col("_read"))
    new = {"image": F.when(~same, F.col("image")), "image_ref": F.when(same, F.col("_ref")).otherwise(F.col("image_ref")), "image_id": F.when(same, F.concat(F.lit("i"), F.substring(F.sha2(F.col("_ref.file"), 256), 1, 20))).otherwise(F.col("image_id"))}
    if "image_bytes" in records.columns:
        new["image_bytes"] = F.when(same, F.col("_ref.size")).otherwise(F.col("image_bytes"))
    kept = records.select("id", "image_id")
    lost = m.join(kept, "id", "left").where(~F.coalesce(F.col("image_id").eqNullSafe(F.col("_read")), F.lit(False)) | F.col("image_id").isNull() & F.col("_read").isNotNull())
    return x.withColumns(new).drop("_read", "_ref"), lost.select("_ref.book", "_ref.file")


def move_report(records: DataFrame, moved: DataFrame, lost: DataFrame) -> DataFrame:
    """total, changed, failed, skipped: what a move did."""
    n = lambda df, c, name: df.agg(F.count_if(c).alias(name))
    counts = [n(records, F.lit(True), "total"), moved.agg(F.count_if(F.col("image_ref").isNotNull()).alias("placed"), F.count_if(F.col("image_ref").isNull()).alias("failed")), n(lost, F.lit(True), "skipped")]
    x = counts[0].join(counts[1]).join(counts[2])  # one row each
    return x.select("total", (F.col("placed") - F.col("skipped")).alias("changed"), "failed", "skipped")


def megabytes(size: Column) -> Column:
    """A size as MB with one decimal, halves to the even one; 0.1 at least."""
    return F.format_string("%.1fMB", F.greatest(F.lit(0.1), F.bround(size / 1048576, 1)))


def megabytes_or_gigabytes(size: Column) -> Column:
    """A size as MB (0.1 at least) or, from 1024 MB on, GB; with one decimal, halves up."""
    mb = size / 1048576
    return F.when(mb >= 1024, F.format_string("%.1fGB", mb / 1024)).otherwise(F.format_string("%.1fMB", F.greatest(F.lit(0.1), mb)))


def storage(records: DataFrame, scope: list[str] = ("book_id",), shown: Callable[[Column], Column] = megabytes_or_gigabytes) -> DataFrame:
    """scope, pictures, image_bytes, shown: what pictures take, and how that is shown."""
    x = records.groupBy(*scope).agg(F.count_if(F.col("image_bytes") > 0).alias("pictures"), F.coalesce(F.sum("image_bytes"), F.lit(0)).alias("image_bytes"))
    return x.withColumn("shown", shown(F.col("image_bytes")))


class Snapshots:
    """Tables as snapshots in folders of their own; one pointer row, written last, makes those of several tables current at once. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _state(self) -> tuple[int, dict[str, str], dict[str, str]]:
        schema = "n long, tables map<string,string>, schemas map<string,string>"
        try:
            rows = self.spark.read.json(f"{self.root}/_pointer", schema=schema).orderBy(F.col("n").desc()).limit(1).collect()
        except Exception as e:  # no such path: nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return (rows[0]["n"], rows[0]["tables"], rows[0]["schemas"]) if rows else (0, {}, {})

    def _point(self, tables: dict[str, str], schemas: dict[str, str]) -> None:
        n, old, kinds = self._state()
        row = [(n + 1, old | tables, kinds | schemas)]
        self.spark.createDataFrame(row, "n long, tables map<string,string>, schemas map<string,string>").coalesce(1).write.mode("append").json(f"{self.root}/_pointer")

    def read(self, name: str) -> DataFrame | None:
        _, tables, schemas = self._state()
        if name not in tables:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(schemas[name]))).parquet(f"{self.root}/{name}/{tables[name]}")

    def commit(self, frames: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> None:
        """New contents of several tables: all of them become current, or, where a write fails, none."""
        tables = {}
        for name, df in frames.items():
            tables[name] = f"snapshot-{uuid.uuid4().hex}"
            df.write.partitionBy(*((partition_by or {}).get(name) or [])).parquet(f"{self.root}/{name}/{tables[name]}")
        self._point(tables, {name: df.schema.json() for name, df in frames.items()})

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        self.commit({name: df}, {name: partition_by or []})

    def append(self, name: str, df: DataFrame) -> None:
        """More rows, in files beside those that are there."""
        _, tables, _ = self._state()
        at = tables.get(name, f"snapshot-{uuid.uuid4().hex}")
        df.write.mode("append").parquet(f"{self.root}/{name}/{at}")
        if name not in tables:
            self._point({name: at}, {name: df.schema.json()})

    def upsert_slices(self, name: str, rows: DataFrame, slice_by: list[str], key: list[str] = ("id",)) -> DataFrame | None:
        """Upsert into a table partitioned by slice_by; only the slices that rows touch are rewritten, and they are returned.

        The slices' new contents are written aside first, then swapped in by a dynamic partition overwrite. Without slices the table is
        written anew. Nothing, and None, for no rows.
        """
        given = f"{self.root}/{name}/given-{uuid.uuid4().hex}"
        rows.write.parquet(given)  # made once, whatever it takes to make
        rows = self.spark.read.schema(rows.schema).parquet(given)
        if not rows.limit(1).count():
            return None
        old = self.read(name)
        merged = lambda was: rows if was is None else was.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)
        if not slice_by:
            self.write(name, merged(old))
            return self.read(name)
        touched = rows.select(*slice_by).distinct()
        of = lambda df: None if df is None else df.join(F.broadcast(touched), list(slice_by), "left_semi")  # noqa: E731  (a batch's slices: no more than its rows)
        aside = f"{self.root}/{name}/aside-{uuid.uuid4().hex}"
        new = merged(of(old))
        new.write.parquet(aside)
        held = self.spark.read.schema(new.schema).parquet(aside)
        _, tables, _ = self._state()
        at = tables.get(name, "slices")
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slice_by).parquet(f"{self.root}/{name}/{at}")
        if name not in tables:
            self._point({name: at}, {name: new.schema.json()})
        return held
