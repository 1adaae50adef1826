"""A book from its pages to linked and graded items: page records, items, pictures, links, in a store that keeps what was done.

Pages are read on their own, each in its task; items need their book and kind, texts and pictures join by page.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.text import with_anchor
from ..sources import connectors
from ..streaming.ingest import STALE_MS, needs_ocr, needs_strip_retry
from . import flow, lines, segment
from .store import Snapshots, make_id

PAGE = ["book_id", "kind", "page"]
#: Options of a book.
OPTIONS = {"scale": 2.0, "top": 0.07, "bottom": 0.06, "left_tol": 0.1, "max_skip": 3, "force_ocr": False}

_FIELDS = [f.split(":")[0] for f in segment.LINE[len("struct<") : -1].split(",")]
_TYPES = dict(f.split(":") for f in segment.LINE[len("struct<") : -1].split(","))


def page_id() -> Column:
    return F.concat_ws(":", *PAGE)


def with_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with their lines (PAGE, text, x0 ... source) as an array, from top to bottom."""
    entry = F.struct("y0", "x0", F.struct(*[(F.col(c) if c in found.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in _FIELDS]).alias("l"))
    by = found.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["l"]).alias("lines"))
    return pages.drop("lines").join(by, PAGE, "left").withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{segment.LINE}>")))


def accepted_numbers(pages: DataFrame, max_skip: int = 3, top: float = 0.07, bottom: float = 0.06) -> DataFrame:
    """PAGE, accepted: how many numbers of items each page by itself shows; pages without one aren't returned."""

    def run(key: tuple, ms: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, len(segment.select_marks(segment.marks_of(ms), max_skip)))], columns=[*PAGE, "accepted"])

    marks = segment.candidates(segment.page_lines(pages), top, bottom)
    return marks.groupBy(*PAGE).applyInPandas(run, "book_id string, kind string, page int, accepted int").where("accepted > 0")


def text_lines(items: DataFrame, layout: DataFrame) -> DataFrame:
    """Lines of text items(PAGE, str, x, y, width, height), split at the columns of layout(PAGE, columns)."""
    x = items.join(layout.select(*PAGE, "columns"), PAGE)
    ends = F.transform("columns", lambda c: F.col("x") < c["x1"])
    col = F.when(F.size("columns") > 0, F.least(F.coalesce(F.nullif(F.array_position(ends, True), F.lit(0)), F.size("columns").cast("long")) - 1, F.size("columns") - 1)).otherwise(0)
    return lines.items_to_lines(x.select(*PAGE, "str", "x", "y", "width", "height", col.cast("int").alias("col")), PAGE).withColumn("source", F.lit("text"))


def _merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Lines of pages with those of another source put in (operators.lines.merge_lines)."""
    numbered = lambda df: with_anchor(df, "text", "a", "fw_text").withColumns({"number": F.col("a.num"), "token": F.col("a.token")})
    columns = [*PAGE, *_FIELDS, "fw_x1", "number", "token"]
    full = lambda df, own: numbered(df.withColumns({c: F.lit(None).cast({"fw_text": "string"}.get(c, "double")) for c in ("fw_text", "fw_x0", "fw_x1") if c not in df.columns})).withColumn("_own", F.lit(own)).select(*columns, "_own")
    both = full(base, True).unionByName(full(extra, False)).withColumn("said", F.col("source")).withColumn("source", F.when(F.col("_own"), "primary").otherwise(F.col("source"))).drop("_own")
    out = lines.merge_lines(both, PAGE)
    return out.withColumn("source", F.when(F.col("source") == "primary", F.col("said")).otherwise(F.col("source"))).select(*PAGE, *_FIELDS, "fw_x1")


def _exploded(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, F.explode("lines").alias("l")).select(*PAGE, "l.*")


def read_pages(
    images: DataFrame, items: DataFrame | None = None, recognise: Callable[[bytes], str] | None = None, recognise_strip: Callable[[bytes, float, float, float], str] | None = None, options: dict | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> DataFrame:
    """Page records (segment.PAGES and id, ocr, format, diagnostics) of images(PAGE, image: a row of Spark's image source) and text items.

    A page without a text layer, or without any accepted number, goes to recognise (null where it fails: the text layer stays); where that
    still leaves fewer numbers than half the visual starts, each column's number strip goes to recognise_strip. keep writes a table
    and reads it again, so that no service is called twice.
    """
    o = OPTIONS | (options or {})
    layout = keep(raster.page_layout(images, PAGE, o["top"], o["bottom"]), "layout")
    own = None if items is None else text_lines(items, layout)
    empty = layout.select(*PAGE).limit(0).withColumns({c: F.lit(None).cast(_TYPES[c]) for c in _FIELDS})
    pages = with_lines(layout, empty if own is None else own)
    texts = None if items is None else lines.has_text_layer(items, PAGE)
    pages = pages.withColumn("has_text", F.lit(False)) if texts is None else pages.join(texts, PAGE, "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))
    numbers = lambda p: accepted_numbers(p, o["max_skip"], o["top"], o["bottom"])
    count = lambda p: p.drop("accepted").join(numbers(p), PAGE, "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    pages = keep(count(pages), "pages").withColumns({"ocr": F.lit(False), "strip_retried": F.lit(False), "ocr_skipped": F.lit(False)})
    content = images.select(*PAGE, page_id().alias("page_id"), F.col("image.data").alias("content"))
    if recognise is not None:
        wanted = pages.where(needs_ocr(F.col("has_text"), F.lit(bool(o["force_ocr"])), F.col("accepted")))
        got = keep(connectors.recognise(content.join(wanted.select(*PAGE), PAGE, "left_semi"), recognise), "ocr")
        pages = _with_ocr(pages, got, keep, count)
    if recognise is not None and recognise_strip is not None:
        weak = pages.where(F.col("ocr") & (F.size("visual_starts") > 0) & needs_strip_retry(F.col("accepted"), F.size("visual_starts")))
        asked = connectors.strips(weak.select(*PAGE, page_id().alias("page_id"), "width", "columns")).join(content, "page_id")
        got = keep(connectors.recognise(asked, recognise_strip, extra=("col", "x0", "x1", "zoom")), "strips")
        pages = _with_strips(pages, got, keep, count)
    found = F.struct(F.size("lines").alias("line_count"), F.col("accepted").alias("lexical_candidates"), F.size("visual_starts").alias("visual_candidates"), "strip_retried", "ocr_skipped")
    return pages.select(page_id().alias("id"), *PAGE, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "columns", "lines", "visual_starts", "ink_bottoms", "ocr", "format", found.alias("diagnostics"))


def _with_ocr(pages: DataFrame, got: DataFrame, keep, count) -> DataFrame:
    key = pages.select(*PAGE, page_id().alias("page_id"))
    asked = got.join(key, "page_id").select(*PAGE, F.col("ocr").isNotNull().alias("_done"))
    seen = connectors.ocr_lines(got.where("ocr is not null")).join(key, "page_id").drop("page_id").withColumn("source", F.lit("ocr"))
    by = pages.join(asked, PAGE, "left")
    changed = by.where("_done")
    merged = _merged(_exploded(changed), seen)
    new = keep(count(with_lines(changed.drop("_done"), merged).withColumn("ocr", F.lit(True))), "pages-ocr")
    rest = by.where("_done is null or not _done").withColumn("ocr_skipped", F.coalesce(~F.col("_done"), F.lit(False))).drop("_done")
    return rest.unionByName(new)


def _with_strips(pages: DataFrame, got: DataFrame, keep, count) -> DataFrame:
    key = pages.select(*PAGE, page_id().alias("page_id"))
    seen = connectors.strip_lines(got.where("ocr is not null")).join(key, "page_id").drop("page_id", "col")
    asked = got.select("page_id").distinct().join(key, "page_id").select(*PAGE)
    changed = pages.join(asked, PAGE, "left_semi")
    new = keep(count(with_lines(changed, _merged(_exploded(changed), seen)).withColumn("strip_retried", F.lit(True))), "pages-strips")
    return pages.join(asked, PAGE, "left_anti").unionByName(new)


CUT = "id string, fragments array<struct<page:int,x0:double,y0:double,x1:double,y1:double,cont:boolean>>, picture binary, w int, h int, size_factor double"


def cut_items(items: DataFrame, images: DataFrame) -> DataFrame:
    """id, fragments (cut down to their ink), picture (PNG), w, h, size_factor of items(id, book_id, kind, fragments); items of which nothing is left are out.

    Each fragment is trimmed beside its page; an item's few parts then meet in one group.
    """
    parts = items.select("id", "book_id", "kind", F.posexplode("fragments").alias("part", "f")).withColumn("page", F.col("f.page"))
    x = parts.join(images.select(*PAGE, "image"), PAGE).select("id", "part", "f", "image")

    def trim(batches):
        for pdf in batches:
            out = []
            for ident, part, f, im in zip(pdf["id"], pdf["part"], pdf["f"], pdf["image"]):
                y = raster.luminance(im["data"], im["height"], im["width"], im["nChannels"])
                for t in raster.trim_fragments({f["page"]: y}, [f]):
                    cut = y[int(t["y0"]) : int(t["y1"]), int(t["x0"]) : int(t["x1"])]
                    out.append((ident, part, t, cut.shape[1], cut.shape[0], cut.tobytes()))
            yield pd.DataFrame(out, columns=["id", "part", "f", "w", "h", "pixels"])

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        cuts = [raster.np.frombuffer(p, raster.np.uint8).reshape(h, w) for p, w, h in zip(pdf["pixels"], pdf["w"], pdf["h"])]
        img = raster.stitch(cuts)
        whole = sum(c.shape[0] for c in cuts) + 8 * (len(cuts) - 1)
        return pd.DataFrame([(key[0], list(pdf["f"]), raster.png(img), img.shape[1], img.shape[0], min(1.0, img.shape[0] / whole))], columns=["id", "fragments", "picture", "w", "h", "size_factor"])

    kind = "struct<page:int,x0:double,y0:double,x1:double,y1:double,cont:boolean>"
    return x.mapInPandas(trim, f"id string, part int, f {kind}, w int, h int, pixels binary").groupBy("id").applyInPandas(join, CUT)


class PicturesMissing(ValueError):
    """Pages of a book have no picture, so it can't be cut anew."""


def segment_kind(pages: DataFrame, images: DataFrame, options: dict | None = None) -> DataFrame:
    """New items of the page records: cut from the pictures, with text, points or answer. The old items stay where pictures are missing."""
    o = OPTIONS | (options or {})
    bare = [r["page"] for r in pages.join(images.where("image is not null").select(*PAGE), PAGE, "left_anti").select("page").distinct().orderBy("page").limit(11).collect()]
    if bare:
        raise PicturesMissing(f"pages without a picture: {', '.join(map(str, bare[:10]))}{' …' if len(bare) > 10 else ''}")
    raw = segment.segment_pages(pages, o["max_skip"], o["top"], o["bottom"])
    raw = raw.withColumn("id", make_id("i", F.col("book_id"), F.col("kind"), F.col("label"), F.col("section"), F.col("number")))
    items = raw.drop("fragments").join(cut_items(raw, images), "id")
    found = pages.select("book_id", "kind", "page", F.posexplode("lines").alias("seq", "l")).select("book_id", "kind", "page", "seq", "l.text", "l.x0", "l.y0", "l.x1", "l.y1")
    done = flow.finalise(items, found, pages.select("book_id", "kind", "page", F.col("height").cast("int").alias("height")))
    return done.withColumn("scale", F.lit(float(o["scale"])) * F.col("size_factor")).drop("size_factor")


def claim(store: Snapshots, book_id: str, now_ms: int | None = None) -> bool:
    """Mark a book as being worked on; False where someone else does, and was heard of in the last five minutes."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    books = store.read("locks")
    held = None if books is None else books.where((F.col("id") == book_id) & F.col("busy") & (F.lit(now) - F.col("updated_at") < STALE_MS)).limit(1).first()
    if held is not None:
        return False
    store.upsert_slices("locks", store.spark.createDataFrame([(book_id, True, now)], "id string, busy boolean, updated_at long"), [])
    return True


def release(store: Snapshots, book_id: str) -> None:
    store.upsert_slices("locks", store.spark.createDataFrame([(book_id, False, 0)], "id string, busy boolean, updated_at long"), [])


def ingest_book(store: Snapshots, book: dict, sources: dict[str, Callable[[], DataFrame]], images: dict[str, DataFrame], options: dict | None = None, stop: Callable[[], bool] = lambda: False) -> str:
    """Read, cut and link a book: kind by kind, problems first, page records from sources (functions that give read_pages' result).

    Each kind's pages and items are stored as they are done; stop() is asked between kinds. The book's status ends as complete, stopped or,
    with what went wrong and the error raised on, error; what is stored by then stays. Returns the status.
    """
    spark, status, why = store.spark, "complete", None
    if not claim(store, book["id"]):
        raise RuntimeError(f"{book['id']} is being worked on elsewhere")

    def note(state: str, error: str | None = None, **more) -> None:
        row = {"id": book["id"], "name": book.get("name"), "subject": book.get("subject"), "level": book.get("level"), "status": state, "error": error, "updated_at": int(time.time() * 1000)} | more
        store.upsert_slices("books", spark.createDataFrame([tuple(row.values())], "id string, name string, subject string, level string, status string, error string, updated_at long" + "".join(f", {k} long" for k in more)), [])

    note("processing")
    try:
        for kind in ("problem", "solution"):
            if kind not in sources:
                continue
            if stop():
                status = "stopped"
                break
            store.upsert_slices("pages", sources[kind](), ["book_id", "kind"])
            pages = store.read("pages").where((F.col("book_id") == book["id"]) & (F.col("kind") == kind))
            store.upsert_slices("items", segment_kind(pages, images[kind], options), ["book_id", "kind"])
        items = store.read("items")
        mine = items.where(F.col("book_id") == book["id"])
        linked = flow.relink(_linkable(mine))
        kept = linked.select("id", "solution_id", "solution_inferred", F.col("answer").alias("linked_answer"))
        store.upsert_slices("links", kept.withColumn("book_id", F.lit(book["id"])), ["book_id"])
        stats = flow.link_stats(linked).first()
        note(status, None, **{k: int(stats[k]) for k in ("problems", "solutions", "matched", "inferred_links")} if stats else {})
        return status
    except Exception as e:
        why = str(e)[:500]
        note("error", why)
        raise
    finally:
        release(store, book["id"])


def _linkable(items: DataFrame) -> DataFrame:
    """Items with the columns that linking fills, where they have none."""
    need = {"solution_id": "string", "solution_inferred": "boolean", "answer_manual": "boolean", "answer_llm": "boolean"}
    return items.withColumns({c: F.lit(None).cast(t) for c, t in need.items() if c not in items.columns})
