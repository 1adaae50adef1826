"""Outside services behind callables: recognition, models, PDF text. Each takes rows in and gives a table of a fixed schema.

No such service is installed here; a caller passes a function, which runs in the tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ITEMS = "book_id string, kind string, page int, seq int, str string, x double, y double, width double, height double"
OCR_JSON = "page_id string, ocr string"
REPLY = "item_id string, provider string, raw string, error string"

OCR = (
    "lines array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>,words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>, "
    "blocks array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>,words:array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>>>>>, "
    "words array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
)


class NotAvailable(RuntimeError):
    """The service isn't installed."""


def missing(*_):
    raise NotAvailable("pass a function that calls the service")


def recognise(pages: DataFrame, call: Callable[..., str] = missing, retries: int = 1, extra: tuple[str, ...] = ()) -> DataFrame:
    """page_id, ocr and the extra columns of pages(page_id, content, extra): call(content, *extra) gives the recogniser's JSON; one retry,
    then null, and no more calls in this task."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]):
        gone = False
        for pdf in batches:
            out = []
            for page_id, content, *more in zip(pdf["page_id"], pdf["content"], *(pdf[c] for c in extra)):
                got = None
                for _ in range(0 if gone else retries + 1):
                    try:
                        got = call(content, *more)
                        break
                    except Exception:
                        gone = True
                gone = gone and got is None
                out.append((page_id, got, *more))
            yield pd.DataFrame(out, columns=["page_id", "ocr", *extra])

    return pages.select("page_id", "content", *extra).mapInPandas(run, OCR_JSON + "".join(f", `{c}` {kinds[c]}" for c in extra))


def ocr_lines(ocr: DataFrame, key: str = "page_id", dx: float = 0.0, dy: float = 0.0, zoom: float = 1.0) -> DataFrame:
    """Lines of a recogniser's JSON, flat or nested in blocks, on the page's coordinates; a line without confidence has its words' mean."""
    x = ocr.select(key, F.from_json("ocr", OCR).alias("o"))
    nested = F.flatten(F.flatten(F.transform("o.blocks", lambda b: F.transform(b["paragraphs"], lambda p: p["lines"]))))
    lines = F.when(F.size("o.lines") > 0, F.col("o.lines")).otherwise(nested)
    l = x.select(key, F.explode(lines).alias("l")).where(F.trim("l.text") != "")
    sure = F.coalesce("l.confidence", F.aggregate("l.words", F.lit(0.0), lambda a, w: a + F.coalesce(w["confidence"], F.lit(0.0))) / F.nullif(F.size("l.words"), F.lit(0)))
    on = lambda c, d: (F.col(f"l.bbox.{c}") / zoom + d).alias(c)
    return l.select(key, F.trim("l.text").alias("text"), on("x0", dx), on("y0", dy), on("x1", dx), on("y1", dy), sure.alias("confidence"))


def ocr_words(ocr: DataFrame, key: str = "page_id") -> DataFrame:
    """Words of results that have no lines, for operators.lines.words_to_lines."""
    x = ocr.select(key, F.from_json("ocr", OCR).alias("o")).where((F.coalesce(F.size("o.lines"), F.lit(0)) <= 0) & (F.coalesce(F.size("o.blocks"), F.lit(0)) <= 0))
    return x.select(key, F.explode("o.words").alias("w")).select(key, "w.text", "w.bbox.x0", "w.bbox.y0", "w.bbox.x1", "w.bbox.y1", "w.confidence")


#: Zoom that number strips are recognised at.
STRIP_ZOOM = 1.35


def strips(pages: DataFrame) -> DataFrame:
    """page_id, col, x0, x1, zoom of pages(page_id, width, columns): each column's number strip; those under 4 pixels wide are out."""
    x = pages.select("page_id", "width", F.posexplode("columns").alias("col", "c"))
    left, right = strip_region(F.col("c.x0"), F.col("c.x1"))
    x = x.select("page_id", "col", F.floor(left).cast("double").alias("x0"), F.least(F.col("width").cast("double"), F.ceil(right).cast("double")).alias("x1"))
    return x.where(F.col("x1") - F.col("x0") >= 4).withColumn("zoom", F.lit(STRIP_ZOOM))


def strip_lines(ocr: DataFrame) -> DataFrame:
    """Lines of recognised strips(page_id, col, x0, x1, zoom, ocr) on the page's coordinates, by page from top to bottom."""
    x = ocr_lines(ocr.withColumn("_key", F.struct("page_id", "col", F.col("x0").alias("sx0"), F.col("x1").alias("sx1"), "zoom")), "_key")
    on = lambda c: F.col("_key.sx0") + F.greatest(F.lit(0.0), F.least(F.col("_key.sx1") - F.col("_key.sx0"), F.col(c) / F.col("_key.zoom")))
    down = lambda c: F.col(c) / F.col("_key.zoom")
    return x.select("_key.page_id", "_key.col", "text", on("x0").alias("x0"), down("y0").alias("y0"), on("x1").alias("x1"), down("y1").alias("y1"), "confidence", F.lit("number-strip").alias("source"))


def strip_region(x0: Column, x1: Column, share: float = 0.34, pad: float = 6) -> tuple[Column, Column]:
    """The lane at a column's left where numbers stand."""
    return F.greatest(F.lit(0.0), x0 - pad), x0 + share * (x1 - x0) + pad


def prompt(subject: Column, system: str, hint: str, ask: str) -> Column:
    """The request text: with a subject it is named, without one the model is asked to name it."""
    return F.concat(F.lit(system), F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit(hint), subject)).otherwise(F.lit(ask)))


class ServiceError(Exception):
    """A call that failed: status of the answer, or unreadable for an answer without a usable text (truncated: it was cut off)."""

    def __init__(self, message: str, status: int | None = None, unreadable: bool = False, truncated: bool = False):
        super().__init__(message)
        self.status, self.unreadable, self.truncated = status, unreadable, truncated


def wait_after(e: Exception, attempt: int, tries: int = 3) -> float | None:
    """Seconds to wait before another attempt (from 0), or None where there is none: for too many requests and failures of the server
    twice as long each time, for an unreadable answer that isn't cut off once. Other errors would come again."""
    status = getattr(e, "status", None)
    busy = status is not None and (status == 429 or 500 <= status < 600)
    again = getattr(e, "unreadable", False) and not getattr(e, "truncated", False) and attempt == 0
    if attempt >= tries or not (busy or again or (status is None and not isinstance(e, ServiceError))):
        return None
    return 1.0 if again else 2.0 * 2**attempt


def stops_run(e: Exception) -> bool:
    """An error that every further call would meet: no access."""
    return getattr(e, "status", None) in (401, 403)


def ask_model(items: DataFrame, provider: str, call: Callable[[str, bytes], str] = missing, wait_s: float = 1.5, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """item_id, provider, raw, error of items(item_id, prompt, content): one call at a time in each task, further attempts by wait_after.
    An error of access ends the task's calls; what is left has the same error."""

    def run(batches: Iterator[pd.DataFrame]):
        closed = None
        for pdf in batches:
            out = []
            for item_id, text, content in zip(pdf["item_id"], pdf["prompt"], pdf["content"]):
                raw, error, attempt = None, closed, 0
                while closed is None:
                    try:
                        raw, error = call(text, content), None
                        break
                    except NotAvailable:
                        raise
                    except Exception as e:
                        error, pause = str(e)[:500], wait_after(e, attempt, tries)
                        closed = error if stops_run(e) else None
                        if pause is None:
                            break
                        sleep(pause)
                        attempt += 1
                out.append((item_id, provider, raw, error))
                if closed is None:
                    sleep(wait_s)
            yield pd.DataFrame(out, columns=["item_id", "provider", "raw", "error"])

    return items.select("item_id", "prompt", "content").mapInPandas(run, REPLY)


#: Columns that one reply fills, and the field of a summary (functions.jsonfix.summarise) each is from.
ANSWERED = {"ai_problems": "problems", "difficulty_llm": "difficulty", "grade_llm": "grade_llm", "llm_reason": "llm_reason", "unit": "topic", "type_llm": "type_llm"}


def apply_replies(items: DataFrame, answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items with what was answered (id, image_id: the picture that was sent, and the values of ANSWERED and subject_llm), and id, saved, why of
    each answer. Compare and set: an item that was cut anew meanwhile keeps its values. A reply without a difficulty clears the old one."""
    a = answered.select("id", F.col("image_id").alias("_sent"), *[F.col(v).alias(f"_{k}") for k, v in ANSWERED.items()], F.col("subject_llm").alias("_subject"))
    x = items.join(a.withColumn("_hit", F.lit(True)), "id", "left")
    same = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("image_id").eqNullSafe(F.col("_sent"))
    new = {k: F.when(same, F.col(f"_{k}")).otherwise(F.col(k)) for k in ANSWERED}
    new["llm_reason"] = F.when(same, F.when(F.col("_difficulty_llm").isNotNull(), F.col("_llm_reason"))).otherwise(F.col("llm_reason"))
    new |= {"subject_llm": F.when(same & F.col("_subject").isNotNull(), F.col("_subject")).otherwise(F.col("subject_llm")), "ai_stale": F.when(same, False).otherwise(F.col("ai_stale"))}
    done = a.select("id", "_sent").join(items.select("id", "image_id", F.lit(True).alias("_there")), "id", "left")
    there, kept = F.col("_there").isNotNull(), F.col("image_id").eqNullSafe(F.col("_sent"))
    why = F.when(~there, "gone").when(~kept, "recut")
    return x.withColumns(new).drop("_hit", "_sent", "_subject", *[f"_{k}" for k in ANSWERED]), done.select("id", (there & kept).alias("saved"), why.alias("why"))


def data_url_bytes(c: Column) -> Column:
    """Bytes of a data URL's base64 part; null for other strings."""
    return F.try_to_binary(F.nullif(F.regexp_extract(c, r"^data:[^;,]*;base64,(.*)$", 1), F.lit("")), F.lit("base64"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures (Spark's image source, BGR)."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
