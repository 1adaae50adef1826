"""Boxes, lines and intervals: range joins on an equality (a page), sessions and lanes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import upper_median


def same_regions(a: Column, b: Column, tol: float = 4) -> Column:
    """Equal many fragments, pairwise on one page and within tol on every side."""
    close = lambda x, y: (x["page"] == y["page"]) & (F.abs(x["x0"] - y["x0"]) <= tol) & (F.abs(x["y0"] - y["y0"]) <= tol) & (F.abs(x["x1"] - y["x1"]) <= tol) & (F.abs(x["y1"] - y["y1"]) <= tol)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda ok: F.coalesce(ok, F.lit(False)))


def text_in_boxes(lines: DataFrame, boxes: DataFrame, scope: list[str], ident: str) -> DataFrame:
    """ident, text: lines(page, seq, text, x0, y0, x1, y1) whose centre is inside a box(ident, part, page, x0, y0, x1, y1), by box part then line, one a line."""
    b = boxes.select(*scope, "page", ident, "part", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("b_x0"), F.col("b_x1")) & cy.between(F.col("b_y0"), F.col("b_y1"))
    rows = lines.join(b, [*scope, "page"]).where(inside)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(*scope, ident).agg(text.alias("text"))


def bins(low: Column, high: Column, width: float) -> Column:
    """Numbers of the bins of that width that an interval touches."""
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def point_in_interval(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, scope: list[str], width: float | None = None) -> DataFrame:
    """Points with the intervals that hold them; scope is the equality that the join is dealt by.

    With a width, also the bin: an interval stands in each bin it touches, a point in one, so that points meet only intervals of
    their bin. Take about the usual length of an interval, or several times it; a long one has a row for each of its bins.
    """
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    if width is None:
        return points.join(intervals, scope).where(inside)
    p = points.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
    return p.join(i, [*scope, "_bin"]).where(inside).drop("_bin")


def near_pairs(left: DataFrame, right: DataFrame, scope: list[str], a: str, b: str, reach: float) -> DataFrame:
    """Rows of left and right of one scope whose values a and b are at most reach apart: left's row stands in its bin of that width and both beside it."""
    l = left.withColumn("_bin", F.explode(bins(F.col(a) - reach, F.col(a) + reach, reach)))
    r = right.withColumn("_bin", F.floor(F.col(b) / reach).cast("long"))
    return l.join(r, [*scope, "_bin"]).where(F.abs(F.col(a) - F.col(b)) <= reach).drop("_bin")


def pick_last(boxes: DataFrame, x: float, y: float, order: str) -> DataFrame:
    """The box drawn last over a point."""
    return boxes.where((F.col("x0") <= x) & (F.col("x1") >= x) & (F.col("y0") <= y) & (F.col("y1") >= y)).orderBy(F.col(order).desc()).limit(1)


def near_start(y: Column, height: Column, page_height: Column, starts: Column, share: float = 0.014) -> Column:
    """A visual start (array of y0, h) stands beside a line: closer than the taller of both, and than share of the page."""
    return F.coalesce(F.exists(starts, lambda v: F.abs(v["y0"] - y) < F.greatest(height, v["h"], share * page_height)), F.lit(False))


def column_of(x: Column, columns: Column) -> Column:
    """Index of the column (array of x0, x1) that holds x; null if none."""
    hits = F.transform(columns, lambda c: (x >= c["x0"]) & (x < c["x1"]))
    return F.nullif(F.array_position(hits, True), F.lit(0)) - 1


def on_page(items: DataFrame, page: int) -> DataFrame:
    return items.select("*", F.posexplode("fragments").alias("part", "fragment")).where(F.col("fragment.page") == page)


def delete_fragment(fragments: Column, n: int) -> Column:
    return F.filter(fragments, lambda f, i: i != n)


def add_fragment(fragments: Column, new: Column) -> Column:
    """Fragments with new in reading order."""
    keyed = F.transform(F.array_append(fragments, new), lambda f: F.struct(f["page"].alias("a"), f["x0"].alias("b"), f["y0"].alias("c"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def adaptive_blocks(df: DataFrame, group: list[str], at: str, tie: str, factor: float = 1.8, least: float = 0.0, cut: Column | None = None) -> DataFrame:
    """df with gap and block: a row starts a block where its gap exceeds factor times the group's upper median of positive gaps (and least), or where cut holds."""
    order = Window.partitionBy(*group).orderBy(at, tie)
    x = df.withColumn("gap", F.col(at) - F.lag(at).over(order))
    typical = x.where("gap > 0").groupBy(*group).agg(upper_median(F.collect_list("gap")).alias("_typical"))
    x = x.join(typical, group, "left")
    starts = F.coalesce(F.col("gap") > F.greatest(F.lit(least), factor * F.coalesce("_typical", F.lit(0.0))), F.lit(True))
    starts = starts if cut is None else starts | F.coalesce(cut, F.lit(False))
    return x.withColumn("block", F.sum(starts.cast("int")).over(order)).drop("_typical")


def densest_lane(df: DataFrame, group: list[str], x: str, need: int, width: float) -> DataFrame:
    """group, lane: the smallest value that has need - 1 more values within width behind it."""
    order = Window.partitionBy(*group).orderBy(x)
    ahead = F.lead(x, need - 1).over(order)
    return df.withColumn("_ahead", ahead).where(F.col("_ahead") - F.col(x) <= width).groupBy(*group).agg(F.min(x).alias("lane"))


def section_restarts(df: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """df with section: it grows where the number does not."""
    w = Window.partitionBy(*group).orderBy(*order)
    fell = F.coalesce((F.col(number) <= F.lag(number).over(w)).cast("int"), F.lit(0))
    return df.withColumn("_fell", fell).withColumn("section", F.lit(1) + F.sum("_fell").over(w)).drop("_fell")


def gap_before(y0: str, y1: str, over) -> Column:
    """Space between a line and the lowest one above it."""
    return F.greatest(F.lit(0.0), F.col(y0) - F.max(y1).over(over.rowsBetween(Window.unboundedPreceding, -1)))


def overlap_pairs(df: DataFrame, scope: list[str], ident: str, start: str, end: str, share: float = 0.5, width: float | None = None) -> DataFrame:
    """a, b (a < b): intervals of one scope that overlap more than share of the narrower.

    With a width, intervals meet by the bins they touch, and a pair counts in the first bin that both touch. Pairs are what the
    caller asks for: as many as overlap.
    """
    l = df.select(*scope, F.col(ident).alias("a"), F.col(start).alias("a0"), F.col(end).alias("a1"))
    r = df.select(*scope, F.col(ident).alias("b"), F.col(start).alias("b0"), F.col(end).alias("b1"))
    on = list(scope)
    if width is not None:
        l, r, on = l.withColumn("_bin", F.explode(bins(F.col("a0"), F.col("a1"), width))), r.withColumn("_bin", F.explode(bins(F.col("b0"), F.col("b1"), width))), [*scope, "_bin"]
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    x = l.join(r, on).where("a < b").where(shared > share * F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")))
    if width is not None:
        x = x.where(F.col("_bin") == F.floor(F.greatest("a0", "b0") / width).cast("long"))
    return x.select(*scope, "a", "b")


def drop_overlapping_extras(df: DataFrame, scope: list[str]) -> DataFrame:
    """Rows(id, seq, extra, ai_key, question, page, x0, x1, y0, y1) of a scope, extras out that repeat a row kept before them:
    boxes on one page that overlap more than half the narrower in x and 8 px in y, with one key, or without one the same question."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values(["extra", "seq", "id"]), []
        for row in pdf.itertuples():
            def repeats(k, row=row):
                wide = min(row.x1, k.x1) - max(row.x0, k.x0) > 0.5 * min(row.x1 - row.x0, k.x1 - k.x0)
                tall = min(row.y1, k.y1) - max(row.y0, k.y0) > 8
                same = row.ai_key == k.ai_key if pd.notna(row.ai_key) else "".join(str(row.question).split()) == "".join(str(k.question).split())
                return row.page == k.page and wide and tall and same and row.id != k.id

            if not (row.extra and any(map(repeats, kept))):
                kept.append(row)
        return pdf.loc[[k.Index for k in kept]]

    return df.groupBy(*scope).applyInPandas(run, df.schema)
