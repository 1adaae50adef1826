"""Layout plan of a printed selection: where each block of an exam stands, and its answer-key rows.

Blocks come from projections over the entries; only the flow itself, where each block depends on the one before, runs in
order, one exam at a time (an exam is a selection of bounded size).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import MM_PER_PT, fit

#: Fixed values, in mm: page, margins, space between columns, between blocks and under a rule.
PAGE_W, PAGE_H, MARGIN, GUTTER, FOOT, SPACE, RULE = 210.0, 297.0, 14.0, 8.0, 6.0, 1.5, 4.0
#: A label's height in mm by its kind, a fifth of its type size.
LABELS = {"header": 5.2, "solution_title": 4.8, "no_solution": 4.4, "chapter": 8.0, "key_row": 5.2}
TITLE, SUBTITLE, UNDERLINE = 12.0, 8.0, 4.0
BOTTOM = PAGE_H - MARGIN - FOOT

PLAN = "block int, kind string, entry int, page int, col int, x double, y double, w double, h double"


def column_width(columns: int) -> float:
    return (PAGE_W - 2 * MARGIN - (columns - 1) * GUTTER) / columns


def picture_size(w: Column, h: Column, scale: Column, columns: int, zoom: float = 1.0) -> Column:
    """Struct(width, height) in mm of a picture of w by h pixels, fitted into a column; scale defaults to 2."""
    unit = MM_PER_PT * zoom / F.when(scale > 0, scale).otherwise(2.0)
    k = unit * fit(w * unit, h * unit, column_width(columns), BOTTOM - MARGIN)
    return F.when((w > 0) & (h > 0), F.struct((w * k).alias("width"), (h * k).alias("height")))


def answer_key(entries: DataFrame, scope: list[str], columns: int = 1) -> DataFrame:
    """scope, row, text: answers in rows of five (three with two columns), "-" where there is none; only exams with some answer."""
    per_row = 3 if columns == 2 else 5
    x = entries.select(*scope, "entry", F.concat_ws(". ", (F.col("entry") + 1).cast("string"), F.coalesce("answer", F.lit("-"))).alias("cell"), F.col("answer").isNotNull().alias("some"))
    rows = x.groupBy(*scope, F.floor(F.col("entry") / per_row).cast("int").alias("row")).agg(F.array_sort(F.collect_list(F.struct("entry", "cell"))).alias("cells"))
    answered = x.where("some").select(*scope).distinct()
    return rows.join(answered, scope, "left_semi").select(*scope, "row", F.array_join("cells.cell", "      ").alias("text"))


def blocks(entries: DataFrame, scope: list[str], columns: int = 1, mode: str = "pair", zoom: float = 1.0, key: bool = True) -> DataFrame:
    """Blocks of entries(scope, entry from 0, w, h, scale, solution_w, solution_h, solution_scale, answer), in order.

    part is what stays in one column if it can, unit what does so before its parts are tried; fresh opens a page, and a
    rule follows the last block of a unit. mode pair puts each solution behind its problem, separate all behind all.
    """
    solo = mode == "separate"
    label = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(column_width(columns)).alias("w"), F.lit(LABELS[kind]).alias("h"))
    block = lambda kind, size: F.struct(F.lit(kind).alias("kind"), size["width"].alias("w"), size["height"].alias("h"))
    own = picture_size(F.col("w"), F.col("h"), F.col("scale"), columns, zoom)
    sol = picture_size(F.col("solution_w"), F.col("solution_h"), F.col("solution_scale"), columns, zoom)
    problem = F.array(label("header"), F.when(own.isNotNull(), block("problem", own)))
    solution = F.array(label("solution_title"), F.when(sol.isNotNull(), block("solution", sol)).otherwise(label("no_solution")))

    def rows(df: DataFrame, chapter: int, unit: Column, part: int, made: Column, fresh: Column = F.lit(False), ruled: bool = True) -> DataFrame:
        return df.select(*scope, F.lit(chapter).alias("chapter"), "entry", unit.alias("unit"), F.lit(part).alias("part"), fresh.alias("fresh"), F.lit(ruled).alias("ruled"), F.posexplode(F.filter(made, lambda b: b.isNotNull())).alias("k", "b"))

    one = entries.select(*scope, F.lit(None).cast("int").alias("entry")).distinct()
    out = rows(entries, 0, F.col("entry"), 0, problem).unionByName(rows(entries, 2 if solo else 0, F.col("entry"), 1, solution))
    if solo:
        out = out.unionByName(rows(one, 1, F.lit(0), 0, F.array(label("chapter")), F.lit(True), False))
    if key:
        lines = answer_key(entries, scope, columns)
        out = out.unionByName(rows(lines.select(*scope).distinct().withColumn("entry", F.lit(None).cast("int")), 3, F.lit(0), 0, F.array(label("chapter")), F.lit(True), False))
        out = out.unionByName(rows(lines.withColumn("entry", F.lit(None).cast("int")), 4, F.col("row"), 0, F.array(label("key_row")), ruled=False))
    return out.select(*scope, "chapter", "unit", "part", "k", "entry", "fresh", "ruled", "b.kind", "b.w", "b.h")


@dataclass
class Flow:
    """A pen that goes down columns and over pages."""

    columns: int
    top: float
    page: int = 1
    col: int = 0

    def __post_init__(self):
        self.y = self.top

    def turn(self) -> None:
        self.page, self.col, self.top, self.y = self.page + 1, 0, MARGIN, MARGIN

    def step(self) -> None:
        if self.col + 1 < self.columns:
            self.col, self.y = self.col + 1, self.top
        else:
            self.turn()

    def keep(self, height: float) -> None:
        """Go on where so much fits in one piece, if an empty column could hold it."""
        if self.top < self.y and self.y + height > BOTTOM and height <= BOTTOM - self.top:
            self.step()

    def put(self, w: float, h: float) -> tuple:
        """Place a block; one that is taller than what a column's top leaves is scaled down."""
        if self.y + h > BOTTOM and self.y > self.top:
            self.step()
        k = 1.0 if self.y + h <= BOTTOM else max(0.1, (BOTTOM - self.y) / h)
        at = (self.page, self.col, MARGIN + self.col * (column_width(self.columns) + GUTTER), self.y, w * k, h * k)
        self.y += h * k + SPACE
        return at

    def rule(self) -> None:
        if self.y + RULE <= BOTTOM:
            self.y += RULE


def layout_plan(entries: DataFrame, scope: list[str], columns: int = 1, mode: str = "pair", zoom: float = 1.0, key: bool = True, subtitle: bool = False) -> DataFrame:
    """scope, block (number in order), kind, entry, page, col, x, y, w, h (mm) of every block of each exam."""
    columns = 2 if columns == 2 else 1
    start = MARGIN + TITLE + SUBTITLE * subtitle + UNDERLINE

    def run(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flow, out = Flow(columns, start), []
        rows = pdf.sort_values(["chapter", "unit", "part", "k"]).itertuples()
        for _, same_unit in groupby(rows, key=lambda b: (b.chapter, b.unit)):
            unit = list(same_unit)
            if unit[0].fresh:
                flow.turn()
            flow.keep(sum(b.h + SPACE for b in unit))
            for _, same_part in groupby(unit, key=lambda b: b.part):
                part = list(same_part)
                flow.keep(sum(b.h + SPACE for b in part))
                for b in part:
                    out.append((*ids, len(out), b.kind, None if pd.isna(b.entry) else int(b.entry), *flow.put(b.w, b.h)))
            if unit[0].ruled:
                flow.rule()
        return pd.DataFrame(out, columns=[*scope, *(c.split()[0] for c in PLAN.split(", "))]).astype({"entry": "Int32"})

    made = blocks(entries, scope, columns, mode, zoom, key)
    kinds = dict(made.dtypes)
    return made.groupBy(*scope).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in scope) + ", " + PLAN)
