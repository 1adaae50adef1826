"""A book's steps over the tables: texts, links, grades and types of items, and the pool that exams are drawn from.

Books are dealt by their keys; only links that need the serial second pass run a book at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_answer, extract_points, item_key, keyword_count
from . import classify, geometry, grade, link
from .review import label_or_none

SLICE = ["book_id", "kind"]
#: Columns that an item keeps when its place is cut anew.
KEPT = ["grade_manual", "grade_llm", "difficulty_llm", "unit", "subject_llm", "llm_reason", "type_llm", "type_manual"]


def finalise(items: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """items(id, book_id, kind, fragments) with text (lines whose centre is in a fragment), page_height, and points of problems or answer of solutions."""
    part = items.select(*SLICE, "id", F.posexplode("fragments").alias("part", "f"))
    boxes = part.select(*SLICE, "id", "part", "f.page", "f.x0", "f.y0", "f.x1", "f.y1")
    text = geometry.text_in_boxes(lines, boxes, SLICE, "id")
    x = items.drop("text", "page_height", "points").withColumn("_page", F.get("fragments", F.lit(0))["page"])
    x = x.join(text, [*SLICE, "id"], "left").join(pages.select(*SLICE, F.col("page").alias("_page"), F.col("height").alias("page_height")), [*SLICE, "_page"], "left").drop("_page")
    x = x.withColumns({"text": F.coalesce("text", F.lit("")), "page_height": F.coalesce("page_height", F.lit(1))})
    own = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    return x.withColumns({"points": F.when(F.col("kind") == "problem", extract_points(F.col("text"))), "answer": F.when(F.col("kind") == "solution", extract_answer(F.col("text"))).otherwise(own)})


def relink(items: DataFrame) -> DataFrame:
    """items with solution_id, solution_inferred and answer of problems: read numbers first, then what is left in order; those
    links are inferred and bring no answer."""
    x = items.withColumn("label", label_or_none(F.col("label")))
    p, s = x.where("kind = 'problem'"), x.where("kind = 'solution'")
    number = ["label", "section", "number"]
    of = lambda df, name: df.select("book_id", *number, "inferred", F.col("id").alias(name))
    first = link.match_by_key(of(p, "problem_id"), of(s, "solution_id"), ["book_id"], number, ["label", "number"]).select("problem_id", "solution_id")
    key = lambda n: item_key(F.col("label"), F.col("section"), F.col(n))
    wanted = F.when(F.col("ocr_number").isNotNull(), F.array(key("ocr_number"), key("number"))).otherwise(F.array(key("number")))
    rest = link.match_greedy(
        p.select("book_id", F.col("id").alias("problem_id"), F.lit(0).alias("seq"), F.col("ocr_number").isNotNull().alias("has_number"), wanted.alias("keys")),
        s.select("book_id", F.col("id").alias("solution_id"), key("number").alias("key")),
        ["book_id"],
        first,
    )
    links = first.withColumn("solution_inferred", F.lit(False)).unionByName(rest).withColumnRenamed("problem_id", "id")
    linked = items.where("kind = 'problem'").drop("solution_id", "solution_inferred").join(links, "id", "left").withColumn("solution_inferred", F.coalesce("solution_inferred", F.lit(False)))
    done = link.propagate_answers(linked, items.where("kind = 'solution'").select("id", "answer"))
    return done.unionByName(items.where(~F.col("kind").eqNullSafe("problem")), allowMissingColumns=True)


def link_stats(items: DataFrame) -> DataFrame:
    """book_id, problems, solutions, matched, inferred_links."""
    problem, linked = F.col("kind") == "problem", F.col("solution_id").isNotNull()
    return items.groupBy("book_id").agg(
        F.count_if(problem).alias("problems"), F.count_if(F.col("kind") == "solution").alias("solutions"), F.count_if(problem & linked).alias("matched"), F.count_if(problem & linked & F.col("solution_inferred")).alias("inferred_links")
    )


def _with_solutions(items: DataFrame, **columns: str) -> DataFrame:
    """Problems with columns of the solution they are linked to."""
    s = items.where("kind = 'solution'").select(F.col("id").alias("solution_id"), F.col("id").alias("_sol"), *[F.col(c).alias(k) for k, c in columns.items()])
    return items.where("kind = 'problem'").join(s, "solution_id", "left")


def grade_books(items: DataFrame, books: DataFrame, keywords: list[str]) -> DataFrame:
    """Problems with heur_score and grade_heur, ranked within each book over the grades of its level (books.level; unknown ones as 'auto')."""
    x = _with_solutions(items, _sol_h="h", _sol_page="page_height", _sol_text="text")
    x = x.withColumn("_last", F.max("number").over(Window.partitionBy("book_id", "section")))
    c = F.col
    scored = grade.features(c("number"), c("_last"), c("h"), c("page_height"), c("text"), keyword_count(F.coalesce("text", F.lit("")), keywords), c("points"), c("_sol"), c("_sol_h"), c("_sol_page"), c("_sol_text"))
    x = x.withColumns({f"_f_{k}": v for k, v in scored.items()})
    bound = lambda k: F.coalesce(*[F.when(c("_level") == name, r[k]) for name, r in grade.LEVELS.items()], F.lit(grade.LEVELS["auto"][k]))
    x = x.join(books.select(c("id").alias("book_id"), c("level").alias("_level")), "book_id", "left").withColumns({"_hard": bound(0), "_easy": bound(1)})
    x = grade.composite_grade(x, {f"_f_{k}": w for k, w in grade.WEIGHTS.items()}, ["book_id"], "id", c("_hard"), c("_easy"))
    return x.select(*dict.fromkeys([*items.columns, "heur_score", "grade_heur"]))


def classify_items(items: DataFrame, rules: list[classify.Rule], unclassified: str = classify.UNCLASSIFIED) -> DataFrame:
    """Problems with auto_type, type and type_source: rules on problem and solution, smoothed within a section, under what models and people said."""
    x = classify.score(_with_solutions(items, _sol_text="text"), rules, "text", "_sol_text")
    x = x.withColumn("_section", F.coalesce("section", F.lit(1)))
    x = classify.smooth(x, ["book_id", "_section"], ["number", "id"]).withColumnRenamed("type_source", "_from").withColumn("auto_type", F.col("type"))
    value, source = classify.effective_type(F.col("type_manual"), F.col("type_llm"), F.col("type"), unclassified)
    x = x.withColumns({"type": value, "type_source": F.when(source == "auto", F.col("_from")).otherwise(source)})
    return x.select(*dict.fromkeys([*items.columns, "auto_type", "auto_score", "type", "type_source"]))


def load_pool(problems: DataFrame, books: DataFrame, unknown: str = "(미정)") -> DataFrame:
    """Problems of books that exist, with subject: the model's, else the book's, else unknown."""
    b = books.select(F.col("id").alias("book_id"), F.col("subject").alias("_book"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return problems.join(b, "book_id").withColumn("subject", F.coalesce(some("subject_llm"), some("_book"), F.lit(unknown))).drop("_book")


def resegment(old: DataFrame, new: DataFrame, floor: int = 8, share: float = 0.25) -> DataFrame:
    """The items to store after cutting slices anew: new ones with what was said of the old ones in their places; where a slice of
    at least floor items would fall under share of them, its old items. A model's text is stale where the regions differ."""
    lead = lambda c: F.coalesce(F.try_element_at(F.filter(c, lambda f: ~F.coalesce(f["cont"], F.lit(False))), F.lit(1)), F.get(c, F.lit(0)))
    box = lambda df: df.withColumn("_f", lead(F.col("fragments"))).where("_f is not null").select(*SLICE, "id", "_f.page", "_f.x0", "_f.x1", "_f.y0", F.coalesce("page_height", F.lit(1200)).alias("page_height"))
    keyed = lambda df: df.select(*SLICE, "id", "inferred", item_key(label_or_none(F.col("label")), F.col("section"), F.col("number")).alias("key"))
    placed = link.match_spatial(box(old), box(new), SLICE).select(*SLICE, "old_id", "new_id")
    matched = placed.unionByName(link.match_leftover(keyed(old), keyed(new), SLICE, placed))
    was = old.select(F.col("id").alias("old_id"), F.col("fragments").alias("_fragments"), F.struct(*[c for c in old.columns]).alias("_old")).join(matched.select("old_id", "new_id"), "old_id").drop("old_id").withColumnRenamed("new_id", "id")
    x = new.join(was, "id", "left")
    prev: dict[str, Column] = {c: F.col("_old")[c] for c in old.columns}
    own = F.coalesce(prev["answer_manual"], F.lit(False)) | F.coalesce(prev["answer_llm"], F.lit(False))
    manual = F.coalesce(prev["number_manual"], F.lit(False))
    moved = ~F.coalesce(geometry.same_regions(F.col("_fragments"), F.col("fragments")), F.lit(False))
    take = lambda when, *cs: {c: F.when(when, prev[c]).otherwise(F.col(c)) for c in cs}
    x = x.withColumns(
        {c: F.coalesce(prev[c], F.col(c)) for c in KEPT}
        | {"ai_stale": F.when(prev["ai_problems"].isNotNull(), F.coalesce(prev["ai_stale"], F.lit(False)) | moved).otherwise(F.col("ai_stale")), "ai_problems": F.coalesce(prev["ai_problems"], F.col("ai_problems"))}
        | take(own, "answer", "answer_manual", "answer_llm")
        | take(manual, "label", "section", "number", "number_manual")
        | {"inferred": F.when(manual, False).otherwise(F.col("inferred")), "ocr_number": F.when(~manual, F.col("ocr_number"))}
    ).drop("_old", "_fragments")
    count = lambda df, name: df.groupBy(*SLICE).agg(F.count("*").alias(name))
    lost = count(old, "_o").join(count(new, "_n"), SLICE, "left").where((F.col("_o") >= floor) & (F.coalesce("_n", F.lit(0)) < share * F.col("_o"))).select(*SLICE)
    return x.join(lost, SLICE, "left_anti").unionByName(old.join(lost, SLICE, "left_semi"), allowMissingColumns=True)
