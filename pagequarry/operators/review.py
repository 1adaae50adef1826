"""Predicates and flags for reviewing a book: what is still to do, what looks wrong, and what can't be cut again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, clean, hangul_count, last_integer, subject_particle

#: What a model writes where it couldn't read, names of the kinds, circled digits.
UNREADABLE = "[미상]"
KINDS = {"problem": "문제집", "solution": "해설지"}
CIRCLES = "[①-⑳❶-❿]"


def needs_analysis(problems: Column, stale: Column, difficulty: Column) -> Column:
    """No model reply, one of other regions, or one without a difficulty."""
    return problems.isNull() | (F.size(problems) == 0) | F.coalesce(stale, F.lit(False)) | difficulty.isNull()


def unreadable(problem: Column, marker: str = UNREADABLE) -> Column:
    """The marker is in the passage, the question or a choice."""
    has = lambda c: F.coalesce(F.contains(c, F.lit(marker)), F.lit(False))
    return has(problem["passage"]) | has(problem["question"]) | F.coalesce(F.exists(problem["choices"], has), F.lit(False))


def review_flags(problems: Column, primary: Column, number: Column, stale: Column, marker: str = UNREADABLE) -> Column:
    """Array of several, unreadable, number, stale: what the model's reply says is wrong with an item; empty without a reply."""
    main = F.coalesce(F.get(problems, primary), F.get(problems, F.lit(0)))
    read = last_integer(main["problem_number"])
    flags = {"several": F.size(problems) > 1, "unreadable": unreadable(main, marker), "number": read.isNotNull() & ~read.eqNullSafe(number), "stale": F.coalesce(stale, F.lit(False))}
    said = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(problems), F.lit(0)) > 0, said).otherwise(F.array().cast("array<string>"))


def pending_kinds(pages: dict[str, Column], segmented: dict[str, Column], items: dict[str, Column], recorded: Column, status: Column) -> Column:
    """Kinds whose pages are stored but not yet cut into items. A book from before that was recorded counts as done once it is complete or stopped."""
    done = ~recorded & F.coalesce(status, F.lit("complete")).isin("complete", "stopped")
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    open_ = [F.when(some(pages[k]) & ~done & ~F.coalesce(segmented[k], F.lit(False)) & ~some(items[k]), F.lit(k)) for k in pages]
    return F.filter(F.array(*open_), lambda x: x.isNotNull())


def todo_notice(kinds: Column, tail: str) -> Column:
    """'kind·kind' with its topic particle, then tail; empty without kinds."""
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    names = F.array_join(F.transform(kinds, lambda k: F.try_element_at(named, k)), "·")
    return F.when(F.size(kinds) > 0, F.concat(subject_particle(names, "은", "는"), F.lit(tail))).otherwise("")


def pages_without_image(items: DataFrame, pages: DataFrame, scope: list[str]) -> DataFrame:
    """scope, id, pages (ascending): pages of an item's fragments that have no stored picture. Items that miss none aren't returned."""
    used = items.select(*scope, "id", F.explode(F.array_distinct(F.transform("fragments", lambda f: f["page"]))).alias("page"))
    have = pages.where(F.col("image").isNotNull()).select(*scope, "page")
    return used.join(have, [*scope, "page"], "left_anti").groupBy(*scope, "id").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def review_quality(items: DataFrame, pages: DataFrame, scope: list[str]) -> DataFrame:
    """scope, items, inferred, pages, weak_pages (without a number that was read)."""
    i = items.groupBy(*scope).agg(F.count("*").alias("items"), F.count_if("inferred").alias("inferred"))
    p = pages.groupBy(*scope).agg(F.count("*").alias("pages"), F.count_if(F.coalesce("lexical_candidates", F.lit(0)) <= 0).alias("weak_pages"))
    return i.join(p, scope, "full").na.fill(0, ["items", "inferred", "pages", "weak_pages"])


def asks_question(text: Column) -> Column:
    """A line that ends as a question or a request; a proviso in brackets, stops and closing brackets at its end don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[(（]{WS}*단{WS}*[,，].*$", ""), r"[\s.。,|)\]】]+$", "")
    return (bare.rlike("[?？]$") & ~bare.rlike(rf"까{WS}*[?？]$")) | bare.rlike(rf"(시{WS}*오|여{WS}*라)$")


def problem_blocks(lines: DataFrame, block: list[str], order: str, text: str = "text") -> DataFrame:
    """block, is_problem: some line has points, a box head or several circled digits, three different short lines open
    with one, or the last line of the stem asks a question. One aggregation: no block is gathered."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{WS}+|{WS}+$", "")
    x = lines.select(*block, F.col(order).alias("_k"), t.alias("_t")).where("_t <> ''")
    t = F.col("_t")
    circled = t.rlike(f"^{CIRCLES}")
    strong = t.rlike(rf"\[{WS}*[0-9]{WS}*점{WS}*\]|<{WS}*보{WS}*기{WS}*>") | t.rlike(f"{CIRCLES}.*{CIRCLES}")
    short = circled & (F.length(F.regexp_replace(t, WS, "")) <= 16)
    aside = circled | t.rlike(rf"^[(（]?{WS}*단{WS}*[,，]") | t.rlike(rf"^[(（]{WS}*[가나다라마]{WS}*[)）]|^[ㄱㄴㄷㄹㅁ]{WS}*[.．]")
    stem = ~aside & (asks_question(t) | (hangul_count(t) >= 3))
    x = x.select(*block, strong.alias("_strong"), F.when(short, F.substring(t, 1, 1)).alias("_choice"), F.when(stem, F.struct("_k", asks_question(t).alias("asks"))).alias("_stem"))
    # at most as many distinct openings as there are circled digits
    return x.groupBy(*block).agg((F.max("_strong") | (F.size(F.collect_set("_choice")) >= 3) | F.coalesce(F.max("_stem")["asks"], F.lit(False))).alias("is_problem"))


def schema_json(problems: Column) -> Column:
    """{"problems": [...]} with every key in its order; missing choices, texts and flags are empty, other missing values null."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    full = lambda p: F.struct(
        p["problem_number"].alias("problem_number"), p["passage"].alias("passage"), empty(p["question"]).alias("question"), F.coalesce(p["choices"], F.array().cast("array<string>")).alias("choices"),
        F.coalesce(p["has_figure_or_diagram"], F.lit(False)).alias("has_figure_or_diagram"), p["topic"].alias("topic"), p["difficulty_level"].alias("difficulty_level"), empty(p["difficulty_reasoning"]).alias("difficulty_reasoning"),
    )
    return F.to_json(F.struct(F.transform(problems, full).alias("problems")), {"ignoreNullFields": "false"})


def label_or_none(label: Column) -> Column:
    """A label to join on: null and empty are one."""
    return F.coalesce(clean(label), F.lit(""))
