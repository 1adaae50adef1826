"""Linking problems with solutions, and old items with new ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_by_key(problems: DataFrame, solutions: DataFrame, scope: list[str], full: list[str], short: list[str], problem_id: str = "problem_id", solution_id: str = "solution_id") -> DataFrame:
    """problem_id, solution_id, tier: each problem's candidate has the same full key (the last of repeated solutions), else the
    same short key where that is unique on both sides; a solution goes to the first problem (by id) that asks for it.

    Two equi-joins and windows; scope columns (a book) are part of every key. Inputs with an inferred column leave those rows out.
    """
    read = ~F.coalesce("inferred", F.lit(False)) if "inferred" in problems.columns else F.lit(True)
    keys, shorts = [*scope, *full], [*scope, *short]
    last = solutions.groupBy(*keys).agg(F.max(solution_id).alias("by_full"))
    lone = solutions.groupBy(*shorts).agg(F.max(solution_id).alias("by_short"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    alone = Window.partitionBy(*shorts)
    x = problems.select(problem_id, *dict.fromkeys(keys + shorts), read.alias("_read")).withColumn("_own", F.count("*").over(alone)).where("_read")
    x = x.join(last, keys, "left").join(lone, shorts, "left")
    candidate = F.coalesce("by_full", F.when(F.col("_own") == 1, F.col("by_short")))
    x = x.select(problem_id, candidate.alias(solution_id), F.when(F.col("by_full").isNotNull(), "full").otherwise("short").alias("tier")).where(F.col(solution_id).isNotNull())
    if "inferred" in solutions.columns:
        x = x.join(solutions.where(~F.coalesce("inferred", F.lit(False))).select(solution_id), solution_id, "left_semi")
    claim = Window.partitionBy(solution_id).orderBy(problem_id)
    return x.withColumn("_k", F.row_number().over(claim)).where("_k = 1").drop("_k")


def match_greedy(problems: DataFrame, solutions: DataFrame, scope: list[str], taken: DataFrame) -> DataFrame:
    """Second pass: problems(problem_id, seq, keys: wanted keys in order) of each scope in turn, those with a read number (has_number) first,
    take the first unclaimed solution(solution_id, key) among their keys (of repeated keys only the last solution counts). A row's second choice may be a later row's first, so each scope runs in order."""
    p = problems.join(taken.select("problem_id"), "problem_id", "left_anti").select(*scope, "problem_id", "seq", "has_number", "keys")
    last = solutions.groupBy(*scope, "key").agg(F.max("solution_id").alias("solution_id"))
    s = last.join(taken.select("solution_id"), "solution_id", "left_anti")
    s = s.select(*[F.col(c).alias(f"_s_{c}") for c in scope], "solution_id", "key")  # names of its own: both sides may stem from one table

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = dict(zip(right["key"], right["solution_id"]))
        out = []
        for row in left.sort_values(["has_number", "seq", "problem_id"], ascending=[False, True, True]).itertuples():
            for k in row.keys:
                if k in free:
                    out.append((row.problem_id, free.pop(k)))
                    break
        return pd.DataFrame(out, columns=["problem_id", "solution_id"])

    kind = dict(problems.dtypes)["problem_id"], dict(solutions.dtypes)["solution_id"]
    return p.groupBy(*scope).cogroup(s.groupBy(*[f"_s_{c}" for c in scope])).applyInPandas(pair, f"problem_id {kind[0]}, solution_id {kind[1]}").withColumn("solution_inferred", F.lit(True))


def match_spatial(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """old_id, new_id of boxes(id, page, x0, x1, y0, page_height) that overlap half the narrower in x and start close in y; each box once, nearest first.

    The candidates are an equi-join on scope and page with range conditions; the one-to-one choice runs by scope.
    """
    a = old.select(*scope, "page", F.col("id").alias("old_id"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0")])
    b = new.select(*scope, "page", F.col("id").alias("new_id"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0")], "page_height")
    shared = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    narrow = F.least(F.col("a_x1") - F.col("a_x0"), F.col("b_x1") - F.col("b_x0"))
    gap = F.abs(F.col("a_y0") - F.col("b_y0"))
    pairs = a.join(b, [*scope, "page"]).where((shared >= 0.5 * narrow) & (gap <= F.greatest(F.lit(16.0), 0.025 * F.col("page_height")))).select(*scope, "old_id", "new_id", gap.alias("distance"))
    return one_to_one(pairs, scope, "old_id", "new_id", "distance")


def one_to_one(pairs: DataFrame, scope: list[str], left: str, right: str, distance: str) -> DataFrame:
    """Greedy choice by scope: pairs by ascending distance, then ids; a pair counts if neither side is taken."""
    types = dict(pairs.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        for i, (l, r) in enumerate(zip((pdf := pdf.sort_values([distance, left, right]))[left], pdf[right])):
            if l not in used_l and r not in used_r:
                used_l.add(l)
                used_r.add(r)
                keep.append(i)
        return pdf.iloc[keep]

    kept = pairs.select(*scope, left, right, distance)
    return kept.groupBy(*scope).applyInPandas(choose, ", ".join(f"`{c}` {types[c]}" for c in kept.columns))


def match_leftover(old: DataFrame, new: DataFrame, scope: list[str], matched: DataFrame) -> DataFrame:
    """Items left after match_spatial, joined by key where that is read (not inferred) and unique on both sides."""
    side = lambda df, name: (
        df.where(~F.coalesce("inferred", F.lit(False)))
        .withColumn("_n", F.count("*").over(Window.partitionBy(*scope, "key")))
        .where("_n = 1")
        .select(*scope, "key", F.col("id").alias(name))
        .join(matched.select(name), name, "left_anti")
    )
    return side(old, "old_id").join(side(new, "new_id"), [*scope, "key"]).select(*scope, "old_id", "new_id")


def propagate_answers(problems: DataFrame, solutions: DataFrame) -> DataFrame:
    """problems with answer taken from the linked solution, but for manual and model answers; null where the link is inferred or missing."""
    s = solutions.select(F.col("id").alias("solution_id"), F.col("answer").alias("_sol"))
    own = F.coalesce("answer_manual", F.lit(False)) | F.coalesce("answer_llm", F.lit(False))
    verified = ~F.coalesce("solution_inferred", F.lit(False))
    return problems.join(s, "solution_id", "left").withColumn("answer", F.when(own, F.col("answer")).when(verified, F.col("_sol"))).drop("_sol")


def carry_over(new: DataFrame, old: DataFrame, matched: DataFrame, keep: list[str], stale: Column | None = None) -> DataFrame:
    """new(id) with the keep columns of the old item it matches, where that has them; stale flags model text whose regions changed."""
    o = matched.join(old.select(F.col("id").alias("old_id"), *[F.col(c).alias(f"_{c}") for c in keep]), "old_id").select(F.col("new_id").alias("id"), *[f"_{c}" for c in keep])
    x = new.join(o, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) if c in new.columns else F.col(f"_{c}") for c in keep})
    if stale is not None:
        x = x.withColumn("stale", stale)
    return x.drop(*[f"_{c}" for c in keep])


def accept_resegment(old_count: int, new_count: int, floor: int = 8, share: float = 0.25) -> bool:
    """False where a re-segmentation lost most of a book's items."""
    return not (old_count >= floor and new_count < share * old_count)


def contained(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", words: int = 3, short: int = 200) -> DataFrame:
    """Pairs of rows of texts and needles where the text contains the needle as it stands.

    Wherever a needle stands, the words inside it (all but its first and last) are whole words of the text: the first few of them are
    the key of an equi-join with each text's windows of as many words, and what meets is checked. Needles with fewer words inside, at
    most short of them, are sought in each text.
    """
    inside = F.expr(f"slice(_w, 2, {words})")
    n = needles.withColumn("_w", F.split(F.col(needle), r"\s+"))
    long = n.where(F.size("_w") >= words + 2).withColumn("_k", F.xxhash64(F.array_join(inside, " "))).drop("_w")
    t = texts.withColumn("_w", F.split(F.col(text), r"\s+"))
    windows = F.expr(f"if(size(_w) < {words}, array(), array_distinct(transform(sequence(1, size(_w) - {words - 1}), i -> xxhash64(array_join(slice(_w, i, {words}), ' ')))))")
    found = t.withColumn("_k", F.explode(windows)).drop("_w").join(long, "_k").drop("_k").where(F.contains(F.col(text), F.col(needle)))
    few = [r[0] for r in n.where(F.size("_w") < words + 2).select(needle).distinct().limit(short + 1).collect()]
    if len(few) > short:
        raise ValueError(f"more than {short} needles of under {words + 2} words")
    if not few:
        return found
    hits = F.explode(F.filter(F.array(*map(F.lit, few)), lambda x: F.contains(F.col(text), x))).alias(needle)
    return found.unionByName(texts.select("*", hits).join(F.broadcast(n.where(F.size("_w") < words + 2).drop("_w")), needle).select(found.columns))
