"""Grades: composite of z-scores, ranked into a range; manual and model grades take precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_up, rank_share, weighted_mean, zscore
from ..functions.text import nonspace_len

#: Fixed values: (hardest, easiest) grade of each level.
LEVELS = {"auto": (1, 9), "concept": (4, 9), "basic": (3, 8), "advanced": (2, 6), "exam": (1, 7), "killer": (1, 3)}
#: Weights of the features.
WEIGHTS = {"sol": 0.35, "pts": 0.30, "pos": 0.20, "height": 0.15, "len": 0.10, "kw": 0.10}


def features(number: Column, section_max: Column, height: Column, page_height: Column, text: Column, keywords: Column, points: Column, sol_id: Column, sol_height: Column, sol_page_height: Column, sol_text: Column) -> dict[str, Column]:
    """What a problem's difficulty shows in: place in its section, size, length, keywords, points and its solution's size (null without one)."""
    tall = lambda h, page: F.log1p(10 * F.coalesce(h, F.lit(0)) / F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)))
    long = lambda t: F.log1p(F.coalesce(nonspace_len(t), F.lit(0)))
    return {
        "pos": F.when(section_max > 1, (number - 1) / (section_max - 1)).otherwise(0.5),
        "height": tall(height, page_height),
        "len": long(text),
        "kw": keywords.cast("double"),
        "pts": points.cast("double"),
        "sol": F.when(sol_id.isNotNull(), tall(sol_height, sol_page_height) + 0.3 * long(sol_text)),
    }


def composite_grade(df: DataFrame, scored: dict[str, float], group: list[str], ident: str, hard: int | Column = 1, easy: int | Column = 9, digits: int = 9) -> DataFrame:
    """df with heur_score and grade_heur: z-scores within group, weighted over those present, ranked without ties (ident last), spread over easy..hard."""
    part = Window.partitionBy(*group)
    z = {c: zscore(F.col(c).cast("double"), part) for c in scored}
    x = df.withColumns({f"_z_{c}": v for c, v in z.items()})
    x = x.withColumn("heur_score", F.round(weighted_mean([(F.col(f"_z_{c}"), w) for c, w in scored.items()]), digits))
    x = x.withColumn("_share", rank_share(part.orderBy("heur_score", ident), part))
    return x.withColumn("grade_heur", half_up(F.lit(easy) - F.col("_share") * (easy - hard)).cast("int")).drop("_share", *[f"_z_{c}" for c in scored])


def effective_grade(manual: Column, model: Column, rule: Column) -> Column:
    return F.coalesce(manual, model, rule)


def grade_source(manual: Column, model: Column, rule: Column, names: tuple[str, str, str, str] = ("수동", "AI", "규칙", "-")) -> Column:
    return F.when(manual.isNotNull(), names[0]).when(model.isNotNull(), names[1]).when(rule.isNotNull(), names[2]).otherwise(names[3])
