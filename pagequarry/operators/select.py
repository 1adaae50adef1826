"""Pool filters and seeded, quota-bound selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_up

#: Shares of easier, target and harder items.
MIXES = {"balanced": (0.2, 0.6, 0.2), "focus": (0.1, 0.8, 0.1), "push": (0.1, 0.5, 0.4), "review": (0.4, 0.5, 0.1)}


def filter_pool(pool: DataFrame, grade: str = "grade", image: str | None = None, solution: str | None = None, include: dict[str, list] | None = None, exclude: dict[str, list] | None = None) -> DataFrame:
    """Graded rows (with an image and a solution, if named); an empty include or exclude list is no filter."""
    where = F.col(grade).isNotNull()
    for c in filter(None, (image, solution)):
        where &= F.col(c).isNotNull()
    for c, values in (include or {}).items():
        if values:
            where &= F.col(c).isin(values)
    for c, values in (exclude or {}).items():
        if values:
            where &= ~F.coalesce(F.col(c).isin(values), F.lit(False))
    return pool.where(where)


def seeded(ident: Column, seed: int) -> Column:
    """A uniform order that a seed fixes, whatever the partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def grade_distance(grade: Column, target: int, band: Column | None = None) -> Column:
    """Distance to the target; a band of one around coarse grades is free."""
    d = F.abs(grade - target)
    return d if band is None else F.greatest(F.lit(0), d - F.when(band, F.lit(1)).otherwise(F.lit(0)))


def quotas(count: int, target: int, mix: tuple[float, float, float]) -> tuple[int, int, int]:
    """Easier, target, harder: rounded shares; nothing is harder than grade 1 or easier than 9; the target takes the rest."""
    up = lambda x: int(x + 0.5)
    easier = 0 if target >= 9 else up(count * mix[0])
    harder = 0 if target <= 1 else up(count * mix[2])
    return easier, max(0, count - easier - harder), harder


def select_quota(pool: DataFrame, ident: str, target: int, count: int, mix: tuple[float, float, float], seed: int, grade: str = "grade", band: str | None = None, order: list[str] = ()) -> DataFrame:
    """Up to count rows: each bucket's quota in seeded order (within two grades of the target), shortfalls filled by distance; easy ones
    first, then by the columns of order.

    Ranks in the three buckets near the target are cut at the largest quota as they are made, so a task keeps that many rows of each;
    what fills up comes from a top-k over all rows.
    """
    d = grade_distance(F.col(grade), target, F.col(band) if band else None)
    bucket = F.when(d == 0, "target").when((d <= 2) & (F.col(grade) < target), "harder").when(d <= 2, "easier").otherwise("far")
    easier, mid, harder = quotas(count, target, mix)
    x = pool.withColumns({"_d": d, "_b": bucket, "_s": seeded(F.col(ident), seed)})
    ranked = x.where("_b <> 'far'").withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_s", ident))).where(F.col("_k") <= max(easier, mid, harder, 1))
    quota = F.when(F.col("_b") == "easier", easier).when(F.col("_b") == "target", mid).otherwise(harder)
    picks = ranked.where(F.col("_k") <= quota).drop("_k").withColumn("chosen_by", F.col("_b"))
    # the nearest rows overall: at most count of them are picked already, so twice as many hold all that may fill up
    near = x.orderBy("_d", "_s", ident).limit(2 * count)
    fill = near.join(F.broadcast(picks.select(ident)), ident, "left_anti").withColumn("chosen_by", F.lit("fill"))
    both = picks.unionByName(fill).orderBy((F.col("chosen_by") == "fill"), "_d", "_s", ident).limit(count)
    return both.drop("_d", "_b", "_s").orderBy(F.col(grade).desc(), *order, ident)


def selection_report(pool: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """available, chosen, shortage."""
    a = pool.agg(F.count("*").alias("available"))
    b = chosen.agg(F.count("*").alias("chosen"))
    return a.join(F.broadcast(b)).withColumn("shortage", F.greatest(F.lit(0), F.lit(count) - F.col("chosen")))


def replace_one(pool: DataFrame, used: DataFrame, ident: str, target: int, seed: int, grade: str = "grade") -> DataFrame:
    """The unused row nearest to the target, ties in seeded order."""
    return pool.join(used.select(ident), ident, "left_anti").orderBy(grade_distance(F.col(grade), target), seeded(F.col(ident), seed), ident).limit(1)


def rebind(chosen: DataFrame, pool: DataFrame, ident: str) -> DataFrame:
    """Chosen rows that the pool still has; valid if none is lost."""
    return pool.join(chosen.select(ident).distinct(), ident, "left_semi")


def quota_of(count: int, share: Column) -> Column:
    return half_up(F.lit(count) * share)
