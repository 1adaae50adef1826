"""Histograms, facets, library and quality summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade_histogram(df: DataFrame, grade: str = "grade", low: int = 1, high: int = 9) -> DataFrame:
    """grade, n, bar (share of the tallest) for every grade, and grade null for ungraded rows. One small aggregate, padded with zeros."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(grade).cast("int").alias("grade")).agg(F.count("*").alias("n"))
    every = spark.range(low, high + 1).select(F.col("id").cast("int").alias("grade")).unionByName(spark.range(1).select(F.lit(None).cast("int").alias("grade")))
    x = every.alias("e").join(F.broadcast(counts).alias("c"), F.col("e.grade").eqNullSafe(F.col("c.grade")), "left").select("e.grade", F.coalesce("n", F.lit(0)).alias("n"))
    top = F.max(F.when(F.col("grade").isNotNull(), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return x.withColumn("bar", F.round(F.col("n") / F.greatest(F.lit(1), top), 6))


def facet_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts in total, by outer and by outer and inner, in one pass; level is 3, 1, 0."""
    return df.groupingSets([[], [F.col(outer)], [F.col(outer), F.col(inner)]], F.col(outer), F.col(inner)).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n of each column by itself, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_p")
    return df.select(pairs).groupBy("_p.facet", "_p.value").agg(F.count("*").alias("n"))


def type_summary(df: DataFrame, label: str, group: list[str] | None = None, unclassified: str | None = None, sep: str = ", ") -> DataFrame:
    """One line 'type count, …' by group: unclassified last, larger counts first, then by name."""
    group = group or []
    c = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    last = (F.col(label) == unclassified) if unclassified is not None else F.lit(False)
    entry = F.struct(F.coalesce(last, F.lit(True)).alias("a"), (-F.col("n")).alias("b"), F.col(label).alias("c"), F.concat(F.col(label), F.lit(" "), F.col("n").cast("string")).alias("d"))
    return c.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["d"]), sep).alias("summary"))


def top_by(df: DataFrame, group: list[str], value: str, k: int, last: str | None = None) -> DataFrame:
    """group, top: the k most frequent values as 'value count', ordered."""
    c = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(*([F.col(value).eqNullSafe(last)] if last is not None else []), F.col("n").desc(), value)
    kept = c.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat(F.col(value), F.lit(" "), F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), ", ")
    return kept.groupBy(*group).agg(joined.alias("top"))


def count_where(df: DataFrame, group: list[str], **conditions: Column) -> DataFrame:
    """Rows of each group, and how many meet each condition."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def with_empty(groups: DataFrame, counts: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Every group's counts, zero where it has none."""
    return groups.select(*key).distinct().join(counts, key, "left").na.fill(0, list(columns))


def dominant(df: DataFrame, group: list[str], value: str, preferred) -> DataFrame:
    """The most frequent value of each group; the preferred one on a tie."""
    c = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return c.groupBy(*group).agg(F.max_by(value, F.struct("n", F.col(value).eqNullSafe(preferred), value)).alias(value))


def kind_counts(ids: DataFrame, ident: str = "id") -> DataFrame:
    """Rows by the first letter of their ids."""
    return ids.groupBy(F.substring(F.col(ident), 1, 1).alias("kind")).agg(F.count("*").alias("n"))
