"""Orders of items, books and groups. Each ends with a key that no two rows share, so that it is one order whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import type_order

#: Locale that names are ordered by.
COLLATION = "ko"


def item_order(label: str = "label", section: str = "section", number: str = "number", ident: str = "id") -> list[Column]:
    """Items without a label first, then by label, section and number."""
    name = F.coalesce(F.col(label), F.lit(""))
    return [name != "", F.collate(name, COLLATION), F.col(section), F.col(number), F.col(ident)]


def book_order(created_at: str = "created_at", ident: str = "id") -> list[Column]:
    """Books as they were made; those without a time first."""
    return [F.col(created_at).asc_nulls_first(), F.col(ident)]


def placed(df: DataFrame, order: list[Column], scope: list[str] = (), name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in its scope. Without a scope all rows go through one task; give it one, or an order() alone."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(scope or [F.lit(0)])).orderBy(*order)))


def first_of(df: DataFrame, order: list[Column], count: int, scope: list[str] = ()) -> DataFrame:
    """The first count rows of each scope (a limit of the group as the ranks are made), or of the whole table (a top-k of each task)."""
    if not scope:
        return df.orderBy(*order).limit(count)
    return placed(df, order, list(scope), "_place").where(F.col("_place") <= count).drop("_place")


def group_ranks(df: DataFrame, group: str, by_book: DataFrame | None = None, labels: list[str] = ()) -> DataFrame:
    """group, rank: the groups that df's rows are shown in, in the order of books (by_book: id and created_at) or of types. A row for each group, not for each row."""
    groups = df.select(group).distinct()
    if by_book is not None:
        known = by_book.select(F.col("id").alias(group), "created_at")
        return placed(groups.join(known, group, "left"), book_order("created_at", group), name="rank").select(group, "rank")
    return placed(groups, type_order(group, list(labels)), name="rank").select(group, "rank")
