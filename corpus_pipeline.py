"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Every stage passes on all columns of docs as they are, whatever their names (a caller's columns are held in a struct meanwhile),
but for text and n_chars where personal data was replaced. Null ids are rows like others; repeated rows are judged each, and
one of them stays; very long texts count whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontam, nearcopies, pii, quality
from pagequarry.llm.common import discard, one_of_each, packed, scratch, spill, table, without
from pagequarry.llm.queries import RANKS

#: Some stages have no SQL: learned scores, XXH64 fingerprints and merges by rank.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. Texts without a word go: there is nothing in them to judge or to learn from."""
    scored = quality.score(packed(docs).select("doc_id", "text", "row"), table(spark, sf_dir, "labels"))
    return scored.where(r"quality_score >= 0.5 and text rlike '[^\\x20\\x09-\\x0D]'").select("row.*")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8), that of the smallest id (nulls last, then by a
    hash of the text); of rows that share id and text the first by the JSON of the whole row."""
    groups = spill(nearcopies.near_copies(docs).select("k1", "k2", "first"), "groups")
    rest = without(packed(docs), groups.where("not first"))
    several = spill(groups.where("first").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "several")
    return one_of_each(rest, several).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    found = spill(decontam.matches(docs, table(spark, sf_dir, "benchmark"), by_window=True).select("k1", "k2"), "leaks")
    return without(packed(docs), found).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text where it changed."""
    out = pii.redact(packed(docs).select("row", "text")).withColumn("n_chars", F.length("text").cast("long"))
    value = {"text": F.col("text")} | ({"n_chars": F.when(F.col("n_found") > 0, F.col("n_chars")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return out.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens of all documents; fails where ids don't decode to the text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), RANKS, check=True).drop("text")


STAGES = [("quality classifier", keep_quality), ("near duplicates", keep_first), ("decontamination", drop_leaks), ("personal data", redact), ("tokens", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as made:
            docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
