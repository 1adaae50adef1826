"""Host-level quality rules, in DataFrame operations only.

Each document gets rule counts inside its own row. Failures are summed by host; each host's failure rate is shrunk
towards all hosts' by a beta prior fitted to them (method of moments), and the verdict joins back to the documents.
A document is kept if it passes the base rules and its host's shrunk rate is at most BAD_HOST.

Repeated word windows are found by sorting a row's window hashes with their positions, n log n in its length.

Defined results: null and empty texts have no words and fail the base rules; null hosts are one host; repeated rows
each count; one host alone (or hosts that all agree) gives the weakest prior, PRIOR[1]; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill

MIN_WORDS = 50
#: A document's rule failures, beside too few words: these shares are exceeded.
REPEATED = 0.5
SYMBOLS = 0.1
DUP_LINES = 0.3
BAD_HOST = 0.5
#: Least and greatest strength of the prior, in documents.
PRIOR = (2.0, 1000.0)

WORD = r"[^\\x20\\x09-\\x0D]+"


def measured(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row of docs(doc_id, text, source)."""
    host = F.col("source") if host is None else host
    x = docs.select("doc_id", host.alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.select(
        "doc_id",
        "host",
        F.expr(f"regexp_extract_all(text, '{WORD}', 0)").alias("w"),
        F.expr(r"size(regexp_extract_all(text, '[#*$%&|<>]', 0))").alias("n_symbols"),
        F.expr(rf"filter(split(text, '\n', -1), l -> l rlike '{WORD}')").alias("lines"),
    )
    x = x.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))").alias("h"),
    )
    x = x.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), array(), sort_array(transform(h, (x, i) -> struct(x as h, i as i))))")).drop("h")
    x = x.withColumn("p", F.expr("sort_array(transform(filter(transform(s, (x, k) -> if(get(s, k - 1).h = x.h or get(s, k + 1).h = x.h, x.i, -1)), i -> i >= 0), i -> i))")).drop("s")
    repeat = F.expr("aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0, (a, x) -> a + x)")
    return x.select("doc_id", "host", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")), repeat.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * REPEATED * F.col("n_words"))


def rule_failed() -> Column:
    return base_failed() | (F.col("n_symbols") > SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > DUP_LINES * F.col("n_lines"))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), of measured rows."""
    hosts = spill(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(rule_failed().cast("long")).alias("failed")), "hosts")
    p = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.sum("failed") / F.sum("n"), F.var_pop(p)).first() or (None, None)
    m = 0.0 if m is None else m
    strength = min(PRIOR[1], max(PRIOR[0], m * (1 - m) / v - 1)) if v else PRIOR[0]
    return hosts.withColumn("rate", (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))


def judge(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """measured(docs) with base_failed, host_rate and kept."""
    rows = spill(measured(docs, host), "rules")
    rates = host_rates(rows).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"))
    return (
        rows.join(rates, F.col("host").eqNullSafe(F.col("of")), "left")
        .drop("of")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= BAD_HOST))
    )
