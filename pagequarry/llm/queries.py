"""The operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, license, pii, quality, rules, simhash, substring, tokencount, warc
from .common import table

#: Vocabulary files; callers of the operators give their own paths.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that contaminates it."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), by_window=True).drop("k1", "k2")


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS).drop("n_bytes")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    base = F.array_distinct("places.label")
    return license.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, "found")).alias("labels"),
        "score",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    listed = lambda s: f"array_join(transform({s}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.expr(listed(f"filter(spans, x -> x.kind in ({base}))")), 256).alias("base_sha256"),
        F.expr(listed("spans")).alias("spans"),
        F.expr("array_join(transform(spans, x -> cast(x.score as string)), ',')").alias("scores"),
    )


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), with_html=False).drop("url", "html")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_knn, op3_template_decontamination, op4_simhash_vptree, op5_bpe_round_trip, op6_license_scan, op7_token_counts, op8_pii_spans, op9_host_rules, op10_warc_zstd)}

_OP1 = r"""
with w as (select doc_id, row_number() over () as rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select rid, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35),
win as (select rid, i, md5(array_to_string(ws[i : i + 34], ' ')) as k from p),
dup as (select k from win group by k having count(*) > 1),
cov as (select rid, list(distinct i + j) as gone from win join dup using (k), (select unnest(range(35)) as j) group by rid),
kept as (select doc_id, len(ws) as n, case when gone is null then ws else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: not list_contains(gone, z[2])), lambda z: z[1]) end as k from w left join cov using (rid))
select doc_id, cast(n as bigint) as n_words, cast(n - len(k) as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""


def _op6_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in license.word_set(text))}], {license.need(len(license.word_set(text)))}, {license.SPREAD * license.n_words(text)})" for label, text in license.TEMPLATES)
    return f"""
with d as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{word}') as ws from d),
b as (select rid, doc_id, len(ws) as n, list_concat(
  list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'mit' and ws[i + 1] = 'license'), lambda i: {{'s': i - 1, 'l': 'mit'}}),
  list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'apache' and ws[i + 1] = 'license'), lambda i: {{'s': i - 1, 'l': 'apache'}}),
  list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license'), lambda i: {{'s': i - 1, 'l': 'gpl'}})) as pl from w),
tpl(label, words, need, span) as (values {templates}),
lines as (select rid, unnest(string_split(t, chr(10))) as line from w),
sets as (select rid, regexp_extract_all(line, '{word}') as l from lines),
cand as (select rid, label, words, need, span, l from sets, tpl where len(list_intersect(words, l)) >= need),
near as (select rid, label, need, len(words) as size, list_max(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_contains(words, l[i])), lambda i: len(list_intersect(words, l[i : i + span - 1])))) as shared from cand),
hit as (select rid, label, shared / size as share from near where shared >= need),
f as (select rid, list(distinct label) as found, max(share) as best from hit group by rid)
select doc_id, cast(n as bigint) as n_words, cast(len(pl) as bigint) as n_base,
  cast(list_min(list_transform(pl, lambda x: x.s)) as bigint) as first_word, cast(list_max(list_transform(pl, lambda x: x.s)) as bigint) as last_word,
  array_to_string(list_sort(list_distinct(list_transform(pl, lambda x: x.l))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(pl, lambda x: x.l), coalesce(found, [])))), ',') as labels,
  case when len(pl) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from b left join f using (rid)
"""


_OP9 = rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from g) where c > 1),
rep as (select rid, count(distinct i + j) as n from r, (values (0), (1), (2)) x(j) group by rid),
m as (select rid, doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, len(lines) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words from w left join rep using (rid)),
v as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m),
h as (select source, count(*) as n, count(*) filter (where base_failed or n_symbols > {rules.SYMBOLS} * n_words or n_dup_lines > {rules.DUP_LINES} * n_lines) as f from v group by source),
p as (select sum(f) / sum(n) as m, var_pop(f / n) as v from h),
s as (select m, case when v > 0 then least({rules.PRIOR[1]}, greatest({rules.PRIOR[0]}, m * (1 - m) / v - 1)) else {rules.PRIOR[0]} end as k from p),
rate as (select source, (f + m * k) / (n + k) as rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and rate <= {rules.BAD_HOST}) as kept
from v join rate on v.source is not distinct from rate.source
"""

_OP10 = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html) as n, sha1(html) as x, max(page_id) over (partition by html) as last from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from q
"""

SQL = {"op1_substring_dedup": _OP1, "op6_license_scan": _op6_sql(), "op9_host_rules": _OP9, "op10_warc_zstd": _OP10}
