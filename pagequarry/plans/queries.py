"""Registered queries over the driver's tables: every operator family, with other columns and dictionaries, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stats import half_up, level_to_grade, picked, unique_in, upper_median
from ..operators import classify, facets, flow, geometry, grade, layout, link, review, select, store
from ..streaming.ingest import ingest_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Rules for the documents' languages: (order, label, kind, expression, weight).
LANGUAGE_RULES: list[classify.Rule] = [
    *[(0, "en", "token", w, x) for w, x in (("the", 1.0), ("and", 1.0), ("of", 0.5), ("to", 0.5), ("is", 0.5))],
    *[(1, "de", "token", w, x) for w, x in (("der", 1.0), ("und", 1.0), ("die", 0.5), ("von", 0.5), ("zu", 0.5))],
    *[(2, "fr", "token", w, x) for w, x in (("les", 1.0), ("pour", 1.0), ("du", 0.5), ("dans", 0.5), ("sur", 0.5))],
    *[(3, "es", "token", w, x) for w, x in (("los", 1.0), ("con", 1.0), ("las", 0.5), ("una", 0.5), ("para", 0.5))],
    (0, "en", "word", "ing", 0.25),
    (2, "fr", "word", "eau", 0.25),
    (3, "es", "word", "ment e", 0.25),
]

_PREPARED = r"translate(trim(regexp_replace(replace(translate(coalesce(text, ''), '′’`−–⟶➝', '''''''--→→'), '->', '→'), '\s+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hit_sql(kind: str, expr: str) -> str:
    if kind == "token":
        return f"regexp_matches(t, '(^| ){expr}( |$)')"
    if " " in expr:
        return f"contains(replace(t, ' ', ''), '{expr.replace(' ', '')}')"
    return f"(contains(t, '{expr}') or regexp_matches(t, '{tx.keyword_regex(expr)}'))"


def _scores_sql(boost: str | None = None) -> str:
    """CTE s: doc_id, lang, source, label, idx, score."""
    by: dict[tuple[int, str], list[str]] = {}
    for idx, label, kind, expr, w in LANGUAGE_RULES:
        by.setdefault((idx, label), []).append(f"case when {_hit_sql(kind, expr)} then {w} else 0.0 end")
    parts = []
    for (idx, label), terms in sorted(by.items()):
        total = "cast(" + " + ".join(terms) + " as double)"
        if boost:
            total = f"case when {boost} = '{label}' then {total} * {classify.BOOST} else {total} end"
        parts.append(f"select doc_id, lang, source, '{label}' as label, {idx} as idx, {total} as score from p")
    return f"p as (select doc_id, lang, source, {_PREPARED} as t from documents), s as ({' union all '.join(parts)}), r as (select *, row_number() over (partition by doc_id order by score desc, idx) as k, lead(score) over (partition by doc_id order by score desc, idx) as second from s)"


def _classified(spark: SparkSession, sf_dir: str, boosted: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    if boosted:
        docs = docs.withColumn("favoured", F.array("lang"))
    return classify.score(docs, LANGUAGE_RULES, favoured="favoured" if boosted else None)


_CLASSIFIED = "select doc_id, case when score >= 2 then label end as auto_type, round(score, 6) as auto_score, (score >= 3 and score - coalesce(second, 0) >= 1) as strong from r where k = 1"


@query(f"with {_scores_sql()} {_CLASSIFIED}")
def rule_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "auto_type", F.round("auto_score", 6).alias("auto_score"), "strong")


@query(f"with {_scores_sql('lang')} {_CLASSIFIED}")
def rule_classify_boosted(spark, sf_dir):
    return _classified(spark, sf_dir, True).select("doc_id", "auto_type", F.round("auto_score", 6).alias("auto_score"), "strong")


@query(
    f"with {_scores_sql()}, c as (select source, case when score >= 2 then label end as auto_type from r where k = 1) "
    "select source, auto_type, count(*) as n, cast(grouping(source, auto_type) as integer) as level from c group by grouping sets ((), (source), (source, auto_type))"
)
def classify_facets(spark, sf_dir):
    """The flagship: classify whole texts by weighted rules, then facet counts, in one scan and one shuffle of counts."""
    return facets.facet_counts(_classified(spark, sf_dir).select("source", "auto_type"), "source", "auto_type")


_TYPED = "with t as (select conv_id, turn, case when contains(text, 'the') then 'x' when contains(text, 'un') then 'y' end as auto_type, role = 'user' and (contains(text, 'the') or contains(text, 'un')) as strong from conversations)"


@query(
    _TYPED
    + """, w as (select conv_id, turn, auto_type, strong, case when strong then auto_type end as sure from t),
    n as (select *, last_value(sure ignore nulls) over (o rows between 3 preceding and 1 preceding) as a, first_value(sure ignore nulls) over (o rows between 1 following and 3 following) as b,
      last_value(sure ignore nulls) over (o rows between 2 preceding and 1 preceding) as a2, first_value(sure ignore nulls) over (o rows between 1 following and 2 following) as b2
      from w window o as (partition by conv_id order by turn, auto_type nulls first, strong)),
    f as (select *, not strong and a is not null and a = b as agree, auto_type is null and (a is null or b is null) and coalesce(a2, b2) is not null as lone from n)
    select conv_id, turn, case when agree then a when lone then coalesce(a2, b2) else auto_type end as type,
      case when agree and a is distinct from auto_type then 'neighbor' when lone then 'neighbor' when auto_type is not null then 'rule' end as type_source from f"""
)
def neighbor_smooth(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    has = lambda w: F.contains("text", F.lit(w))
    x = c.select("conv_id", "turn", F.when(has("the"), "x").when(has("un"), "y").alias("auto_type"), ((F.col("role") == "user") & (has("the") | has("un"))).alias("strong"))
    return classify.smooth(x, ["conv_id"], ["turn", "auto_type", "strong"]).select("conv_id", "turn", "type", "type_source")


@query(
    """select d.doc_id, coalesce(nullif(case when l.toxic = 1 then 'toxic' else '' end, ''), case when l.quality = 0 then 'low' end, d.lang, '미분류') as type,
    case when l.toxic = 1 then 'manual' when l.quality = 0 then 'ai' when d.lang is not null then 'auto' else 'none' end as type_source,
    cast(coalesce(l.toxic, l.quality, 5) as integer) as grade, case when l.toxic is not null then '수동' when l.quality is not null then 'AI' else '규칙' end as grade_source
    from documents d left join labels l on d.doc_id = l.doc_id"""
)
def effective_coalesce(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    value, source = classify.effective_type(F.when(F.col("toxic") == 1, "toxic").otherwise(""), F.when(F.col("quality") == 0, "low"), F.col("lang"))
    five = F.lit(5)
    return x.select("doc_id", value.alias("type"), source.alias("type_source"), grade.effective_grade(F.col("toxic"), F.col("quality"), five).cast("int").alias("grade"), grade.grade_source(F.col("toxic"), F.col("quality"), five).alias("grade_source"))


_GRADED = """with l as (select l_partkey, count(*) as n from lineitem group by 1),
p as (select p_partkey, p_brand, cast(p_size as double) as size, cast(p_retailprice as double) as price, cast(length(p_name) as double) as len, cast(n as double) as n from part left join l on p_partkey = l_partkey),
z as (select p_partkey, p_brand, {z} from p),
s as (select *, round(coalesce((coalesce(zs * 0.35, 0) + coalesce(zp * 0.3, 0) + coalesce(zl * 0.15, 0) + coalesce(zn * 0.2, 0)) / nullif(case when zs is null then 0 else 0.35 end + case when zp is null then 0 else 0.3 end + case when zl is null then 0 else 0.15 end + case when zn is null then 0 else 0.2 end, 0), 0), 9) as sc from z),
g as (select *, case when count(*) over (partition by p_brand) = 1 then 0.5 else (row_number() over (partition by p_brand order by sc, p_partkey) - 1) / (count(*) over (partition by p_brand) - 1) end as share from s),
graded as (select p_partkey, p_brand, round(sc, 6) as heur_score, cast(floor(9 - share * 8 + 0.5) as integer) as grade from g) """.format(
    z=", ".join(
        f"case when count({c}) over w < 2 then case when {c} is not null then 0.0 end else ({c} - avg({c}) over w) / coalesce(nullif(stddev_pop({c}) over w, 0), 1) end as {a}"
        for c, a in (("size", "zs"), ("price", "zp"), ("len", "zl"), ("n", "zn"))
    )
).replace("from p),\ns as", "from p window w as (partition by p_brand)),\ns as")


def _graded(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    p = p.select("p_partkey", "p_brand", "p_size", "p_retailprice", F.length("p_name").alias("len"), "n")
    return grade.composite_grade(p, {"p_size": 0.35, "p_retailprice": 0.3, "len": 0.15, "n": 0.2}, ["p_brand"], "p_partkey")


@query(_GRADED + "select p_partkey, heur_score, grade from graded")
def composite_grade(spark, sf_dir):
    return _graded(spark, sf_dir).select("p_partkey", F.round("heur_score", 6).alias("heur_score"), F.col("grade_heur").alias("grade"))


@query(
    _GRADED
    + """, c as (select grade, count(*) as n from graded group by 1), e as (select cast(unnest(range(1, 10)) as integer) as grade union all select null)
    select e.grade, coalesce(n, 0) as n, round(coalesce(n, 0) / greatest(1, max(case when e.grade is not null then coalesce(n, 0) end) over ()), 6) as bar from e left join c on e.grade is not distinct from c.grade"""
)
def grade_hist(spark, sf_dir):
    return facets.grade_histogram(_graded(spark, sf_dir).select(F.col("grade_heur").alias("grade")))


@query("select source, lang, count(*) as n, cast(grouping(source, lang) as integer) as level from documents group by grouping sets ((), (source), (source, lang))")
def facet_counts(spark, sf_dir):
    return facets.facet_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    """select 'lang' as facet, lang as value, count(*) as n from documents group by lang union all select 'source', source, count(*) from documents group by source"""
)
def filter_counts(spark, sf_dir):
    return facets.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


@query(
    """with c as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2),
    r as (select *, row_number() over (partition by o_orderstatus order by n desc, o_orderpriority) as k from c),
    t as (select o_orderstatus, string_agg(o_orderpriority || ' ' || n, ', ' order by k) as top from r where k <= 5 group by 1)
    select o.o_orderstatus, count(*) as n, count(*) filter (where o_totalprice > 200000) as large, count(*) filter (where o_custkey % 2 = 0) as linked, any_value(t.top) as top from orders o join t using (o_orderstatus) group by o.o_orderstatus"""
)
def library_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    counts = facets.count_where(o, ["o_orderstatus"], large=F.col("o_totalprice") > 200000, linked=F.col("o_custkey") % 2 == 0)
    return counts.join(facets.top_by(o, ["o_orderstatus"], "o_orderpriority", 5), "o_orderstatus")


@query("select string_agg(p_type || ' ' || n, ', ' order by (p_type = 'STANDARD'), n desc, p_type) as summary from (select p_type, count(*) as n from part group by 1)")
def type_summary(spark, sf_dir):
    return facets.type_summary(table(spark, sf_dir, "part"), "p_type", unclassified="STANDARD")


@query("select c_nationkey, c_mktsegment from (select c_nationkey, c_mktsegment, count(*) as n, row_number() over (partition by c_nationkey order by count(*) desc, (c_mktsegment = 'BUILDING') desc, c_mktsegment desc) as k from customer group by 1, 2) where k = 1")
def dominant_series(spark, sf_dir):
    return facets.dominant(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "BUILDING")


@query(
    """with l as (select *, lag(turn) over (partition by conv_id // 16 order by conv_id, turn, role, text) as p from conversations)
    select conv_id, turn, 1 + cast(sum(case when turn <= p then 1 else 0 end) over (partition by conv_id // 16 order by conv_id, turn, role, text rows unbounded preceding) as bigint) as section from l"""
)
def section_restart(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("shelf", F.expr("conv_id div 16"))
    return geometry.section_restarts(c, ["shelf"], ["conv_id", "turn", "role", "text"], "turn").select("conv_id", "turn", F.col("section").cast("long").alias("section"))


_BLOCKS = """with e as (select event_id, user_id, epoch_us(ts) / 1000000.0 as tm from events), g as (select *, tm - lag(tm) over (partition by user_id order by tm, event_id) as gap from e),
m as (select user_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] as typical from g where gap > 0 group by 1),
b as (select event_id, g.user_id, tm, gap, sum(cast(coalesce(gap > greatest(0.0, 1.8 * coalesce(typical, 0)), true) as integer)) over (partition by g.user_id order by tm, event_id) as block from g left join m on g.user_id = m.user_id) """


def _blocks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"))
    return geometry.adaptive_blocks(e, ["user_id"], "at", "event_id")


@query(_BLOCKS + "select event_id, user_id, cast(block as bigint) as block from b")
def adaptive_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("event_id", "user_id", F.col("block").cast("long").alias("block"))


@query(
    _BLOCKS
    + """, i as (select user_id, block, min(tm) as s, max(tm) as t from b group by 1, 2), o as (select user_id, epoch_us(ts) / 1000000.0 as tm from events where event_type = 'purchase')
    select i.user_id, cast(i.block as bigint) as block, count(*) as n from o join i on o.user_id = i.user_id and tm between s and t group by 1, 2"""
)
def box_join(spark, sf_dir):
    b = _blocks(spark, sf_dir).groupBy("user_id", "block").agg(F.min("at").alias("s"), F.max("at").alias("t"))
    o = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"))
    return geometry.point_in_interval(o, "at", b, "s", "t", ["user_id"], width=86400.0).groupBy("user_id", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"))


@query("with w as (select event_type, value, lead(value, 4) over (partition by event_type order by value) - value as d from events) select event_type, round(min(value), 6) as lane from w where d <= 0.05 group by 1")
def lane_cluster(spark, sf_dir):
    return geometry.densest_lane(table(spark, sf_dir, "events"), ["event_type"], "value", 5, 0.05).select("event_type", F.round("lane", 6).alias("lane"))


@query("select c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) = 1 as alone from customer")
def dup_key_unique(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", unique_in("c_nationkey", "c_mktsegment").alias("alone"))


@query(
    """with p as (select o_orderkey as problem_id, o_custkey % 7 as section, o_orderkey % 997 as number from orders), s as (select c_custkey as solution_id, c_nationkey % 7 as section, c_custkey as number from customer),
    f as (select section, number, max(solution_id) as by_full from s group by 1, 2), h as (select number, max(solution_id) as by_short from s group by 1 having count(*) = 1),
    x as (select problem_id, by_full, case when count(*) over (partition by p.number) = 1 then by_short end as by_short from p left join f using (section, number) left join h on p.number = h.number),
    c as (select problem_id, coalesce(by_full, by_short) as solution_id, case when by_full is not null then 'full' else 'short' end as tier from x where coalesce(by_full, by_short) is not null)
    select problem_id, solution_id, tier from (select *, row_number() over (partition by solution_id order by problem_id) as k from c) where k = 1"""
)
def two_tier_match(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_id"), (F.col("o_custkey") % 7).alias("section"), (F.col("o_orderkey") % 997).alias("number"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("solution_id"), (F.col("c_nationkey") % 7).cast("long").alias("section"), F.col("c_custkey").alias("number"))
    return link.match_by_key(p, s, [], ["section", "number"], ["number"])


@query()
def greedy_pair_match(spark, sf_dir):
    """Views and purchases of one user within an hour, one to one, nearest first: sequential by user, so without SQL."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("a"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("at").alias("b"))
    pairs = geometry.near_pairs(a, b, ["user_id"], "a", "b", 3600).select("user_id", "view_id", "purchase_id", F.abs(F.col("a") - F.col("b")).alias("distance"))
    return link.one_to_one(pairs, ["user_id"], "view_id", "purchase_id", "distance")


@query(
    """with i as (select o_custkey as customer, l_orderkey as id, min(l_shipdate) as s, max(l_shipdate) + interval 1 day as t from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
    j as (select customer, id, epoch(s) as s, epoch(t) as t from i)
    select l.id as a, r.id as b from j l join j r on l.customer = r.customer and l.id < r.id where least(l.t, r.t) - greatest(l.s, r.s) > 0.5 * least(l.t - l.s, r.t - r.s)"""
)
def overlap_pairs(spark, sf_dir):
    """Orders of a customer whose shipping times overlap."""
    at = F.col("l_shipdate").cast("timestamp").cast("double")
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(at).alias("s"), (F.max(at) + 86400).alias("t"))
    j = i.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), "id")
    return geometry.overlap_pairs(j, ["customer"], "id", "s", "t", width=30 * 86400.0).select("a", "b")


_RESTORE = """with live as (select doc_id, text, lang, source, n_chars from documents),
back as (select doc_id + 7 as doc_id, case when n_chars > 1000 then null else upper(lang) || text end as text, 'b-' || lang as lang, source, n_chars + 1 as n_chars from documents) """


@query(
    _RESTORE
    + """select doc_id, case when b.doc_id is null then l.text when l.doc_id is null then b.text when b.text is null then l.text else b.text end as text,
    case when b.doc_id is not null then b.lang else l.lang end as lang, case when b.doc_id is not null and l.source is null then b.source else l.source end as source,
    case when b.doc_id is not null then b.n_chars else l.n_chars end as n_chars, case when l.doc_id is null then 'backup' when b.doc_id is null then 'live' else 'merged' end as origin
    from live l full outer join back b using (doc_id)"""
)
def restore_merge(spark, sf_dir):
    live = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    back = live.select((F.col("doc_id") + 7).alias("doc_id"), F.when(~F.coalesce(F.col("n_chars") > 1000, F.lit(False)), F.concat(F.upper("lang"), "text")).alias("text"), F.concat(F.lit("b-"), "lang").alias("lang"), "source", (F.col("n_chars") + 1).alias("n_chars"))
    return store.merge_restored(live, back, "doc_id", image=["text"], bundle=["source"], marker="source")


@query(
    "with n as (select s_suppkey as id, s_name as name, s_acctbal as bal from supplier union all select -1 - n_nationkey, n_name, 0.0 from nation) "
    "select id, name, cast(bal as double) as bal from n union all select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select id from n)"
)
def upsert_rows(spark, sf_dir):
    """Suppliers and nations put over customers."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = new.unionByName(table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(0.0).alias("bal")))
    return store.upsert(old, new)


@query("select c_custkey from customer where c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def orphan_sweep(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return store.orphans(c, o, "c_custkey", F.col("c_acctbal"), 0.0000001).select("c_custkey")


_POOL = "select *, 1 + p_size % 9 as grade from part"


def _pool(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("grade", 1 + F.col("p_size") % 9)


@query(f"with p as ({_POOL}) select p_partkey, cast(grade as integer) as grade from p where p_brand not in ('Brand#11', 'Brand#12') and p_partkey in (select l_partkey from lineitem where l_quantity >= 45)")
def semi_rebind(spark, sf_dir):
    pool = select.filter_pool(_pool(spark, sf_dir), exclude={"p_brand": ["Brand#11", "Brand#12"]})
    chosen = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return select.rebind(chosen, pool, "p_partkey").select("p_partkey", F.col("grade").cast("int").alias("grade"))


@query(
    f"""with p as ({_POOL}), d as (select p_partkey, grade, abs(grade - 5) as d, md5('7:' || p_partkey) as s from p),
    b as (select *, case when d = 0 then 'target' when d <= 2 and grade < 5 then 'harder' when d <= 2 then 'easier' else 'far' end as b from d),
    k as (select *, row_number() over (partition by b order by s, p_partkey) <= case b when 'easier' then 10 when 'target' then 30 when 'harder' then 10 else 0 end as q from b)
    select p_partkey, cast(grade as integer) as grade, case when q then b else 'fill' end as chosen_by from k order by q desc, d, s, p_partkey limit 50"""
)
def quota_select(spark, sf_dir):
    chosen = select.select_quota(_pool(spark, sf_dir), "p_partkey", 5, 50, select.MIXES["balanced"], 7)
    return chosen.select("p_partkey", F.col("grade").cast("int").alias("grade"), "chosen_by")


@query(f"with p as ({_POOL}) select p_partkey, cast(grade as integer) as grade from p where p_partkey not in (select l_partkey from lineitem where l_quantity >= 40) order by abs(grade - 4), md5('11:' || p_partkey), p_partkey limit 1")
def replace_nearest(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return select.replace_one(_pool(spark, sf_dir), used, "p_partkey", 4, 11).select("p_partkey", F.col("grade").cast("int").alias("grade"))


@query(
    r"""select doc_id, cast(nullif(list_extract(regexp_extract_all(coalesce(text, ''), '(\d+)', 1), -1), '') as varchar) as last_number, nullif(regexp_extract(coalesce(text, ''), 'licensed? under (?:the )?([A-Z][A-Za-z -]*[A-Za-z])', 1), '') as license,
    cast(length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) as bigint) as n_print from documents"""
)
def text_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    return d.select(
        "doc_id",
        F.try_element_at(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).alias("last_number"),
        F.nullif(F.regexp_extract(t, "licensed? under (?:the )?([A-Z][A-Za-z -]*[A-Za-z])", 1), F.lit("")).alias("license"),
        tx.nonspace_len(F.col("text")).cast("long").alias("n_print"),
    )


#: How a line may begin, with {n} for a number: what it is read as (number, style, label, section).
_ANCHORS = (
    ("{n}. 다음 ", "n", "plain", None, None), ("{n}) 값을 ", "n", "paren", None, None), ("({n}) 구하시오 ", "n", "paren", None, None), ("[{n}] 일곱 ", "n", "plain", None, None), ("예제 {n} 함수 ", "n", "label", "예제", None),
    ("유제 3-{n} 함수 ", "n", "label", "유제", "3"), ("문제 {n} 함수 ", "n", "label", None, None), ("{n}: 값 ", "n", "plain", None, None), ("O{n}. 다음 ", "n", "plain", None, None), ("I. 다음 ", "1", "plain", None, None),
    ("{n} 미분 ", "n", "plain", None, None), ("연습 문제 {n} 함수 ", "n", "label", "연습문제", None), ("１２. 값 ", "12", "plain", None, None), ("⑳ 마지막 ", "20", "circled", None, None), ("1.5배로 ", None, None, None, None), ("  0{n}. 여백 ", "n", "plain", None, None),
)
_READ = lambda k: "case v " + " ".join(f"when {i} then {('null' if a[k] is None else a[k] if k in (1, 4) else repr(a[k]))}" for i, a in enumerate(_ANCHORS)) + " end"


@query(
    f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as k from documents),
    x as (select doc_id, k, line, (doc_id + k) % {len(_ANCHORS)} as v, 1 + (doc_id * 7 + k) % 899 as n from l)
    select doc_id, cast(k as integer) as k, cast({_READ(1)} as integer) as num, {_READ(2)} as style, {_READ(3)} as label, cast({_READ(4)} as integer) as section from x"""
)
def anchor_parse(spark, sf_dir):
    """Every line of the documents behind one of the ways that a numbered line begins, and how it is read."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "line"))
    kind, n = (F.col("doc_id") + F.col("k")) % len(_ANCHORS), (1 + (F.col("doc_id") * 7 + F.col("k")) % 899).cast("string")
    begin = F.replace(F.element_at(F.array(*[F.lit(a[0]) for a in _ANCHORS]), (kind + 1).cast("int")), F.lit("{n}"), n)
    a = tx.with_anchor(d.withColumn("line", F.concat(begin, F.col("line"))), "line", "a")
    return a.select("doc_id", "k", "a.num", "a.style", "a.label", "a.section")


@query(
    r"""with k as (select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k from events), l as (select event_id, case when k between 1 and 5 then k end as level from k)
    select event_id, level, cast(case when level is not null then 11 - 2 * level end as integer) as grade, cast(floor(coalesce(level, 0) * 0.5 + 0.5) as bigint) as half from l"""
)
def json_normalize(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    level = F.when(F.col("k").between(1, 5), F.col("k"))
    return k.select("event_id", level.alias("level"), level_to_grade(level).cast("int").alias("grade"), half_up(F.coalesce(level, F.lit(0)) * 0.5).cast("long").alias("half"))


@query(
    """with l as (select user_id, max(epoch_ms(ts)) as tm, max_by(event_type, (ts, event_id)) as kind from events group by 1), n as (select max(epoch_ms(ts)) as now from events)
    select user_id, case when kind = 'view' and now - tm < 300000 then 'processing' when kind = 'view' then 'interrupted' else kind end as state from l, n"""
)
def heartbeat_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    last = e.groupBy("user_id").agg(F.max("ms").alias("at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    now = e.agg(F.max("ms").alias("now")).first()["now"] or 0
    status = F.when(F.col("kind") == "view", "processing").otherwise(F.col("kind"))
    return last.select("user_id", ingest_state(status, F.col("at"), F.lit(now)).alias("state"))


_KEYWORDS = ["the", "und", "les", "los", "tion", "licen", "@", "||"]


@query(f"select doc_id, cast({' + '.join(f'''cast(contains(coalesce(text, ''), '{w}') as integer)''' for w in _KEYWORDS)} as bigint) as n from documents")
def keyword_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword_count(F.coalesce("text", F.lit("")), _KEYWORDS).cast("long").alias("n"))


@query("select doc_id, text, lang, source, n_chars from documents")
def backup_roundtrip(spark, sf_dir):
    """Documents written as a backup's items, in files of the shared folder, and read back."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("b").alias("book_id"), "doc_id", "text", "lang", "source", "n_chars")
    path = f"{store.work_dir(spark)}/backup-{uuid.uuid4().hex}"
    store.export_backup({"items": d}, path)
    rows, _ = store.import_backup(spark, path, {"items": "id string, book_id string, doc_id bigint, text string, lang string, source string, n_chars bigint"})
    return rows["items"].select("doc_id", "text", "lang", "source", "n_chars")


@query(
    r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text,
    nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title from pages"""
)
def html_text(spark, sf_dir):
    h = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(h, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"), F.nullif(F.regexp_extract(h, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


@query("select l_returnflag, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] as upper_median, list_sort(list(l_quantity))[(len(list(l_quantity)) - 1) // 4 + 1] as lower_quartile from lineitem group by 1")
def order_statistics(spark, sf_dir):
    return picked(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", upper_median=lambda n: F.floor(n / 2), lower_quartile=lambda n: F.floor((n - 1) / 4))


@query("with n as (select l_orderkey, l_linenumber, l_shipdate, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as k from lineitem) select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by k) as lines from n group by 1")
def reading_order(spark, sf_dir):
    """Ordered concatenation by group, as text is gathered from boxes."""
    entry = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(entry, lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query("select distinct lang, source from documents except select lang, source from documents where n_chars > 5000")
def set_except(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang", "source").distinct().exceptAll(d.where("n_chars > 5000").select("lang", "source").distinct())


@query("select lang from documents where n_chars < 100 intersect select lang from documents where n_chars > 5000")
def set_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("n_chars < 100").select("lang").intersect(d.where("n_chars > 5000").select("lang"))


def _exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as an exam, its order lines as entries."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    size = lambda n: (F.col("l_quantity") * n).cast("int")
    solved = F.col("l_returnflag") != "N"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("exam"), (F.row_number().over(order) - 1).alias("entry"), size(16).alias("w"), size(20).alias("h"), F.lit(2.0).alias("scale"),
        size(12).alias("solution_w"), F.when(solved, size(9)).alias("solution_h"), F.lit(2.0).alias("solution_scale"), F.when(solved, F.col("l_returnflag")).alias("answer"),
    )


@query(
    """
with e as (select l_suppkey as exam, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 as entry, case when l_returnflag <> 'N' then l_returnflag end as answer from lineitem),
s as (select *, bool_or(answer is not null) over (partition by exam) as answered from e)
select exam, cast(entry // 3 as int) as row, string_agg(cast(entry + 1 as varchar) || '. ' || coalesce(answer, '-'), '      ' order by entry) as text
from s where answered group by exam, entry // 3
"""
)
def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.answer_key(_exams(spark, sf_dir), ["exam"], columns=2)


@query()
def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_plan(_exams(spark, sf_dir), ["exam"], columns=2)


@query(
    """
with p as (select *, doc_id + case when doc_id % 3 = 0 then 1 else 0 end as number from documents)
select doc_id, array_to_string(list_filter([case when lang = 'de' then 'several' end, case when contains(coalesce(text, ''), '@') or contains(coalesce(source, ''), '@') then 'unreadable' end,
    case when doc_id <> number then 'number' end, case when n_chars > 5000 then 'stale' end], lambda x: x is not null), ',') as flags from p
"""
)
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as what a model read, and what is wrong with it."""
    d = table(spark, sf_dir, "documents")
    problem = F.struct(F.col("doc_id").cast("string").alias("problem_number"), F.lit(None).cast("string").alias("passage"), F.col("text").alias("question"), F.array("source").alias("choices"))
    found = F.when(F.col("lang") == "de", F.array(problem, problem)).otherwise(F.array(problem))
    number = (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("int")
    return d.select("doc_id", F.array_join(review.review_flags(found, F.lit(0), number, F.col("n_chars") > 5000, marker="@"), ",").alias("flags"))


@query(
    r"""
with x as (select conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from conversations),
y as (select *, regexp_replace(regexp_replace(t, '[(（]\s*단\s*[,，].*$', ''), '[\s.。,|)\]】]+$', '') as bare, regexp_matches(t, '^[①-⑳❶-❿]') as circled from x where t <> ''),
z as (select *, (regexp_matches(bare, '[?？]$') and not regexp_matches(bare, '까\s*[?？]$')) or regexp_matches(bare, '(시\s*오|여\s*라)$') as asks,
    circled or regexp_matches(t, '^[(（]?\s*단\s*[,，]') or regexp_matches(t, '^[(（]\s*[가나다라마]\s*[)）]|^[ㄱㄴㄷㄹㅁ]\s*[.．]') as aside, length(regexp_replace(t, '[^가-힣]', '', 'g')) >= 3 as worded from y)
select conv_id, bool_or(regexp_matches(t, '\[\s*[0-9]\s*점\s*\]|<\s*보\s*기\s*>') or regexp_matches(t, '[①-⑳❶-❿].*[①-⑳❶-❿]'))
    or count(distinct case when circled and length(regexp_replace(t, '\s', '', 'g')) <= 16 then t[1] end) >= 3
    or coalesce(max_by(asks, (turn, asks)) filter (not aside and (asks or worded)), false) as is_problem
from z group by 1
"""
)
def problem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose last stem asks a question."""
    return review.problem_blocks(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(
    """
select o_orderkey as id, coalesce(nullif(case when o_orderstatus = 'F' then '' when o_orderstatus = 'P' then o_orderpriority end, ''), nullif(c_mktsegment, ''), '(미정)') as subject
from orders join customer on o_custkey = c_custkey
"""
)
def pool_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as problems of their customers' books."""
    said = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    problems = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), said.alias("subject_llm"))
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("subject"))
    return flow.load_pool(problems, books).select("id", "subject")


@query(
    """
with u as (select distinct l_orderkey, l_partkey from lineitem), h as (select p_partkey from part where p_size > 10)
select l_orderkey as id, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) as pages from u where l_partkey not in (select p_partkey from h) group by 1
"""
)
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items over parts as pages, of which the small ones have no picture."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("page"))).alias("fragments"))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("image"))
    return review.pages_without_image(items, pages, []).select("id", F.array_join("pages", ",").alias("pages"))


@query()
def book_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as a book: kept ones are problems, returned ones solutions, linked in two passes."""
    x = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "problem").otherwise("solution")
    items = x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("book_id"), kind.alias("kind"), F.col("l_linestatus").alias("label"), F.col("l_linenumber").alias("section"),
        F.col("l_quantity").cast("int").alias("number"), (F.col("l_tax") > 0.06).alias("inferred"), F.when(F.col("l_tax") > 0.07, F.col("l_quantity").cast("int") + 1).alias("ocr_number"), F.col("l_returnflag").alias("answer"),
        F.lit(None).cast("string").alias("solution_id"), F.lit(False).alias("solution_inferred"), F.lit(False).alias("answer_manual"), F.lit(False).alias("answer_llm"),
    )
    return flow.relink(items).where("kind = 'problem'").select("id", "solution_id", "solution_inferred", "answer")
