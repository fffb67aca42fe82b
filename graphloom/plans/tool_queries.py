"""The checking tools over a typed graph of the driver's tables: one call an order, about its first two parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tools import Tools
from ..session import save
from .views import ANSWERS_SQL, answers, clinic, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _box(spark: SparkSession, d: str) -> Tools:
    """The clinic with an entry for every other herb, which is also called as the herb is, with a note."""
    nodes, edges = clinic(spark, d)
    key = F.col("p_partkey").cast("string")
    attrs = F.to_json(F.struct(F.when(F.col("p_size") % 3 == 0, "辛，大毒，有毒").otherwise("平").alias("nature_taste_meridian"), F.col("p_type").alias("part_used"), F.array(F.concat(F.lit("炙药"), key, F.lit("号"))).alias("common_aliases")))
    entries = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("entry:"), key).alias("id"), F.lit("PharmacoPoeiaEntry").alias("type"), F.concat(F.lit("典"), key, F.lit("号")).alias("name"), F.array().cast("array<string>").alias("source_docs"), F.lit(None).cast("struct<doc_id:string,sentence:string>").alias("first_mention"), attrs.alias("attrs"), (F.lit(3 * 10**12) + F.col("p_partkey")).cast("long").alias("ord"))
    listed = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.lit("REGISTERED_IN_PHARMACOPOEIA").alias("type"), F.concat(F.lit("part:"), key).alias("source"), F.concat(F.lit("entry:"), key).alias("target"), F.array().cast("array<string>").alias("source_docs"), F.array().cast("array<struct<sentence:string>>").alias("evidence"), F.col("p_partkey").cast("long").alias("ord"))
    return Tools(nodes.unionByName(entries), edges.unionByName(listed.withColumn("id", F.concat_ws("|", "source", "type", "target"))))


def _calls(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """call_id, items: the herbs of an order's first two options."""
    herb = lambda c: F.regexp_extract(F.col("options")[c], "^药[0-9]+号", 0)
    return save(answers(spark, d).select(F.col("case_id").alias("call_id"), F.filter(F.array(herb("A"), herb("B")), lambda x: x != "").alias("items"), *more), "calls")


def _shown(array: str, *fields: str) -> Column:
    """An array of structs as one text, sorted."""
    return F.array_join(F.array_sort(F.transform(array, lambda x: F.concat_ws("/", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]))), ";").alias(array)


_TWO = f"{ANSWERS_SQL}, it as (select k, '药' || a || '号' as item, a as p from ans union all select l.k, '药' || l.p[2] || '号', l.p[2] from lp l where len(l.p) > 1), ip as (select it.*, p_size from it join part on p_partkey = p)"


@query(f"""with {_TWO} select k as call_id, 'not_covered' as coverage, string_agg(item || '/' || case when p_size % 4 = 0 then '有毒' else '-' end, ';' order by item || '/' || case when p_size % 4 = 0 then '有毒' else '-' end) as findings from ip group by k""")
def tool_check_dose(spark: SparkSession, d: str) -> DataFrame:
    return _box(spark, d).check_dose(_calls(spark, d)).select("call_id", "coverage", _shown("findings", "item", "toxicity"))


@query(f"""with {_TWO}, h as (select distinct l_orderkey as f, l_partkey as p from lineitem),
x as (select a.k, a.item as a, b.item as b, a.p as pa, b.p as pb from it a join it b on a.k = b.k and a.item < b.item),
n as (select pa, pb, count(*) as n from (select distinct pa, pb from x) join h i on i.p = pa join h j on j.p = pb and j.f = i.f group by all)
select k as call_id, 'not_covered' as coverage, coalesce(string_agg(a || '/' || b || '/' || coalesce(n, 0) || '/not_covered', ';'), '') as pairs from lp left join x using (k) left join n using (pa, pb) group by k""")
def tool_check_combination(spark: SparkSession, d: str) -> DataFrame:
    return _box(spark, d).check_combination(_calls(spark, d)).select("call_id", "coverage", _shown("pairs", "a", "b", "n_co_occurrences", "verdict"))


@query(f"""with {_TWO}, h as (select distinct l_orderkey as f, l_partkey as p from lineitem), s as (select f, count(*) as n from h group by f),
o as (select a.f as x, b.f as y, count(*) as shared from h a join h b on a.p = b.p and b.f = a.f - 1 group by all),
r as (select x as k, case when '方' || x || '号' < '方' || y || '号' then '方' || x || '号/方' || y || '号' else '方' || y || '号/方' || x || '号' end || '/' || shared as overlap from o),
l as (select it.k, string_agg(item || '/方' || f || '号', ';' order by item || '/方' || f || '号') as loose from it join h on h.p = it.p and h.f in (it.k, it.k - 1) group by it.k)
select k as call_id, 'supported' as coverage, coalesce(overlap, '') as formula_overlap, coalesce(loose, '') as herb_in_formula from lp left join r using (k) left join l using (k)""")
def tool_check_duplicate(spark: SparkSession, d: str) -> DataFrame:
    c = _calls(spark, d)
    formula = lambda n: F.concat(F.lit("方"), F.col("call_id") - n, F.lit("号"))
    asked = c.select("call_id", F.concat("items", F.array(formula(0), formula(1))).alias("items"))
    return _box(spark, d).check_duplicate_medication(asked).select("call_id", "coverage", _shown("formula_overlap", "a", "b", "shared"), _shown("herb_in_formula", "herb", "formula"))


@query(f"""with {_TWO}, r as (select k, item || '/contraindicated/nation:' || p % 25 || '/' || (p % 25 = k % 25) as r from ip where p_size % 3 = 0)
select k as call_id, case when count(r.r) > 0 then 'supported' else 'empty' end as coverage, coalesce(string_agg(r.r, ';' order by r.r), '') as restrictions from lp left join r using (k) group by k""")
def tool_check_restricted(spark: SparkSession, d: str) -> DataFrame:
    cohort = F.concat(F.lit("人群"), F.col("case_id") % 25, F.lit("号")).alias("patient_context")
    return _box(spark, d).check_restricted_item(_calls(spark, d, cohort)).select("call_id", "coverage", _shown("restrictions", "item", "severity", "applies_to", "matches_context"))


@query(f"""with {_TWO}, m as (select herb, list_sort(list(distinct m)) as m from att group by herb),
f as (select k, item || '/' || case when m is null then 'not_covered' when list_contains(m, '先煎') then 'supported' else 'contradicted_by_graph' end as f, m is not null as known from it left join m on herb = p)
select k as call_id, case when bool_or(known) then 'supported' else 'empty' end as coverage, string_agg(f, ';' order by f) as findings from f group by k""")
def tool_check_decoction(spark: SparkSession, d: str) -> DataFrame:
    return _box(spark, d).check_decoction_requirement(_calls(spark, d, F.lit("先煎").alias("claimed"))).select("call_id", "coverage", _shown("findings", "item", "verdict"))


@query("""select p_partkey as call_id, case when p_size % 3 = 0 then 'supported' else 'empty' end as coverage, case when p_size % 3 = 0 then 'contraindicated/part:' || p_partkey || '/nation:' || p_partkey % 25 || '/herb' else '' end as findings from part""")
def tool_safety_constraints(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "part").select(F.col("p_partkey").alias("call_id"), F.concat(F.lit("药"), "p_partkey", F.lit("号")).alias("entity"), F.lit(None).cast("string").alias("context"))
    return _box(spark, d).retrieve_safety_constraints(calls).select("call_id", "coverage", _shown("findings", "severity", "restricted", "applies_to", "kind"))


@query("""with a as (select p_partkey as k, p_partkey % 2 = 0 as known, p_partkey % 4 = 0 as listed, case when p_size % 3 = 0 then '大毒' else '-' end as t from part)
select k * 2 as call_id, case when known then 'supported' else 'empty' end as coverage, case when known then 'entry:' || k || '/' || t else '' end as entries from a
union all select k * 2 + 1, case when listed then 'supported' else 'partially_supported' end, case when listed then 'entry:' || k || '/' || t else '' end from a""")
def tool_pharmacopoeia_entry(spark: SparkSession, d: str) -> DataFrame:
    """By an alias of the entry, and by the herb that may be registered in it."""
    k = F.col("p_partkey")
    asked = table(spark, d, "part").select(F.explode(F.array(F.struct((k * 2).alias("call_id"), F.concat(F.lit("炙药"), k, F.lit("号")).alias("herb")), F.struct((k * 2 + 1).alias("call_id"), F.concat(F.lit("药"), k, F.lit("号")).alias("herb")))).alias("x")).select("x.*")
    return _box(spark, d).retrieve_pharmacopeia_entry(asked).select("call_id", "coverage", _shown("entries", "entry", "toxicity"))
