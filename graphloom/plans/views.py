"""The graph, runs and cases that the registered queries see in the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NODES = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("order", "o_orderkey", "o_orderstatus"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, type, name, ord: regions, nations, customers, suppliers, parts and orders."""
    out = None
    for i, (kind, key, name) in enumerate(_NODES):
        part = table(spark, d, "orders" if kind == "order" else kind).select(F.concat_ws(":", F.lit(kind), key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), (F.lit(i * 10**12) + F.col(key)).cast("long").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """type, source, target, ord."""
    t = lambda n: table(spark, d, n)
    ref = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    row = lambda df, kind, s, x, o: df.select(F.lit(kind).alias("type"), s.alias("source"), x.alias("target"), F.col(o).cast("long").alias("ord"))
    parts = t("part")
    first = parts.groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    out = row(t("nation"), "HAS_NATION", ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "n_nationkey")
    for more in (
        row(t("customer"), "HAS_CUSTOMER", ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "c_custkey"),
        row(t("supplier"), "HAS_SUPPLIER", ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), "s_suppkey"),
        row(t("orders"), "PLACED", ref("customer", "o_custkey"), ref("order", "o_orderkey"), "o_orderkey"),
        row(t("lineitem").select("l_orderkey", "l_partkey").distinct(), "CONTAINS", ref("order", "l_orderkey"), ref("part", "l_partkey"), "l_orderkey"),
        row(parts.join(first, "p_name").where("p_partkey <> first"), "SAME_AS", ref("part", "p_partkey"), ref("part", "first"), "p_partkey"),
    ):
        out = out.unionByName(more)
    return out


def tool_steps(spark: SparkSession, d: str) -> DataFrame:
    """user_id, idx, tool, phase, ok, coverage, latency_ms, result_chars from events."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("user_id", F.col("event_id").alias("idx"), F.col("event_type").alias("tool"), F.when(k % 3 == 0, "verification").otherwise("agent").alias("phase"), (F.col("value") >= 10).alias("ok"), F.when(k % 5 == 0, "not_covered").when(k % 5 == 1, "empty").otherwise("supported").alias("coverage"), F.col("value").alias("latency_ms"), k.alias("result_chars"))


NODES_SQL = "nodes as (" + " union all ".join(f"select '{k}:' || {c} as id, '{k}' as type, {n} as name, ({i * 10**12} + {c})::bigint as ord from {'orders' if k == 'order' else k}" for i, (k, c, n) in enumerate(_NODES)) + ")"
EDGES_SQL = """edges as (
  select 'HAS_NATION' as type, 'region:' || n_regionkey as source, 'nation:' || n_nationkey as target, n_nationkey::bigint as ord from nation
  union all select 'HAS_CUSTOMER', 'nation:' || c_nationkey, 'customer:' || c_custkey, c_custkey from customer
  union all select 'HAS_SUPPLIER', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, s_suppkey from supplier
  union all select 'PLACED', 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey from orders
  union all select 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey, l_orderkey from (select distinct l_orderkey, l_partkey from lineitem)
  union all select 'SAME_AS', 'part:' || p_partkey, 'part:' || m, p_partkey from (select *, min(p_partkey) over (partition by p_name) as m from part) where p_partkey <> m)"""
STEPS_SQL = """steps as (
  select user_id, event_id as idx, event_type as tool, case when k % 3 = 0 then 'verification' else 'agent' end as phase, value >= 10 as ok,
    case when k % 5 = 0 then 'not_covered' when k % 5 = 1 then 'empty' else 'supported' end as coverage, value as latency_ms, k as result_chars
  from (select *, (props->>'$.k')::bigint as k from events))"""


def clinic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a typed graph: parts are herbs, orders formulas that hold them, nations cohorts that some herbs are forbidden for.

    Herbs of a size that 4 divides are toxic by their entry; a line of over 40 is evidence of how its herb is prepared.
    """
    t = lambda n: table(spark, d, n)
    named = lambda head, key: F.concat(F.lit(head), key.cast("string"), F.lit("号"))
    ref = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    entry = F.to_json(F.struct(F.struct(F.when(F.col("p_size") % 4 == 0, "辛，有毒").otherwise("甘").alias("nature_taste_meridian")).alias("pharmacopoeia_entry")))
    row = lambda df, kind, head, key, at, attrs=None: df.select(ref(kind, key).alias("id"), F.lit(head[0]).alias("type"), named(head[1], F.col(key)).alias("name"), F.array().cast("array<string>").alias("source_docs"), F.lit(None).cast("struct<doc_id:string,sentence:string>").alias("first_mention"), (attrs if attrs is not None else F.lit("{}")).alias("attrs"), (F.lit(at * 10**12) + F.col(key)).cast("long").alias("ord"))
    nodes = row(t("part"), "part", ("Herb", "药"), "p_partkey", 0, entry).unionByName(row(t("orders"), "order", ("Formula", "方"), "o_orderkey", 1)).unionByName(row(t("nation"), "nation", ("SafetyContext", "人群"), "n_nationkey", 2))
    held = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    said = F.when(F.col("q") > 40, F.array(F.struct(F.concat(named("药", F.col("l_partkey")), F.when(F.col("l_orderkey") % 2 == 0, "（先煎）").otherwise("（后下）")).alias("sentence")))).otherwise(F.array().cast("array<struct<sentence:string>>"))
    edge = lambda df, kind, a, b, evidence, o: df.select(F.concat_ws("|", a, F.lit(kind), b).alias("id"), F.lit(kind).alias("type"), a.alias("source"), b.alias("target"), F.array().cast("array<string>").alias("source_docs"), evidence.alias("evidence"), F.col(o).cast("long").alias("ord"))
    none = F.array().cast("array<struct<sentence:string>>")
    edges = edge(held, "CONTAINS_HERB", ref("order", F.col("l_orderkey")), ref("part", F.col("l_partkey")), said, "l_orderkey")
    banned = t("part").where("p_size % 3 = 0").withColumn("n", F.col("p_partkey") % 25)
    return nodes, edges.unionByName(edge(banned, "CONTRAINDICATED_FOR", ref("part", F.col("p_partkey")), ref("nation", F.col("n")), none, "p_partkey"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """case_id, category, letters, options, question: an order's first two lines as options, itself and the order before it in the question."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("单味药剂量", "先煎方法", "重复用药", "禁忌症", "规则 a-009 一类", "心情")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    herb = lambda i: F.concat(F.lit("药"), F.get("p", F.lit(i)).cast("string"), F.lit("号"))
    options = F.create_map(F.lit("A"), F.concat(herb(0), F.lit("（先煎）")), F.lit("B"), F.coalesce(herb(1), F.lit("无")), F.lit("C"), F.lit("方1号"))
    question = F.concat(F.lit("病人服方"), F.col("l_orderkey"), F.lit("号与方"), F.col("l_orderkey") - 1, F.lit("号，如何"))
    letters = F.when(F.col("l_orderkey") % 4 == 0, F.array(F.lit("A"), F.lit("K"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    return l.select(F.col("l_orderkey").alias("case_id"), kind.alias("category"), letters.alias("letters"), options.alias("options"), question.alias("question"))


ANSWERS_SQL = """lp as (select l_orderkey as k, list_sort(list(distinct l_partkey)) as p from lineitem group by l_orderkey),
ans as (select k, k % 6 as kind, p[1] as a, case when k % 4 <> 0 then p[2] end as b from lp),
hb as (select k, kind, a as herb from ans union all select k, kind, b from ans where b is not null),
fm as (select k, kind, o_orderkey as f from ans join orders on o_orderkey in (k, k - 1)),
att as (select distinct l_partkey as herb, case when l_orderkey % 2 = 0 then '先煎' else '后下' end as m from (select l_orderkey, l_partkey, max(l_quantity) as q from lineitem group by all) where q > 40)"""
