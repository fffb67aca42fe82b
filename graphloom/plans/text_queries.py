"""Retrieval, text, JSON and contamination queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.jsons import leaves
from ..operators import contamination as cn
from ..operators import retrieval as rt
from ..session import save, small_enough
from .views import table

QUERIES, ORACLES = {}, {}
#: Languages and label centres that may be broadcast; more of them meet the other side unbroadcast.
MOST_LANGUAGES, MOST_CENTRES = 1000, 10_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _times(rows: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """Every row with every one of few: broadcast if there are at most that many, else a product of partitions."""
    return rows.crossJoin(F.broadcast(few) if small_enough(few, most) else few)


_BM25 = """d as (select doc_id as id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') as terms from documents),
dl as (select id, len(terms)::bigint as dl from d where len(terms) > 0),
st as (select count(*)::double as n, avg(dl) as avg_dl from dl),
tf as (select id, term, count(*) as tf from (select id, unnest(terms) as term from d) group by all),
df as (select term, count(*)::double as df from tf group by term),
q as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by all),
s as (select query_id, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl)) * ln(1 + qf)) as score
  from q join tf using (term) join df using (term) join dl using (id), st group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)"""


def _bm25(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return rt.Bm25Index(table(spark, d, "documents"), rt.words, id_col="doc_id").search(table(spark, d, "benchmark"), rt.words, query_id="item_id", limit=limit)


@query(f"with {_BM25} select query_id, id, round(score, 4) as score, rank::int as rank from r where rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query("""with d as (select doc_id as id, lang as part, regexp_extract_all(lower(text), '[a-z0-9]+') as terms from documents),
dl as (select part, id, len(terms)::bigint as dl from d where len(terms) > 0),
st as (select part, count(*)::double as n, avg(dl) as avg_dl from dl group by part),
tf as (select part, id, term, count(*) as tf from (select part, id, unnest(terms) as term from d) group by all),
df as (select part, term, count(*)::double as df from tf group by all),
q as (select item_id, part, term, count(*) as qf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark), (select distinct part from d) group by all),
s as (select item_id || '/' || part as query_id, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl)) * ln(1 + qf)) as score
  from q join tf using (part, term) join df using (part, term) join dl using (part, id) join st using (part) group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)
select query_id, id, round(score, 4) as score, rank::int as rank from r where rank <= 3""")
def bm25_by_domain(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    index = rt.Bm25Index(docs, rt.words, id_col="doc_id", part=F.col("lang"))
    asked = _times(table(spark, d, "benchmark"), docs.select("lang").distinct(), MOST_LANGUAGES).select(F.concat_ws("/", F.col("item_id").cast("string"), "lang").alias("q"), "text", "lang")
    return index.search(asked, rt.words, query_id="q", part_col="lang", limit=3).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query(f"""with {_BM25},
p as (select query_id, id, score / max(score) over (partition by query_id) as semantic, rank from r where rank <= 300),
a as (select query_id, id as anchor, d.source, d.lang from p join d using (id) where rank = 1),
g as (select query_id, d.id, case when d.id = anchor then 1.0::double else 0.25::double end as graph from a join d on d.source = a.source),
o as (select query_id, d.id, 1.0::double as source from a join d on d.lang = a.lang),
j as (select coalesce(p.query_id, g.query_id) as query_id, coalesce(p.id, g.id) as id, coalesce(semantic, 0) as semantic, coalesce(graph, 0) as graph from p full join g on p.query_id = g.query_id and p.id = g.id),
t as (select j.*, coalesce(o.source, 0) as source, 0.6::double * semantic + 0.25::double * graph + 0.15::double * coalesce(o.source, 0) as score from j left join o using (query_id, id)),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as n from t)
select query_id, id, round(semantic, 4) as semantic, graph, source, round(score, 4) as score, n::int as rank from k where n <= 10""")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.lit("document").alias("type"))
    pool = save(_bm25(spark, d, rt.POOL), "pool")
    anchor = pool.where("rank = 1").select("query_id", F.col("id").alias("anchor")).join(docs.select(F.col("id").alias("anchor"), "lang", "source"), "anchor")
    anchor = save(anchor, "anchor")
    # what only the graph reaches scores alike within a source and a language: the first of these by id are enough behind a pool
    first = lambda *by: docs.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(f"n_ <= {rt.POOL + 10}").select("id", *by)
    near = anchor.join(first("source", "lang"), ["source", "lang"]).select("query_id", "id")
    far = anchor.select("query_id", "source").join(first("source"), "source").select("query_id", "id")
    asked = pool.select("query_id", "id").unionByName(near).unionByName(far).distinct().join(docs.select("id", F.col("lang").alias("l"), F.col("source").alias("s")), "id").join(anchor, "query_id")
    asked = save(asked, "candidates")
    reached = asked.where("s = source").select("query_id", "id", F.when(F.col("id") == F.col("anchor"), 1.0).otherwise(0.25).alias("score"))
    same = asked.where("l = lang").select("query_id", "id", F.lit(1.0).alias("overlap"))
    out = rt.hybrid(rt.normalised(pool), reached, same, docs, 10)
    return out.select("query_id", "id", F.round("semantic", 4).alias("semantic"), "graph", "source", F.round("score", 4).alias("score"), "rank")


@query("""with x as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
c as (select label, i, avg(v) as c from x group by all),
s as (select c.label, vec_id, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) as cos from x join c on c.i = x.i group by all)
select label, vec_id, round(cos, 4) as cosine, row_number() over (partition by label order by round(cos, 6) desc, vec_id)::int as rank from s qualify rank <= 5""")
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("c"))
    centre = save(flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("c")), "centres")
    scored = _times(e.select("vec_id", "embedding"), centre, MOST_CENTRES).select("label", "vec_id", rt.cosine(F.col("embedding").cast("array<double>"), F.col("c")).alias("cos"))
    w = Window.partitionBy("label").orderBy(F.desc(F.round("cos", 6)), "vec_id")
    return scored.select("label", "vec_id", F.round("cos", 4).alias("cosine"), F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("""with n as (select distinct p_name as name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as w from part),
u as (select name, w, unnest(w) as g from n), p as (select distinct a.name as a, b.name as b, a.w as x, b.w as y from u a join u b on a.g = b.g and a.name < b.name)
select a, b, round(case when contains(a, b) or contains(b, a) then 1.0::double else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end, 6) as similarity from p""")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    u = save(n.select("name", F.array_distinct(tx.char_ngrams(F.col("name"), (2,))).alias("w")), "names").select("name", F.explode("w").alias("g"))
    pairs = u.withColumnRenamed("name", "a").join(u.withColumnRenamed("name", "b"), "g").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(tx.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(r"""select doc_id, length(c)::bigint as n, md5(c) as canon_md5 from (select doc_id, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') as c from documents)""")
def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", tx.bare_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("canon_md5"))


@query("""with n as (select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as i, n_name from nation)
select n_regionkey, chr((64 + i)::int) as letter, n_name as option from n""")
def option_parse(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.chr(F.lit(65).cast("long") + i), F.lit(": "))).otherwise(F.lit("")), x["n_name"])), ";")
    return n.select("n_regionkey", F.explode(tx.parse_options(text)).alias("letter", "option"))


@query("""select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_brand || ';' || p_type), '[A-Z]'))), '') as letters from part""")
def letters_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.parse_letters(F.concat_ws(";", "p_brand", "p_type")), "").alias("letters"))


@query("""select event_id, (props->>'$.k')::bigint as k from events""")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""select event_id, 'fenced' as strategy, (props->>'$.k')::bigint as k from events""")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.jsons import extract_object

    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\ndone"))
    out = table(spark, d, "events").select("event_id", extract_object(wrapped).alias("r"))
    return out.select("event_id", F.col("r.strategy").alias("strategy"), F.get_json_object("r.json", "$.k").cast("long").alias("k"))


_GRAMS = r"""c as (select doc_id as id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as t from documents),
b as (select item_id as id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as t from benchmark),
cg as (select distinct id, substr(t, i, 5) as g from (select id, t, unnest(range(1, length(t) - 3)) as i from c where length(t) >= 5) union select id, t from c where length(t) between 1 and 4),
bg as (select distinct id, substr(t, i, 5) as g from (select id, t, unnest(range(1, length(t) - 3)) as i from b where length(t) >= 5)),
cn as (select id, count(*) as n from cg group by id), bn as (select id, count(*) as n from bg group by id),
s as (select cg.id as c, bg.id as b, count(*) as k from cg join bg using (g) group by all),
o as (select c, b, k, k::double / (cn.n + bn.n - k) as j, k::double / bn.n as gc, k::double / cn.n as cg from s join cn on cn.id = c join bn on bn.id = b),
m as (select * from o qualify row_number() over (partition by c order by round(greatest(j, gc, cg), 9) desc, k desc, b) = 1)"""


def _case_passages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    canon = F.lower(tx.bare_text(F.col("text")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), canon.alias("canon")), table(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), canon.alias("canon"))


@query(f"""with {_GRAMS} select id as case_id, coalesce(round(j, 4), 0) as jaccard, coalesce(round(gc, 4), 0) as graph_in_case, coalesce(round(cg, 4), 0) as case_in_graph,
  case when coalesce(greatest(j, gc, cg), 0) >= 0.4 then 'likely' when coalesce(greatest(j, gc, cg), 0) >= 0.2 then 'possible' else 'clean' end as stratum from c left join m on m.c = c.id""")
def contamination_cases(spark: SparkSession, d: str) -> DataFrame:
    best = cn.best_overlap(*_case_passages(spark, d))
    r = lambda c: F.round(c, 4).alias(c)
    return best.select("case_id", r("jaccard"), r("graph_in_case"), r("case_in_graph"), cn.stratum(F.col("overlap"), F.lit(False), F.lit(False)).alias("stratum"))


@query(f"""with {_GRAMS}, t as (select case when coalesce(greatest(j, gc, cg), 0) >= 0.4 then 'likely' when coalesce(greatest(j, gc, cg), 0) >= 0.2 then 'possible' else 'clean' end as s from c left join m on m.c = c.id)
select count(*) as n_cases, count(*) filter (s = 'clean') as clean, count(*) filter (s = 'possible') as possible, count(*) filter (s = 'likely') as likely, round(count(*) filter (s = 'clean')::double / count(*), 6) as share_clean from t""")
def contamination_strata(spark: SparkSession, d: str) -> DataFrame:
    best = cn.best_overlap(*_case_passages(spark, d))
    return cn.strata(best.select(cn.stratum(F.col("overlap"), F.lit(False), F.lit(False)).alias("stratum"))).withColumn("share_clean", F.round("share_clean", 6))


@query(r"""with e as (select event_id, event_type as t, user_id as u, (props->>'$.k')::bigint as k from events),
p as (
  select event_id, 'node:' || event_id || ':kind' as origin, t || ' seen' as text, 1 as a from e
  union all select event_id, 'node:' || event_id || ':notes', 'item ' || k, 2 from e union all select event_id, 'node:' || event_id || ':notes', t || ', ' || u || '!', 3 from e
  union all select event_id, 'node:' || event_id || ':deep', 'user (' || u || ')', 4 from e where k % 2 = 0),
c as (select *, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') as canon from p)
select origin, text, canon from c where length(canon) >= 5 qualify row_number() over (partition by canon order by event_id, a) = 1""")
def corpus_passages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    note = F.to_json(F.struct(F.concat_ws(" ", "event_type", F.lit("seen")).alias("kind"), F.lit(7).alias("n")))
    inner = F.concat(F.lit('["item '), "k", F.lit('", 5, null, {"b": true, "c": "'), "event_type", F.lit(", "), "user_id", F.lit('!"}]'))
    deep = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"x": [[{"y": "user ('), "user_id", F.lit(')"}]]}'))).otherwise(F.lit("[]"))
    made = F.concat(F.rtrim(note, F.lit("}")), F.lit(', "notes": '), inner, F.lit(', "deep": '), deep, F.lit("}"))
    parts = leaves(e.select(F.col("event_id").alias("id"), made.alias("attrs")), "attrs", ["id"])
    listed = parts.select(F.concat_ws(":", F.lit("node"), "id", "key").alias("origin"), "text", F.concat(F.array(F.col("id").cast("long")), "path").alias("ord"))
    return cn.corpus(listed).select("origin", "text", "canon")


_ITEM_GRAMS = _GRAMS.replace("m as (select * from o qualify", "m2 as (select * from o qualify").replace("partition by c order by round(greatest(j, gc, cg), 9) desc, k desc, b)", "partition by b order by round(greatest(j, gc, cg), 9) desc, k desc, c)")


@query(f"with {_GRAMS} select c as case_id, b as passage_id, k as shared, round(j, 4) as jaccard, round(greatest(j, gc, cg), 4) as overlap from o where round(greatest(j, gc, cg), 9) >= 0.2")
def contamination_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = cn.similar_pairs(*_case_passages(spark, d))
    return found.select("case_id", "passage_id", F.col("shared").cast("long").alias("shared"), F.round("jaccard", 4).alias("jaccard"), F.round("overlap", 4).alias("overlap"))


@query(f"""with {_ITEM_GRAMS} select b.id as case_id, c as passage_id, coalesce(round(j, 4), 0) as jaccard, coalesce(round(cg, 4), 0) as graph_in_case, coalesce(round(gc, 4), 0) as case_in_graph,
  case when coalesce(greatest(j, gc, cg), 0) >= 0.4 then 'likely' when coalesce(greatest(j, gc, cg), 0) >= 0.2 then 'possible' else 'clean' end as stratum from b left join m2 on m2.b = b.id""")
def contamination_by_join(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _case_passages(spark, d)
    best = cn.best_by_join(items.select(F.col("passage_id").alias("case_id"), "canon"), docs.select(F.col("case_id").alias("passage_id"), "canon"))
    r = lambda c: F.round(c, 4).alias(c)
    return best.select("case_id", "passage_id", r("jaccard"), r("graph_in_case"), r("case_in_graph"), cn.stratum(F.col("overlap"), F.lit(False), F.lit(False)).alias("stratum"))


@query(r"""with c as (select doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as t from documents), b as (select item_id, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as t from benchmark)
select item_id as case_id, 'whole' as part, min(doc_id) as passage_id from b join c on contains(c.t, b.t) where length(b.t) >= 6 group by item_id""")
def exact_passage_contains(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _case_passages(spark, d)
    return cn.exact_parts(items.select(F.col("passage_id").alias("case_id"), F.lit("whole").alias("part"), "canon"), docs.select(F.col("case_id").alias("passage_id"), "canon"))


@query()
def rouge_l_adjacent_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return t.select("conv_id", "turn", F.round(tx.rouge_l(F.col("text"), F.col("before")), 6).alias("rouge_l"))
