"""Run, score, statistics, rule and benchmark-building queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import text as tx
from ..operators import benchmark as bm
from ..operators import evaluation as ev
from ..operators import judging as jd
from ..operators import reports as rp
from ..operators import rules
from ..operators import statistics as st
from ..operators import traces as tr
from ..operators import verification as vf
from ..operators.tools import Tools
from ..session import save
from .views import ANSWERS_SQL, STEPS_SQL, answers, clinic, table, tool_steps

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


# ---- runs ---------------------------------------------------------------------------------------------------------


@query(f"""with {STEPS_SQL} select user_id, count(*) as n_tool_calls, count(*) filter (phase = 'agent') as n_agent_calls, count(*) filter (phase <> 'agent') as n_verification_calls,
  count(*) filter (phase = 'agent' and not ok) as n_invalid, count(distinct tool) filter (phase = 'agent') as n_distinct_tools, count(*) filter (phase = 'agent' and coverage = 'not_covered') as n_not_covered,
  round(sum(latency_ms), 2) as latency_ms, sum(result_chars)::bigint as context_chars,
  case when count(*) filter (phase = 'agent') > 0 then round((count(*) filter (phase = 'agent' and ok))::double / count(*) filter (phase = 'agent'), 6) end as success_rate from steps group by user_id""")
def trace_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _r(tr.trace_metrics(tool_steps(spark, d), ["user_id"]), "success_rate")


@query(f"with {STEPS_SQL} select tool, count(*) as n, round(avg(ok::int), 6) as ok_rate from steps group by tool")
def tool_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _r(tr.tool_histogram(tool_steps(spark, d)), "ok_rate")


@query(f"with {STEPS_SQL} select phase, coverage, count(*) as n from steps group by all")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return tr.coverage_counts(tool_steps(spark, d), ["phase"])


@query(f"with {STEPS_SQL}, f as (select user_id, tool, min(idx) as i from steps group by all) select user_id, string_agg(tool, ',' order by i) as tools_used from f group by user_id")
def tools_in_order(spark: SparkSession, d: str) -> DataFrame:
    return tr.tools_in_order(tool_steps(spark, d), ["user_id"]).select("user_id", F.array_join("tools_used", ",").alias("tools_used"))


@query(f"""with {STEPS_SQL}, n as (select *, row_number() over (partition by user_id order by idx) as n, row_number() over (partition by user_id, tool order by idx) as k from steps)
select user_id, idx, n <= 12 and k <= 4 as allowed, case when n > 12 then 'total' when k > 4 then 'per_tool' end as reason from n""")
def tool_budget_gate(spark: SparkSession, d: str) -> DataFrame:
    return tr.budget_gate(tool_steps(spark, d), ["user_id"], ["idx"]).select("user_id", "idx", "allowed", "reason")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    cond = F.create_map(*[F.lit(x) for kv in (("click", "M2C"), ("view", "M3"), ("purchase", "M3C"), ("signup", "M4")) for x in kv])
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.coalesce(cond[F.col("event_type")], F.lit("M4")).alias("condition"), "value")
    return e.groupBy("case_id", "condition").agg(F.count("*").alias("n_llm_calls"), F.avg("value").alias("score"))


_RUNS = """runs as (select user_id as case_id, case event_type when 'click' then 'M2C' when 'view' then 'M3' when 'purchase' then 'M3C' else 'M4' end as condition, count(*) as n_llm_calls, avg(value) as score from events group by all)"""


@query(f"""with {_RUNS}, x as (select r.*, a.n_llm_calls as c, b.n_llm_calls as m from runs r
  left join runs a on a.case_id = r.case_id and a.condition = case when r.condition in ('M2C', 'M3') then 'M2C' else 'M3C' end
  left join runs b on b.case_id = r.case_id and b.condition = case when r.condition in ('M2C', 'M3') then 'M3' else 'M4' end)
select case_id, condition, n_llm_calls, case when c <> m then 'compute parity broken: ' || case when condition in ('M2C', 'M3') then 'M2C' else 'M3C' end || ' used ' || c || ' LLM calls, ' || case when condition in ('M2C', 'M3') then 'M3' else 'M4' end || ' used ' || m end as parity_error from x""")
def parity_errors(spark: SparkSession, d: str) -> DataFrame:
    return tr.parity_errors(_runs(spark, d).drop("score"), ["case_id"])


@query(f"""with {_RUNS}, w as (select distinct case_id, c as condition, 0 as sample from runs, (values ('M0'), ('M2C'), ('M3'), ('M3C'), ('M4')) v(c)),
s as (select w.*, r.case_id is null as missing, case when w.condition = 'M0' then 'M0' else 'g' end as g from w left join runs r using (case_id, condition))
select case_id, condition, sample from s where exists (select 1 from s t where t.missing and t.case_id = s.case_id and t.g = s.g)""")
def resume_missing_jobs(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    recorded = runs.select("case_id", "condition", F.lit(0).alias("sample"), F.lit("r").alias("run_signature"), F.lit("d").alias("design_signature"))
    wanted = runs.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(c) for c in ("M0", "M2C", "M3", "M3C", "M4")])).alias("condition"), F.lit(0).alias("sample"))
    return tr.missing_jobs(wanted, recorded, "r", "d")


@query("""with l as (select (props->>'$.k')::bigint as key, max_by(event_type, event_id) as completion from events group by 1)
select p_size::bigint as key, p_partkey, completion, completion is not null as hit from part left join l on l.key = p_size""")
def replay_cache(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("key"), F.col("event_type").alias("completion"), F.col("event_id").alias("ord"))
    return tr.replay(table(spark, d, "part").select(F.col("p_size").cast("long").alias("key"), "p_partkey"), log).drop("error")


@query("""select c_custkey || '@' || coalesce(string_agg(o_orderkey, ';' order by o_orderkey), '') || '@@@' as value from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def submission_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import submission_lines as lines

    empty = F.array().cast("array<string>")
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("clinical_information")).select("id", "clinical_information", empty.alias("pathogenesis_answer"), empty.alias("syndrome_answer"), F.lit("").alias("explanation"))
    return lines(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord")), made)


# ---- aggregates ---------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


_L = "x as (select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l using (doc_id))"


@query(f"with {_L} select source, count(*) as n, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from x group by source")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.metric_means(_labelled(spark, d), ["source"], ["quality", "toxic"]), "quality", "toxic")


@query(f"with {_L}, a as (select lang, source, avg(quality) as m from x where quality is not null group by all), f as (select lang, avg(m) as m from a group by lang) select round(avg(m), 6) as macro_mean, count(*) as n_families from f")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.macro_mean(_labelled(spark, d).where("quality is not null"), [], "lang", "source", "quality"), "macro_mean")


@query(f"""with {_L} select source, round(avg(quality) filter (lang = 'de'), 6) as de, round(avg(quality) filter (lang = 'en'), 6) as en, round(avg(quality) filter (lang = 'es'), 6) as es, round(avg(quality) filter (lang = 'fr'), 6) as fr,
  round(avg(quality) filter (lang = 'fr') - avg(quality) filter (lang = 'de'), 6) as delta from x group by source""")
def pivot_grid(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.with_delta(ev.grid(_labelled(spark, d), "source", "lang", "quality", ("de", "en", "es", "fr")), "de", "fr"), "de", "en", "es", "fr", "delta")


@query(f"with {_L} select source, count(*) as n, count(*) filter (toxic = 1) as n_flagged, round(avg(quality), 6) as mean_all, round(avg(quality) filter (toxic <> 1), 6) as mean_clean from x group by source")
def conditional_means(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.conditional_means(_labelled(spark, d), ["source"], "quality", F.col("toxic") == 1), "mean_all", "mean_clean")


@query("select event_type, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from events group by event_type")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.shares(table(spark, d, "events"), "event_type"), "share")


@query("""with c as (select user_id, event_type, count(*) as votes from events group by all)
select user_id, event_type, votes, (sum(votes) over (partition by user_id))::bigint as n from c qualify row_number() over (partition by user_id order by votes desc, event_type) = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return ev.majority(table(spark, d, "events"), ["user_id"], "event_type")


@query("""with p as (select user_id, (props->>'$.k')::bigint as s, event_type as o from events),
n as (select user_id, count(distinct s) as n from p group by user_id), v as (select user_id, o, count(distinct s) as v from p group by all),
k as (select user_id, string_agg(o, ',' order by o) filter (v >= case when n > 1 then floor(0.5::double * n) + 1 else 1 end) as kept, arg_min(o, (-v, o)) as best from v join n using (user_id) group by user_id)
select user_id, n as n_samples, coalesce(kept, best) as consensus from n join k using (user_id)""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("s"), "event_type")
    return ev.consensus(p, ["user_id"], "s", "event_type").select("user_id", "n_samples", F.array_join("consensus", ",").alias("consensus"))


@query("""with n as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as i from documents),
t as (select *, row_number() over (order by i, lang) as k from n) select doc_id, lang from t where k <= 150""")
def stratified_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return ev.stratified_quota(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 150)


@query("""with n as (select l_orderkey || '-' || l_linenumber as id, row_number() over (partition by l_orderkey, l_linenumber) as i from lineitem)
select case when i > 1 then id || '#' || i else id end as id from n""")
def unique_id_suffix(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.struct("l_partkey", "l_suppkey").alias("o"))
    return ev.unique_ids(l, "id", "o").select("id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Two models; some parity errors, groups that are null, blank or differ between the arms, strata of one arm only."""
    n = F.col("n_llm_calls")
    group = F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, "").otherwise(F.concat(F.lit("g"), (F.col("case_id") % 3 + ((F.col("condition") == "M3") & (n % 4 == 0)).cast("int")).cast("string")))
    stratum = F.when(n % 3 == 0, "audit_only").when(n % 3 == 1, "deterministic")
    return _runs(spark, d).select(F.concat(F.lit("m"), (F.col("case_id") % 2).cast("string")).alias("model"), "case_id", "condition", F.when(F.col("score") > 5, F.col("score")).alias("score"), F.when(n > 40, "broken").when(n % 2 == 0, "").alias("parity_error"), group.alias("branch_group"), stratum.alias("verification_stratum"), F.lit(0).alias("ord"), n, (n * 10).alias("total_tokens"))


_ITEMS = f"""{_RUNS}, items as (select 'm' || (case_id % 2) as model, case_id, condition, case when score > 5 then score end as score, n_llm_calls, n_llm_calls > 40 as broken,
  case when n_llm_calls % 5 = 0 then null when n_llm_calls % 7 = 0 then '' else 'g' || (case_id % 3 + (condition = 'M3' and n_llm_calls % 4 = 0)::int) end as grp,
  case n_llm_calls % 3 when 0 then 'audit_only' when 1 then 'deterministic' end as stratum from runs),
pairs as (select a.condition || '->' || b.condition as contrast, a.model, a.case_id, a.score as a, b.score as b, a.broken or b.broken as broken, coalesce(b.stratum, a.stratum) as stratum,
  (a.condition, b.condition) in (('M3', 'M3C'), ('M3', 'M4'), ('M3C', 'M4'), ('M2C', 'M3')) and (coalesce(a.grp, '') = '' or a.grp is distinct from b.grp) as split from items a join items b on a.model = b.model and a.case_id = b.case_id)"""
_CONTRASTS = (("M2C", "M3"), ("M3C", "M4"), ("M3", "M4"), ("M2C", "M4"))


@query(f"""with {_ITEMS} select contrast, model, case_id, round(a, 6) as a, round(b, 6) as b from pairs
where contrast in ('M2C->M3', 'M3C->M4', 'M3->M4', 'M2C->M4') and a is not null and b is not null and not broken and not split""")
def contrast_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.contrast_pairs(_items(spark, d), _CONTRASTS, "score"), "a", "b")


@query(f"""with {_ITEMS} select model, case_id, round(a, 6) as a, round(b, 6) as b from pairs where contrast = 'M3C->M4' and a is not null and b is not null and not broken and not split and stratum = 'deterministic'""")
def stratum_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.pair_conditions(_items(spark, d), "M3C", "M4", "score", stratum="deterministic").drop("cluster"), "a", "b")


@query(f"""with {_ITEMS}, p as (select * from pairs where contrast = 'M2C->M3')
select m.model, count(p.case_id) as n_pairs, count(*) filter (broken) as n_parity, count(*) filter (not broken and split) as n_split_group from (select distinct model from items) m left join p using (model) group by m.model""")
def dropped_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ev.dropped_pairs(_items(spark, d), "M2C", "M3")


@query(f"""with {_ITEMS}, g as (select model, avg(n_llm_calls) filter (condition = 'M2C') as c, avg(n_llm_calls) filter (condition = 'M3') as a, count(*) filter (broken) as k from items where condition in ('M2C', 'M3') group by model)
select model, round(c, 6) as control_calls, round(a, 6) as arm_calls, round(10 * c, 6) as control_tokens, round(10 * a, 6) as arm_tokens, k as breaks, round(c / a, 6) as call_ratio, round(c / a, 6) as token_ratio, case when k = 0 and c / a between 0.8 and 1.25 then 'ok' else 'check' end as verdict from g""")
def parity_table(spark: SparkSession, d: str) -> DataFrame:
    return _r(ev.parity_table(_items(spark, d), "M2C", "M3"), "control_calls", "arm_calls", "control_tokens", "arm_tokens", "call_ratio", "token_ratio")


# ---- statistics ---------------------------------------------------------------------------------------------------


def _binary_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).where("quality is not null and toxic is not null").select("doc_id", "lang", "source", F.col("toxic").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))


_MC = f"""{_L}, g as (select source, count(*) as n, count(*) filter (toxic = 0 and quality = 1) as w, count(*) filter (toxic = 1 and quality = 0) as l, avg(quality) - avg(toxic) as delta from x where quality is not null group by source),
k as (select *, unnest(range(0, least(w, l) + 1)) as i from g),
p as (select source, case when max(w + l) = 0 then 1.0::double else least(1.0::double, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2)))) end as p from k group by source)"""


@query(f"with {_MC} select source, n, w as wins, l as losses, round(delta, 6) as delta, round(p + 1e-9, 6) as p_value from g join p using (source)")
def mcnemar_labels(spark: SparkSession, d: str) -> DataFrame:
    # exact fractions of powers of two lie on rounding's edge: both sides move off it
    return _r(st.mcnemar(_binary_pairs(spark, d), ["source"]).withColumn("p_value", F.col("p_value") + 1e-9), "delta", "p_value")


@query(f"with {_MC}, o as (select source, p, least(1.0::double, (count(*) over () - row_number() over (order by round(p, 9), source) + 1) * p) as s, round(p, 9) as q from p) select source, round(max(s) over (order by q, source rows unbounded preceding) + 1e-9, 6) as p_holm from o")
def holm_adjust(spark: SparkSession, d: str) -> DataFrame:
    tests = st.mcnemar(_binary_pairs(spark, d), ["source"]).withColumn("p_value", F.round("p_value", 9))
    return st.holm(tests, [], tie="source", digits=9).select("source", F.round(F.col("p_holm") + 1e-9, 6).alias("p_holm"))


_UP = "u as (select user_id, max(value) filter (event_type = 'click') as a, max(value) filter (event_type = 'view') as b from events group by user_id having a is not null and b is not null)"


def _user_pairs(spark: SparkSession, d: str) -> DataFrame:
    best = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(best("click").alias("a"), best("view").alias("b")).where("a is not null and b is not null")


@query(f"""with {_UP}, d as (select round((b - a) * 100)::bigint as d from u where b <> a), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r, count(*) over (partition by abs(d)) as g from d),
t as (select count(*) as n, sum(r) filter (d > 0) as w, sum(g * g - 1)::bigint as t from r)
select n, w as w_plus, t as tie_term, round((n * (n + 1.0::double) * (2 * n + 1) - t / 2.0::double) / 24, 6) as var, round((abs(w - n * (n + 1) / 4.0::double) - 0.5::double) / sqrt((n * (n + 1.0::double) * (2 * n + 1) - t / 2.0::double) / 24), 6) as z from t""")
def wilcoxon_ranks(spark: SparkSession, d: str) -> DataFrame:
    pairs = _user_pairs(spark, d).select(F.round(F.col("a") * 100).alias("a"), F.round(F.col("b") * 100).alias("b"))
    return _r(st.wilcoxon(pairs, []).select("n", "w_plus", "tie_term", "var", "z"), "var", "z")


@query(f"""with {_L}, r as (select lang, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0::double as rx,
  rank() over (partition by lang order by quality) + (count(*) over (partition by lang, quality) - 1) / 2.0::double as ry from x where quality is not null)
select lang, count(*) as n, round(corr(rx, ry), 6) as r from r group by lang""")
def spearman_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.spearman(_labelled(spark, d).where("quality is not null"), ["lang"], "n_chars", "quality"), "r")


#: Draws of the SQL below.
REPS = st.RESAMPLES


def _boot(unit: str, groups: str, slot: str = "s") -> str:
    lo, hi = max(0, int(0.025 * REPS) - 1), min(REPS - 1, int(0.975 * REPS))
    return f"""tot as (select sum(d)::double / sum(n) as delta, count(*) as m from {groups}),
pl as (select *, row_number() over (order by {unit}) - 1 as place from {groups}),
dr as (select r, ('0x' || substr(md5('20260829:' || r || ':' || s), 1, 8))::bigint % m as place from tot, range(0, {REPS}) a(r), lateral (select unnest(range(0, m)) as s)),
rp as (select r, sum(d)::double / sum(n) as stat from dr join pl using (place) group by r),
ci as (select delta, list(stat order by stat) as ss, count(*) filter (abs(stat - delta) >= abs(delta)) as beyond from rp, tot group by delta)
select round(delta, 6) as delta, round(ss[{lo + 1}], 6) as ci_low, round(ss[{hi + 1}], 6) as ci_high, round((beyond + 1)::double / {REPS + 1}, 6) as p_value"""


@query(f"with {_UP}, gr as (select user_id, b - a as d, 1 as n from u), {_boot('user_id', 'gr')}, (select count(*) from u) as n, (select count(*) from u where b > a) as wins, (select count(*) from u where b < a) as losses, (select count(*) from u where b = a) as ties from ci")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    out = st.paired_bootstrap(_user_pairs(spark, d), [], "user_id")
    return _r(out.select("n", "delta", "ci_low", "ci_high", "p_value", "wins", "losses", "ties"), "delta", "ci_low", "ci_high", "p_value")


@query(f"with {_L}, gr as (select source, sum(quality - toxic) as d, count(*) as n from x where quality is not null group by source), {_boot('source', 'gr')}, (select sum(n) from gr)::bigint as n, (select count(*) from gr) as n_clusters from ci")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.cluster_bootstrap(_binary_pairs(spark, d), [], "source"), "delta", "ci_low", "ci_high", "p_value")


_LO, _HI = max(0, int(0.025 * REPS) - 1), min(REPS - 1, int(0.975 * REPS))


@query(f"""with {_L}, gr as (select lang as fam, lang || '|' || (doc_id % 3) as st, source as c, sum(quality - toxic)::double as d, count(*) as n from x where quality is not null group by all),
sz as (select fam, st, count(*) as m, sum(d) / sum(n) as delta from gr group by all), w as (select avg(f) as delta from (select fam, avg(delta) as f from sz group by fam)),
pl as (select *, row_number() over (partition by fam, st order by c) - 1 as place from gr),
dr as (select fam, st, r, ('0x' || substr(md5('20260829:' || r || ':' || fam || '/' || st || '/' || s), 1, 8))::bigint % m as place from sz, range(0, {REPS}) a(r), lateral (select unnest(range(0, m)) as s)),
ps as (select r, fam, st, sum(d) / sum(n) as v from dr join pl using (fam, st, place) group by all), pf as (select r, fam, avg(v) as f from ps group by all), rp as (select r, avg(f) as stat from pf group by r),
ci as (select delta, list(stat order by stat) as ss, count(*) filter (abs(stat - delta) >= abs(delta)) as beyond from rp, w group by delta)
select round(delta, 6) as delta, round(ss[{_LO + 1}], 6) as ci_low, round(ss[{_HI + 1}], 6) as ci_high, round((beyond + 1)::double / {REPS + 1}, 6) as p_value from ci""")
def macro_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    pairs = _binary_pairs(spark, d).withColumn("stratum", F.concat_ws("|", "lang", F.col("doc_id") % 3))
    return _r(st.macro_bootstrap(pairs, "lang", "stratum", "source"), "delta", "ci_low", "ci_high", "p_value")


# ---- scores -------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.substring("l_returnflag", 1, 1))).alias("pred"))
    gold = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("o_orderpriority"), F.lit("([A-N])"), F.lit(1))))
    return table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", sc.TRANSITION_TASK).otherwise("CP3_stage_actions").alias("subtask"), "pred", gold.alias("gold"))


_ANS = """l as (select l_orderkey, list_sort(list(distinct substr(l_returnflag, 1, 1))) as pred from lineitem group by l_orderkey),
a as (select o_orderkey, o_orderstatus = 'O' as tr, pred, list_sort(list_distinct(regexp_extract_all(upper(o_orderpriority), '[A-N]'))) as gold from orders left join l on l_orderkey = o_orderkey),
c as (select *, coalesce(pred, []::varchar[]) as p, len(list_intersect(coalesce(pred, []::varchar[]), gold)) as k from a)"""


@query(f"""with {_ANS} select o_orderkey, round(case when len(gold) + len(p) - k > 0 then k::double / (len(gold) + len(p) - k) else 0 end, 6) as proportional,
  round(case when len(gold) > 0 then k::double / len(gold) else 0 end, 6) as recall,
  round(case when len(p) = 0 and len(gold) = 0 then 1 when k = 0 then 0 else 2.0::double * k / (len(p) + len(gold)) end, 6) as f1 from c""")
def option_scores(spark: SparkSession, d: str) -> DataFrame:
    p = F.coalesce("pred", F.array().cast("array<string>"))
    out = _answers(spark, d).select("o_orderkey", sc.proportional_score(p, F.col("gold")).alias("proportional"), sc.gold_recall(p, F.col("gold")).alias("recall"), tx.set_f1(p, F.col("gold")).alias("f1"))
    return _r(out, "proportional", "recall", "f1")


@query(f"""with {_ANS} select o_orderkey, (len(p) > 0)::int::double as answered, (len(p) > 0 and p = gold)::int::double as exact,
  round(case when len(p) > k or len(gold) = 0 then 0 else k::double / len(gold) end, 6) as partial_credit, round(case when len(gold) + len(p) > 0 then k::double / (len(gold) + len(p) - k) else 0 end, 6) as jaccard from c""")
def multi_select_score(spark: SparkSession, d: str) -> DataFrame:
    return _r(_answers(spark, d).select("o_orderkey", sc.multi_select(F.col("pred"), F.col("gold")).alias("s")).select("o_orderkey", "s.*"), "partial_credit", "jaccard")


@query(f"""with {_ANS} select o_orderkey, (pred is not null)::int::double as answered, (len(p) > 0 and p = gold)::int::double as exact, round(case when len(p) > 0 then k::double / len(p) else 0 end, 6) as precision,
  round(case when len(gold) > 0 then k::double / len(gold) else 0 end, 6) as recall, round(case when k > 0 then 2.0::double * k / (len(p) + len(gold)) else 0 end, 6) as f1,
  case when tr then (list_has_any(gold, ['A', 'D']) and list_has_any(p, ['B', 'C']))::int::double end as unsafe_transition, case when tr then (list_contains(gold, 'D') and not list_contains(p, 'D'))::int::double end as missed_uncertainty from c""")
def pathway_score(spark: SparkSession, d: str) -> DataFrame:
    return _r(_answers(spark, d).select("o_orderkey", sc.pathway_item(F.col("subtask"), F.col("pred"), F.col("gold")).alias("s")).select("o_orderkey", "s.*"), "precision", "recall", "f1")


@query("""with v as (select user_id, list(distinct case event_type when 'click' then 'supported' when 'view' then 'not_covered' when 'purchase' then 'contradicted' else 'not_in_graph' end) as v from events group by user_id)
select user_id, case when list_contains(v, 'contradicted') then 'contradicted' when list_contains(v, 'not_in_graph') then 'not_in_graph' when list_contains(v, 'not_covered') then 'not_covered' else 'supported' end as verdict from v""")
def worst_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    v = F.when(e == "click", "supported").when(e == "view", "not_covered").when(e == "purchase", "contradicted").otherwise("not_in_graph")
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_set(v).alias("v")).select("user_id", sc.worst_verdict(F.col("v")).alias("verdict"))


# ---- rules and benchmark building ---------------------------------------------------------------------------------


@query("""with i as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark),
c as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w, row_number() over (partition by conv_id order by turn, role, text) as n from conversations),
f as (select conv_id, n as finding_id, w from c where role = 'user'), k as (select conv_id, n as criterion_id, w from c where role <> 'user'),
p as (select k.conv_id, k.criterion_id, f.finding_id, len(k.w) as m, case when len(k.w) > 0 and f.w is not null then len(list_intersect(k.w, f.w))::double / len(k.w) else 0 end as s from k left join f using (conv_id)),
b as (select conv_id, criterion_id, max(m) as m, max(s) as s, count(finding_id) as c from p group by all)
select conv_id, criterion_id, round(s, 3) as score, case when c = 0 then 'no_findings_supplied' when m = 0 then 'unparseable' when s >= 0.6::double then 'met' when s >= 0.3::double then 'partial' else 'not_evidenced' end as status from b""")
def criterion_match(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.retrieval import words

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations").withColumn("n", F.row_number().over(w).cast("long"))
    criteria = c.where("role <> 'user'").select("conv_id", F.col("n").alias("criterion_id"), F.col("text").alias("criterion"))
    findings = c.where("role = 'user'").select("conv_id", F.col("n").alias("finding_id"), F.col("text").alias("finding"))
    return rules.match_criteria(criteria, findings, words, ["conv_id"]).drop("criterion")


@query("""with s as (select user_id, count(*) as n, count(*) filter (event_type = 'click') as met, count(*) filter (event_type = 'view') as part from events group by user_id)
select user_id, case when n - met - part = 0 then 'insufficient_evidence' when part > 3 then 'continue' when met = n then 'advance' when met > 0 then 'continue' else 'continue' end as decision from s""")
def transition_decision(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_exit"), F.count_if(F.col("event_type") == "click").alias("n_exit_met"), F.count_if(F.col("event_type") == "view").alias("v"))
    s = s.select("user_id", "n_exit", "n_exit_met", F.when(F.col("v") > 3, F.col("v")).otherwise(0).alias("n_exit_contradicted"), (F.col("n_exit") - F.col("n_exit_met") - F.col("v")).alias("n_findings"), F.lit(1).alias("n_successors"), F.lit(False).alias("any_entry_all_met"), F.lit(True).alias("any_entry"))
    return s.select("user_id", rules.transition(s).alias("decision"))


def _stages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.array_sort(F.collect_set(F.substring(F.col("o_orderdate").cast("string"), 1, 7))).alias("actions"), F.min("o_orderkey").alias("id"))
    return o.select(F.col("o_custkey").alias("disease"), F.col("o_orderpriority").alias("name"), F.when(F.substring("o_orderpriority", 1, 1) < "3", "acute").otherwise("chronic").alias("variant"), F.substring("o_orderpriority", 1, 1).cast("int").alias("order"), "id", "actions")


_ST = """s as (select o_custkey as disease, o_orderpriority as name, case when substr(o_orderpriority, 1, 1) < '3' then 'acute' else 'chronic' end as variant, substr(o_orderpriority, 1, 1)::int as ord, min(o_orderkey) as id, list_sort(list(distinct substr(o_orderdate::varchar, 1, 7))) as actions from orders group by all)"""


@query(f"""with {_ST}, h as (select s.disease, s.id, s.variant, (select list_distinct(flatten(list(t.actions))) from s t where t.disease = s.disease and t.variant = s.variant and (t.ord, t.id) < (s.ord, s.id)) as prior,
  row_number() over (partition by disease, variant order by ord, id) as n, count(*) over (partition by disease, variant) as t from s)
select disease, id, coalesce(len(prior), 0)::bigint as n_prior, case when n = 1 then 'first' when n = t then 'last' else 'middle' end as position from h""")
def prefix_history(spark: SparkSession, d: str) -> DataFrame:
    return bm.history(_stages(spark, d)).select("disease", "id", F.size("prior").cast("long").alias("n_prior"), "position")


@query(f"""with {_ST}, g as (select disease, id, variant, len(actions) as k from s), x as (select disease, id, variant || '/' || k as sig from g),
c as (select disease, sig, count(*) as same from x group by all), t as (select disease, count(*) as n from x group by disease)
select disease, id, n - same as n_others from x join c using (disease, sig) join t using (disease) where n - same >= 2""")
def discriminable_stages(spark: SparkSession, d: str) -> DataFrame:
    s = _stages(spark, d).select("disease", "id", F.concat_ws("/", "variant", F.size("actions")).alias("signature"))
    return bm.discriminable(s).select("disease", "id", "n_others")


@query("""with g as (select n_nationkey as item, n_name as value, n_regionkey from nation), w as (select g.item, b.n_name as value from g join nation b on b.n_regionkey <> g.n_regionkey),
d as (select item, value, row_number() over (partition by item order by md5('20260829:' || item || ':' || value), value) as k from w),
e as (select item, value, true as is_gold from g union all select item, value, false from d where k <= 5)
select item, chr((64 + row_number() over (partition by item order by md5('20260830:' || item || ':' || value), value))::int) as letter, value, is_gold from e""")
def option_sets(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    gold = n.select(F.col("n_nationkey").alias("item"), F.col("n_name").alias("value"))
    other = n.select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("value"))
    wrong = n.select(F.col("n_nationkey").alias("item"), "n_regionkey").join(other, F.col("n_regionkey") != F.col("r")).select("item", "value")
    return bm.options(gold, wrong, "item", "value")


@query("""with i as (select o_orderkey as id, list_sort(list(distinct l_returnflag)) as v, any_value(o_orderpriority) as t from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey)
select 'too_few_distractors' as problem, id::varchar as id from i where len(v) - 1 < 2""")
def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("v"))
    items = table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.map_from_entries(F.transform("v", lambda x, i: F.struct(F.chr(F.lit(65).cast("long") + i).alias("key"), x.alias("value")))).alias("options"), F.array(F.lit("A")).alias("answer"), F.col("o_orderpriority").alias("text"))
    return bm.violations(items, lambda c: tx.bare_text(c, compatibility=False))


@query("""select p_partkey, ('0x' || substr(md5('20260829:' || p_partkey), 1, 8))::bigint % 100 < 25 as kept from part""")
def seeded_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", bm.under_cap(F.col("p_partkey")).alias("kept"))


# ---- verification of answers --------------------------------------------------------------------------------------


@query(r"""with w as (select item_id, unnest(string_split_regex(text, '\s+')) as name from benchmark),
n as (select name, min(item_id % 3) as t from w where length(name) >= 4 group by name),
f as (select doc_id, name, row_number() over (partition by doc_id order by t, name) as k from documents join n on contains(text, name))
select doc_id, array_to_string(list(name order by k), ' ') as names from f where k <= 6 group by doc_id""")
def names_in_documents(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\s+")).alias("name")).where("length(name) >= 4")
    kind = F.element_at(F.array(*[F.lit(x) for x in vf.NAMED_TYPES]), (F.col("item_id") % 3 + 1).cast("int"))
    names = words.select("name", kind.alias("type"), F.lit(0).cast("long").alias("ord"))
    found = vf.names_in_play(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), names)
    return found.select(F.col("id").alias("doc_id"), F.array_join("names", " ").alias("names"))


@query(f"""with {ANSWERS_SQL},
v as (
  select k, 'not_covered' as v from ans where kind = 0
  union all select h.k, case when '先煎' in (select m from att where att.herb = h.herb) then 'supported' when exists (select 1 from att where att.herb = h.herb) then 'contradicted_by_graph' else 'not_covered' end from hb h where kind = 1
  union all select x.k, 'contradicted' from fm x join lineitem i on i.l_orderkey = x.f join fm y on y.k = x.k and y.f <> x.f join lineitem j on j.l_orderkey = y.f and j.l_partkey = i.l_partkey where x.kind = 2
  union all select h.k, 'supported' from hb h join part on p_partkey = herb where kind = 3 and p_size % 3 = 0
  union all select k, 'not_covered' from ans where kind = 4),
r as (select k, min(list_position(['contradicted', 'contradicted_by_graph', 'partially_supported', 'not_in_graph', 'not_covered', 'supported'], v)) as r from v group by k)
select k as case_id, (kind <> 5)::bigint as n_checks, case when kind = 5 then 'not_applicable' when r is null then 'no_verdict' else (['contradicted', 'contradicted_by_graph', 'partially_supported', 'not_in_graph', 'not_covered', 'supported'])[r] end as verdict
from ans left join r using (k)""")
def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = clinic(spark, d)
    given = save(answers(spark, d), "given")
    plans = vf.safety_plans(given, vf.node_names(nodes))
    return vf.reports(given, vf.check_safety(Tools(nodes, edges), plans))


# ---- report tables ------------------------------------------------------------------------------------------------

_MEANS = f"""{_ITEMS}, audited as (select *, case case_id % 4 when 0 then 'likely' when 1 then 'clean' when 2 then 'clean' end as audit from pairs join (select distinct model as m2, case_id as c2 from items) on m2 = model and c2 = case_id),
usable as (select * from audited where contrast in ('M2C->M3', 'M3C->M4') and a is not null and b is not null and not broken and not split)"""


def _audited(spark: SparkSession, d: str) -> DataFrame:
    audit = F.when(F.col("case_id") % 4 == 0, "likely").when((F.col("case_id") % 4).isin(1, 2), "clean")
    return _items(spark, d).withColumn("contamination_stratum", audit)


@query(f"""with {_MEANS}, f as (select model, contrast, count(*) as n, avg(b) - avg(a) as delta from usable group by all), c as (select model, contrast, count(*) as n_clean, avg(b) - avg(a) as delta_clean from usable where audit = 'clean' group by all)
select model, contrast, n, round(delta, 6) as delta, coalesce(n_clean, 0) as n_clean, round(delta_clean, 6) as delta_clean, round(delta_clean - delta, 6) as shift from f left join c using (model, contrast)""")
def contamination_table(spark: SparkSession, d: str) -> DataFrame:
    return _r(rp.contamination_table(_audited(spark, d), "score", contrasts=(("M2C", "M3"), ("M3C", "M4"))), "delta", "delta_clean", "shift")


@query(f"""with {_RUNS}, s as (select distinct case_id, case case_id % 4 when 0 then 'likely' when 3 then 'unaudited' else 'clean' end as stratum from runs) select stratum, count(*) as n_cases from s group by stratum""")
def case_strata(spark: SparkSession, d: str) -> DataFrame:
    return rp.case_strata(_audited(spark, d))


@query(f"""with {_ITEMS}, m as (select model, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, avg(b) - avg(a) as delta from pairs where contrast = 'M2C->M4' and a is not null and b is not null and not broken group by model)
select model, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(delta, 6) as delta from m""")
def compensation_table(spark: SparkSession, d: str) -> DataFrame:
    return _r(rp.compensation_table(_items(spark, d), "score", "M2C", "M4"), "mean_a", "mean_b", "delta")


@query(f"""with {_ITEMS}, v as (select model, coalesce(stratum, '') as stratum, count(*) as n, avg(a) as mean_a, avg(b) as mean_b from pairs where contrast = 'M3C->M4' and a is not null and b is not null and not broken and not split and stratum in ('deterministic', 'audit_only', 'not_applicable') group by all)
select model, stratum, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(mean_b - mean_a, 6) as delta from v""")
def verification_strata(spark: SparkSession, d: str) -> DataFrame:
    return _r(rp.verification_stratum_table(_items(spark, d), "score").select("model", "stratum", "n", "mean_a", "mean_b", "delta"), "mean_a", "mean_b", "delta")


@query(f"""with {_L}, p as (select lang as model, doc_id, toxic::double as a, quality::double as b from x where quality is not null),
g as (select model, count(*) as n, avg(a) as mean_a, avg(b) as mean_b, count(*) filter (a = 0 and b = 1) as w, count(*) filter (a = 1 and b = 0) as l from p group by model),
k as (select *, unnest(range(0, least(w, l) + 1)) as i from g),
t as (select model, case when max(w + l) = 0 then 1.0::double else least(1.0::double, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2)))) end as p from k group by model),
h as (select *, round(least(1.0::double, (count(*) over () - row_number() over (order by p, model) + 1) * p), 9) as step from t)
select g.model, 'M0->M1' as contrast, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(mean_b - mean_a, 6) as delta, 'mcnemar' as test, round(p + 1e-9, 5) as p_value, round(max(step) over (order by p, g.model rows unbounded preceding) + 1e-9, 5) as p_holm from g join h using (model)""")
def contrast_table(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).where("quality is not null")
    none = [F.lit(None).cast("string").alias(c) for c in ("parity_error", "branch_group", "verification_stratum")]
    arm = lambda c, v: x.select(F.col("lang").alias("model"), F.lit(c).alias("condition"), F.col("doc_id").alias("case_id"), F.lit(0).alias("ord"), F.col(v).cast("double").alias("score"), *none)
    out = rp.contrast_table(arm("M0", "toxic").unionByName(arm("M1", "quality")), "score")
    near = lambda c: F.round(F.col(c) + 1e-9, 5).alias(c)
    return _r(out.select("model", "contrast", "n", "mean_a", "mean_b", "delta", "test", near("p_value"), near("p_holm")), "mean_a", "mean_b", "delta")


@query(f"""with {_L}, p as (
  select 'm' || (doc_id % 2) as model, lang as fam, lang || '|' || (doc_id % 3) as st, source as c, unnest(['M0->M1', 'M0->M2']) as contrast, toxic::double as a, unnest([quality::double, (doc_id % 5 < 2)::int::double]) as b from x where quality is not null),
gr as (select model, contrast, fam, st, c, sum(b - a) as d, count(*) as n from p group by all),
sz as (select model, contrast, fam, st, count(*) as m, sum(d) / sum(n) as delta from gr group by all),
w as (select model, contrast, avg(f) as delta from (select model, contrast, fam, avg(delta) as f from sz group by all) group by all),
mb as (select model, contrast, sum(n)::bigint as n, avg(a) as mean_a, avg(b) as mean_b from (select model, contrast, fam, sum(n) as n, avg(a) as a, avg(b) as b from (select model, contrast, fam, st, count(*) as n, avg(a) as a, avg(b) as b from p group by all) group by all) group by all),
pl as (select *, row_number() over (partition by model, contrast, fam, st order by c) - 1 as place from gr),
dr as (select model, contrast, fam, st, r, ('0x' || substr(md5('20260829:' || r || ':' || fam || '/' || st || '/' || s), 1, 8))::bigint % m as place from sz, range(0, {REPS}) a(r), lateral (select unnest(range(0, m)) as s)),
ps as (select model, contrast, r, fam, st, sum(d) / sum(n) as v from dr join pl using (model, contrast, fam, st, place) group by all), pf as (select model, contrast, r, fam, avg(v) as f from ps group by all), rp as (select model, contrast, r, avg(f) as stat from pf group by all),
ci as (select model, contrast, delta, list(stat order by stat) as ss, count(*) filter (round(abs(stat - delta), 12) >= round(abs(delta), 12)) as beyond from rp join w using (model, contrast) group by all),
t as (select *, (beyond + 1)::double / {REPS + 1} as p from ci),
h as (select *, round(least(1.0::double, (count(*) over () - row_number() over (order by p, model || '|' || contrast) + 1) * p), 9) as step from t)
select model, contrast, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(delta, 6) as delta, round(ss[{_LO + 1}], 6) as ci_low, round(ss[{_HI + 1}], 6) as ci_high, round(p, 6) as p_value,
  round(max(step) over (order by p, model || '|' || contrast rows unbounded preceding), 6) as p_holm from h join mb using (model, contrast)""")
def macro_contrasts(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).where("quality is not null")
    none = [F.lit(None).cast("string").alias(c) for c in ("parity_error", "branch_group", "verification_stratum")]
    arm = lambda c, v: x.select(F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"), F.lit(c).alias("condition"), F.col("doc_id").alias("case_id"), F.lit(0).alias("ord"), v.cast("double").alias("score"), F.col("lang").alias("family"), F.concat_ws("|", "lang", F.col("doc_id") % 3).alias("subtask"), "source", *none)
    arms = arm("M0", F.col("toxic")).unionByName(arm("M1", F.col("quality"))).unionByName(arm("M2", (F.col("doc_id") % 5 < 2).cast("int")))
    out = rp.macro_contrast_table(arms, "score", "family", "subtask", "source", (("M0", "M1"), ("M0", "M2")))
    return _r(out.select("model", "contrast", "n", "mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value", "p_holm"), "mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value", "p_holm")


@query("""with e as (select event_type, event_id, (props->>'$.k')::bigint as k from events),
j as (select event_type, k % 7 = 0 as bad, case when k % 7 = 0 or k % 5 = 0 then null else least(4, greatest(0, k - 3)) / 4.0::double end as info, case when k % 7 <> 0 then (k % 9) / 2 / 4.0::double end as expl, case when k % 7 <> 0 and k % 3 > 0 then (k % 3 = 1)::int end as h from e)
select event_type, count(*) as n_judged, round(avg(info), 6) as clinical_information, round(avg(expl), 6) as explanation, round(avg(h), 6) as hallucination_rate, count(*) filter (bad) as n_errors from j group by event_type""")
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    info = F.when(F.col("k") % 5 == 0, '"none"').otherwise((F.col("k") - 3).cast("string"))
    flag = F.when(F.col("k") % 3 == 1, "true").when(F.col("k") % 3 == 2, "false").otherwise('"maybe"')
    said = F.concat(F.lit('{"clinical_information": '), info, F.lit(', "explanation": "'), ((F.col("k") % 9) / 2).cast("string"), F.lit('", "hallucination": '), flag, F.lit("}"))
    text = F.when(F.col("k") % 7 == 0, "I would rather not say").when(F.col("k") % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    return _r(jd.aggregate(jd.judged(e.select("event_type", text.alias("text"))), ["event_type"]), "clinical_information", "explanation", "hallucination_rate")
