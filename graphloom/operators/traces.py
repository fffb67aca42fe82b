"""Recorded runs: one row for each call, gates over their order, and metrics for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_enough

#: Tool specifications that may be broadcast.
MOST_SPECS = 10_000
# fixed values
BUDGET_TOTAL, BUDGET_PER_TOOL, RESULT_CHARS = 12, 4, 4000
GROUPED = ("M3", "M3C", "M4", "M2C")
MATCHED = {"M2C": "M3", "M3C": "M4"}
RECOVERED = ("fenced", "balanced_span", "repaired", "repaired_whole")
RESULT_LISTS = ("results", "candidates", "items", "entries", "findings")


def coverage_counts(steps: DataFrame, keys: list[str], phase: str | None = None) -> DataFrame:
    some = steps if phase is None else steps.where(F.col("phase") == phase)
    return some.groupBy(*keys, "coverage").agg(F.count("*").alias("n"))


def trace_metrics(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys and calls by phase, invalid calls, success rate (null without calls), distinct tools, latency, context.

    steps(keys, idx, tool, phase, ok, latency_ms, result_chars).
    """
    agent = F.col("phase") == "agent"
    g = steps.groupBy(*keys).agg(
        F.count("*").alias("n_tool_calls"),
        F.count_if(agent).alias("n_agent_calls"),
        F.count_if(~agent).alias("n_verification_calls"),
        F.count_if(agent & ~F.col("ok")).alias("n_invalid"),
        F.countDistinct(F.when(agent, F.col("tool"))).alias("n_distinct_tools"),
        F.count_if(agent & (F.col("coverage") == "not_covered")).alias("n_not_covered"),
        F.round(F.sum("latency_ms"), 2).alias("latency_ms"),
        F.sum("result_chars").alias("context_chars"),
    )
    return g.withColumn("success_rate", F.when(F.col("n_agent_calls") > 0, (F.col("n_agent_calls") - F.col("n_invalid")) / F.col("n_agent_calls")))


def tools_in_order(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Each run's tools in first-used order; a run's calls are few (the budget bounds them)."""
    first = steps.groupBy(*keys, "tool").agg(F.min("idx").alias("idx"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tool"))), lambda x: x["tool"]).alias("tools_used"))


def tool_histogram(steps: DataFrame) -> DataFrame:
    return steps.groupBy("tool").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("ok_rate"))


def budget_gate(calls: DataFrame, run: list[str], order: list[str], total: int = BUDGET_TOTAL, per_tool: int = BUDGET_PER_TOOL) -> DataFrame:
    """calls with allowed and reason: a call over the total is refused for it, else over its tool's share for that."""
    n = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    k = F.row_number().over(Window.partitionBy(*run, "tool").orderBy(*order))
    reason = F.when(F.col("n_") > total, "total").when(F.col("k_") > per_tool, "per_tool")
    return calls.withColumn("n_", n).withColumn("k_", k).withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop("n_", "k_")


def gate(calls: DataFrame, specs: DataFrame, domain: str, phase: str) -> DataFrame:
    """calls with refusal: unknown_tool, domain, phase, missing_arguments, or null; in that order.

    specs(tool, domains, phases, required); calls(tool, arguments as a map).
    """
    known = specs.withColumn("known_", F.lit(True))
    joined = calls.join(F.broadcast(known) if small_enough(specs, MOST_SPECS) else known, "tool", "left")
    blank = lambda v: v.isNull() | v.isin("", "[]", "{}", "null")
    missing = F.filter("required", lambda r: blank(F.try_element_at(F.col("arguments"), r)))
    why = F.when(F.col("known_").isNull(), "unknown_tool").when(~F.array_contains("domains", domain), "domain").when(~F.array_contains("phases", phase), "phase").when(F.size(missing) > 0, "missing_arguments")
    return joined.withColumn("refusal", why).drop("known_", "domains", "phases", "required")


def rendered(payload: Column, most: int = RESULT_CHARS) -> Column:
    """JSON text for a context window, cut so that a marker fits."""
    return F.when(F.length(payload) <= most, payload).otherwise(F.concat(F.substring(payload, 1, most - 20), F.lit('..."<truncated>"}')))


def result_count(payload: Column) -> Column:
    """How many things a JSON result lists, under the first of the usual names; 0 for none."""
    v = F.try_parse_json(payload)
    sizes = [F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in RESULT_LISTS]
    return F.coalesce(*[F.when(s >= 0, s) for s in sizes], F.lit(0)).cast("long")


def parity_errors(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs with parity_error where a control's calls differ from the arm's that it is matched with, on both."""
    out = runs.withColumn("parity_error", F.lit(None).cast("string"))
    for control, arm in MATCHED.items():
        side = lambda c, n: runs.where(F.col("condition") == c).select(*keys, F.col("n_llm_calls").alias(n))  # noqa: B023, E731
        broken = side(control, "c_").join(side(arm, "a_"), keys).where("c_ <> a_").withColumn("note_", F.format_string(f"compute parity broken: {control} used %d LLM calls, {arm} used %d", "c_", "a_")).select(*keys, "note_")
        out = out.join(broken, keys, "left").withColumn("parity_error", F.when(F.col("condition").isin(control, arm), F.coalesce("note_", "parity_error")).otherwise(F.col("parity_error"))).drop("note_")
    return out


def merge_samples(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a case as one row: steps in sample order, summed time, largest context, first parity error, sample -1."""
    return runs.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sample", "steps"))), lambda x: x["steps"])).alias("steps"),
        F.sum("wall_ms").alias("wall_ms"),
        F.max("context_chars").alias("context_chars"),
        F.min_by("parity_error", F.when(F.coalesce("parity_error", F.lit("")) != "", F.col("sample"))).alias("parity_error"),
        F.lit(-1).alias("sample"),
        F.count("*").alias("n_samples"),
    )


def missing_jobs(wanted: DataFrame, recorded: DataFrame, run_signature: str, design_signature: str, grouped: tuple[str, ...] = GROUPED) -> DataFrame:
    """case_id, condition, sample still to run: what isn't recorded under both signatures.

    Grouped conditions of a case and sample share a prefix, so if one is missing all are run again.
    """
    keys = ["case_id", "condition", "sample"]
    have = recorded.where((F.col("run_signature") == run_signature) & (F.col("design_signature") == design_signature)).select(*keys).distinct().withColumn("have_", F.lit(True))
    state = wanted.select(*keys).join(have, keys, "left").withColumn("missing_", F.col("have_").isNull())
    group = F.when(F.col("condition").isin(*grouped), F.lit("grouped")).otherwise(F.col("condition"))
    broken = state.where("missing_").select("case_id", "sample", group.alias("group_")).distinct()
    return state.withColumn("group_", group).join(broken, ["case_id", "sample", "group_"], "left_semi").select(*keys)


def score_gate(traces: DataFrame, gold: DataFrame, signature: str | None = None) -> DataFrame:
    """reason, n: why a scored result would not be one experiment; empty if it would."""
    r = lambda df, why: df.agg(F.count("*").alias("n")).select(F.lit(why).alias("reason"), "n")
    checks = [
        r(traces.groupBy("case_id", "condition", "model", "sample").count().where("count > 1"), "duplicate_rows"),
        r(traces.join(gold.select("case_id"), "case_id", "left_anti"), "no_gold"),
        r(gold.groupBy("case_id").count().where("count > 1"), "duplicate_gold"),
        r(traces.select("run_signature").distinct().agg(F.count("*").alias("k")).where("k > 1"), "mixed_run_signatures"),
        r(traces.select("design_signature").distinct().agg(F.count("*").alias("k")).where("k > 1"), "mixed_design_signatures"),
    ]
    if signature is not None:
        checks.append(r(traces.where(F.col("run_signature") != signature), "other_run_signature"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.where("n > 0")


def signature(fields: dict[str, Column | str]) -> Column:
    """sha256 over named values in the order of their names."""
    parts = [F.struct(*[(F.lit(v) if isinstance(v, str) else v).cast("string").alias(k) for k, v in sorted(fields.items())])]
    return F.sha2(F.to_json(parts[0]), 256)


def latest_generations(log: DataFrame) -> DataFrame:
    """key, completion: the last record of each request of an append-only log(key, completion, ord)."""
    return log.groupBy("key").agg(F.max_by("completion", "ord").alias("completion"))


def replay(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests with completion and hit; a miss is a row with an error, never a call."""
    out = requests.join(latest_generations(log).withColumn("hit", F.lit(True)), "key", "left")
    return out.withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("error", F.when(~F.col("hit"), "replay miss"))
