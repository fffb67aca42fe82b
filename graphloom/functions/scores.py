"""Row-level scores of predictions; absent is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import longest_common_subsequence

# ---- fixed values -------------------------------------------------------------------------------------------------
COMPOSITE_WEIGHTS = (0.2, 0.3, 0.4, 0.1)
MOVE_ON, UNSAFE_GOLD, UNCERTAIN = ("B", "C"), ("A", "D"), "D"
TRANSITION_TASK = "CP6_transition_decision"
FAMILIES = {
    "CP1": ("CP1_pathway_eligibility",),
    "CP2": ("CP2_stage_identification",),
    "CP3": ("CP3_stage_actions",),
    "CP4": ("CP4_treatment_principle", "CP4_formula", "CP4_patent_medicine", "CP4_external_therapy"),
    "CP5": ("CP5_monitoring",),
    "CP6": ("CP6_transition_decision",),
    "CP4G": ("CP4G_cross_disease_treatment",),
}
PRIMARY_FAMILIES = ("CP1", "CP2", "CP3", "CP4", "CP5", "CP6")
VERDICTS_WORST_FIRST = ("contradicted", "contradicted_by_graph", "partially_supported", "not_in_graph", "not_covered", "supported")
GRAPH_CLAIMS = ("知识图谱", "图谱显示", "图谱记载", "根据图谱", "图谱表明")
GAP_ADMISSIONS = ("图谱未", "图谱不", "未覆盖", "无据", "图谱没有", "不收录", "未收录")
UNCOVERED_TOPICS = {"dose": ("剂量", "用量", "超量", "克", "g", "用法用量"), "incompatibility": ("十八反", "十九畏", "配伍禁忌", "相反", "相畏"), "pregnancy": ("妊娠", "孕妇", "孕期"), "drug_interaction": ("相互作用", "中西药联用")}
EXPECTED_TOOLS = {
    "A-002": ("retrieve_clinical_context", "retrieve_syndrome_evidence", "retrieve_medication_knowledge"),
    "A-003": ("check_dose", "retrieve_pharmacopeia_entry"),
    "A-004": ("retrieve_medication_knowledge", "check_dose"),
    "A-005": ("check_decoction_requirement", "retrieve_medication_knowledge", "retrieve_pharmacopeia_entry"),
    "A-006": ("retrieve_pharmacopeia_entry", "retrieve_medication_knowledge"),
    "A-007": ("retrieve_safety_constraints", "check_restricted_item"),
    "A-008": ("check_duplicate_medication", "retrieve_medication_knowledge"),
    "A-009": ("check_combination", "retrieve_safety_constraints"),
    "N-002": ("retrieve_medication_knowledge", "retrieve_source_evidence"),
    "N-003": ("check_decoction_requirement", "retrieve_pharmacopeia_entry"),
    "N-007": ("retrieve_safety_constraints", "retrieve_pharmacopeia_entry", "check_restricted_item"),
    "N-009": ("retrieve_safety_constraints", "check_restricted_item"),
}
SEARCH_TOOL = "search_tcm_entities"
# -------------------------------------------------------------------------------------------------------------------


def _d(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def gold_recall(prediction: Column, gold: Column) -> Column:
    """Share of the gold items, repeats counted, that are predicted; 0 without gold."""
    hits = F.size(F.filter(gold, lambda g: F.array_contains(prediction, g)))
    return F.when(F.size(gold) > 0, hits / F.size(gold)).otherwise(F.lit(0.0))


def proportional_score(prediction: Column, gold: Column) -> Column:
    """right / (gold + wrong): every wrong pick dilutes."""
    under = F.size(F.array_distinct(gold)) + F.size(F.array_except(prediction, gold))
    return F.when(under > 0, F.size(F.array_intersect(prediction, gold)) / under).otherwise(F.lit(0.0))


def composite(t1: Column, t2: Column, t3: Column, t4: Column, answered: Column | None = None) -> Column:
    a, b, c, d = COMPOSITE_WEIGHTS
    total = a * t1 + b * t2 + c * t3 + d * t4
    return total if answered is None else F.when(answered, total).otherwise(F.lit(0.0))


def explanation_score(prediction: Column, reference: Column, newline: bool = True) -> Column:
    """Subsequence F measure; by default both sides end in a newline, so that even an empty explanation scores something."""
    end = F.lit("\n" if newline else "")
    p, r = F.concat(F.coalesce(prediction, F.lit("")), end), F.concat(F.coalesce(reference, F.lit("")), end)
    n = longest_common_subsequence(p, r)
    return F.when((F.length(p) == 0) | (F.length(r) == 0) | (n == 0), F.lit(0.0)).otherwise(2.0 * n / (F.length(p) + F.length(r)))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def multi_select(prediction: Column, gold: Column) -> Column:
    """struct(answered, exact, partial_credit, jaccard): any wrong letter forfeits the partial credit."""
    p, g = F.coalesce(prediction, F.array().cast("array<string>")), F.coalesce(gold, F.array().cast("array<string>"))
    both, any_ = F.size(F.array_intersect(p, g)), F.size(F.array_union(p, g))
    return F.struct(
        _d(F.size(p) > 0).alias("answered"),
        _d((F.size(p) > 0) & same_set(p, g)).alias("exact"),
        F.when((F.size(F.array_except(p, g)) > 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_distinct(g))).alias("partial_credit"),
        F.when(any_ > 0, both / any_).otherwise(F.lit(0.0)).alias("jaccard"),
    )


def family_of(subtask: Column) -> Column:
    known = F.create_map(*[F.lit(x) for f, tasks in FAMILIES.items() for t in tasks for x in (t, f)])
    return F.coalesce(known[subtask], F.lit("other"))


def pathway_item(subtask: Column, prediction: Column, gold: Column) -> Column:
    """struct(answered, exact, precision, recall, f1, unsafe_transition, missed_uncertainty); a null prediction is unanswered.

    The last two are null but for transition items.  No answer is no unsafe answer.
    """
    p, answered = F.coalesce(prediction, F.array().cast("array<string>")), prediction.isNotNull()
    both, n, m = F.size(F.array_intersect(p, gold)), F.size(F.array_distinct(p)), F.size(F.array_distinct(gold))
    precision, recall = F.when(n > 0, both / n).otherwise(F.lit(0.0)), F.when(m > 0, both / m).otherwise(F.lit(0.0))
    letters = lambda xs: F.array(*[F.lit(x) for x in xs])
    unsafe = F.arrays_overlap(gold, letters(UNSAFE_GOLD)) & F.arrays_overlap(p, letters(MOVE_ON))
    return F.struct(
        answered.cast("double").alias("answered"),
        _d((n > 0) & same_set(p, gold)).alias("exact"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(both > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)).alias("f1"),
        F.when(subtask == TRANSITION_TASK, _d(unsafe)).alias("unsafe_transition"),
        F.when(subtask == TRANSITION_TASK, _d(F.array_contains(gold, UNCERTAIN) & ~F.array_contains(p, UNCERTAIN))).alias("missed_uncertainty"),
    )


def worst_verdict(verdicts: Column) -> Column:
    order = F.array(*[F.lit(v) for v in VERDICTS_WORST_FIRST])
    places = F.filter(F.transform(verdicts, lambda v: F.array_position(order, v)), lambda x: x > 0)
    return F.when(F.size(places) > 0, F.element_at(order, F.array_min(places).cast("int"))).otherwise(F.lit("no_verdict"))


def verification_stratum(verdict: Column, n_checks: Column) -> Column:
    return F.when(verdict == "not_applicable", "not_applicable").when(F.coalesce(n_checks, F.lit(0)) > 0, "deterministic").otherwise("audit_only")


def topics_mentioned(prose: Column) -> Column:
    """Topics that the graph doesn't cover and the prose mentions; null for no prose."""
    hits = F.array(*[F.when(_any(prose, words), F.lit(t)) for t, words in UNCOVERED_TOPICS.items()])
    return F.when(F.trim(F.coalesce(prose, F.lit(""))) != "", F.array_compact(hits))


def coverage_honesty(uncovered: Column, prose: Column) -> Column:
    """Null unless something was not covered and there is prose; 0 for claiming the graph without admitting the gap."""
    claims, admits = _any(prose, GRAPH_CLAIMS), _any(prose, GAP_ADMISSIONS)
    return F.when(uncovered & (F.coalesce(prose, F.lit("")) != ""), F.when(claims & ~admits, F.lit(0.0)).otherwise(F.lit(1.0)))


def tool_selection(rule: Column, tools: Column, valid: Column) -> Column:
    """Share of the agent's valid calls that hit the rule's tools or the search; null without a rule or calls, 0 without a valid one."""
    expected = F.create_map(*[x for r, ts in EXPECTED_TOOLS.items() for x in (F.lit(r), F.array(*[F.lit(t) for t in ts]))])[F.upper(rule)]
    good = F.transform(F.filter(F.arrays_zip(tools.alias("t"), valid.alias("v")), lambda x: x["v"]), lambda x: x["t"])
    hits = F.filter(good, lambda t: F.array_contains(expected, t) | (t == SEARCH_TOOL))
    return F.when(expected.isNull() | (F.size(tools) == 0), F.lit(None).cast("double")).when(F.size(good) == 0, F.lit(0.0)).otherwise(F.size(hits) / F.size(good))


def probe_rate(queries: Column, options: Column) -> Column:
    """Share of search queries that contain an option's text; null without queries or options."""
    asked = F.filter(queries, lambda q: F.trim(q) != "")
    names = F.filter(F.transform(F.map_values(options), lambda v: F.trim(v)), lambda v: v != "")
    hits = F.size(F.filter(asked, lambda q: F.exists(names, lambda n: F.contains(q, n))))
    return F.when((F.size(asked) > 0) & (F.size(options) > 0), hits / F.size(asked))


def judge_score(raw: Column) -> Column:
    """0 to 4 as a share; what can't be read is null."""
    x = raw.try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(4.0), x)) / 4)


def cost(prompt_tokens: Column, completion_tokens: Column, price_in: float, price_out: float) -> Column:
    return F.round((prompt_tokens * price_in + completion_tokens * price_out) / 1_000_000, 6)
