"""Report tables: contrasts of conditions with the tests that fit them, and how they depend on families, strata, audits and models.

items(model, condition, case_id, ord, parity_error, branch_group, verification_stratum, metrics ...): the last record of a case counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import save
from . import evaluation as ev
from . import statistics as st

# ---- fixed values -------------------------------------------------------------------------------------------------
KG_CONTRASTS = (("M1", "M2"), ("M2C", "M3"))
VERIFICATION_STRATA = ("deterministic", "audit_only", "not_applicable")
#: target, dataset, metric
TARGETS = (("PA (all rules)", "pa", "exact"), ("SDT task 3 syndrome", "sdt", "task3_syndrome"), ("SDT task 2 pathogenesis", "sdt", "task2_pathogenesis"), ("SDT task 1 clinical info", "sdt", "task1_clinical_information"), ("SDT task 4 explanation", "sdt", "task4_explanation"))
#: How what a target asks for is in the graph: as entities and edges, in part, as nothing of its own, or not at all.
RELATION_TO_GRAPH = {"PA (all rules)": "explicit", "SDT task 3 syndrome": "partial", "SDT task 2 pathogenesis": "implicit", "SDT task 1 clinical info": "unaided", "SDT task 4 explanation": "unaided"}
GROUNDABILITY = {
    "A-002": "grounded", "A-006": "grounded", "N-003": "grounded",
    "A-004": "partial", "A-005": "partial", "A-007": "partial", "A-008": "partial", "N-007": "partial", "N-009": "partial",
    "A-001": "not grounded", "A-003": "not grounded", "A-009": "not grounded", "N-001": "not grounded", "N-002": "not grounded", "N-004": "not grounded", "N-005": "not grounded", "N-006": "not grounded", "N-008": "not grounded", "C-001": "not grounded",
}
# -------------------------------------------------------------------------------------------------------------------


def all_pairs(items: DataFrame, metric: str, contrasts: Sequence[tuple[str, str]], cluster: str | None = None, stratum: str | None = None) -> DataFrame:
    """contrast, model, case_id, a, b, cluster of all contrasts."""
    out = None
    for first, last in contrasts:
        part = ev.pair_conditions(items, first, last, metric, cluster=cluster, stratum=stratum).withColumn("contrast", F.lit(f"{first}->{last}"))
        out = part if out is None else out.unionByName(part)
    return out.select("contrast", "model", "case_id", "a", "b", "cluster")


def tested(pairs: DataFrame, keys: list[str], unit: str = "case_id", binary: bool | None = None, clustered: bool = False, resamples: int = st.RESAMPLES) -> DataFrame:
    """keys, n, mean_a, mean_b, delta, ci_low, ci_high, test, p_value, p_wilcoxon.

    Clustered pairs: the cluster bootstrap.  Else the exact test where all values are 0 or 1 (or binary says so), which has no
    interval, and the paired bootstrap elsewhere, with the signed ranks beside it.
    """
    pairs = save(pairs, "pairs")
    means = pairs.groupBy(*keys).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    none = F.lit(None).cast("double")
    columns = [*keys, "n", "delta", "ci_low", "ci_high", "test", "p_value", "p_wilcoxon"]
    if clustered:
        out = st.cluster_bootstrap(pairs, keys, "cluster", resamples=resamples).withColumn("test", F.lit("cluster_bootstrap")).withColumn("p_wilcoxon", none).select(*columns)
    else:
        kind = st.is_binary(pairs, keys) if binary is None else pairs.select(*keys).distinct().withColumn("binary", F.lit(binary))
        kind = save(kind, "kinds")
        some = lambda flag: pairs.join(kind.where(F.col("binary") == flag).select(*keys), keys, "left_semi")
        exact = st.mcnemar(some(True), keys).withColumn("test", F.lit("mcnemar")).withColumn("ci_low", none).withColumn("ci_high", none).withColumn("p_wilcoxon", none)
        ranks = st.wilcoxon(some(False), keys).select(*keys, F.col("p_value").alias("p_wilcoxon"))
        drawn = st.paired_bootstrap(some(False), keys, unit, resamples=resamples).withColumn("test", F.lit("paired_bootstrap")).join(ranks, keys, "left")
        out = exact.select(*columns).unionByName(drawn.select(*columns))
    return out.join(means, keys)


def corrected(tests: DataFrame, keys: list[str], alpha: float = st.ALPHA) -> DataFrame:
    """tests with p_holm over all of them, and whether it is below alpha."""
    named = tests.withColumn("name", F.concat_ws("|", *keys))
    return st.holm(named, []).drop("name").withColumn("significant", F.col("p_holm") < alpha)


def contrast_table(items: DataFrame, metric: str, contrasts: Sequence[tuple[str, str]] = ev.CONTRASTS, binary: bool | None = None, cluster: str | None = None, resamples: int = st.RESAMPLES) -> DataFrame:
    """One row for each model and contrast that has usable pairs, corrected over all of them; cluster: a column of the items to resample by."""
    pairs = all_pairs(items, metric, contrasts, cluster)
    return corrected(tested(pairs, ["model", "contrast"], binary=binary, clustered=cluster is not None, resamples=resamples), ["model", "contrast"])


def macro_contrast_table(items: DataFrame, metric: str, family: str, subtask: str, cluster: str, contrasts: Sequence[tuple[str, str]] = ev.CONTRASTS, resamples: int = st.RESAMPLES) -> DataFrame:
    """contrast_table() for the mean over families of the means over their subtasks: interval and test are of that very mean.

    All models and contrasts are one job.
    """
    labels = ev.latest(items, ["model", "condition", "case_id"], "ord").select("model", F.col("condition").alias("first_"), "case_id", F.col(family).cast("string").alias("family"), F.coalesce(F.col(subtask).cast("string"), F.lit("unknown")).alias("stratum"))
    pairs = all_pairs(items, metric, contrasts, cluster).withColumn("first_", F.substring_index("contrast", "->", 1))
    pairs = save(pairs.join(labels, ["model", "first_", "case_id"]).drop("first_"), "macro-pairs")
    keys = ["model", "contrast"]
    boot = st.macro_bootstrap(pairs, "family", "stratum", "cluster", resamples=resamples, keys=keys)
    by = pairs.groupBy(*keys, "family", "stratum").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("n")).groupBy(*keys, "family").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.sum("n").alias("n"))
    mean = by.groupBy(*keys).agg(F.sum("n").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    out = mean.join(boot, keys).select(*keys, "n", "mean_a", "mean_b", "delta", "ci_low", "ci_high", "p_value")
    return corrected(save(out, "macro"), keys)


def verification_stratum_table(items: DataFrame, metric: str, first: str = "M3C", last: str = "M4", least: int = st.MIN_STRATUM, resamples: int = st.RESAMPLES) -> DataFrame:
    """model, stratum, n, means, delta; interval and p only for strata of ``least`` pairs or more."""
    out = None
    for stratum in VERIFICATION_STRATA:
        part = ev.pair_conditions(items, first, last, metric, stratum=stratum).withColumn("stratum", F.lit(stratum))
        out = part if out is None else out.unionByName(part)
    pairs, keys = save(out, "stratum-pairs"), ["model", "stratum"]
    means = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (F.avg("b") - F.avg("a")).alias("delta"))
    large = pairs.join(means.where(f"n >= {least}").select(*keys), keys, "left_semi")
    return means.join(tested(large, keys, resamples=resamples).select(*keys, "ci_low", "ci_high", "test", "p_value"), keys, "left")


def case_strata(items: DataFrame, stratum: str = "contamination_stratum") -> DataFrame:
    """stratum, n_cases: each case once, by its first record; cases without one are unaudited."""
    first = items.groupBy("case_id").agg(F.min_by(F.coalesce(F.nullif(F.col(stratum).cast("string"), F.lit("")), F.lit("unaudited")), "ord").alias("stratum"))
    return first.groupBy("stratum").agg(F.count("*").alias("n_cases"))


def contamination_table(items: DataFrame, metric: str, stratum: str = "contamination_stratum", contrasts: Sequence[tuple[str, str]] = KG_CONTRASTS) -> DataFrame:
    """model, contrast, n, delta, n_clean, delta_clean, shift: contrasts that a leak would inflate, on all cases and on clean ones."""
    keys = ["model", "contrast"]
    summed = lambda df, n, d: all_pairs(df, metric, contrasts).groupBy(*keys).agg(F.count("*").alias(n), (F.avg("b") - F.avg("a")).alias(d))
    clean = summed(items.where(F.col(stratum) == "clean"), "n_clean", "delta_clean")
    both = summed(items, "n", "delta").join(clean, keys, "left")
    return both.select(*keys, "n", "delta", F.coalesce("n_clean", F.lit(0)).alias("n_clean"), "delta_clean", (F.col("delta_clean") - F.col("delta")).alias("shift"))


def compensation_table(items: DataFrame, metric: str, base: str = "M0", enhanced: str = "M3") -> DataFrame:
    """model, n, mean_a, mean_b, delta: what the framework adds to each model."""
    pairs = ev.pair_conditions(items, base, enhanced, metric)
    return pairs.groupBy("model").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (F.avg("b") - F.avg("a")).alias("delta"))


def compensation(table: DataFrame) -> DataFrame:
    """n, r: rank correlation of base scores and gains over models; negative: weaker models gain more."""
    return st.spearman(table.withColumn("all_", F.lit(1)), ["all_"], "mean_a", "delta").drop("all_")


def target_gains(items: DataFrame, targets: Sequence[tuple[str, str, str]] = TARGETS, first: str = "M0", last: str = "M3") -> DataFrame:
    """target, n_models, mean_first, mean_delta: each target's gain, models counting alike; items have a dataset column."""
    out = None
    for target, dataset, metric in targets:
        if metric not in items.columns:
            continue
        by = compensation_table(items.where(F.col("dataset") == dataset), metric, first, last)
        row = by.agg(F.count("*").alias("n_models"), F.avg("mean_a").alias("mean_first"), F.avg("delta").alias("mean_delta")).where("n_models > 0").select(F.lit(target).alias("target"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def explicit_vs_implicit(gains: DataFrame) -> DataFrame:
    """relation, n_targets, mean_first, mean_delta of target_gains(): targets whose knowledge the graph holds against those that it only narrows (D19)."""
    known = F.create_map(*[F.lit(x) for kv in RELATION_TO_GRAPH.items() for x in kv])
    return gains.groupBy(F.coalesce(known[F.col("target")], F.lit("unknown")).alias("relation")).agg(F.count("*").alias("n_targets"), F.avg("mean_first").alias("mean_first"), F.avg("mean_delta").alias("mean_delta"))


def groundability(rule: Column) -> Column:
    """Whether the graph can ground a family of rules."""
    known = F.create_map(*[F.lit(x) for kv in GROUNDABILITY.items() for x in kv])
    return F.coalesce(known[F.upper(rule)], F.lit("unknown"))


def groundability_table(items: DataFrame, metric: str, rule: str = "rule_id", conditions: Sequence[str] = ev.CONDITIONS) -> DataFrame:
    """verdict, items, a mean for each condition, delta from the first to the last of them."""
    named = items.withColumn("verdict", groundability(F.coalesce(F.col(rule).cast("string"), F.lit("?"))))
    sizes = named.groupBy("verdict").agg(F.countDistinct("case_id").alias("items"))
    return sizes.join(ev.with_delta(ev.grid(named, "verdict", "condition", metric, conditions), conditions[0], conditions[-1]), "verdict", "left")


def compare(base: DataFrame, candidate: DataFrame, metric: str, resamples: int = st.RESAMPLES) -> DataFrame:
    """One row of tested() for two score tables: the last records of cases that both have; an absent metric counts as 0."""
    keys = ["model", "condition", "case_id"]
    side = lambda df, n: ev.latest(df.select(*keys, "ord", F.coalesce(F.col(metric).cast("double"), F.lit(0.0)).alias("v_")), keys, "ord").select(*keys, F.col("v_").alias(n))
    pairs = side(base, "a").join(side(candidate, "b"), keys)
    unit = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])
    return tested(pairs.select(F.lit(metric).alias("metric"), unit.alias("case_id"), "a", "b", unit.alias("cluster")), ["metric"], resamples=resamples)
