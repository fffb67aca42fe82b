"""Aggregates of scored items: means that know absence, grids, pivots, votes, quotas, pairs, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
CONDITIONS = ("M0", "M1", "M2", "M3", "M4", "M2C", "M3C")
CONTRASTS = (("M0", "M1"), ("M1", "M2"), ("M2", "M3"), ("M3", "M4"), ("M2C", "M3"), ("M3C", "M4"), ("M0", "M3"))
#: Arms that one invocation makes together: their pairs must share a branch group.
TOGETHER = (("M3", "M3C"), ("M3", "M4"), ("M3C", "M4"), ("M2C", "M3"))
PARITY_RANGE = (0.8, 1.25)
LIST_FALLBACK = 5


def metric_means(items: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """keys, n and the mean of each metric over the rows that have it (null if none has)."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])


def label_or_unknown(*candidates: Column) -> Column:
    """The first label that isn't null, empty or zero."""
    return F.coalesce(*[F.when(~F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), c.cast("string")) for c in candidates], F.lit("unknown"))


def macro_mean(items: DataFrame, keys: list[str], family: str, stratum: str, metric: str) -> DataFrame:
    """The mean over families of the mean over their strata: small strata count as much as large ones."""
    by = items.groupBy(*keys, family, stratum).agg(F.avg(metric).alias("m_"))
    return by.groupBy(*keys, family).agg(F.avg("m_").alias("m_")).groupBy(*keys).agg(F.avg("m_").alias("macro_mean"), F.count("*").alias("n_families"))


def grid(items: DataFrame, row: str, column: str, metric: str, values: Sequence[str]) -> DataFrame:
    """One row for each ``row``, one mean for each value of ``column``."""
    return items.groupBy(row).pivot(column, list(values)).agg(F.avg(metric))


def with_delta(pivoted: DataFrame, first: str, last: str) -> DataFrame:
    return pivoted.withColumn("delta", F.col(last) - F.col(first))


def conditional_means(items: DataFrame, keys: list[str], metric: str, flag: Column) -> DataFrame:
    """n, n_flagged, the mean of all and of those without the flag."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), F.avg(metric).alias("mean_all"), F.avg(F.when(~flag, F.col(metric))).alias("mean_clean"))


def shares(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.select(key, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def majority(votes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the least."""
    counts = votes.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("neg"), F.col(value).alias("value"))).alias("m"), F.sum("votes").alias("n"))
    return best.select(*keys, F.col("m.value").alias(value), (-F.col("m.neg")).alias("votes"), "n")


def consensus(picks: DataFrame, keys: list[str], sample: str, option: str, theta: float = 0.5, fallback: int = 1) -> DataFrame:
    """Options with more than theta of the samples' votes, sorted; without any, the ``fallback`` ones with most votes (the least of equals first).

    picks(keys, sample, option); a sample without options has one row with a null option.  Letters fall back to 1, lists of findings to LIST_FALLBACK.
    """
    n = picks.groupBy(*keys).agg(F.countDistinct(sample).alias("n_samples"))
    votes = picks.where(F.col(option).isNotNull()).groupBy(*keys, option).agg(F.countDistinct(sample).alias("votes")).join(n, keys)
    need = F.when(F.col("n_samples") > 1, F.floor(F.lit(theta) * F.col("n_samples")) + 1).otherwise(F.lit(1))
    kept = votes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("votes") >= need, F.col(option)))).alias("kept"), F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.col(option).alias("o")))).alias("best"))
    most = F.transform(F.slice("best", 1, fallback), lambda b: b["o"])
    picked = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.coalesce(most, F.array().cast("array<string>")))
    return n.join(kept, keys, "left").select(*keys, "n_samples", picked.alias("consensus"))


def medoid(texts: DataFrame, keys: list[str], sample: str, grams: str) -> DataFrame:
    """The sample most like the others of its key by summed F measure of gram sets; the first of equals.

    Samples of a key are few (a handful of runs of one case), so pairs within a key are few.
    """
    from ..functions.text import set_f1

    a, b = texts.select(*keys, F.col(sample).alias("s_"), F.col(grams).alias("ga")), texts.select(*keys, F.col(sample).alias("t_"), F.col(grams).alias("gb"))
    total = a.join(b, keys).groupBy(*keys, "s_").agg(F.sum(F.when(F.col("s_") != F.col("t_"), set_f1(F.col("ga"), F.col("gb"))).otherwise(F.lit(0.0))).alias("f"))
    best = total.groupBy(*keys).agg(F.min(F.struct((-F.round("f", 9)).alias("f"), F.col("s_").alias("s"))).alias("m"))
    return best.select(*keys, F.col("m.s").alias(sample))


def latest(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: log tables in which later records win."""
    cols = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("m_")).select(*keys, "m_.*")


def _arms(items: DataFrame, first: str, last: str, metric: Column, keys: list[str], order: str, cluster: Column) -> DataFrame:
    """keys, a, b, broken, split, stratum, cluster for every case that both conditions have, the latest record of each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = items.select(*keys, "condition", F.col(order).alias("o_"), metric.cast("double").alias("v"), text("parity_error").alias("p"), text("branch_group").alias("g"), text("verification_stratum").alias("s"), cluster.cast("string").alias("c"))
    side = lambda condition, n: latest(own.where(F.col("condition") == condition).drop("condition"), keys, "o_").select(*keys, *[F.col(x).alias(f"{x}{n}") for x in "vpgsc"])
    both = side(first, "a").join(side(last, "b"), keys)
    split = (F.col("ga") == "") | (F.col("ga") != F.col("gb")) if (first, last) in TOGETHER else F.lit(False)
    return both.select(*keys, F.col("va").alias("a"), F.col("vb").alias("b"), ((F.col("pa") != "") | (F.col("pb") != "")).alias("broken"), split.alias("split"), F.when(F.col("sb") != "", F.col("sb")).otherwise(F.col("sa")).alias("stratum"), F.coalesce("ca", F.col(keys[-1]).cast("string")).alias("cluster"))


def pair_conditions(items: DataFrame, first: str, last: str, metric: str, keys=("model", "case_id"), order: str = "ord", stratum: str | None = None, cluster: str | None = None) -> DataFrame:
    """keys, a, b, cluster for cases that both conditions have and that can be compared.

    Both have the metric and neither a parity error.  Arms that one invocation makes together need one branch group, and a
    missing or blank group is none; other arms need no group.  stratum: only cases whose verification (the last arm's, else the
    first's) came to it.  cluster: a column of the first arm to resample by, the case itself where that is null or blank.
    """
    by = F.lit(None) if cluster is None else F.nullif(F.col(cluster).cast("string"), F.lit(""))
    both = _arms(items, first, last, F.col(metric), list(keys), order, by).where("a is not null and b is not null and not broken and not split")
    return (both if stratum is None else both.where(F.col("stratum") == stratum)).select(*keys, "a", "b", "cluster")


def dropped_pairs(items: DataFrame, first: str, last: str, keys=("model", "case_id"), order: str = "ord") -> DataFrame:
    """model, n_pairs, n_parity, n_split_group of every model of the items: pairs that a contrast can't use, broken parity before split groups."""
    both = _arms(items, first, last, F.lit(None), list(keys), order, F.lit(None))
    counted = both.groupBy(keys[0]).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("broken")).alias("n_parity"), F.count_if(~F.col("broken") & F.col("split")).alias("n_split_group"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pairs", "n_parity", "n_split_group")]
    return items.select(keys[0]).distinct().join(counted, keys[0], "left").select(keys[0], *zero)


def parity_table(items: DataFrame, control: str, arm: str, calls: str = "n_llm_calls", tokens: str = "total_tokens") -> DataFrame:
    """model, mean calls and tokens of control and arm, ratios, breaks, verdict: ok without a break and with the calls' ratio in range."""
    some = items.where(F.col("condition").isin(control, arm))
    mean = lambda c, v: F.avg(F.when(F.col("condition") == c, F.col(v)))
    g = some.groupBy("model").agg(mean(control, calls).alias("control_calls"), mean(arm, calls).alias("arm_calls"), mean(control, tokens).alias("control_tokens"), mean(arm, tokens).alias("arm_tokens"), F.count_if(F.coalesce("parity_error", F.lit("")) != "").alias("breaks"))
    ratio = F.when(F.col("arm_calls") > 0, F.col("control_calls") / F.col("arm_calls"))
    g = g.withColumn("call_ratio", ratio).withColumn("token_ratio", F.when(F.col("arm_tokens") > 0, F.col("control_tokens") / F.col("arm_tokens")))
    return g.withColumn("verdict", F.when((F.col("breaks") == 0) & F.col("call_ratio").between(*PARITY_RANGE), "ok").otherwise("check"))


def contrast_pairs(items: DataFrame, contrasts: Sequence[tuple[str, str]], metric: str) -> DataFrame:
    """contrast, model, case_id, a, b for all contrasts at once."""
    out = None
    for first, last in contrasts:
        part = pair_conditions(items, first, last, metric).drop("cluster").withColumn("contrast", F.lit(f"{first}->{last}"))
        out = part if out is None else out.unionByName(part)
    return out


def quota_table(counts: list[tuple[str, int]], limit: int) -> dict[str, int]:
    """Even shares of a limit over strata (a small list); what short strata leave is shared by the others, in order of their names."""
    left, quotas, open_ = limit, {s: 0 for s, _ in counts}, sorted(counts)
    while left > 0 and open_:
        share = left // len(open_)
        for i, (s, n) in enumerate(open_):
            take = min(n - quotas[s], share or int(i < left))
            quotas[s] += take
        left = limit - sum(quotas.values())
        open_ = [(s, n) for s, n in open_ if quotas[s] < n]
    return quotas


def stratified_quota(df: DataFrame, stratum: str, order: str, limit: int) -> DataFrame:
    """The first rows of each stratum up to its quota, in all ``limit`` rows.

    Null, empty, zero and false strata are one, "unknown", as they are for quotas.  Only the strata's counts come to the driver.
    """
    name, rank = "stratum_", "rn_"
    plain = df.schema[stratum].dataType.simpleString() == "string"
    label = F.coalesce(F.nullif(F.col(stratum), F.lit("")), F.lit("unknown")) if plain else label_or_unknown(F.col(stratum))
    named = df.withColumn(name, label)
    quotas = quota_table([(r[0], r[1]) for r in named.groupBy(name).count().collect()], limit)
    known = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]) if quotas else F.create_map(F.lit(""), F.lit(0))
    ranked = named.withColumn(rank, F.row_number().over(Window.partitionBy(name).orderBy(order)))
    return ranked.where(F.col(rank) <= limit).where(F.col(rank) <= known[F.col(name)]).drop(name, rank)


def unique_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Repeated ids get #2, #3 in order."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return df.withColumn("n_", n).withColumn(id_col, F.when(F.col("n_") > 1, F.concat_ws("#", F.col(id_col), F.col("n_"))).otherwise(F.col(id_col).cast("string"))).drop("n_")


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A pipe table of a small frame."""
    show = lambda v: "–" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in row) + " |" for row in df.collect()])
