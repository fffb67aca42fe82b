"""Paired statistics as aggregates: resampling, exact and rank tests, corrections for many tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_enough

# fixed values
RESAMPLES, SEED, ALPHA, MIN_STRATUM = 10_000, 20260829, 0.05, 20
#: Cluster sums that may be broadcast to the draws, at some 60 bytes each.
MOST_BROADCAST = 100_000


def pick(seed: int, rep: Column, slot: Column, n: Column) -> Column:
    """A pseudo-random place below n: 32 bits of an md5, the same in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), slot.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n)


def _slots(sizes: DataFrame, resamples: int) -> DataFrame:
    """sizes(m, ...) with rep and slot for every draw; repetitions are dealt out first, since sizes may be a single row."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")).repartition(parts, "rep")
    return reps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("slot"))


def _beside_draws(sums: DataFrame) -> DataFrame:
    """The side of the join that is built; without a hint Spark takes the draws, whose number it can't estimate."""
    return F.broadcast(sums) if small_enough(sums, MOST_BROADCAST) else sums.hint("shuffle_hash")


def _interval(reps: DataFrame, keys: list[str], resamples: int, alpha: float) -> DataFrame:
    """Percentiles and p of repetitions; a statistic exactly as far off as delta counts, to 12 digits, since the order of sums moves the last ones."""
    lo, hi = max(0, int(alpha / 2 * resamples) - 1), min(resamples - 1, int((1 - alpha / 2) * resamples))
    g = reps.groupBy(*keys, "delta").agg(F.array_sort(F.collect_list("stat")).alias("s"), F.count_if(F.round(F.abs(F.col("stat") - F.col("delta")), 12) >= F.round(F.abs("delta"), 12)).alias("beyond"))
    return g.select(*keys, "delta", F.get("s", F.lit(lo)).alias("ci_low"), F.get("s", F.lit(hi)).alias("ci_high"), ((F.col("beyond") + 1) / F.lit(resamples + 1)).alias("p_value"))


def cluster_bootstrap(pairs: DataFrame, keys: list[str], cluster: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """keys, n, n_clusters, delta, ci_low, ci_high, p_value for pairs(keys, cluster, a, b): whole clusters drawn with replacement.

    Clusters are summed up first.  The draws of a repetition are a table of (repetition, slot) rows that meet the sums in an equi-join
    and are summed before they meet again, so what grows is resamples x clusters, spread over the cluster; unclustered pairs are clusters of one.
    """
    sums = pairs.groupBy(*keys, F.col(cluster).alias("c_")).agg(F.sum(F.col("b") - F.col("a")).alias("d"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("c_") if keys else Window.partitionBy(F.lit(0)).orderBy("c_")
    placed = sums.withColumn("place", F.row_number().over(w) - 1)
    total = sums.groupBy(*keys).agg(F.sum("d").alias("sd"), F.sum("n").alias("sn"), F.count("*").alias("m"))
    total = total.withColumn("delta", F.col("sd") / F.col("sn"))
    slots = _slots(total.select(*keys, "m", "delta"), resamples)
    drawn = slots.select(*keys, "delta", "rep", pick(seed, F.col("rep"), F.col("slot"), F.col("m")).cast("int").alias("place"))
    reps = drawn.join(_beside_draws(placed.select(*keys, "place", "d", "n")), [*keys, "place"]).groupBy(*keys, "delta", "rep").agg((F.sum("d") / F.sum("n")).alias("stat"))
    interval = _interval(reps, keys, resamples, alpha).drop("delta")
    out = total.select(*keys, F.col("sn").alias("n"), F.col("m").alias("n_clusters"), "delta")
    return out.join(interval, keys) if keys else out.crossJoin(interval)


def paired_bootstrap(pairs: DataFrame, keys: list[str], unit: str, **kwargs) -> DataFrame:
    """cluster_bootstrap() with each pair for itself, and wins, losses, ties."""
    signs = pairs.groupBy(*keys).agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    out = cluster_bootstrap(pairs, keys, unit, **kwargs).drop("n_clusters")
    return out.join(signs, keys) if keys else out.crossJoin(signs)


def macro_bootstrap(pairs: DataFrame, family: str | None, stratum: str, cluster: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, keys: list[str] | None = None) -> DataFrame:
    """keys, delta, ci_low, ci_high, p_value of the mean over families of the mean over their strata; clusters are drawn within strata.

    All keys are one job, and the same draws serve each of them.  Without families all strata count alike.  A stratum in two
    families is an error.
    """
    keys = keys or []
    fam = F.lit("all") if family is None else F.col(family)
    base = pairs.select(*keys, fam.alias("fam"), F.col(stratum).alias("st"), F.col(cluster).alias("c_"), (F.col("b") - F.col("a")).alias("d"))
    twice = base.select(*keys, "fam", "st").distinct().groupBy(*keys, "st").count().where("count > 1")
    sums = base.groupBy(*keys, "fam", "st", "c_").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    guard = twice.agg(F.when(F.count("*") > 0, F.raise_error(F.lit("a stratum is in two families")).cast("int")).otherwise(F.lit(0)).alias("ok"))
    placed = sums.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "fam", "st").orderBy("c_")) - 1)
    size = sums.groupBy(*keys, "fam", "st").agg(F.count("*").alias("m"), (F.sum("d") / F.sum("n")).alias("delta"))
    macro = lambda df, by, v: df.groupBy(*by, "fam").agg(F.avg(v).alias("f")).groupBy(*by).agg(F.avg("f").alias("stat"))
    slots = _slots(size.select(*keys, "fam", "st", "m"), resamples)
    drawn = slots.select(*keys, "fam", "st", "rep", pick(seed, F.col("rep"), F.concat_ws("/", "fam", "st", "slot"), F.col("m")).cast("int").alias("place"))
    per = drawn.join(_beside_draws(placed.select(*keys, "fam", "st", "place", "d", "n")), [*keys, "fam", "st", "place"]).groupBy(*keys, "rep", "fam", "st").agg((F.sum("d") / F.sum("n")).alias("v"))
    whole = macro(size, keys, "delta").withColumnRenamed("stat", "delta").crossJoin(guard).where("ok = 0").drop("ok")
    reps = macro(per, [*keys, "rep"], "v")
    return _interval(reps.join(whole, keys) if keys else reps.crossJoin(whole), keys, resamples, alpha)


@F.pandas_udf(T.DoubleType())
def _binomial_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """min(1, 2 P(X <= k)) for X of n fair coins: exact integers, or logarithms where those grow long."""

    def p(k: int, n: int) -> float:
        if n <= 0:
            return 1.0
        if n <= 1000:
            return min(1.0, 2 * sum(math.comb(n, i) for i in range(int(k) + 1)) / 2**n)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(int(k) + 1)]
        top = max(logs)
        return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))

    return pd.Series([p(int(a), int(b)) for a, b in zip(k, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))) if x == x else float("nan"))


def mcnemar(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, wins, losses, delta, p_value of the exact test on discordant pairs, cut at one half."""
    a, b = F.col("a") >= 0.5, F.col("b") >= 0.5
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~a & b).alias("wins"), F.count_if(a & ~b).alias("losses"), (F.avg("b") - F.avg("a")).alias("delta"))
    return g.withColumn("p_value", F.when(F.col("wins") + F.col("losses") == 0, F.lit(1.0)).otherwise(_binomial_two_sided(F.least("wins", "losses"), F.col("wins") + F.col("losses"))))


def rank_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, w_plus, tie_term for differences that aren't 0; ranks of equal sizes are their mean.

    Ranks come from counts by size: a window over distinct sizes, not over rows.
    """
    d = pairs.select(*keys, (F.col("b") - F.col("a")).alias("d")).where("d <> 0")
    by = d.groupBy(*keys, F.abs("d").alias("s")).agg(F.count("*").alias("g"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("g").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("r", before + (F.col("g") + 1) / 2)
    return ranked.groupBy(*keys).agg(F.sum("g").alias("n"), F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("g") * F.col("g") * F.col("g") - F.col("g")).alias("tie_term"))


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """rank_sums() with z and the two-sided p of the normal approximation, continuity and ties corrected; p is 1 without variance."""
    n = F.col("n")
    g = rank_sums(pairs, keys).withColumn("var", (n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    g = g.withColumn("z", F.when(F.col("var") > 0, (F.abs(F.col("w_plus") - n * (n + 1) / 4) - 0.5) / F.sqrt("var")))
    p = F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.coalesce("z", F.lit(0.0))))))
    return g.withColumn("p_value", p).withColumn("test", F.when(n < 20, "wilcoxon_approx").otherwise("wilcoxon"))


def holm(tests: DataFrame, keys: list[str], p: str = "p_value", tie: str = "name", digits: int = 6) -> DataFrame:
    """tests with p_holm: the running maximum of (m - i) p in the order of p, at most 1, rounded."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = whole.orderBy(p, tie)
    step = F.least(F.lit(1.0), (F.count("*").over(whole) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("step_", step).withColumn("p_holm", F.round(F.max("step_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), digits)).drop("step_")


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, r; NaN for fewer than three points or none that differ."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return g.withColumn("r", F.when((F.col("n") < 3) | F.col("r").isNull(), F.lit(float("nan"))).otherwise(F.col("r")))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the mean rank of equal values, by counts of distinct values."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(value)
    by = df.groupBy(*keys, value).agg(F.count("*").alias("g_"))
    by = by.withColumn(out, F.coalesce(F.sum("g_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("g_") + 1) / 2).drop("g_")
    return df.join(by, [*keys, value])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return pearson(average_rank(average_rank(df, keys, x, "rx_"), keys, y, "ry_"), keys, "rx_", "ry_")


def is_binary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    near = lambda c: (F.abs(c) <= 1e-9) | (F.abs(c - 1) <= 1e-9)
    return pairs.groupBy(*keys).agg(F.bool_and(near(F.col("a")) & near(F.col("b"))).alias("binary"))


def paired_test(pairs: DataFrame, keys: list[str], unit: str, **kwargs) -> DataFrame:
    """keys, test, n, delta, p_value: the exact test where all values are 0 or 1, the bootstrap elsewhere."""
    kind = is_binary(pairs, keys)
    some = lambda flag: pairs.join(kind.where(F.col("binary") == flag).drop("binary"), keys, "left_semi")
    exact = mcnemar(some(True), keys).select(*keys, F.lit("mcnemar").alias("test"), "n", "delta", "p_value")
    boot = paired_bootstrap(some(False), keys, unit, **kwargs).select(*keys, F.lit("paired_bootstrap").alias("test"), "n", "delta", "p_value")
    return exact.unionByName(boot)


def reference_bootstrap(a, b, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA) -> dict:
    """The same draws on the driver, for small vectors and tests."""
    import hashlib

    d = np.asarray(b, float) - np.asarray(a, float)
    n = len(d)
    if not n:
        return {"n": 0, "p_value": 1.0, "delta": float("nan")}
    place = lambda r, s: int(hashlib.md5(f"{seed}:{r}:{s}".encode()).hexdigest()[:8], 16) % n
    stats = sorted(float(np.mean([d[place(r, s)] for s in range(n)])) for r in range(resamples))
    delta = float(d.mean())
    beyond = sum(abs(s - delta) >= abs(delta) for s in stats)
    return {"n": n, "delta": delta, "ci_low": stats[max(0, int(alpha / 2 * resamples) - 1)], "ci_high": stats[min(resamples - 1, int((1 - alpha / 2) * resamples))], "p_value": (beyond + 1) / (resamples + 1)}
