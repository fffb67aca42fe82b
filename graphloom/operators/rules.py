"""Rule checks that tell "nothing found" (empty) from "the graph doesn't say" (not_covered)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NARRATIVE_PREFIX  # noqa: F401  (re-exported for callers that clean findings)
from ..session import save

# fixed values
MET, PARTLY = 0.6, 0.3
NEGATIONS = ("未", "无", "不", "非", "尚未", "没有")
PRINCIPLE_JACCARD, FEATURE_SHARE = 0.5, 0.25


def coverage(found: Column, known: Column) -> Column:
    """supported: facts found; empty: the item is known and has none; not_covered: the graph can't say."""
    return F.when(found, "supported").when(known, "empty").otherwise("not_covered")


def overall_verdict(verdicts: Column) -> Column:
    return F.when(F.exists(verdicts, lambda v: v == "contradicted"), "contradicted").when(F.forall(verdicts, lambda v: v == "supported") & (F.size(verdicts) > 0), "supported").otherwise("partially_supported")


def item_overlap(contents: DataFrame, group: str, container: str, part: str, least: int = 1) -> DataFrame:
    """group, a, b, shared, jaccard (3 digits) for containers of one group that share parts, a < b.

    Containers that meet in a part of their group are paired there: containers of a group are a prescription's few formulas.
    """
    c = contents.select(group, container, part).distinct().withColumn("n_", F.count("*").over(Window.partitionBy(group, container)))
    met = c.dropna(subset=[group, container, part]).groupBy(group, part).agg(F.array_sort(F.collect_list(F.struct(F.col(container).alias("x"), "n_"))).alias("m_")).where("size(m_) > 1")
    first = met.select(group, "m_", F.posexplode("m_").alias("i_", "a_"))
    pairs = first.select(group, "a_", F.explode(F.slice("m_", F.col("i_") + 2, F.size("m_"))).alias("b_"))
    shared = pairs.groupBy(group, F.col("a_.x").alias("a"), F.col("b_.x").alias("b"), F.col("a_.n_").alias("na"), F.col("b_.n_").alias("nb")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return shared.select(group, "a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 3).alias("jaccard"))


def alias_duplicates(items: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """group, root, items: different items of a group that are one thing."""
    named = items.select(group, "id").distinct().join(roots, "id")
    return named.groupBy(group, "root").agg(F.array_sort(F.collect_list("id")).alias("items")).where("size(items) > 1")


def loose_in_container(items: DataFrame, containers: DataFrame, contents: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """group, id, container: single items that a container of the same group holds already, by cluster."""
    held = containers.join(contents, "container").join(roots.select(F.col("id").alias("part"), F.col("root").alias("root")), "part").select(group, "container", "root").distinct()
    return items.select(group, "id").join(roots, "id").join(held, [group, "root"]).select(group, "id", "container")


def held_together(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """a, b, n of the different asked pairs(a, b) that some containers hold both of: n of contents(container, part), each row once.

    Either a pair looks through the containers of its rarer part, or containers list their pairs of asked parts: whichever forms
    fewer rows by the counts.  Parts that go into everything make the first dear, containers of everything the second.
    """
    p = save(pairs.select("a", "b").distinct(), "pairs")
    ids = p.select(F.explode(F.array("a", "b")).alias("part")).distinct()
    c = save(contents.join(ids, "part", "left_semi").select("container", "part"), "contents")
    often = c.groupBy("part").agg(F.count("*").alias("n"))
    counted = p.join(often.toDF("a", "na"), "a").join(often.toDF("b", "nb"), "b")
    by_part = counted.agg(F.sum(F.least("na", "nb"))).first()[0] or 0
    by_container = c.groupBy("container").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    if by_container <= by_part:
        both = c.withColumnRenamed("part", "a").join(c.withColumnRenamed("part", "b"), "container").groupBy("a", "b").agg(F.count("*").alias("n"))
        return both.join(p, ["a", "b"], "left_semi")
    rare = counted.select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("y"))
    met = rare.join(c.withColumnRenamed("part", "x"), "x").join(c.withColumnRenamed("part", "y"), ["y", "container"])
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


def pair_cooccurrence(pairs: DataFrame, contents: DataFrame, container: str, part: str) -> DataFrame:
    """a, b, n for asked pairs(a, b), a < b: containers with both.  The verdict is always not_covered: to be held together says nothing of what agrees."""
    c = contents.select(F.col(container).alias("c_"), F.col(part).alias("p_")).distinct()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("p_")).distinct()
    some = c.join(ids, "p_", "left_semi")
    both = pairs.join(some.withColumnRenamed("p_", "a"), "a").join(some.withColumnRenamed("p_", "b"), ["b", "c_"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit("not_covered").alias("verdict"))


def constraints(items: DataFrame, edges: DataFrame, roots: DataFrame, types=("CONTRAINDICATED_FOR", "CAUTION_FOR")) -> DataFrame:
    """seed, severity, restricted, applies_to for constraint edges at either end of any member of the seed's cluster; the first of equals."""
    members = items.select(F.col("id").alias("seed")).join(roots.withColumnRenamed("id", "seed"), "seed").join(roots.withColumnRenamed("id", "member"), "root").select("seed", "member")
    some = edges.where(F.col("type").isin(*types)).select("type", "source", "target", "ord")
    at = lambda end: some.join(members, F.col(end) == F.col("member"))
    found = at("source").unionByName(at("target")).select("seed", F.when(F.col("type") == "CONTRAINDICATED_FOR", "contraindicated").otherwise("caution").alias("severity"), F.col("source").alias("restricted"), F.col("target").alias("applies_to"), "ord")
    return found.groupBy("seed", "severity", "restricted", "applies_to").agg(F.min("ord").alias("ord"))


def claimed_requirement(claim: Column, attested: Column) -> Column:
    """A claimed preparation against those that the graph attests (an array; null or empty: none)."""
    n = F.coalesce(F.size(attested), F.lit(0))
    return F.when(F.coalesce(claim, F.lit("")) == "", F.lit(None).cast("string")).when(F.array_contains(attested, claim), "supported").when(n > 0, "contradicted_by_graph").otherwise("not_covered")


def match_criteria(criteria: DataFrame, findings: DataFrame, grams, keys: list[str]) -> DataFrame:
    """keys, criterion_id, criterion, score, status: each criterion against the findings of its case.

    Score: the best share of the criterion's grams in a finding (the first of equals).  met from 0.6, partial from 0.3; what a
    finding negates and the criterion doesn't is contradicted.  criteria(keys, criterion_id, criterion), findings(keys, finding_id, finding).
    """
    negated = lambda t: F.exists(F.array(*[F.lit(n) for n in NEGATIONS]), lambda n: F.contains(t, n))
    c = criteria.select(*keys, "criterion_id", "criterion", F.array_distinct(grams(F.col("criterion"))).alias("cg"))
    f = findings.select(*keys, "finding_id", "finding", grams(F.col("finding")).alias("fg"))
    n = F.size("cg")
    pairs = c.join(f, keys, "left").withColumn("s_", F.when((n > 0) & F.col("finding").isNotNull(), F.size(F.array_intersect("cg", "fg")) / n).otherwise(F.lit(0.0)))
    best = pairs.groupBy(*keys, "criterion_id").agg(F.max_by(F.struct("criterion", "finding", "s_", n.alias("n_")), F.struct("s_", -F.coalesce("finding_id", F.lit(0)))).alias("m"), F.count("finding").alias("k_")).select(*keys, "criterion_id", "m.*", "k_")
    status = F.when(F.col("s_") >= MET, "met").when(F.col("s_") >= PARTLY, "partial").otherwise("not_evidenced")
    full = F.when(F.col("k_") == 0, "no_findings_supplied").when(F.col("n_") == 0, "unparseable").when((status != "not_evidenced") & negated(F.col("finding")) & ~negated(F.col("criterion")), "contradicted").otherwise(status)
    return best.select(*keys, "criterion_id", "criterion", F.round("s_", 3).alias("score"), full.alias("status"))


def transition(stages: DataFrame) -> Column:
    """The recommendation for a row with n_findings, n_exit, n_exit_met, n_exit_contradicted, n_successors, any_entry_all_met, any_entry."""
    c = F.col
    return (
        F.when(c("n_findings") == 0, "insufficient_evidence")
        .when((c("n_exit") > 0) & (c("n_exit_contradicted") > 0), "continue")
        .when((c("n_exit") > 0) & (c("n_exit_met") == c("n_exit")), F.when(c("n_successors") > 0, "advance").otherwise("exit"))
        .when((c("n_exit") > 0) & (c("n_exit_met") > 0), "continue")
        .when(c("any_entry_all_met"), "advance")
        .when((c("n_exit") == 0) & ~c("any_entry"), "insufficient_evidence")
        .otherwise("continue")
    )


def criteria_counts(matched: DataFrame, keys: list[str]) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return matched.groupBy(*keys).agg(F.count("*").alias("n"), is_("met").alias("n_met"), is_("partial").alias("n_partial"), is_("contradicted").alias("n_contradicted"))


def decision_checks(exists: Column, linked: Column, principle_similarity: Column, feature_share: Column, literal_hit: Column) -> Column:
    """The verdicts of a decision: existence, link, principle, features; null inputs weren't asked for and give none."""
    v = lambda ok, bad: F.when(ok, "supported").otherwise(bad)
    checks = F.array(
        v(exists, "not_in_graph"),
        F.when(linked.isNotNull(), v(linked, "contradicted")),
        F.when(principle_similarity.isNotNull(), v(principle_similarity >= PRINCIPLE_JACCARD, "contradicted")),
        F.when(feature_share.isNotNull(), v((feature_share >= FEATURE_SHARE) | F.coalesce(literal_hit, F.lit(False)), "partially_supported")),
    )
    return F.array_compact(checks)
