"""What a graph can ground: facts about it counted in one pass a table, rule families with the facts behind them, options that it knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import save
from . import graph as gr
from .ontology import values_frame
from .reports import GROUNDABILITY

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Literals whose mentions are counted in all that the graph says.
MENTIONS = {
    "mentions_junchen": ("君臣佐使", "君药"),
    "mentions_shibafan": ("十八反", "十九畏"),
    "mentions_dosage_field": ("用法用量",),
    "mentions_validity": ("处方效期", "有效期"),
    "mentions_controlled": ("毒性药品", "麻醉药品", "精神药品"),
    "mentions_neonate": ("新生儿", "婴幼儿"),
}
TOXIC, PREGNANCY, PAEDIATRIC = ("有毒", "小毒", "大毒"), ("孕", "妊娠"), ("小儿", "儿童", "婴")
#: A sentence defines a syndrome if it is longer than the name by more than this.
DEFINITION_MARGIN = 6
SAFETY_EDGES = ("CONTRAINDICATED_FOR", "CAUTION_FOR")
#: rule: title, tools that answer it, facts that its verdict rests on
RULES = {
    "A-001": ("处方适宜性概念", (), ()),
    "A-002": ("用药与病名/证型相符", ("retrieve_clinical_context", "retrieve_medication_knowledge"), ("n_syndromes",)),
    "A-003": ("单味药剂量", ("check_dose",), ("n_pharmacopoeia_entries", "mentions_dosage_field")),
    "A-004": ("总剂量/药味数量", ("retrieve_medication_knowledge",), ("n_formulas", "n_formulas_with_composition")),
    "A-005": ("用法合理", ("check_decoction_requirement",), ("n_herbs", "n_herbs_with_preparation")),
    "A-006": ("品种选择", ("retrieve_pharmacopeia_entry",), ("n_identity_clusters",)),
    "A-007": ("使用禁忌", ("retrieve_safety_constraints", "check_restricted_item"), ("safety_edges",)),
    "A-008": ("重复用药", ("check_duplicate_medication",), ("n_identity_clusters", "n_patent_medicines", "n_patent_with_composition")),
    "A-009": ("联合用药/配伍禁忌", ("check_combination",), ("mentions_shibafan",)),
    "N-001": ("处方完整性", (), ()),
    "N-002": ("君臣佐使", (), ("mentions_junchen",)),
    "N-003": ("特殊煎煮", ("check_decoction_requirement",), ("n_herbs_with_preparation",)),
    "N-004": ("剂量单位", (), ()),
    "N-005": ("处方用量", (), ()),
    "N-006": ("处方效期", (), ("mentions_validity",)),
    "N-007": ("特殊药品", ("retrieve_pharmacopeia_entry",), ("n_toxicity_flagged", "n_pharmacopoeia_entries", "mentions_controlled")),
    "N-008": ("开具规范", (), ()),
    "N-009": ("新生儿/婴幼儿", ("retrieve_safety_constraints",), ("mentions_neonate", "n_paediatric_contexts", "n_pregnancy_contexts")),
    "C-001": ("基本概念", (), ()),
}
#: What isn't part of a node's own text beside its name.
NOT_TEXT = ("id", "type", "name", "source_docs", "first_mention")
# -------------------------------------------------------------------------------------------------------------------


def occurrences(text: Column, needle: str) -> Column:
    """How often a literal stands in a text, without overlaps, from the left (D21)."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def mentions(text: Column, words: dict[str, tuple[str, ...]] = MENTIONS) -> list[Column]:
    """For each group of literals the sum of its mentions over all rows."""
    return [F.coalesce(F.sum(reduce(lambda a, b: a + b, [occurrences(text, w) for w in group])), F.lit(0)).cast("long").alias(name) for name, group in words.items()]


def node_text(nodes: DataFrame) -> Column:
    """All that a node says: its name, its attributes, its first mention."""
    own = F.map_filter(F.coalesce(F.from_json("attrs", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*NOT_TEXT) & v.isNotNull())
    return F.concat_ws("\n", "name", F.concat_ws("\n", F.map_values(own)), F.col("first_mention.doc_id"), F.col("first_mention.sentence"))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(text, F.lit("")), F.lit(w)) for w in words])


def graph_facts(nodes: DataFrame, edges: DataFrame, tools=None) -> DataFrame:
    """fact, detail, value: what a coverage audit cites (D22).  `detail` is the kind of a safety edge, else null.

    Nodes and edges are each read once for all counts.  With tools, their clusters and preparation notes are used; else they are made.
    """
    from .tools import Tools

    tools = tools or Tools(nodes, edges)
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_"), F.count_if(F.col("type") == "CONTAINS_HERB").alias("held_"))
    n = nodes.join(out, "id", "left")
    is_ = lambda kind, more=F.lit(True): F.count_if((F.col("type") == kind) & F.coalesce(more, F.lit(False)))
    sentence = F.coalesce("first_mention.sentence", F.lit(""))
    counts = {
        "n_syndromes": is_("Syndrome"),
        "n_syndromes_with_definition": is_("Syndrome", F.length(sentence) > F.length("name") + DEFINITION_MARGIN),
        "n_herbs": is_("Herb"),
        "n_formulas": is_("Formula"),
        "n_formulas_with_composition": is_("Formula", F.col("held_") > 0),
        "n_pharmacopoeia_entries": is_("PharmacoPoeiaEntry"),
        "n_toxicity_flagged": is_("PharmacoPoeiaEntry", _holds(F.get_json_object("attrs", "$.nature_taste_meridian"), TOXIC)),
        "n_patent_medicines": is_("PatentMedicine"),
        "n_patent_with_composition": is_("PatentMedicine", F.col("out_") > 0),
        "n_pregnancy_contexts": is_("SafetyContext", _holds(F.col("name"), PREGNANCY)),
        "n_paediatric_contexts": is_("SafetyContext", _holds(F.col("name"), PAEDIATRIC)),
    }
    said = n.withColumn("text_", node_text(nodes)).agg(*[c.cast("long").alias(k) for k, c in counts.items()], *mentions(F.col("text_")))
    by_edges = edges.select(F.explode(gr.evidence_sentences(F.col("evidence"))).alias("s")).agg(*mentions(F.col("s")))
    rows = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*df.columns))).alias("fact", "value"))
    noted = tools.preparation(nodes.where("type = 'Herb'").select("id")).agg(F.count_distinct("id").alias("n_herbs_with_preparation"))
    clusters = tools.roots.groupBy("root").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_identity_clusters"))
    plain = reduce(DataFrame.unionByName, map(rows, (said, by_edges, noted, clusters))).groupBy("fact").agg(F.sum("value").alias("value"))
    safety = edges.where(F.col("type").isin(*SAFETY_EDGES)).join(nodes.select(F.col("id").alias("source"), F.col("type").alias("t_"), "name"), "source")
    kinds = safety.groupBy(tx.restriction_kind(F.col("t_"), F.col("name")).alias("detail")).agg(F.count("*").alias("value"))
    return plain.select("fact", F.lit(None).cast("string").alias("detail"), "value").unionByName(kinds.select(F.lit("safety_edges").alias("fact"), "detail", "value"))


def rule_audit(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """rule, title, verdict, evidence, tools: every rule family with the facts that its verdict rests on."""
    table = [(r, title, GROUNDABILITY[r], list(cited), list(used)) for r, (title, used, cited) in RULES.items()]
    rules = values_frame(spark, table, "rule string, title string, verdict string, cited array<string>, tools array<string>")
    shown = facts.select("fact", F.concat_ws("=", F.concat_ws(":", "fact", "detail"), F.col("value").cast("string")).alias("said"))
    cited = rules.select("rule", F.posexplode("cited").alias("pos", "fact")).join(shown, "fact", "left").groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("said", F.concat("fact", F.lit("=0"))).alias("said")))), lambda x: x["said"]).alias("evidence"))
    return rules.join(cited, "rule", "left").select("rule", "title", "verdict", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), "tools")


def impact(items: DataFrame, audit: DataFrame, rule_col: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """(by rule, by verdict): items and their share of all; rules that the audit doesn't know are unknown (D23)."""
    n = items.groupBy(F.upper(F.coalesce(F.col(rule_col).cast("string"), F.lit("?"))).alias("rule")).agg(F.count("*").alias("n"))
    n = save(n.join(audit.select("rule", "verdict"), "rule", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown"))), "impact")
    total = n.agg(F.sum("n").alias("all_"))
    share = lambda df: df.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("all_")).drop("all_")  # noqa: E731  one row
    return share(n), share(n.groupBy("verdict").agg(F.sum("n").alias("n")))


def option_coverage(looked_up: DataFrame, gold: DataFrame) -> DataFrame:
    """split, n_cases, n_options, n_found, n_gold, n_gold_found, share_found, share_gold_found (D24).

    looked_up: call_id, options (letter, found) as Tools.look_up_options() gives them; gold: call_id, split, letters.  Gold options
    that are found more often than others would leak the answer.
    """
    rows = gold.join(looked_up.select("call_id", F.explode("options").alias("o")), "call_id").withColumn("is_gold", F.array_contains("letters", F.col("o.letter")))
    out = rows.groupBy("split").agg(F.count_distinct("call_id").alias("n_cases"), F.count("*").alias("n_options"), F.count_if("o.found").alias("n_found"), F.count_if("is_gold").alias("n_gold"), F.count_if(F.col("is_gold") & F.col("o.found")).alias("n_gold_found"))
    return out.withColumn("share_found", F.try_divide("n_found", "n_options")).withColumn("share_gold_found", F.try_divide("n_gold_found", "n_gold"))


def report(audit: DataFrame, facts: DataFrame, items: DataFrame | None = None, options: DataFrame | None = None) -> str:
    """The audit as Markdown (N13): families by verdict, facts, and, where there are data, the items that they touch and the options known."""
    from .evaluation import markdown

    flat = audit.select("rule", "title", "verdict", F.array_join("evidence", ", ").alias("evidence"), F.array_join("tools", ", ").alias("tools")).orderBy("rule")
    parts = ["# Coverage of the graph", markdown(audit.groupBy("verdict").agg(F.count("*").alias("families")).orderBy("verdict")), "## Rule families", markdown(flat), "## Facts", markdown(facts.orderBy("fact", "detail"))]
    if items is not None:
        by_rule, by_verdict = impact(items, audit)
        parts += ["## Items by rule", markdown(by_rule.orderBy(F.desc("n"), "rule")), "## Items by verdict", markdown(by_verdict.orderBy(F.desc("n"), "verdict"))]
    if options is not None:
        parts += ["## Options that the graph knows", markdown(options.orderBy("split"))]
    return "\n\n".join(parts) + "\n"
