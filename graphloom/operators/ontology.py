"""Types, signatures and visibility rules of the graph, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
NODE_TYPES = ("Department", "Disease", "DiseaseSubtype", "Syndrome", "TreatmentPrinciple", "Formula", "Herb", "PatentMedicine", "ExternalTherapy", "PathwayStage", "SafetyContext", "RestrictedItem", "PharmacoPoeiaEntry", "DocumentSource")
SIGNATURES = (
    ("Formula", "CONTAINS_HERB", "Herb"),
    ("Syndrome", "USES_EXTERNAL_THERAPY", "ExternalTherapy"),
    ("Disease", "HAS_PATHWAY_STAGE", "PathwayStage"),
    ("Syndrome", "TREATED_BY_PRINCIPLE", "TreatmentPrinciple"),
    ("Disease", "HAS_SYNDROME", "Syndrome"),
    ("Syndrome", "USES_PATENT_MEDICINE", "PatentMedicine"),
    ("Syndrome", "USES_FORMULA", "Formula"),
    ("PathwayStage", "NEXT_STAGE", "PathwayStage"),
    ("Herb", "REGISTERED_IN_PHARMACOPOEIA", "PharmacoPoeiaEntry"),
    ("Disease", "CITES_DOCUMENT", "DocumentSource"),
    ("Disease", "HAS_SUBTYPE", "DiseaseSubtype"),
    ("Disease", "BELONGS_TO_DEPARTMENT", "Department"),
    ("Herb", "ALIAS_OF", "Herb"),
    ("DiseaseSubtype", "SUBTYPE_HAS_SYNDROME", "Syndrome"),
    ("RestrictedItem", "CONTRAINDICATED_FOR", "SafetyContext"),
    ("RestrictedItem", "CONTRAINDICATED_FOR", "Syndrome"),
    ("RestrictedItem", "CAUTION_FOR", "SafetyContext"),
    ("RestrictedItem", "CAUTION_FOR", "Syndrome"),
    ("Herb", "CONTRAINDICATED_FOR", "SafetyContext"),
    ("Syndrome", "USES_HERB_DIRECT", "Herb"),
    ("Herb", "SAME_AS", "Herb"),
    ("Formula", "SAME_AS", "Formula"),
    ("Herb", "DERIVED_FROM", "Herb"),
    ("Herb", "PROCESSED_FROM", "Herb"),
)
IDENTITY_EDGES = ("SAME_AS", "ALIAS_OF", "DERIVED_FROM", "PROCESSED_FROM")
_CLINICAL = ("Department", "Disease", "DiseaseSubtype", "Syndrome", "PathwayStage", "DocumentSource")
_SAFETY = ("Disease", "Syndrome", "TreatmentPrinciple", "Formula", "Herb", "PatentMedicine", "ExternalTherapy", "SafetyContext", "RestrictedItem", "PharmacoPoeiaEntry", "DocumentSource")
#: domain -> (types it may return, types for verification only)
DOMAINS = {
    "clinical_reasoning": (_CLINICAL, ("TreatmentPrinciple",)),
    "prescription_safety": (_SAFETY, ()),
    "clinical_pathway": (NODE_TYPES, ()),
    "full_graph": (NODE_TYPES, ()),
}
# -------------------------------------------------------------------------------------------------------------------


def values_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant frame that needs no Python on the executors."""
    import pyarrow as pa

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, columns, strict=True)}), schema=schema) if rows else spark.createDataFrame([], schema)


def signatures(spark: SparkSession, rows=SIGNATURES) -> DataFrame:
    return values_frame(spark, list(rows), "source_type string, type string, target_type string")


def policies(spark: SparkSession, domains=DOMAINS) -> DataFrame:
    rows = [(d, t, v) for d, (may, only) in domains.items() for v, ts in ((False, may), (True, only)) for t in ts]
    return values_frame(spark, rows, "domain string, node_type string, verification_only boolean")


def visible_types(domain: str, verification: bool = False, domains=DOMAINS) -> tuple[str, ...]:
    may, only = domains[domain]
    return tuple(may) + (tuple(only) if verification else ())


def may_return(node_type: Column, domain: str, verification: bool = False, domains=DOMAINS) -> Column:
    return node_type.isin(*visible_types(domain, verification, domains))


def visible(nodes: DataFrame, domain: str, verification: bool = False, domains=DOMAINS) -> DataFrame:
    return nodes.where(may_return(F.col("type"), domain, verification, domains))


def requested_types(requested: Column, domain: str, verification: bool = False) -> Column:
    """Requested and visible types, sorted."""
    return F.array_sort(F.array_intersect(requested, F.array(*[F.lit(t) for t in visible_types(domain, verification)])))


def guard_domain(nodes: DataFrame, domain: str, verification: bool = False) -> DataFrame:
    """nodes, failing at run time on a type that the domain must not show."""
    ok = may_return(F.col("type"), domain, verification)
    return nodes.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{domain} must not return "), F.col("type"))).cast("boolean")))


def violations(nodes: DataFrame, edges: DataFrame, allowed: DataFrame, node_types: tuple[str, ...] = NODE_TYPES) -> DataFrame:
    """problem, id, detail for unknown types, edges that dangle and signatures that aren't allowed; empty for a sound graph.

    Of an edge only the first problem is told: its type, its source, its target, its signature.
    """
    known = nodes.select("id", "type")
    ends = edges.join(known.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source", "left").join(known.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target", "left")
    row = lambda problem, detail: (F.lit(problem).alias("problem"), F.col("id"), detail.alias("detail"))
    bad_nodes = nodes.where(~F.col("type").isin(*node_types)).select(*row("unknown_node_type", F.col("type")))
    judged = ends.join(allowed.select("type").distinct().withColumn("typed_", F.lit(True)), "type", "left").join(allowed.distinct().withColumn("signed_", F.lit(True)), ["source_type", "type", "target_type"], "left")
    problem = F.when(F.col("typed_").isNull(), "unknown_edge_type").when(F.col("source_type").isNull(), "dangling_source").when(F.col("target_type").isNull(), "dangling_target").when(F.col("signed_").isNull(), "unknown_signature")
    detail = F.when(problem == "unknown_edge_type", F.col("type")).when(problem == "dangling_source", F.col("source")).when(problem == "dangling_target", F.col("target")).otherwise(F.concat_ws(" ", "source_type", "type", "target_type"))
    return bad_nodes.unionByName(judged.select(problem.alias("problem"), "id", detail.alias("detail")).where("problem is not null"))
