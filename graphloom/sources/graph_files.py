"""Graphs from node-link JSON and GraphML, gzip or plain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import drop_dangling
from ..session import small_enough

# fixed values
JSON_ATTRIBUTES = ("source_docs", "first_mention", "pharmacopoeia_entry", "evidence", "common_aliases", "entry_criteria", "exit_criteria", "monitoring_items", "outcome_indicators", "day_actions", "nursing_items")

#: Keys of a GraphML file that may be broadcast; more meet the data in a shuffled join.
MOST_KEYS = 10_000
_NODE_FIELDS = "id string, type string, name string, title string, doc_id string, source_docs array<string>, first_mention struct<doc_id:string,sentence:string>"


def _evidence(v: Column) -> Column:
    """One sentence, a list of them, a struct or a list of structs: always a list of structs."""
    as_list = F.from_json(v, "array<struct<sentence:string>>")
    as_texts = F.transform(F.from_json(v, "array<string>"), lambda s: F.struct(s.alias("sentence")))
    one = F.from_json(v, "struct<sentence:string>")
    t = F.trim(v)
    looks_object = F.exists(F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>")), lambda s: F.ltrim(s).startswith("{"))
    return F.when(t.startswith("["), F.when(looks_object, as_list).otherwise(as_texts)).when(t.startswith("{"), F.array(one)).when(t != "", F.array(F.struct(F.btrim(t, F.lit('"')).alias("sentence")))).otherwise(F.array().cast("array<struct<sentence:string>>"))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON document {nodes, edges or links}; edges may say source/target or from/to.

    Attributes stay as a JSON text ``attrs``; ``ord`` is the place in the file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<nodes:array<string>,edges:array<string>,links:array<string>>").alias("g"))
    nodes = raw.select(F.posexplode("g.nodes").alias("ord", "attrs")).select("attrs", F.col("ord").cast("long").alias("ord"), F.from_json("attrs", _NODE_FIELDS).alias("n"))
    name = F.coalesce(*[F.nullif(F.col(f"n.{c}"), F.lit("")) for c in ("name", "title", "doc_id")], F.lit(""))
    nodes = nodes.select("n.id", "n.type", name.alias("name"), F.coalesce("n.source_docs", F.array().cast("array<string>")).alias("source_docs"), "n.first_mention", "attrs", "ord")
    edges = raw.select(F.posexplode(F.coalesce("g.edges", "g.links")).alias("ord", "attrs")).select("attrs", F.col("ord").cast("long").alias("ord"), F.from_json("attrs", "_id string, id string, type string, source string, target string, `from` string, `to` string, source_docs array<string>, evidence string, evidence_type string, claim_type string").alias("e"))
    edges = edges.select(F.coalesce("e._id", "e.id").alias("id"), "e.type", F.coalesce("e.from", "e.source").alias("source"), F.coalesce("e.to", "e.target").alias("target"), F.coalesce("e.source_docs", F.array().cast("array<string>")).alias("source_docs"), _evidence(F.coalesce("e.evidence", F.lit(""))).alias("evidence"), "e.evidence_type", "e.claim_type", "ord")
    return nodes, drop_dangling(edges, nodes)


def _as_json(attrs: Column) -> Column:
    """A map as a JSON object in which the listed attributes that hold JSON are values, not texts."""
    text = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    holds = lambda k, v: k.isin(*JSON_ATTRIBUTES) & F.ltrim(v).rlike(r"^[\[{]") & F.try_parse_json(v).isNotNull()
    entries = F.transform(F.map_entries(F.map_filter(attrs, lambda k, v: v.isNotNull())), lambda e: F.concat(text(e["key"]), F.lit(":"), F.when(holds(e["key"], e["value"]), e["value"]).otherwise(text(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


_DATA = "array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: data elements become a map by the names of the file's keys.

    Values of the listed attributes that are JSON are JSON in ``attrs``; integers stay text until a caller casts them.
    """
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = xml("key", "_id string, `_attr.name` string").select(F.col("_id").alias("k"), F.coalesce(F.col("`_attr.name`"), F.col("_id")).alias("field"))
    few = F.broadcast(keys) if small_enough(keys, MOST_KEYS) else keys

    def attributes(df: DataFrame, ids: list[Column]) -> DataFrame:
        numbered = df.withColumn("ord", F.monotonically_increasing_id())
        flat = numbered.select("ord", *ids, F.explode_outer("data").alias("d"))
        named = flat.join(few, F.col("d._key") == F.col("k"), "left")
        cols = [c for c in flat.columns if c not in ("ord", "d")]
        return named.groupBy("ord", *cols).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", F.col("d._VALUE").alias("value")))))).alias("attrs"))

    nodes = attributes(xml("node", f"_id string, data {_DATA}"), [F.col("_id").alias("id")])
    docs = lambda m: F.coalesce(F.from_json(F.try_element_at(m, F.lit("source_docs")), "array<string>"), F.array().cast("array<string>"))
    at = lambda k: F.try_element_at(F.col("attrs"), F.lit(k))
    name = F.coalesce(*[F.nullif(at(k), F.lit("")) for k in ("name", "title", "doc_id")], F.lit(""))
    nodes = nodes.select("id", at("type").alias("type"), name.alias("name"), docs(F.col("attrs")).alias("source_docs"), F.from_json(at("first_mention"), "doc_id string, sentence string").alias("first_mention"), _as_json(F.col("attrs")).alias("attrs"), "ord")
    edges = attributes(xml("edge", f"_id string, _source string, _target string, data {_DATA}"), [F.col("_id").alias("eid"), F.col("_source").alias("source"), F.col("_target").alias("target")])
    edges = edges.select(F.coalesce(at("_id"), "eid").alias("id"), at("type").alias("type"), "source", "target", docs(F.col("attrs")).alias("source_docs"), _evidence(F.coalesce(at("evidence"), F.lit(""))).alias("evidence"), at("evidence_type").alias("evidence_type"), at("claim_type").alias("claim_type"), "ord")
    return nodes, drop_dangling(edges, nodes)


def load_graph(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """By suffix; with allowed signatures a graph that violates them is an error."""
    from ..operators.ontology import violations

    plain = path.removesuffix(".gz")
    nodes, edges = read_graphml(spark, path) if plain.endswith((".graphml", ".xml")) else read_node_link(spark, path)
    if allowed is not None and (bad := violations(nodes, edges, allowed).take(5)):
        raise ValueError(f"the graph violates its ontology: {[tuple(r) for r in bad]}")
    return nodes, edges
