"""Look-ups, traversal, identity clusters and provenance on node and edge tables.

nodes: id, type, name, source_docs, ord and whatever else; edges: type, source, target, source_docs, evidence, ord.
``ord`` is the position in the source; wherever the first of several counts, it is the one with the least ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import save
from .ontology import IDENTITY_EDGES


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist, with an id of source|type|target where they have none."""
    ids = nodes.select("id")
    kept = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    own = F.col("id") if "id" in edges.columns else F.lit(None).cast("string")
    return kept.withColumn("id", F.coalesce(F.nullif(own, F.lit("")), F.concat_ws("|", "source", "type", "target")))


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    counts = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("type").alias("n_node_types"))
    out = counts.crossJoin(edges.agg(F.count("*").alias("n_edges"), F.countDistinct("type").alias("n_edge_types")))
    return out if roots is None else out.crossJoin(roots.agg(F.countDistinct("root").alias("n_clusters")))


def with_aliases(nodes: DataFrame) -> DataFrame:
    """nodes with `aliases`: what else a node is called.  Herbs and formulas by their names without preparation notes, syndromes by their
    canonical ones, and any node by the aliases and the canonical name of its pharmacopoeia entry and by its own aliases.

    attrs is a JSON text; an entry may be an object in it or, as in GraphML, a text that holds one.
    """
    entry = F.get_json_object("attrs", "$.pharmacopoeia_entry")
    many = lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))
    own = F.when(F.col("type").isin("Herb", "Formula"), tx.herb_base(F.col("name"))).when(F.col("type") == "Syndrome", tx.canonical_syndrome(F.col("name")))
    called = F.concat(F.array(own), many(F.get_json_object(entry, "$.common_aliases")), F.array(F.get_json_object(entry, "$.canonical_name")), many(F.get_json_object("attrs", "$.common_aliases")))
    return nodes.withColumn("aliases", F.array_distinct(F.array_compact(F.filter(called, lambda a: a != F.col("name")))))


def names_table(nodes: DataFrame, key, alias_cols: tuple[str, ...] = ("aliases",)) -> DataFrame:
    """key, id, type, priority, ord: the name first, other names after; each key of a node once.

    key: the function that folds a name.
    """
    parts = [nodes.select(key(F.col("name")).alias("key"), "id", "type", F.lit(0).alias("priority"), "ord")]
    for c in alias_cols:
        if c in nodes.columns:
            each = F.explode(F.col(c)) if dict(nodes.dtypes)[c].startswith("array") else F.col(c)
            parts.append(nodes.select(each.alias("n_"), "id", "type", "ord").select(key(F.col("n_")).alias("key"), "id", "type", F.lit(1).alias("priority"), "ord"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key <> ''").groupBy("key", "id", "type", "ord").agg(F.min("priority").alias("priority"))


def find_by_name(queries: DataFrame, names: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, id, type, rank for queries(query_id, key): all nodes of that name, those named so before those also called so."""
    known = names if types is None else names.where(F.col("type").isin(*types))
    w = Window.partitionBy("query_id").orderBy("priority", "ord", "id")
    return queries.join(known, "key").select("query_id", "id", "type", F.row_number().over(w).alias("rank"))


def neighbours(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out") -> DataFrame:
    """seed, edge_type, direction, id, type, ord for seeds(seed); both directions list a node for each edge."""
    some = edges if types is None else edges.where(F.col("type").isin(*types))
    ways = {"out": ("source", "target"), "in": ("target", "source")}
    found = None
    for way in ("out", "in") if direction == "both" else (direction,):
        here, there = ways[way]
        part = some.select(F.col(here).alias("seed"), F.col("type").alias("edge_type"), F.lit(way).alias("direction"), F.col(there).alias("id"), "ord").join(seeds.select("seed"), "seed")
        found = part if found is None else found.unionByName(part)
    return found.join(nodes.select("id", "type"), "id").select("seed", "edge_type", "direction", "id", "type", "ord")


def expand(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2, decay: float = 0.5, allowed: tuple[str, ...] | None = None, edge_types: tuple[str, ...] | None = None, max_nodes: int | None = None) -> DataFrame:
    """seed, id, hop, score = decay ** hop by level: both directions, each node at its least distance, seeds at 0.

    Nodes of types that aren't allowed are neither returned nor crossed (seeds excepted).  max_nodes is soft: no
    further level starts once a seed has that many nodes.  Every level is written before the next one joins it.
    """
    some = edges if edge_types is None else edges.where(F.col("type").isin(*edge_types))
    steps = some.select(F.col("source").alias("here"), F.col("target").alias("id")).union(some.select(F.col("target").alias("here"), F.col("source").alias("id"))).distinct()
    if allowed is not None:
        steps = steps.join(of_type(nodes, *allowed).select("id"), "id", "left_semi")
    steps = save(steps, "steps")
    seen = front = save(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")).distinct(), "hop")
    for hop in range(1, hops + 1):
        if max_nodes is not None:
            room = seen.groupBy("seed").agg(F.count("*").alias("n_")).where(F.col("n_") < max_nodes).select("seed")
            front = front.join(room, "seed", "left_semi")
        reached = front.select("seed", F.col("id").alias("here")).join(steps, "here").select("seed", "id").distinct()
        front = save(reached.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(front)
    return seen.select("seed", "id", "hop", F.pow(F.lit(float(decay)), F.col("hop")).alias("score"))


def clusters(edges: DataFrame, nodes: DataFrame, label: Column, identity: tuple[str, ...] = IDENTITY_EDGES) -> DataFrame:
    """id, root for every node: components of the identity edges, headed by the member with the least (length, id) of its label."""
    from .components import components

    pairs = edges.where(F.col("type").isin(*identity)).select(F.col("source").alias("a"), F.col("target").alias("b"))
    # nodes without a link head themselves; only linked ones are gathered
    linked = save(components(pairs), "linked")
    group = nodes.select("id", label.alias("label_")).join(linked, F.col("id") == F.col("node")).select("id", "label_", F.col("root").alias("group_"))
    heads = group.groupBy("group_").agg(F.min(F.struct(F.length("label_").alias("n"), F.col("id").alias("head"))).alias("m")).select("group_", F.col("m.head").alias("head"))
    headed = group.join(heads, "group_").select("id", "head")
    return nodes.select("id").join(headed, "id", "left").select("id", F.coalesce("head", "id").alias("root"))


def cluster_members(seeds: DataFrame, roots: DataFrame) -> DataFrame:
    """seed, id for all members of each seed's cluster, itself included."""
    return seeds.join(roots.select(F.col("id").alias("seed"), "root"), "seed").join(roots, "root").select("seed", "id")


def documents_of(nodes: DataFrame) -> DataFrame:
    """id, doc, pos in the order in which a node names its documents."""
    return nodes.select("id", F.posexplode("source_docs").alias("pos", "doc"))


def document_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc, id: nodes in a document by themselves or as an end of one of its edges, each once."""
    own = nodes.select(F.explode("source_docs").alias("doc"), "id")
    ends = edges.select("source", "target", F.explode("source_docs").alias("doc"))
    return own.union(ends.select("doc", F.col("source").alias("id"))).union(ends.select("doc", F.col("target").alias("id"))).distinct()


def in_same_documents(seeds: DataFrame, doc_nodes: DataFrame) -> DataFrame:
    """seed, id, n_docs: other nodes that share documents with the seed."""
    mine = doc_nodes.withColumnRenamed("id", "seed").join(seeds.select("seed"), "seed")
    return mine.join(doc_nodes, "doc").where("id <> seed").groupBy("seed", "id").agg(F.count("*").alias("n_docs"))


def document_overlap(asked: DataFrame, doc_nodes: DataFrame) -> DataFrame:
    """query_id, id, overlap for asked(query_id, doc): the share of the asked documents, repeats counted, that hold the node."""
    weight = asked.groupBy("query_id", "doc").agg(F.count("*").alias("w_"))
    total = asked.groupBy("query_id").agg(F.count("*").alias("n_"))
    hits = weight.join(doc_nodes, "doc").groupBy("query_id", "id").agg(F.sum("w_").alias("h_"))
    return hits.join(total, "query_id").select("query_id", "id", (F.col("h_") / F.col("n_")).alias("overlap"))


def first_documents(df: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """The first documents of each key in first-seen order, from (keys, doc, ord)."""
    first = df.groupBy(*keys, "doc").agg(F.min("ord").alias("ord"))
    return first.groupBy(*keys).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc"))), lambda x: x["doc"]), 1, most).alias("docs"))


def hierarchy(edges: DataFrame, direct: str = "HAS_SYNDROME", has_sub: str = "HAS_SUBTYPE", sub_direct: str = "SUBTYPE_HAS_SYNDROME") -> DataFrame:
    """top, via (null: direct), leaf, ord: one row for each path of one or two steps, none left out."""
    e = lambda t: edges.where(F.col("type") == t)
    one = e(direct).select(F.col("source").alias("top"), F.lit(None).cast("string").alias("via"), F.col("target").alias("leaf"), F.struct(F.lit(0).cast("long").alias("a"), F.col("ord").alias("b"), F.lit(0).cast("long").alias("c")).alias("ord"))
    subs = e(has_sub).select(F.col("source").alias("top"), F.col("target").alias("via"), F.col("ord").alias("o1_"))
    two = subs.join(e(sub_direct).select(F.col("source").alias("via"), F.col("target").alias("leaf"), F.col("ord").alias("o2_")), "via")
    return one.unionByName(two.select("top", "via", "leaf", F.struct(F.lit(1).cast("long").alias("a"), F.col("o1_").alias("b"), F.col("o2_").alias("c")).alias("ord")))


def leaves_of(paths: DataFrame) -> DataFrame:
    """The first path to each leaf of each top."""
    return first_per_key(paths, ["top", "leaf"], "ord")


def context_documents(edges: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, doc: documents of the edges that start in a context's members; contexts(context, member)."""
    return edges.join(contexts.withColumnRenamed("member", "source"), "source").select("context", F.explode("source_docs").alias("doc")).distinct()


def split_by_provenance(facts: DataFrame, context_docs: DataFrame, keys: list[str]) -> DataFrame:
    """facts(keys, context, source_docs) with scope: specific if a document is shared with the context, general if not, unscoped without one.

    A semi join of the exploded documents; facts with very many documents are never gathered.
    """
    docs = facts.where("context is not null").select(*keys, "context", F.explode("source_docs").alias("doc")).join(context_docs, ["context", "doc"], "left_semi")
    hit = docs.select(*keys, "context").distinct().withColumn("hit_", F.lit(True))
    scope = F.when(F.col("context").isNull(), "unscoped").when(F.col("hit_"), "disease_specific").otherwise("cross_disease_general")
    return facts.join(hit, [*keys, "context"], "left").withColumn("scope", scope).drop("hit_")


def presentation(wanted: DataFrame, edges: DataFrame, nodes: DataFrame, edge_type: str = "HAS_SYNDROME") -> DataFrame:
    """syndrome, disease, sentence, scope for wanted(syndrome, disease): the edge's own first sentence, else the node's first mention."""
    own = edges.where(F.col("type") == edge_type).select(F.col("source").alias("disease"), F.col("target").alias("syndrome"), "ord", F.posexplode("evidence").alias("pos", "e")).where("coalesce(e.sentence, '') <> ''")
    own = own.groupBy("disease", "syndrome").agg(F.min_by("e.sentence", F.struct("ord", "pos")).alias("own_"))
    general = nodes.select(F.col("id").alias("syndrome"), F.nullif(F.col("first_mention.sentence"), F.lit("")).alias("general_"))
    out = wanted.join(own, ["disease", "syndrome"], "left").join(general, "syndrome", "left")
    return out.select("syndrome", "disease", F.coalesce("own_", "general_").alias("sentence"), F.when(F.col("own_").isNotNull(), "disease_specific").when(F.col("general_").isNotNull(), "global_first_mention").otherwise("none").alias("scope"))


def node_brief(nodes: DataFrame, attrs: tuple[str, ...] = ()) -> DataFrame:
    text = F.substring(F.col("first_mention.sentence"), 1, 220) if "first_mention" in nodes.columns else F.lit(None).cast("string")
    return nodes.select("id", "type", "name", F.nullif(text, F.lit("")).alias("sentence"), *[F.nullif(F.col(a).cast("string"), F.lit("")).alias(a) for a in attrs], F.slice("source_docs", 1, 6).alias("source_docs"))


def evidence_sentences(evidence: Column) -> Column:
    return F.filter(F.transform(evidence, lambda e: e["sentence"]), lambda s: s != "")


def edge_brief(edges: DataFrame, most: int = 2) -> DataFrame:
    return edges.select("id", "type", "source", "target", F.transform(F.slice(evidence_sentences(F.col("evidence")), 1, most), lambda s: F.substring(s, 1, 220)).alias("quotes"), F.slice("source_docs", 1, 6).alias("source_docs"))


def stage_order(df: DataFrame) -> list[Column]:
    return [F.coalesce("variant", F.lit("")), F.coalesce("order", F.lit(0)), F.col("ord")]


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: sha256 over the rows' canonical texts, whatever their order.  Rows are hashed first, so what meets is 64 characters a row;

    groups of a few thousand rows are folded, then the folds, so no task holds all of them.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.select(row.alias("h"))
    parts = rows.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("content_hash"), F.sum("n").alias("n_rows"))
