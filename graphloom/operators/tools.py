"""The tools of a run over a graph, each for a whole table of calls at once: resolve names, join, and say what the graph can and can't tell.

A tool takes calls(call_id, arguments ...) and gives one row for each call: call_id, coverage and what was found, as arrays
of structs.  coverage: supported (facts found), partially_supported, empty (the thing is known and has none), not_covered (the graph
can't say, whatever it holds).  A call whose names the graph doesn't know is a result as well, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph as gr
from . import ontology, rules
from . import retrieval as rt
from .ontology import values_frame

# ---- fixed values -------------------------------------------------------------------------------------------------
_ALL = ("clinical_reasoning", "prescription_safety", "clinical_pathway", "full_graph")
_SAFE, _PATH = _ALL[1:], _ALL[2:]
_AGENT, _VERIFY = ("agent",), ("verification",)
#: tool, domains, phases, required arguments
SPECS = (
    ("search_tcm_entities", _ALL, _AGENT, ("query",)),
    ("retrieve_clinical_context", _ALL, _AGENT, ("entity",)),
    ("retrieve_syndrome_evidence", _ALL, _AGENT, ("syndrome",)),
    ("retrieve_source_evidence", _ALL, _AGENT, ()),
    ("retrieve_medication_knowledge", _SAFE, _AGENT, ("name",)),
    ("retrieve_safety_constraints", _SAFE, _AGENT, ()),
    ("retrieve_pharmacopeia_entry", _SAFE, _AGENT, ("herb",)),
    ("verify_tcm_decision", _ALL, _VERIFY, ("syndrome",)),
    ("check_dose", _SAFE, _VERIFY, ("items",)),
    ("check_duplicate_medication", _SAFE, _VERIFY, ("items",)),
    ("check_restricted_item", _SAFE, _VERIFY, ("items",)),
    ("check_combination", _SAFE, _VERIFY, ("items",)),
    ("check_decoction_requirement", _SAFE, _VERIFY, ("items",)),
    ("retrieve_pathway_stage", _PATH, _AGENT, ("disease",)),
    ("evaluate_pathway_transition", _PATH, ("agent", "verification"), ("stage_id",)),
    ("retrieve_treatment_plan", _PATH, _AGENT, ("syndrome", "disease")),
)
DRUGS = ("Herb", "Formula", "PatentMedicine", "ExternalTherapy", "PharmacoPoeiaEntry")
TREATMENTS = (("TREATED_BY_PRINCIPLE", "treatment_principles"), ("USES_FORMULA", "formulas"), ("USES_PATENT_MEDICINE", "patent_medicines"), ("USES_EXTERNAL_THERAPY", "external_therapies"))
CONSTRAINTS = ("CONTRAINDICATED_FOR", "CAUTION_FOR")
STAGE_FIELDS = ("entry_criteria", "exit_criteria", "monitoring_items", "outcome_indicators", "day_actions", "nursing_items")
MIN_NAME_SIMILARITY = 0.5
#: Attributes of a type that are searched, beside name, first sentence, pharmacopoeia entry, aliases and evidence.
SEARCHED = {
    "Disease": ("full_name", "tcm_name", "western_name"),
    "DiseaseSubtype": ("disease",),
    "SafetyContext": ("disease",),
    "PharmacoPoeiaEntry": ("part_used", "nature_taste_meridian", "pharmacopoeial_functions"),
    "DocumentSource": ("title", "doc_type", "department", "version_label", "institution_attribution"),
    "PathwayStage": ("disease", "variant", "entry_criteria", "exit_criteria", "monitoring_items", "outcome_indicators"),
}
ENTRY_FIELDS = ("canonical_name", "part_used", "nature_taste_meridian", "pharmacopoeial_functions")
TOP_K, MOST_HITS, BLOCK_ENTITIES, HOPS, DECAY = 8, 20, 8, 2, 0.5
# -------------------------------------------------------------------------------------------------------------------


def specs(spark: SparkSession) -> DataFrame:
    """tool, domains, phases, required: what traces.gate() asks before a call runs."""
    return values_frame(spark, [tuple(map(lambda x: list(x) if isinstance(x, tuple) else x, row)) for row in SPECS], "tool string, domains array<string>, phases array<string>, required array<string>")


def toxicity(nature: Column) -> Column:
    """The first of the markers, strongest first, that a nature holds."""
    return tx.first_marker(F.coalesce(nature, F.lit("")), tx.TOXICITY_MARKERS)


def _listed(df: DataFrame, keys: list[str], name: str, *fields: str, order: str = "ord", most: int | None = None) -> DataFrame:
    """keys and an array of structs of the fields, in order, the first of equals kept."""
    first = df.groupBy(*keys, *fields).agg(F.min(order).alias("o_"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return first.groupBy(*keys).agg((rows if most is None else F.slice(rows, 1, most)).alias(name))


def text_pieces(nodes: DataFrame, edges: DataFrame, with_evidence: bool = True) -> DataFrame:
    """id, ord, piece: what is searched of a node, in order: names, attributes of its type, first sentence, entry, aliases, evidence of its edges."""
    get = lambda path: F.get_json_object("attrs", f"$.{path}")
    many = lambda path: F.coalesce(F.from_json(get(path), "array<string>"), F.array(get(path)))
    own = [F.array("name"), F.array(F.when(F.col("type") == "Herb", tx.herb_base(F.col("name"))))]
    own += [F.when(F.col("type") == kind, many(f)) for kind, fields in SEARCHED.items() for f in fields]
    own += [F.array(F.col("first_mention.sentence")), *[F.array(get(f"pharmacopoeia_entry.{f}")) for f in ENTRY_FIELDS], many("pharmacopoeia_entry.common_aliases"), many("common_aliases")]
    every = F.array_compact(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in own]))
    pieces = nodes.select("id", F.posexplode(every).alias("pos", "piece")).select("id", F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "pos").alias("ord"), "piece")
    if with_evidence:
        for way, end in ((1, "source"), (2, "target")):
            said = edges.select(F.col(end).alias("id"), F.col("ord").alias("b"), F.posexplode(gr.evidence_sentences(F.col("evidence"))).alias("pos", "piece"))
            pieces = pieces.unionByName(said.select("id", F.struct(F.lit(way).cast("long").alias("a"), F.col("b").cast("long").alias("b"), "pos").alias("ord"), "piece"))
    return pieces


class Tools:
    """nodes(id, type, name, source_docs, first_mention, attrs as JSON, ord) and edges as read_node_link() gives them; names and clusters are made once and written, as every look-up reads them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None, roots: DataFrame | None = None, pool: DataFrame | None = None):
        """pool(key, id, rank): lexical hits for folded names that no node bears, where a search has been run for them."""
        edges = gr.save(edges, "edges")
        self.nodes, self.edges, self.pool, self._indexes = nodes, edges, pool, {}
        self.names = names if names is not None else gr.save(gr.names_table(gr.with_aliases(nodes), tx.fold_text), "names")
        self.roots = roots if roots is not None else gr.save(gr.clusters(edges, nodes, F.col("name")), "roots")
        self.brief = nodes.select("id", "type", "name")

    # ---- names ----------------------------------------------------------------------------------------------------

    def resolve(self, asked: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
        """asked' columns, id, rank: nodes that a name means, best first: the id itself, nodes of the name, kin of nodes of the name, lexical hits with a like name.

        asked(q, name); each stage answers only what the ones before it left open.
        """
        wanted = (lambda c: F.lit(True)) if types is None else (lambda c: c.isin(*types))
        keyed = gr.save(asked.select("q", F.trim("name").alias("name")).where("name <> ''").withColumn("key", tx.fold_text(F.col("name"))), "asked")
        own = keyed.join(self.brief.select(F.col("id").alias("name"), F.col("id").alias("id"), F.col("type")), "name").select("q", "id", F.lit(0).alias("stage"), F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"))
        one = keyed.join(self.names, "key").where(wanted(F.col("type"))).select("q", "id", F.lit(1).alias("stage"), F.struct(F.col("priority").alias("a"), F.col("ord").alias("b")).alias("ord"))
        every = gr.save(own.unionByName(one), "resolved")
        left = gr.save(keyed.join(every.select("q"), "q", "left_anti"), "left-open")
        # kin take joins of all names, clusters and nodes: only where a name was left open
        if not left.isEmpty():
            every = every.unionByName(self._by_kin(left, wanted))
        if self.pool is not None:
            near = left.join(self.pool, "key").join(self.brief, "id").where(wanted(F.col("type")) & (F.col("rank") <= 5)).where(tx.name_similarity(F.col("key"), tx.fold_text(self.brief["name"])) >= MIN_NAME_SIMILARITY)
            every = every.unionByName(near.select("q", "id", F.lit(3).alias("stage"), F.struct(F.lit(0).alias("a"), F.col("rank").cast("long").alias("b")).alias("ord")))
        best = every.groupBy("q").agg(F.min("stage").alias("stage"))
        ranked = every.join(best, ["q", "stage"]).groupBy("q", "id").agg(F.min("ord").alias("ord"))
        return ranked.select("q", "id", F.row_number().over(gr.Window.partitionBy("q").orderBy("ord", "id")).alias("rank"))

    def _by_kin(self, left: DataFrame, wanted) -> DataFrame:
        """Stage 2 of resolve(): nodes in the clusters of what bears the name."""
        kin = left.join(self.names, "key").select("q", "id", F.col("ord").alias("o_")).join(self.roots, "id").select("q", "root", "o_").join(self.roots, "root").join(self.brief, "id").where(wanted(F.col("type")))
        return kin.select("q", "id", F.lit(2).alias("stage"), F.struct(F.lit(0).alias("a"), F.col("o_").cast("long").alias("b")).alias("ord"))

    def first(self, calls: DataFrame, column: str, types: tuple[str, ...] | None) -> DataFrame:
        """call_id, id: the best node of a name argument; calls without one are missing."""
        found = self.resolve(calls.select(F.col("call_id").alias("q"), F.col(column).alias("name")), types)
        return found.where("rank = 1").select(F.col("q").alias("call_id"), "id")

    def drugs(self, calls: DataFrame, types: tuple[str, ...]) -> DataFrame:
        """call_id, item, id (null: unknown), ord: items by their names, else by their names without preparation notes."""
        items = calls.select("call_id", F.posexplode("items").alias("ord", "item")).select("call_id", F.trim("item").alias("item"), F.col("ord").cast("long").alias("ord")).where("item <> ''").groupBy("call_id", "item").agg(F.min("ord").alias("ord"))
        items = gr.save(items, "items")
        distinct = items.select("item").distinct()
        plain = gr.save(self.resolve(distinct.select(F.col("item").alias("q"), F.col("item").alias("name")), types).where("rank = 1").select(F.col("q").alias("item"), F.col("id").alias("a")), "plain-items")
        noted = gr.save(distinct.join(plain, "item", "left_anti").select(F.col("item").alias("q"), tx.herb_base(F.col("item")).alias("name")).where("name <> q"), "noted-items")
        if noted.isEmpty():
            return items.join(plain, "item", "left").select("call_id", "item", F.col("a").alias("id"), "ord")
        base = self.resolve(noted, types).where("rank = 1").select(F.col("q").alias("item"), F.col("id").alias("b"))
        return items.join(plain, "item", "left").join(base, "item", "left").select("call_id", "item", F.coalesce("a", "b").alias("id"), "ord")

    def unresolved(self, drugs: DataFrame) -> DataFrame:
        return _listed(drugs.where("id is null"), ["call_id"], "u_", "item").select("call_id", F.transform("u_", lambda u: u["item"]).alias("unresolved"))

    def _answer(self, calls: DataFrame, coverage: Column, *parts: DataFrame) -> DataFrame:
        """call_id, coverage and the parts' arrays, empty where a call has none."""
        out = calls.select("call_id").distinct()
        arrays = []
        for p in parts:
            out = out.join(p, "call_id", "left")
            arrays += [f for f in p.schema.fields if f.name != "call_id"]
        kept = [F.coalesce(f.name, F.from_json(F.lit("[]"), f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in arrays]
        filled = out.select("call_id", *kept)
        return filled.select("call_id", coverage.alias("coverage"), *[f.name for f in arrays])

    # ---- search ---------------------------------------------------------------------------------------------------

    def index(self, domain: str, verification: bool = False) -> rt.Bm25Index:
        """The index of the types that a domain may see: statistics are of these alone, so hidden types leave no trace in scores."""
        key = (domain, verification)
        if key not in self._indexes:
            visible = ontology.visible(self.nodes, domain, verification)
            docs = gr.save(rt.virtual_documents(text_pieces(visible, self.edges)), "virtual-documents")
            self._indexes[key] = rt.Bm25Index(docs, lambda t: tx.char_ngrams(t, (1, 2, 3)))
        return self._indexes[key]

    def search_tcm_entities(self, calls: DataFrame, domain: str) -> DataFrame:
        """calls(call_id, query, entity_types, anchors, top_k): the best nodes by text, nearness to the anchors and documents shared with them.

        Asked types that the domain doesn't show leave a call without any type: not_covered, with an error.  No types: all that it shows.
        """
        shown = F.array(*[F.lit(t) for t in ontology.visible_types(domain)])
        asked = F.size(F.coalesce("entity_types", F.array().cast("array<string>"))) > 0
        c = calls.select("call_id", F.trim("query").alias("query"), F.when(asked, F.array_intersect("entity_types", shown)).otherwise(shown).alias("types"), F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"), F.greatest(F.lit(1), F.least(F.lit(MOST_HITS), F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(TOP_K)))).alias("k"))
        pool = rt.normalised(gr.save(self.index(domain).search(c.where("size(types) > 0"), lambda t: tx.char_ngrams(t, (1, 2, 3)), query_id="call_id", text_col="query"), "pool"))
        anchors = c.select(F.col("call_id").alias("query_id"), F.explode("anchors").alias("seed"))
        near = gr.expand(anchors.select("seed").distinct(), self.edges, self.nodes, HOPS, DECAY, allowed=ontology.visible_types(domain))
        reached = anchors.join(near.select("seed", "id", "score"), "seed").groupBy("query_id", "id").agg(F.max("score").alias("score"))
        docs = anchors.join(gr.documents_of(self.nodes).withColumnRenamed("id", "seed"), "seed").select("query_id", "doc")
        overlap = gr.document_overlap(docs, gr.documents_of(self.nodes).select("doc", "id").distinct())
        known = self.nodes.select("id", "type")
        ranked = rt.hybrid(pool, reached, overlap, known.join(ontology.visible(self.nodes, domain).select("id"), "id", "left_semi"), 10**6)
        fit = ranked.withColumnRenamed("query_id", "call_id").join(self.brief, "id").join(c.select("call_id", "types", "k"), "call_id").where(F.array_contains("types", F.col("type")))
        best = fit.withColumn("ord", F.row_number().over(gr.Window.partitionBy("call_id").orderBy("rank"))).where("ord <= k")
        refused = c.select("call_id", F.when(F.size("types") == 0, "no asked type is visible in this domain").alias("error"))
        out = self._answer(calls, F.lit("empty"), _listed(best, ["call_id"], "results", "id", "type", "name", "score", "semantic", "graph", "source"), refused)
        return out.withColumn("coverage", F.when(F.col("error").isNotNull(), "not_covered").when(F.size("results") > 0, "supported").otherwise("empty"))

    def look_up_options(self, cases: DataFrame) -> DataFrame:
        """call_id, options(letter, name, found, id, diseases) for cases(call_id, options as a map): every option, found or not, by its name or its canonical one."""
        options = cases.select("call_id", F.explode("options").alias("letter", "name"))
        asked = options.select(F.concat_ws("\x1f", F.col("call_id").cast("string"), "letter").alias("q"), "call_id", "letter", F.trim("name").alias("name"))
        first = lambda name: self.resolve(asked.select("q", name.alias("name")), ("Syndrome",)).where("rank = 1").select("q", "id")
        plain, canonical = first(F.col("name")), first(tx.canonical_syndrome(F.col("name"))).withColumnRenamed("id", "other")
        found = asked.join(plain, "q", "left").join(canonical, "q", "left").select("call_id", "letter", "name", F.coalesce("id", "other").alias("id"))
        above = self.step(found.where("id is not null"), ("HAS_SYNDROME", "SUBTYPE_HAS_SYNDROME"), out=False).select("id", F.col("name").alias("disease"), "ord")
        named = _listed(above, ["id"], "d_", "disease", most=4).select("id", F.transform("d_", lambda d: d["disease"]).alias("diseases"))
        rows = found.join(named, "id", "left").select("call_id", "letter", "name", F.col("id").isNotNull().alias("found"), "id", "diseases", F.col("letter").alias("ord"))
        return _listed(rows, ["call_id"], "options", "letter", "name", "found", "id", "diseases")

    def static_context(self, cases: DataFrame, domain: str = "clinical_reasoning", most: int = BLOCK_ENTITIES) -> DataFrame:
        """call_id, anchors, syndromes, options of cases(call_id, text, options): the likeliest diseases with their syndromes, syndromes like the text, and the options' look-up."""
        c = cases.select("call_id", tx.clinical_query(F.col("text")).alias("query"), "options")
        none = lambda kind: F.lit(None).cast(kind)
        ask = lambda types, anchors, k, df: self.search_tcm_entities(df.select("call_id", "query", F.array(*[F.lit(t) for t in types]).alias("entity_types"), anchors.alias("anchors"), F.lit(k).alias("top_k")), domain)
        ill = gr.save(ask(("Disease", "DiseaseSubtype"), none("array<string>"), 3, c).select("call_id", "results"), "anchors")
        ids = F.transform("results", lambda r: r["id"])
        like = ask(("Syndrome",), F.col("ids"), most, c.join(ill.select("call_id", ids.alias("ids")), "call_id")).select("call_id", F.col("results").alias("syndromes"))
        anchors = ill.select("call_id", F.posexplode("results").alias("ord", "r")).select("call_id", F.col("ord").cast("long").alias("ord"), F.col("r.id").alias("disease"), F.col("r.name").alias("name"), F.round("r.score", 3).alias("score"))
        below = gr.leaves_of(self.contexts()).join(self.brief.select(F.col("id").alias("leaf"), F.col("name").alias("syndrome")), "leaf").groupBy(F.col("top").alias("disease")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "syndrome"))), lambda x: x["syndrome"]), 1, most).alias("candidates"))
        listed = _listed(anchors.join(below, "disease", "left"), ["call_id"], "anchors", "disease", "name", "score", "candidates")
        return c.select("call_id", "query").join(listed, "call_id", "left").join(like, "call_id", "left").join(self.look_up_options(c), "call_id", "left")

    # ---- facts ----------------------------------------------------------------------------------------------------

    def members(self, ids: DataFrame) -> DataFrame:
        """id, member of each id's cluster."""
        return gr.cluster_members(ids.select(F.col("id").alias("seed")).distinct(), self.roots).select(F.col("seed").alias("id"), F.col("id").alias("member"))

    def step(self, ids: DataFrame, types: tuple[str, ...], out: bool = True, said: bool = False) -> DataFrame:
        """id, other, name, type, edge_type, ord, evidence, source_docs across edges of the types; only those with evidence, if `said`."""
        here, there = ("source", "target") if out else ("target", "source")
        some = self.edges.where(F.col("type").isin(*types) & ((F.size(gr.evidence_sentences(F.col("evidence"))) > 0) if said else F.lit(True))).select(F.col(here).alias("id"), F.col(there).alias("other"), F.col("type").alias("edge_type"), "ord", "evidence", "source_docs")
        return some.join(ids.select("id").distinct(), "id", "left_semi").join(self.brief.select(F.col("id").alias("other"), "name", "type"), "other")

    def preparation(self, ids: DataFrame) -> DataFrame:
        """id, marker, evidence: how a herb is to be prepared, from the names of its cluster and from notes right behind such a name in the evidence of its edges."""
        members = self.members(ids).join(self.brief.select(F.col("id").alias("member"), F.col("name").alias("own")), "member")
        noted = members.select("id", F.explode(tx.herb_markers(F.col("own"))).alias("marker"), F.col("own").alias("evidence"), F.lit(-1).cast("long").alias("ord"))
        called = members.select("id", F.explode(F.array_distinct(F.array("own", tx.herb_base(F.col("own"))))).alias("called")).distinct()
        edges = self.step(members.select(F.col("member").alias("id")), ("CONTAINS_HERB", "USES_HERB_DIRECT"), out=False, said=True).select(F.col("id").alias("member"), "ord", F.explode(gr.evidence_sentences(F.col("evidence"))).alias("evidence"))
        said = members.select("id", "member").join(edges, "member").join(called, "id")
        said = said.select("id", F.explode(tx.markers_after_name(F.col("evidence"), F.col("called"))).alias("marker"), "evidence", "ord")
        return noted.unionByName(said).groupBy("id", "marker", "evidence").agg(F.min("ord").alias("ord"))

    def attribute(self, ids: DataFrame, path: str, name: str) -> DataFrame:
        return ids.join(self.nodes.select("id", F.get_json_object("attrs", f"$.{path}").alias(name)), "id", "left")

    def natures(self, ids: DataFrame) -> DataFrame:
        """id, nature: the herb's own pharmacopoeia entry, else that of an entry it is registered in."""
        own = self.attribute(ids.select("id").distinct(), "pharmacopoeia_entry.nature_taste_meridian", "own_")
        entries = self.step(ids, ("REGISTERED_IN_PHARMACOPOEIA",)).join(self.nodes.select(F.col("id").alias("other"), F.get_json_object("attrs", "$.nature_taste_meridian").alias("n_")), "other")
        first = entries.groupBy("id").agg(F.min_by("n_", "ord").alias("n_"))
        return own.join(first, "id", "left").select("id", F.coalesce(F.nullif("own_", F.lit("")), "n_").alias("nature"))

    # ---- checkers -------------------------------------------------------------------------------------------------

    def check_dose(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, items).  Doses aren't in the graph: always not_covered, with toxicity and preparation as what it does know."""
        d = self.drugs(calls, ("Herb", "PharmacoPoeiaEntry"))
        marks = _listed(self.preparation(d), ["id"], "m_", "marker").select("id", F.array_sort(F.transform("m_", lambda m: m["marker"])).alias("markers"))
        found = d.where("id is not null").join(self.natures(d.where("id is not null")), "id").join(marks, "id", "left")
        rows = found.withColumn("toxicity", toxicity(F.col("nature"))).withColumn("dose_range", F.lit(None).cast("string"))
        return self._answer(calls, F.lit("not_covered"), _listed(rows, ["call_id"], "findings", "item", "id", "dose_range", "toxicity", "nature", "markers"), self.unresolved(d))

    def check_duplicate_medication(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, items): one thing under several names, herbs that formulas share, herbs that a formula holds already.  Patent medicines' contents aren't in the graph."""
        d = gr.save(self.drugs(calls, ("Herb", "Formula", "PatentMedicine")), "drugs")
        # a formula's parts and what calls name are joined once and written, as every finding reads them
        known = gr.save(d.where("id is not null").join(self.roots, "id").join(self.brief, "id").select("call_id", "item", "id", "root", "type", "ord"), "known")
        alias = known.groupBy("call_id", "root").agg(F.array_sort(F.collect_set("item")).alias("listed_as"), F.min("ord").alias("ord")).where("size(listed_as) > 1")
        formulas = known.where("type = 'Formula'")
        edges = self.edges.where("type = 'CONTAINS_HERB'").select(F.col("source").alias("id"), F.col("target").alias("herb")).join(formulas.select("id").distinct(), "id", "left_semi")
        held = edges.join(self.roots.select(F.col("id").alias("herb"), F.col("root").alias("part")), "herb").select("id", "part").distinct()
        contents = gr.save(formulas.select("call_id", F.col("item").alias("formula"), "id").join(held, "id").select("call_id", "formula", "part"), "contents")
        # dealt by call once: all that follows is within a call
        overlap = rules.item_overlap(contents.repartition("call_id"), "call_id", "formula", "part").withColumn("ord", F.struct("a", "b"))
        loose = known.where("type = 'Herb'").select("call_id", F.col("item").alias("herb"), F.col("root").alias("part"), "ord").join(contents, ["call_id", "part"])
        kinds = known.groupBy("call_id").agg(F.count("*").alias("n_known"), F.count_if(F.col("type") == "PatentMedicine").alias("n_patent"))
        verdict = F.when(F.col("n_patent") > 0, "partially_supported").when(F.col("n_known") > 0, "supported").otherwise("empty")
        return self._answer(calls, verdict, _listed(alias, ["call_id"], "alias_duplicates", "root", "listed_as"), _listed(overlap, ["call_id"], "formula_overlap", "a", "b", "shared", "jaccard"), _listed(loose, ["call_id"], "herb_in_formula", "herb", "formula"), kinds, self.unresolved(d)).drop("n_known", "n_patent")

    def check_restricted_item(self, calls: DataFrame, domain: str = "prescription_safety") -> DataFrame:
        """calls(call_id, items, patient_context): what items are contraindicated or to be used with caution for, and whether that is the patient's context.

        A context that names nothing is searched among safety contexts and syndromes; hits whose names hold it are meant.  Without
        any context every restriction matches.
        """
        d = gr.save(self.drugs(calls, ("RestrictedItem", "Herb", "ExternalTherapy")), "items")
        context = self.resolve(calls.select(F.col("call_id").alias("q"), F.col("patient_context").alias("name")), ("Syndrome", "SafetyContext", "Disease")).select(F.col("q").alias("call_id"), F.col("id").alias("applies_to"))
        context = gr.save(context, "contexts")
        lost = gr.save(calls.select("call_id", F.trim("patient_context").alias("query")).where("query <> ''").join(context.select("call_id"), "call_id", "left_anti"), "lost-contexts")
        if not lost.isEmpty():
            kinds = F.array(*[F.lit(t) for t in ("SafetyContext", "Syndrome")])
            hits = self.search_tcm_entities(lost.select("call_id", "query", kinds.alias("entity_types"), F.lit(None).cast("array<string>").alias("anchors"), F.lit(TOP_K).alias("top_k")), domain)
            meant = hits.select("call_id", F.explode("results").alias("r")).join(lost, "call_id").where(F.contains("r.name", "query"))
            context = context.unionByName(meant.select("call_id", F.col("r.id").alias("applies_to")))
        context = context.withColumn("hit_", F.lit(True))
        some = context.select("call_id").distinct().withColumn("any_", F.lit(True))
        edges = self.members(d.where("id is not null")).join(self.edges.where(F.col("type").isin(*CONSTRAINTS)).select(F.col("source").alias("member"), "type", F.col("target").alias("applies_to"), F.col("ord").alias("o2")), "member")
        hits = d.join(edges, "id").join(context, ["call_id", "applies_to"], "left").join(some, "call_id", "left")
        hits = hits.select("call_id", "item", "id", F.when(F.col("type") == "CONTRAINDICATED_FOR", "contraindicated").otherwise("caution").alias("severity"), "applies_to", (F.col("any_").isNull() | F.col("hit_").isNotNull()).alias("matches_context"), F.struct("ord", "o2").alias("ord"))
        known = _listed(d.where("id is not null"), ["call_id"], "resolved", "item", "id")
        verdict = rules.coverage(F.size("restrictions") > 0, F.size("resolved") > 0)
        return self._answer(calls, verdict, _listed(hits, ["call_id"], "restrictions", "item", "severity", "applies_to", "matches_context"), known, self.unresolved(d))

    def check_combination(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, items of two or more; else error).  Incompatibility isn't in the graph: always not_covered, whatever formulas hold both."""
        d = gr.save(self.drugs(calls, ("Herb",)), "herbs")
        known = d.where("id is not null")
        held = self.members(known).join(self.edges.where("type = 'CONTAINS_HERB'").select(F.col("target").alias("member"), F.col("source").alias("formula")), "member").select("id", "formula").distinct()
        pairs = gr.save(known.select("call_id", F.col("item").alias("a"), F.col("id").alias("ia")).join(known.select("call_id", F.col("item").alias("b"), F.col("id").alias("ib")), "call_id").where("a < b"), "herb-pairs")
        both = rules.held_together(pairs.select(F.col("ia").alias("a"), F.col("ib").alias("b")), held.select(F.col("formula").alias("container"), F.col("id").alias("part"))).toDF("ia", "ib", "n")
        rows = pairs.join(both, ["ia", "ib"], "left").select("call_id", "a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n_co_occurrences"), F.lit("not_covered").alias("verdict"), F.struct("a", "b").alias("ord"))
        toxic = known.join(self.natures(known), "id").withColumn("toxicity", toxicity(F.col("nature"))).where("toxicity is not null")
        few = calls.select("call_id", F.when(F.size("items") < 2, "two items or more are needed").alias("error"))
        return self._answer(calls, F.lit("not_covered"), _listed(rows, ["call_id"], "pairs", "a", "b", "verdict", "n_co_occurrences"), _listed(toxic, ["call_id"], "toxic", "item", "toxicity"), self.unresolved(d), few)

    def check_decoction_requirement(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, items, claimed): attested preparations of each herb and the verdict on a claimed one."""
        d = gr.save(self.drugs(calls, ("Herb",)), "herbs").join(calls.select("call_id", "claimed"), "call_id")
        marks = _listed(self.preparation(d.where("id is not null")), ["id"], "m_", "marker").select("id", F.array_sort(F.transform("m_", lambda m: m["marker"])).alias("attested"))
        rows = d.where("id is not null").join(marks, "id", "left").withColumn("attested", F.coalesce("attested", F.array().cast("array<string>")))
        rows = rows.withColumn("verdict", rules.claimed_requirement(F.trim("claimed"), F.col("attested")))
        verdict = rules.coverage(F.exists("findings", lambda f: F.size(f["attested"]) > 0), F.size("findings") > 0)
        return self._answer(calls, verdict, _listed(rows, ["call_id"], "findings", "item", "id", "attested", "verdict"), self.unresolved(d))

    def verify_tcm_decision(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, syndrome, disease, treatment_principle, clinical_features): verdict of each check and overall.

        The syndrome or one of its atoms must be known; it must belong to the disease; the best attested principle must share half
        of the bigrams; features must stand in the presentation in that disease or share a quarter of theirs with it.
        """
        c = calls.select("call_id", F.trim("syndrome").alias("syndrome"), F.nullif(F.trim("disease"), F.lit("")).alias("disease"), F.nullif(F.trim("treatment_principle"), F.lit("")).alias("principle"), F.filter(F.coalesce("clinical_features", F.array().cast("array<string>")), lambda f: F.trim(f) != "").alias("features"))
        whole = self.first(c, "syndrome", ("Syndrome",))
        atoms = c.join(whole, "call_id", "left_anti").select("call_id", F.posexplode(tx.syndrome_atoms(F.col("syndrome"))).alias("pos", "atom"))
        part = self.resolve(atoms.select(F.struct("call_id", "pos").alias("q"), F.col("atom").alias("name")), ("Syndrome",)).groupBy("q.call_id").agg(F.min_by("id", F.struct("q.pos", "rank")).alias("id"))
        known = gr.save(whole.unionByName(part.select("call_id", "id")), "syndromes")
        parents = self.step(known, ("HAS_SYNDROME", "SUBTYPE_HAS_SYNDROME"), out=False).join(self.nodes.select(F.col("id").alias("other"), F.coalesce(F.get_json_object("attrs", "$.disease"), F.lit("")).alias("of_")), "other")
        named = known.join(c.select("call_id", "disease"), "call_id").join(parents, "id", "left")
        fits = F.contains(F.col("name"), F.col("disease")) | F.contains(F.col("disease"), F.col("name")) | F.contains(F.col("of_"), F.col("disease"))
        link = named.groupBy("call_id").agg(F.first("disease").alias("disease"), F.count("other").alias("n"), F.min(F.when(fits, F.struct("ord", F.col("other").alias("anchor")))).alias("m"))
        link = link.select("call_id", F.when(F.col("disease").isNull(), F.when(F.col("n") > 0, "partially_supported").otherwise("not_in_graph")).when(F.col("m").isNotNull(), "supported").when(F.col("n") > 0, "contradicted").otherwise("not_in_graph").alias("link"), F.col("m.anchor").alias("anchor"))
        grams = lambda t: F.array_distinct(tx.char_ngrams(t, (2,)))
        cures = self.step(known, ("TREATED_BY_PRINCIPLE",)).select("id", F.col("name").alias("cure"))
        likeness = known.join(c.where("principle is not null").select("call_id", "principle"), "call_id").join(cures, "id", "left").select("call_id", "cure", tx.jaccard(grams(F.col("cure")), grams(F.col("principle"))).alias("s"))
        principle = likeness.groupBy("call_id").agg(F.max("s").alias("s"), F.count("cure").alias("n")).select("call_id", F.when((F.col("n") > 0) & (F.col("s") >= rules.PRINCIPLE_JACCARD), "supported").when(F.col("n") > 0, "partially_supported").otherwise("not_in_graph").alias("principle"))
        shown = gr.presentation(known.join(link, "call_id").select(F.col("id").alias("syndrome"), F.col("anchor").alias("disease")).distinct(), self.edges, self.nodes)
        seen = known.join(link, "call_id").join(c.where("size(features) > 0").select("call_id", "features"), "call_id").join(shown, (F.col("id") == F.col("syndrome")) & F.col("anchor").eqNullSafe(shown["disease"]), "left")
        literal = F.exists("features", lambda f: F.contains(F.col("sentence"), f))
        share = tx.containment(grams(F.array_join("features", " ")), grams(F.col("sentence")))
        overlap = seen.select("call_id", F.when(F.col("sentence").isNull(), "not_covered").when(literal | (share >= rules.FEATURE_SHARE), "supported").when(F.col("scope") == "global_first_mention", "not_covered").otherwise("partially_supported").alias("features"))
        out = c.select("call_id").join(known, "call_id", "left").join(link.select("call_id", "link"), "call_id", "left").join(principle, "call_id", "left").join(overlap, "call_id", "left")
        verdicts = F.array_compact(F.array("link", "principle", "features"))
        overall = F.when(F.col("id").isNull(), "not_in_graph").otherwise(rules.overall_verdict(F.concat(F.array(F.lit("supported")), verdicts)))
        return out.select("call_id", F.when(F.col("id").isNull(), "partially_supported").otherwise("supported").alias("coverage"), F.col("id").alias("syndrome"), F.when(F.col("id").isNull(), "not_in_graph").otherwise("supported").alias("exists"), "link", "principle", "features", overall.alias("overall"))

    # ---- look-ups -------------------------------------------------------------------------------------------------

    def documents(self, owners: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
        """keys, documents(doc, title) of owners(keys, id, ord): documents of nodes in first-seen order, as far as the graph has their records."""
        docs = owners.join(gr.documents_of(self.nodes), "id").select(*keys, "doc", F.struct("ord", "pos").alias("ord"))
        first = docs.groupBy(*keys, "doc").agg(F.min("ord").alias("ord"))
        records = self.nodes.where("type = 'DocumentSource'").select(F.coalesce(F.get_json_object("attrs", "$.doc_id"), F.col("id")).alias("doc"), F.col("name").alias("title"), *[F.get_json_object("attrs", f"$.{f}").alias(f) for f in ("doc_type", "department", "version_label", "publisher", "effective_date", "supersedes")])
        rank = F.row_number().over(gr.Window.partitionBy(*keys).orderBy("ord", "doc"))
        return _listed(first.withColumn("rn_", rank).where(f"rn_ <= {most}").join(records, "doc"), keys, "documents", "doc", "title", "doc_type", "department", "version_label", "publisher", "effective_date", "supersedes")

    def retrieve_source_evidence(self, calls: DataFrame, most: int = 8, together: int = 25) -> DataFrame:
        """calls(call_id, entity, doc_ids): documents that were asked for, then those of the entity, and what else they hold."""
        own = self.first(calls, "entity", None)
        asked = calls.select("call_id", F.posexplode("doc_ids").alias("pos", "doc")).select("call_id", "doc", F.struct(F.lit(0).alias("a"), "pos").alias("ord"))
        theirs = own.join(gr.documents_of(self.nodes), "id").select("call_id", "doc", F.struct(F.lit(1).alias("a"), "pos").alias("ord"))
        docs = asked.unionByName(theirs).groupBy("call_id", "doc").agg(F.min("ord").alias("ord"))
        docs = docs.withColumn("rn_", F.row_number().over(gr.Window.partitionBy("call_id").orderBy("ord"))).where(f"rn_ <= {most}")
        records = self.nodes.where("type = 'DocumentSource'").select(F.coalesce(F.get_json_object("attrs", "$.doc_id"), F.col("id")).alias("doc"), F.col("name").alias("title"))
        held = gr.document_nodes(self.nodes, self.edges).join(self.nodes.where("type <> 'DocumentSource'").select("id", "name", "ord"), "id")
        inside = held.join(docs.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), 1, together).alias("co_occurring"), F.count("*").alias("n_co_occurring"))
        rows = docs.join(records, "doc").join(inside, "doc", "left")
        return self._answer(calls, F.when(F.size("documents") > 0, "supported").otherwise("empty"), _listed(rows, ["call_id"], "documents", "doc", "title", "co_occurring", "n_co_occurring"), own.withColumnRenamed("id", "entity"))

    def retrieve_safety_constraints(self, calls: DataFrame, most: int = 15) -> DataFrame:
        """calls(call_id, entity, context): constraints at either end of the entity's cluster, or of safety contexts whose name holds the context."""
        seeds = self.resolve(calls.select(F.col("call_id").alias("q"), F.col("entity").alias("name")), None).where("rank <= 3").select(F.col("q").alias("call_id"), "id", F.col("rank").alias("r"))
        wanted = calls.select("call_id", F.nullif(F.trim("context"), F.lit("")).alias("context")).where("context is not null")
        contexts = wanted.join(self.nodes.where("type = 'SafetyContext'").select("id", "name", "ord"), F.contains("name", "context")).withColumn("r", F.row_number().over(gr.Window.partitionBy("call_id").orderBy("ord")) + 3).where(f"r <= {most + 3}").select("call_id", "id", "r")
        found = rules.constraints(seeds.select("id").distinct(), self.edges, self.roots)
        by_seed = seeds.join(found, F.col("id") == F.col("seed"))
        of_context = contexts.join(self.edges.where(F.col("type").isin(*CONSTRAINTS)).select(F.when(F.col("type") == "CONTRAINDICATED_FOR", "contraindicated").otherwise("caution").alias("severity"), F.col("source").alias("restricted"), F.col("target").alias("applies_to"), "ord"), F.col("id") == F.col("applies_to"))
        rows = by_seed.select("call_id", "severity", "restricted", "applies_to", F.struct("r", "ord").alias("ord")).unionByName(of_context.select("call_id", "severity", "restricted", "applies_to", F.struct("r", "ord").alias("ord")))
        rows = rows.join(self.brief.select(F.col("id").alias("restricted"), "type", "name"), "restricted").withColumn("kind", tx.restriction_kind(F.col("type"), F.col("name")))
        known = _listed(seeds.unionByName(contexts), ["call_id"], "resolved", "id", order="r")
        return self._answer(calls, rules.coverage(F.size("findings") > 0, F.size("resolved") > 0), _listed(rows, ["call_id"], "findings", "severity", "restricted", "applies_to", "kind", most=most), known)

    def retrieve_pharmacopeia_entry(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, herb): entries of the herb and of its cluster, with the strongest toxicity marker; doses are never there."""
        seeds = self.resolve(calls.select(F.col("call_id").alias("q"), F.col("herb").alias("name")), ("PharmacoPoeiaEntry", "Herb")).select(F.col("q").alias("call_id"), "id", "rank")
        kin = seeds.join(self.members(seeds), "id").select("call_id", F.col("member").alias("id"), F.struct(F.when(F.col("member") == F.col("id"), 0).otherwise(1).alias("a"), "rank").alias("ord"))
        own = kin.join(self.brief.where("type = 'PharmacoPoeiaEntry'"), "id").select("call_id", F.col("id").alias("entry"), "ord")
        theirs = kin.join(self.step(kin, ("REGISTERED_IN_PHARMACOPOEIA",)).select("id", F.col("other").alias("entry")), "id").select("call_id", "entry", "ord")
        get = lambda f: F.get_json_object("attrs", f"$.{f}").alias(f)
        rows = own.unionByName(theirs).join(self.nodes.select(F.col("id").alias("entry"), "name", get("part_used"), get("nature_taste_meridian"), get("pharmacopoeial_functions"), F.from_json(F.get_json_object("attrs", "$.common_aliases"), "array<string>").alias("common_aliases")), "entry").withColumn("toxicity", toxicity(F.col("nature_taste_meridian")))
        known = _listed(seeds, ["call_id"], "resolved", "id", order="rank")
        verdict = F.when(F.size("entries") > 0, "supported").when(F.size("resolved") > 0, "partially_supported").otherwise("empty")
        return self._answer(calls, verdict, _listed(rows, ["call_id"], "entries", "entry", "name", "part_used", "nature_taste_meridian", "pharmacopoeial_functions", "common_aliases", "toxicity"), known)

    def retrieve_medication_knowledge(self, calls: DataFrame, most: int = 15) -> DataFrame:
        """calls(call_id, name): what a formula holds, what uses a drug, how a herb is prepared, which diseases a patent medicine's syndromes belong to."""
        own = gr.save(self.first(calls, "name", DRUGS), "drugs").join(self.brief.select("id", "type"), "id")
        of = lambda t: own.where(F.col("type") == t)
        holds = own.select("call_id", "id").join(self.step(of("Formula"), ("CONTAINS_HERB",)).select("id", F.col("other").alias("herb"), "name", "ord"), "id")
        inside = own.select("call_id", "id").join(self.step(of("Herb"), ("CONTAINS_HERB",), out=False).select("id", F.col("other").alias("formula"), "name", "ord"), "id")
        users = self.step(own, ("USES_FORMULA", "USES_HERB_DIRECT", "USES_PATENT_MEDICINE", "USES_EXTERNAL_THERAPY"), out=False)
        used = own.select("call_id", "id").join(users.select("id", F.col("other").alias("syndrome"), "name", "ord"), "id")
        ill = used.select("call_id", F.col("syndrome").alias("id")).join(of("PatentMedicine").select("call_id"), "call_id", "left_semi")
        diseases = ill.join(self.step(ill, ("HAS_SYNDROME",), out=False).select("id", F.col("other").alias("disease"), "name", "ord"), "id")
        marks = self.preparation(of("Herb")).join(own.select("call_id", "id"), "id")
        aliases = own.select("call_id", "id").join(self.members(own), "id").where("member <> id").join(self.nodes.select(F.col("id").alias("member"), "name", "ord"), "member")
        return self._answer(calls, F.when(F.col("drug").isNotNull(), "supported").otherwise("empty"), own.select("call_id", F.col("id").alias("drug"), F.col("type")), _listed(aliases, ["call_id"], "aliases", "member", "name"), _listed(holds, ["call_id"], "composition", "herb", "name", most=60), _listed(inside, ["call_id"], "in_formulas", "formula", "name", most=most), _listed(used, ["call_id"], "used_by", "syndrome", "name", most=most), _listed(diseases, ["call_id"], "indicated_diseases", "disease", "name", most=most), _listed(marks, ["call_id"], "preparation", "marker", "evidence"), self.documents(own.select("call_id", "id", F.lit(0).alias("ord")), ["call_id"]))

    def contexts(self) -> DataFrame:
        """top, via, leaf, ord for diseases and for subtypes that are entered themselves."""
        paths = gr.hierarchy(self.edges)
        own = self.edges.where("type = 'SUBTYPE_HAS_SYNDROME'").select(F.col("source").alias("top"), F.lit(None).cast("string").alias("via"), F.col("target").alias("leaf"), F.struct(F.lit(0).cast("long").alias("a"), F.col("ord").alias("b"), F.lit(0).cast("long").alias("c")).alias("ord"))
        return paths.unionByName(own)

    def retrieve_clinical_context(self, calls: DataFrame, most: int = 12) -> DataFrame:
        """calls(call_id, entity): the disease of a disease, subtype or stage, its departments, subtypes, syndromes as they present there, and stages."""
        own = self.first(calls, "entity", ("Disease", "DiseaseSubtype", "PathwayStage"))
        up = self.step(own, ("HAS_SUBTYPE", "HAS_PATHWAY_STAGE"), out=False).groupBy("id").agg(F.min_by("other", "ord").alias("above"))
        of = gr.save(own.join(self.brief.select("id", "type"), "id").join(up, "id", "left").select("call_id", "id", F.when(F.col("type") == "Disease", F.col("id")).otherwise(F.coalesce("above", "id")).alias("disease")), "diseases")
        ids = of.select(F.col("disease").alias("id"))
        across = lambda t, n: of.select("call_id", F.col("disease").alias("id")).join(self.step(ids, (t,)).select("id", F.col("other").alias(n), "name", "ord"), "id")
        syndromes = across("HAS_SYNDROME", "syndrome")
        shown = gr.presentation(syndromes.select("syndrome", F.col("id").alias("disease")).distinct(), self.edges, self.nodes)
        syndromes = syndromes.join(shown.withColumnRenamed("disease", "id"), ["syndrome", "id"])
        subtypes = across("HAS_SUBTYPE", "subtype")
        below = gr.leaves_of(self.contexts()).select(F.col("top").alias("subtype"), F.col("leaf"), F.col("ord").alias("o2"))
        subs = subtypes.join(below.groupBy("subtype").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o2", "leaf"))), lambda x: x["leaf"]), 1, most).alias("syndromes")), "subtype", "left")
        stages = across("HAS_PATHWAY_STAGE", "stage")
        verdict = F.when(F.col("disease").isNull(), "empty").when((F.size("syndromes") > 0) | (F.size("subtypes") > 0), "supported").otherwise("partially_supported")
        return self._answer(calls, verdict, of.select("call_id", F.col("id").alias("resolved"), "disease"), _listed(across("BELONGS_TO_DEPARTMENT", "department"), ["call_id"], "departments", "department", "name"), _listed(subs, ["call_id"], "subtypes", "subtype", "name", "syndromes"), _listed(syndromes, ["call_id"], "syndromes", "syndrome", "name", "sentence", "scope", most=most), _listed(self._staged(stages), ["call_id"], "pathway_stages", "stage", "name", "variant", most=12), self.documents(of.select("call_id", F.col("disease").alias("id"), F.lit(0).alias("ord")), ["call_id"]))

    def _staged(self, stages: DataFrame) -> DataFrame:
        """stages(stage, ord, ...) in the order of variant and place, with their attributes."""
        get = lambda f: F.get_json_object("attrs", f"$.{f}")
        many = [F.coalesce(F.from_json(get(f), "array<string>"), F.array().cast("array<string>")).alias(f) for f in STAGE_FIELDS]
        known = self.nodes.select(F.col("id").alias("stage"), F.coalesce(get("variant"), F.lit("")).alias("variant"), F.coalesce(get("order").cast("long"), F.lit(0)).alias("place"), *many)
        return stages.join(known, "stage").withColumn("ord", F.struct("variant", "place", "ord"))

    def siblings(self, syndromes: DataFrame, diseases: DataFrame, most: int = 10) -> DataFrame:
        """call_id, siblings: the other syndromes of the same diseases, directly or through subtypes; syndromes(call_id, id), diseases(call_id, disease, ord)."""
        near = diseases.join(gr.leaves_of(self.contexts()).select(F.col("top").alias("disease"), "leaf", "via", F.col("ord").alias("o2")), "disease").join(syndromes.select("call_id", F.col("id").alias("self_")), "call_id").where("leaf <> self_")
        first = near.groupBy("call_id", "leaf").agg(F.min_by("via", F.struct("ord", "o2")).alias("via"), F.min(F.struct("ord", "o2")).alias("ord"))
        return _listed(first.join(self.brief.select(F.col("id").alias("leaf"), "name"), "leaf"), ["call_id"], "siblings", "leaf", "name", "via", most=most)

    def retrieve_syndrome_evidence(self, calls: DataFrame, most: int = 10) -> DataFrame:
        """calls(call_id, syndrome, disease_filter): diseases and subtypes of a syndrome, how it presents there, stages, competing syndromes."""
        own = gr.save(self.first(calls, "syndrome", ("Syndrome",)), "syndromes")
        wanted = own.join(calls.select("call_id", F.coalesce(F.trim("disease_filter"), F.lit("")).alias("f")), "call_id")
        diseases = wanted.join(self.step(own, ("HAS_SYNDROME",), out=False).select("id", F.col("other").alias("disease"), "name", "ord"), "id").where((F.col("f") == "") | F.contains("name", "f"))
        diseases = gr.save(diseases.join(gr.presentation(diseases.select(F.col("id").alias("syndrome"), "disease").distinct(), self.edges, self.nodes).withColumnRenamed("syndrome", "id"), ["id", "disease"]), "presented")
        subtypes = wanted.join(self.step(own, ("SUBTYPE_HAS_SYNDROME",), out=False).select("id", F.col("other").alias("subtype"), "name", "ord"), "id").join(self.nodes.select(F.col("id").alias("subtype"), F.coalesce(F.get_json_object("attrs", "$.disease"), F.lit("")).alias("of_")), "subtype").where((F.col("f") == "") | F.contains("of_", "f"))
        focus = wanted.join(diseases.where("f <> ''").groupBy("call_id").agg(F.min_by("disease", "ord").alias("disease")), "call_id", "left")
        shown = gr.presentation(focus.select(F.col("id").alias("syndrome"), "disease").distinct(), self.edges, self.nodes)
        focus = focus.join(shown.select(F.col("syndrome").alias("id"), F.col("disease").alias("d_"), F.col("sentence").alias("presentation"), F.col("scope").alias("presentation_scope")), "id").where(F.col("disease").eqNullSafe(F.col("d_")))
        top = diseases.withColumn("rn_", F.row_number().over(gr.Window.partitionBy("call_id").orderBy("ord")))
        head = top.where("rn_ <= 3").select("call_id", F.col("disease").alias("id"), "rn_")
        stages = head.join(self.step(head, ("HAS_PATHWAY_STAGE",)).select("id", F.col("other").alias("stage"), "name", F.col("ord").alias("o2")), "id").withColumn("ord", F.struct("rn_", "o2"))
        verdict = F.when(F.col("resolved").isNull(), "empty").when(F.col("presentation").isNotNull(), "supported").otherwise("partially_supported")
        return self._answer(calls, verdict, focus.select("call_id", F.col("id").alias("resolved"), "presentation", "presentation_scope"), _listed(diseases, ["call_id"], "diseases", "disease", "name", "sentence", "scope", most=most), _listed(subtypes, ["call_id"], "subtypes", "subtype", "name", most=most), _listed(stages, ["call_id"], "pathway_stages", "stage", "name", most=6), self.siblings(own, top.where("rn_ <= 2").select("call_id", "disease", F.col("rn_").alias("ord"))), self.documents(own.select("call_id", "id", F.lit(0).alias("ord")), ["call_id"]))

    def retrieve_pathway_stage(self, calls: DataFrame, most: int = 8) -> DataFrame:
        """calls(call_id, disease, stage, variant): the stages of a disease's pathway in order, with what follows and precedes each."""
        own = gr.save(self.first(calls, "disease", ("Disease",)), "diseases")
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
        every = own.join(self.step(own, ("HAS_PATHWAY_STAGE",)).select("id", F.col("other").alias("stage"), "name", "ord"), "id")
        asked = calls.select("call_id", blank("stage").alias("asked_stage"), blank("variant").alias("asked_variant"))
        open_ = gr.save(self._staged(every).join(asked, "call_id").where((F.col("asked_variant") == "") | F.contains("variant", "asked_variant")), "stages")
        near = lambda out, n: self.step(open_.select(F.col("stage").alias("id")), ("NEXT_STAGE",), out=out).groupBy(F.col("id").alias("stage")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "other"))), lambda x: x["other"]).alias(n))
        fit = open_.where((F.col("asked_stage") == "") | (F.col("stage") == F.col("asked_stage")) | F.contains("name", "asked_stage")).join(near(True, "next"), "stage", "left").join(near(False, "previous"), "stage", "left")
        absent = F.filter(F.array(F.lit("entry_criteria"), F.lit("exit_criteria")), lambda f: ((f == "entry_criteria") & (F.size("entry_criteria") == 0)) | ((f == "exit_criteria") & (F.size("exit_criteria") == 0)))
        verdict = F.when(F.size("stages") > 0, "supported").when(F.size("available") > 0, "partially_supported").otherwise("empty")
        return self._answer(calls, verdict, own.withColumnRenamed("id", "disease"), _listed(open_, ["call_id"], "available", "stage", "name"), _listed(fit.withColumn("absent", absent), ["call_id"], "stages", "stage", "name", "variant", "place", *STAGE_FIELDS, "next", "previous", "absent", most=most))

    def evaluate_pathway_transition(self, calls: DataFrame) -> DataFrame:
        """calls(call_id, stage_id, disease, findings): exit criteria of a stage and entry criteria of its successors against the findings, and a recommendation."""
        blank = F.coalesce(F.trim("disease"), F.lit("")) == ""
        own = self.resolve(calls.select(F.col("call_id").alias("q"), F.col("stage_id").alias("name")), ("PathwayStage",)).join(self.brief.where("type = 'PathwayStage'").select("id"), "id", "left_semi").where("rank = 1").select(F.col("q").alias("call_id"), "id")
        exact = own.join(calls.select("call_id", "stage_id", blank.alias("b_")), "call_id").where("b_ or id = stage_id").select("call_id", "id")
        ill = self.first(calls.where(~blank), "disease", ("Disease",)).join(exact, "call_id", "left_anti")
        within = ill.join(self.step(ill, ("HAS_PATHWAY_STAGE",)).select("id", F.col("other").alias("stage"), "name", "ord"), "id").join(calls.select("call_id", F.trim("stage_id").alias("s")), "call_id").where("s <> '' and (contains(name, s) or stage = s)").groupBy("call_id").agg(F.min_by("stage", "ord").alias("id"))
        stage = gr.save(exact.unionByName(within), "stage")
        said = calls.select("call_id", F.posexplode("findings").alias("finding_id", "finding")).where("trim(finding) <> ''")
        listed = lambda df, f: df.join(self.nodes.select(F.col("id").alias("at"), F.from_json(F.get_json_object("attrs", f"$.{f}"), "array<string>").alias("x")), "at").select("call_id", "at", F.posexplode("x").alias("criterion_id", "criterion"))
        exits = listed(stage.select("call_id", F.col("id").alias("at")), "exit_criteria")
        after = stage.join(self.step(stage, ("NEXT_STAGE",)).select("id", F.col("other").alias("at"), "ord"), "id").select("call_id", "at", "ord").groupBy("call_id", "at").agg(F.min("ord").alias("ord"))
        entries = listed(after.select("call_id", "at"), "entry_criteria")
        grams = lambda t: tx.char_ngrams(t, (2,))
        judged = gr.save(rules.match_criteria(exits.withColumn("way", F.lit("exit")).unionByName(entries.withColumn("way", F.lit("entry"))), said.join(exits.select("call_id", "at").distinct().withColumn("way", F.lit("exit")).unionByName(entries.select("call_id", "at").distinct().withColumn("way", F.lit("entry"))), "call_id"), grams, ["call_id", "way", "at"]), "criteria")
        n_out = judged.where("way = 'exit'").groupBy("call_id").agg(F.count("*").alias("n_exit"), F.count_if(F.col("status") == "met").alias("n_exit_met"), F.count_if(F.col("status") == "contradicted").alias("n_exit_contradicted"))
        n_in = judged.where("way = 'entry'").groupBy("call_id", "at").agg(F.min((F.col("status") == "met").cast("int")).alias("all_")).groupBy("call_id").agg((F.max("all_") == 1).alias("any_entry_all_met"))
        n_next = after.groupBy("call_id").agg(F.count("*").alias("n_successors"))
        row = stage.join(n_out, "call_id", "left").join(n_in, "call_id", "left").join(n_next, "call_id", "left").join(said.groupBy("call_id").agg(F.count("*").alias("n_findings")), "call_id", "left")
        row = row.select("call_id", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exit", "n_exit_met", "n_exit_contradicted", "n_successors", "n_findings")], F.coalesce("any_entry_all_met", F.lit(False)).alias("any_entry_all_met"), F.col("any_entry_all_met").isNotNull().alias("any_entry"))
        told = row.select("call_id", F.col("id").alias("stage"), F.when((F.col("n_exit") > 0) | (F.col("n_successors") > 0), "supported").otherwise("not_covered").alias("c_"), rules.transition(row).alias("recommendation"))
        out = self._answer(calls, F.coalesce("c_", F.lit("empty")), told, _listed(judged.withColumn("ord", F.struct("way", "at", "criterion_id")), ["call_id"], "criteria", "way", "at", "criterion", "score", "status"))
        return out.withColumn("recommendation", F.coalesce("recommendation", F.lit("insufficient_evidence"))).drop("c_")

    def retrieve_treatment_plan(self, calls: DataFrame, most: int = 10) -> DataFrame:
        """calls(call_id, syndrome, disease): treatments of a syndrome, those that share a document with the disease's own records kept apart from those of other diseases."""
        own = self.first(calls, "syndrome", ("Syndrome",))
        ill = self.first(calls, "disease", ("Disease", "DiseaseSubtype")).withColumnRenamed("id", "disease")
        plan = gr.save(own.join(ill, "call_id", "left"), "plans")
        kinds = F.create_map(*[F.lit(x) for kv in TREATMENTS for x in kv])
        facts = plan.join(self.step(own, tuple(t for t, _ in TREATMENTS)).select("id", "other", "name", kinds[F.col("edge_type")].alias("kind"), "ord", "source_docs"), "id").select("call_id", F.when(F.col("disease").isNotNull(), F.col("call_id")).alias("context"), "other", "name", "kind", "ord", "source_docs")
        # the documents that attest the syndrome within the disease or one of its subtypes
        owners = plan.where("disease is not null").select("call_id", "id", F.col("disease").alias("owner"))
        owners = owners.unionByName(owners.join(self.edges.where("type = 'HAS_SUBTYPE'").select(F.col("source").alias("owner"), F.col("target").alias("sub")), "owner").select("call_id", "id", F.col("sub").alias("owner")))
        attested = owners.join(self.edges.where("type in ('HAS_SYNDROME', 'SUBTYPE_HAS_SYNDROME')").select(F.col("source").alias("owner"), F.col("target").alias("id"), "source_docs"), ["owner", "id"])
        docs = attested.select(F.col("call_id").alias("context"), F.explode("source_docs").alias("doc")).distinct()
        scoped = gr.split_by_provenance(facts, docs, ["call_id", "other", "kind", "ord"])
        part = lambda scope, n: _listed(scoped.where(F.col("scope").isin(*scope)), ["call_id"], n, "kind", "other", "name", order="ord", most=most * len(TREATMENTS))
        verdict = F.when(F.size("disease_specific") > 0, "supported").when(F.size("cross_disease_general") > 0, "partially_supported").otherwise("empty")
        return self._answer(calls, verdict, plan.select("call_id", F.col("id").alias("resolved"), "disease"), part(("disease_specific",), "disease_specific"), part(("cross_disease_general", "unscoped"), "cross_disease_general"))
