"""The tools on a small graph: domains and phases, coverage, names, checks and look-ups."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, ontology, tools, traces
from graphloom.sources.graph_files import load_graph

N = lambda i, kind, name, docs=(), mention=None, **attrs: {"id": i, "type": kind, "name": name, "source_docs": list(docs), "first_mention": {"doc_id": "d0", "sentence": mention} if mention else None, **attrs}
E = lambda kind, a, b, said=None, docs=(): {"type": kind, "source": a, "target": b, "source_docs": list(docs), "evidence": [{"sentence": said}] if said else []}

GRAPH = {
    "nodes": [
        N("ds", "Disease", "心悸（心律失常）", ["d1"], tcm_name="心悸"), N("dk", "Disease", "消渴病肾病", ["d2"]), N("sub", "DiseaseSubtype", "快速型", disease="心悸（心律失常）"),
        N("s1", "Syndrome", "心虚胆怯证", ["d1"], "心悸不宁，善惊易恐"), N("s2", "Syndrome", "气阴两虚证", ["d2"], "气短乏力，口干"), N("s3", "Syndrome", "痰火扰心证", ["d1"], "心悸时发时止"), N("s4", "Syndrome", "无据证"),
        N("p1", "TreatmentPrinciple", "镇惊定志，养心安神"), N("p2", "TreatmentPrinciple", "益气养阴"), N("dep", "Department", "心血管科"),
        N("f1", "Formula", "安神定志丸", ["d1"]), N("f2", "Formula", "白虎汤", ["d2"]), N("f3", "Formula", "附子半夏汤"), N("m1", "PatentMedicine", "宁心宝"), N("x1", "ExternalTherapy", "针灸"),
        N("h1", "Herb", "石膏", pharmacopoeia_entry={"nature_taste_meridian": "辛、甘，大寒"}), N("h2", "Herb", "大黄"), N("h3", "Herb", "附子", pharmacopoeia_entry={"nature_taste_meridian": "辛、甘，大热；有毒"}), N("h4", "Herb", "半夏"), N("h5", "Herb", "瓜蒌"), N("h6", "Herb", "全瓜蒌"), N("h7", "Herb", "茯苓"),
        N("e4", "PharmacoPoeiaEntry", "半夏", nature_taste_meridian="辛，温；有毒", part_used="块茎", common_aliases=["法半夏"]),
        N("c1", "SafetyContext", "孕妇"), N("r1", "RestrictedItem", "生冷食物"),
        N("g1", "PathwayStage", "第一阶段", variant="常规", order=1, exit_criteria=["心率恢复正常", "症状明显缓解"]), N("g2", "PathwayStage", "第二阶段", variant="常规", order=2, entry_criteria=["心率恢复正常"]),
        N("d1", "DocumentSource", "诊疗方案", doc_id="d1", publisher="局"), N("d2", "DocumentSource", "临床路径", doc_id="d2"),
    ],
    "edges": [
        E("HAS_SYNDROME", "ds", "s1", "本病心虚胆怯者善惊易恐，坐卧不安", ["d1"]), E("HAS_SYNDROME", "dk", "s2", None, ["d2"]), E("HAS_SUBTYPE", "ds", "sub"), E("SUBTYPE_HAS_SYNDROME", "sub", "s3", None, ["d1"]),
        E("BELONGS_TO_DEPARTMENT", "ds", "dep"), E("HAS_PATHWAY_STAGE", "ds", "g2"), E("HAS_PATHWAY_STAGE", "ds", "g1"), E("NEXT_STAGE", "g1", "g2"),
        E("TREATED_BY_PRINCIPLE", "s1", "p1", None, ["d1"]), E("USES_FORMULA", "s1", "f1", None, ["d1"]), E("USES_FORMULA", "s1", "f2", None, ["d9"]), E("TREATED_BY_PRINCIPLE", "s2", "p2", None, ["d8"]), E("USES_PATENT_MEDICINE", "s1", "m1"), E("USES_EXTERNAL_THERAPY", "s1", "x1"),
        E("CONTAINS_HERB", "f1", "h7"), E("CONTAINS_HERB", "f2", "h1", "生地、石膏（先煎）、大黄(后下)等"), E("CONTAINS_HERB", "f2", "h2", "生地、石膏（先煎）、大黄(后下)等"), E("CONTAINS_HERB", "f3", "h3"), E("CONTAINS_HERB", "f3", "h4"), E("CONTAINS_HERB", "f3", "h7"),
        E("ALIAS_OF", "h6", "h5"), E("REGISTERED_IN_PHARMACOPOEIA", "h4", "e4"), E("CONTRAINDICATED_FOR", "h2", "c1", "孕妇禁用大黄"), E("CAUTION_FOR", "r1", "s2", "忌生冷"),
    ],
}


@pytest.fixture(scope="module")
def box(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph") / "g.json"
    path.write_text(json.dumps(GRAPH, ensure_ascii=False), encoding="utf-8")
    nodes, edges = load_graph(spark, str(path))
    return tools.Tools(nodes.cache(), edges.cache())


def ask(spark, tool, schema, *rows):
    calls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"call_id int, {schema}")
    got = {r.call_id: r for r in tool(calls).collect()}
    assert set(got) == set(range(len(rows)))
    return [got[i] for i in range(len(rows))]


def test_specs_gate_by_domain_phase_and_arguments(spark):
    specs = tools.specs(spark)
    of = lambda d: specs.where(F.array_contains("domains", d)).count()
    assert (of("full_graph"), of("clinical_reasoning"), of("clinical_pathway")) == (16, 5, 16)
    assert all(d in ontology.DOMAINS for r in specs.collect() for d in r.domains)
    calls = spark.createDataFrame([("check_dose", {"items": '["x"]'}), ("search_tcm_entities", {}), ("search_tcm_entities", {"query": "q"}), ("no_such_tool", {}), ("evaluate_pathway_transition", {"stage_id": "g"})], "tool string, arguments map<string,string>")
    refused = lambda domain, phase: [r.refusal for r in traces.gate(calls, specs, domain, phase).orderBy("tool", F.size("arguments")).collect()]
    assert refused("clinical_reasoning", "agent") == ["domain", "domain", "unknown_tool", "missing_arguments", None]
    assert refused("full_graph", "agent") == ["phase", None, "unknown_tool", "missing_arguments", None]
    assert refused("full_graph", "verification") == [None, None, "unknown_tool", "phase", "phase"]


def test_dose_is_never_covered(spark, box):
    a, b = ask(spark, box.check_dose, "items array<string>", (["附子", "半夏", "石膏(先煎)"],), (["杜撰"],))
    assert a.coverage == b.coverage == "not_covered" and b.unresolved == ["杜撰"] and b.findings == []
    assert {f.item: (f.toxicity, f.dose_range) for f in a.findings} == {"附子": ("有毒", None), "半夏": ("有毒", None), "石膏(先煎)": (None, None)}


def test_combination_never_rules_on_incompatibility(spark, box):
    a, b = ask(spark, box.check_combination, "items array<string>", (["附子", "半夏", "石膏"],), (["半夏"],))
    pairs = {(p.a, p.b): (p.verdict, p.n_co_occurrences) for p in a.pairs}
    assert pairs[("半夏", "附子")] == ("not_covered", 1) and pairs[("半夏", "石膏")] == ("not_covered", 0)
    assert a.coverage == "not_covered" and a.error is None and b.error and {t.item for t in a.toxic} == {"附子", "半夏"}


def test_decoction_claims(spark, box):
    a, b = ask(spark, box.check_decoction_requirement, "items array<string>, claimed string", (["石膏", "大黄", "茯苓"], "先煎"), (["茯苓"], None))
    assert {f.item: (f.attested, f.verdict) for f in a.findings} == {"石膏": (["先煎"], "supported"), "大黄": (["后下"], "contradicted_by_graph"), "茯苓": ([], "not_covered")}
    assert (a.coverage, b.coverage) == ("supported", "empty")


def test_duplicates(spark, box):
    a, b, c = ask(spark, box.check_duplicate_medication, "items array<string>", (["瓜蒌", "全瓜蒌", "安神定志丸", "附子半夏汤", "茯苓"],), (["宁心宝"],), (["杜撰"],))
    assert [d.listed_as for d in a.alias_duplicates] == [["全瓜蒌", "瓜蒌"]] and a.coverage == "supported"
    assert [(o.a, o.b, o.shared, o.jaccard) for o in a.formula_overlap] == [("安神定志丸", "附子半夏汤", 1, 0.333)]
    assert {(h.herb, h.formula) for h in a.herb_in_formula} == {("茯苓", "安神定志丸"), ("茯苓", "附子半夏汤")}
    assert (b.coverage, c.coverage) == ("partially_supported", "empty") and c.unresolved == ["杜撰"]


def test_restrictions(spark, box):
    a, b, c, d = ask(spark, box.check_restricted_item, "items array<string>, patient_context string", (["大黄"], "孕妇"), (["大黄"], "气阴两虚证"), (["茯苓"], None), (["杜撰"], None))
    assert [(r.severity, r.applies_to, r.matches_context) for r in a.restrictions] == [("contraindicated", "c1", True)]
    assert [r.matches_context for r in b.restrictions] == [False] and (a.coverage, c.coverage, d.coverage) == ("supported", "empty", "not_covered")
    e, f, g = ask(spark, box.retrieve_safety_constraints, "entity string, context string", ("大黄", None), (None, "孕"), ("杜撰XYZ", None))
    assert [(x.restricted, x.applies_to, x.kind) for x in e.findings] == [(x.restricted, x.applies_to, x.kind) for x in f.findings] and len(e.findings) == 1
    assert (e.coverage, g.coverage) == ("supported", "not_covered")


def test_names_and_aliases_resolve_alike(spark, box):
    entry = ask(spark, box.retrieve_pharmacopeia_entry, "herb string", ("半夏",), ("法半夏",), ("杜撰",))
    assert [e.coverage for e in entry] == ["supported", "supported", "empty"]
    assert [x.entry for x in entry[1].entries] == ["e4"] and entry[1].entries[0].common_aliases == ["法半夏"]


def test_other_names_of_a_node(spark):
    rows = [("h", "Herb", "大黄(后下)", None), ("f", "Formula", "白虎汤（先煎）", None), ("s", "Syndrome", "①湿热下注证：口苦", None), ("p", "PharmacoPoeiaEntry", "半夏", '{"common_aliases": ["法半夏", "半夏"]}'), ("q", "Herb", "生姜", '{"pharmacopoeia_entry": {"canonical_name": "姜", "common_aliases": ["鲜姜"]}}'), ("x", "Herb", "乌头", '{"pharmacopoeia_entry": "{\\"canonical_name\\": \\"川乌\\"}"}'), ("d", "Disease", "消渴(先煎)", "{}")]
    got = {r.id: r.aliases for r in graph.with_aliases(spark.createDataFrame(rows, "id string, type string, name string, attrs string")).collect()}
    assert got == {"h": ["大黄"], "f": ["白虎汤"], "s": ["湿热下注证"], "p": ["法半夏"], "q": ["鲜姜", "姜"], "x": ["川乌"], "d": []}


def test_a_context_that_names_nothing_is_searched(spark, box):
    a, b, c = ask(spark, box.check_restricted_item, "items array<string>, patient_context string", (["大黄"], "孕"), (["生冷食物"], "孕"), (["大黄"], "全无此人"))
    assert [r.matches_context for r in a.restrictions] == [True] and [r.matches_context for r in b.restrictions] == [False]
    assert [r.matches_context for r in c.restrictions] == [True]


def test_decisions(spark, box):
    schema = "syndrome string, disease string, treatment_principle string, clinical_features array<string>"
    good, bad, off, plain, atom, cure, feature = ask(spark, box.verify_tcm_decision, schema, ("心虚胆怯证", "心悸（心律失常）", None, None), ("心虚胆怯证", "消渴病肾病", None, None), ("杜撰不存在证", None, None, None), ("心虚胆怯证", None, None, None), ("杜撰证，气阴两虚证", "消渴病肾病", None, None), ("心虚胆怯证", "心悸", "镇惊定志，养心安神", None), ("心虚胆怯证", "心悸", "活血化瘀", ["坐卧不安"]))
    assert (good.overall, bad.overall, off.overall, off.coverage) == ("supported", "contradicted", "not_in_graph", "partially_supported")
    assert plain.overall == "partially_supported" and atom.syndrome == "s2" and atom.overall == "supported" and cure.principle == "supported"
    assert (feature.principle, feature.features, feature.overall) == ("partially_supported", "supported", "partially_supported")


def test_medication_and_entries(spark, box):
    formula, herb, patent, none = ask(spark, box.retrieve_medication_knowledge, "name string", ("白虎汤",), ("大黄",), ("宁心宝",), ("杜撰",))
    assert [h.name for h in formula.composition] == ["石膏", "大黄"] and [s.syndrome for s in formula.used_by] == ["s1"] and [d.title for d in formula.documents] == ["临床路径"]
    assert [p.marker for p in herb.preparation] == ["后下"] and [f.formula for f in herb.in_formulas] == ["f2"]
    assert [d.disease for d in patent.indicated_diseases] == ["ds"] and none.coverage == "empty"
    a, b, c = ask(spark, box.retrieve_pharmacopeia_entry, "herb string", ("半夏",), ("茯苓",), ("杜撰",))
    assert [(e.entry, e.toxicity, e.common_aliases) for e in a.entries] == [("e4", "有毒", ["法半夏"])] and (a.coverage, b.coverage, c.coverage) == ("supported", "partially_supported", "empty")


def test_contexts_and_evidence(spark, box):
    a, b, c = ask(spark, box.retrieve_clinical_context, "entity string", ("心悸（心律失常）",), ("快速型",), ("杜撰",))
    assert a.disease == b.disease == "ds" and [s.syndrome for s in a.syndromes] == ["s1"] and a.syndromes[0].scope == "disease_specific"
    assert [(s.subtype, s.syndromes) for s in a.subtypes] == [("sub", ["s3"])] and [s.stage for s in a.pathway_stages] == ["g1", "g2"] and [d.name for d in a.departments] == ["心血管科"]
    assert (a.coverage, c.coverage) == ("supported", "empty")
    d, e, f = ask(spark, box.retrieve_syndrome_evidence, "syndrome string, disease_filter string", ("心虚胆怯证", "心悸"), ("痰火扰心证", None), ("无据证", None))
    assert d.presentation.startswith("本病") and d.presentation_scope == "disease_specific" and [(s.leaf, s.via) for s in d.siblings] == [("s3", "sub")] and [s.stage for s in d.pathway_stages] == ["g2", "g1"]
    assert e.presentation_scope == "global_first_mention" and [s.subtype for s in e.subtypes] == ["sub"] and f.coverage == "partially_supported"
    g, h = ask(spark, box.retrieve_source_evidence, "entity string, doc_ids array<string>", ("气阴两虚证", ["d1"]), (None, ["gone"]))
    assert [x.doc for x in g.documents] == ["d1", "d2"] and "s1" in g.documents[0].co_occurring and h.coverage == "empty"


def test_pathways(spark, box):
    a, b, c, d = ask(spark, box.retrieve_pathway_stage, "disease string, stage string, variant string", ("心悸（心律失常）", None, None), ("心悸（心律失常）", "第二", None), ("心悸（心律失常）", "第九", None), ("消渴病肾病", None, None))
    assert [(s.stage, s.next, s.absent) for s in a.stages] == [("g1", ["g2"], ["entry_criteria"]), ("g2", None, ["exit_criteria"])]
    assert [(s.stage, s.previous) for s in b.stages] == [("g2", ["g1"])] and c.coverage == "partially_supported" and len(c.available) == 2 and d.coverage == "empty"
    schema = "stage_id string, disease string, findings array<string>"
    on, off, none, more, last, lost = ask(spark, box.evaluate_pathway_transition, schema, ("g1", None, ["心率恢复正常", "症状明显缓解"]), ("g1", None, ["心率未恢复正常"]), ("g1", None, []), ("第一阶段", "心悸（心律失常）", ["症状明显缓解"]), ("g2", None, ["心率恢复正常"]), ("杜撰", None, ["x"]))
    assert [x.recommendation for x in (on, off, none, more, last, lost)] == ["advance", "continue", "insufficient_evidence", "continue", "insufficient_evidence", "insufficient_evidence"]
    assert {c.status for c in off.criteria if c.criterion == "心率恢复正常"} == {"contradicted"} and lost.coverage == "empty" and last.coverage == "not_covered"


def test_plans(spark, box):
    a, b, c = ask(spark, box.retrieve_treatment_plan, "syndrome string, disease string", ("心虚胆怯证", "心悸（心律失常）"), ("气阴两虚证", "消渴病肾病"), ("无据证", "消渴病肾病"))
    assert {t.other for t in a.disease_specific} == {"p1", "f1"} and {t.other for t in a.cross_disease_general} == {"f2", "m1", "x1"}
    assert (a.coverage, b.coverage, c.coverage) == ("supported", "partially_supported", "empty")


def test_search_sees_only_its_domain(spark, box):
    calls = spark.createDataFrame([(0, "心悸 善惊易恐", ["Syndrome"], None, None), (1, "安神定志丸", ["Formula"], None, None), (2, "心悸", None, ["ds"], 3), (3, "zzz", None, None, None)], "call_id int, query string, entity_types array<string>, anchors array<string>, top_k int")
    got = {r.call_id: r for r in box.search_tcm_entities(calls, "clinical_reasoning").collect()}
    assert got[0].coverage == "supported" and got[0].results[0].id == "s1" and {x.type for x in got[0].results} == {"Syndrome"}
    assert got[1].coverage == "not_covered" and got[1].error and got[1].results == []
    assert got[2].results[0].id == "ds" and got[2].results[0].graph == 1.0 and len(got[2].results) == 3
    assert got[3].coverage == "empty"
    assert {r.call_id: r for r in box.search_tcm_entities(calls, "prescription_safety").collect()}[1].results[0].id == "f1"


def test_virtual_documents_hold_names_attributes_and_evidence(box):
    from graphloom.operators import retrieval

    text = {r.id: r.text for r in retrieval.virtual_documents(tools.text_pieces(box.nodes, box.edges)).collect()}
    assert text["ds"].startswith("心悸（心律失常） 心悸") and "坐卧不安" in text["s1"] and "善惊易恐" in text["s1"]
    assert text["h1"].count("石膏（先煎）") == 1 and "辛、甘，大寒" in text["h1"] and "心率恢复正常" in text["g1"]


def test_static_context(spark, box):
    cases = spark.createDataFrame([(0, "患者心悸，善惊易恐", {"A": "心虚胆怯证", "B": "①痰火扰心证", "C": "杜撰证"})], "call_id int, text string, options map<string,string>")
    (r,) = box.static_context(cases).collect()
    assert r.anchors[0].disease == "ds" and "心虚胆怯证" in r.anchors[0].candidates and "痰火扰心证" in r.anchors[0].candidates
    assert r.syndromes[0].id == "s1" and [(o.letter, o.found, o.id) for o in r.options] == [("A", True, "s1"), ("B", True, "s3"), ("C", False, None)]
    assert r.options[0].diseases == ["心悸（心律失常）"]


def test_names_that_nodes_bear_are_resolved_without_clusters(spark, box):
    """Joins of all clusters, names and nodes ran for calls that left no name open."""
    never = tools.Tools(box.nodes, box.edges, names=box.names, roots=box.roots.withColumn("root", F.raise_error(F.concat(F.lit("read: "), "root")).cast("string")))
    calls = spark.createDataFrame([(0, ["附子", "安神定志丸"]), (1, ["石膏"])], "call_id int, items array<string>")
    drugs = ("Herb", "Formula", "PatentMedicine")
    assert {(r.call_id, r.item, r.id) for r in never.drugs(calls, drugs).collect()} == {(0, "附子", "h3"), (0, "安神定志丸", "f1"), (1, "石膏", "h1")}
    with pytest.raises(Exception, match="read: "):
        never.drugs(spark.createDataFrame([(0, ["没有的药"]), (1, ["f1", "心悸"])], "call_id int, items array<string>"), drugs).collect()
