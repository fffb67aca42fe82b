"""The coverage audit on a small graph, against plain counts."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coverage, tools
from graphloom.sources.graph_files import load_graph

GRAPH = {
    "nodes": [
        {"id": "s1", "type": "Syndrome", "name": "心虚证", "first_mention": {"doc_id": "d", "sentence": "心虚证者心悸不宁善惊易恐"}},
        {"id": "s2", "type": "Syndrome", "name": "气虚证", "first_mention": {"doc_id": "d", "sentence": "气虚证见乏力"}},
        {"id": "h1", "type": "Herb", "name": "大黄(后下)"}, {"id": "h2", "type": "Herb", "name": "瓜蒌", "note": "十八反十八反，君药"}, {"id": "h3", "type": "Herb", "name": "全瓜蒌"}, {"id": "h4", "type": "Herb", "name": "石膏"},
        {"id": "f1", "type": "Formula", "name": "甲汤"}, {"id": "f2", "type": "Formula", "name": "乙汤"},
        {"id": "m1", "type": "PatentMedicine", "name": "丸", "deep": {"list": ["毒性药品", {"x": "麻醉药品 精神药品"}]}},
        {"id": "e1", "type": "PharmacoPoeiaEntry", "name": "半夏", "nature_taste_meridian": "辛；有毒"}, {"id": "e2", "type": "PharmacoPoeiaEntry", "name": "姜"},
        {"id": "c1", "type": "SafetyContext", "name": "孕妇"}, {"id": "c2", "type": "SafetyContext", "name": "小儿"}, {"id": "c3", "type": "SafetyContext", "name": "老年"}, {"id": "r1", "type": "RestrictedItem", "name": "生冷食物"},
    ],
    "edges": [
        {"type": "CONTAINS_HERB", "source": "f1", "target": "h4", "evidence": [{"sentence": "石膏（先煎），用法用量见后，用法用量"}]}, {"type": "ALIAS_OF", "source": "h3", "target": "h2"},
        {"type": "CONTRAINDICATED_FOR", "source": "h1", "target": "c1", "evidence": [{"sentence": "新生儿婴幼儿"}]}, {"type": "CAUTION_FOR", "source": "r1", "target": "s2"}, {"type": "CAUTION_FOR", "source": "m1", "target": "c3"},
    ],
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph") / "g.json"
    path.write_text(json.dumps(GRAPH, ensure_ascii=False), encoding="utf-8")
    return load_graph(spark, str(path))


def test_facts_rules_and_report(spark, graph):
    nodes, edges = graph
    box = tools.Tools(nodes, edges)
    facts = coverage.graph_facts(nodes, edges, box)
    got = {(r.fact, r.detail): r.value for r in facts.collect()}
    plain = {k: v for (k, d), v in got.items() if d is None}
    assert plain == {
        "n_syndromes": 2, "n_syndromes_with_definition": 1, "n_herbs": 4, "n_herbs_with_preparation": 2, "n_formulas": 2, "n_formulas_with_composition": 1, "n_pharmacopoeia_entries": 2, "n_toxicity_flagged": 1,
        "n_patent_medicines": 1, "n_patent_with_composition": 1, "n_pregnancy_contexts": 1, "n_paediatric_contexts": 1, "n_identity_clusters": 1,
        "mentions_junchen": 1, "mentions_shibafan": 2, "mentions_dosage_field": 2, "mentions_validity": 0, "mentions_controlled": 3, "mentions_neonate": 2,
    }
    assert {d: v for (k, d), v in got.items() if k == "safety_edges"} == {"herb": 1, "diet": 1, "unclassified": 1}
    audit = coverage.rule_audit(spark, facts)
    rules = {r.rule: r for r in audit.collect()}
    assert len(rules) == 19 and rules["A-003"].evidence == ["n_pharmacopoeia_entries=2", "mentions_dosage_field=2"] and rules["A-003"].verdict == "not grounded"
    assert rules["A-001"].evidence == [] and len(rules["A-007"].evidence) == 3
    items = spark.createDataFrame([("a-003",), ("A-003",), ("N-003",), ("Z",), (None,)], "rule_id string")
    by_rule, by_verdict = coverage.impact(items, audit)
    assert {(r.verdict, r.n, r.share) for r in by_verdict.collect()} == {("not grounded", 2, 0.4), ("grounded", 1, 0.2), ("unknown", 2, 0.4)}
    options = box.look_up_options(spark.createDataFrame([(1, {"A": "心虚证", "B": "杜撰证"}), (2, {"A": "气虚证", "B": "无"})], "call_id int, options map<string,string>"))
    known = coverage.option_coverage(options, spark.createDataFrame([(1, "Test", ["A"]), (2, "Test", ["B"])], "call_id int, split string, letters array<string>"))
    assert [tuple(r) for r in known.collect()] == [("Test", 2, 4, 2, 2, 1, 0.5, 0.5)]
    text = coverage.report(audit, facts, items, known)
    assert "| A-009 |" in text and "mentions_shibafan=2" in text and "## Options that the graph knows" in text and "| unknown | 2 | 0.400 |" in text
    assert "## Items" not in coverage.report(audit, facts)


def test_occurrences_do_not_overlap(spark):
    cases = {("aaaa", "aa"): 2, ("abab", "ab"): 2, ("", "x"): 0, (None, "x"): 0, ("十八反十八反八反", "十八反"): 2}
    for (text, needle), n in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(coverage.occurrences(F.col("t"), needle)).first()[0] == n


def test_an_empty_graph(spark, graph):
    nodes, edges = graph
    facts = coverage.graph_facts(nodes.where("false"), edges.where("false"))
    assert {r.value for r in facts.collect()} == {0}
