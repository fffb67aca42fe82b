"""Names in play, plans from answers, and the verdicts of the checks that they ask for."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import tools
from graphloom.operators import verification as vf
from graphloom.sources.graph_files import load_graph

NODES = [("h1", "Herb", "石膏"), ("h2", "Herb", "大黄(后下)"), ("h3", "Herb", "附子"), ("h4", "Herb", "白附子"), ("f1", "Formula", "白虎汤"), ("f2", "Formula", "白虎加参汤"), ("m", "PatentMedicine", "宁心宝"), ("s", "Syndrome", "心虚胆怯证"), ("c", "SafetyContext", "孕妇"), ("x", "Herb", "参")]
EDGES = [("CONTAINS_HERB", "f1", "h1", "石膏（先煎）"), ("CONTAINS_HERB", "f2", "h1", None), ("CONTRAINDICATED_FOR", "h2", "c", "孕妇禁用"), ("CONTAINS_HERB", "f2", "x", None)]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph") / "g.json"
    made = {"nodes": [{"id": i, "type": t, "name": n} for i, t, n in NODES], "edges": [{"type": k, "source": a, "target": b, "evidence": [{"sentence": e}] if e else []} for k, a, b, e in EDGES]}
    path.write_text(json.dumps(made, ensure_ascii=False), encoding="utf-8")
    nodes, edges = load_graph(spark, str(path))
    return nodes.cache(), edges.cache()


@pytest.mark.parametrize("limit", [None, 0])
def test_names_in_play_equal_a_plain_search(spark, monkeypatch, limit):
    if limit is not None:  # beyond the limit names and texts meet in two letters
        monkeypatch.setattr(vf, "MOST_NEEDLES", limit)
    rng = random.Random(9)
    letters = "甲乙丙丁戊ab"
    names = [("".join(rng.choices(letters, k=rng.randint(1, 5))), rng.choice(("Formula", "Herb", "PatentMedicine", "Disease")), i) for i in range(120)]
    texts = [(i // 2, "".join(rng.choices(letters + "一二三", k=rng.choice((0, 1, 5, 40, 200))))) for i in range(80)] + [(99, None)]
    order = {t: i for i, t in enumerate(vf.NAMED_TYPES)}
    want = {}
    for i in {t[0] for t in texts}:
        found = []
        for name, _, _ in sorted((n for n in names if n[1] in order and len(n[0]) > 1), key=lambda n: (order[n[1]], n[2])):
            if any(t and j == i and name in t for j, t in texts) and name not in found:
                found.append(name)
        if found:
            want[i] = found[:6]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = vf.names_in_play(df, spark.createDataFrame(names, "name string, type string, ord int"))
    assert {r.id: r.names for r in got.collect()} == want and len(want) > 20


def test_rules_cohorts_and_letters(spark):
    rules = {"A-003": "A-003", "family n-003.": "N-003", "规则A-003": None, "A-001": None, "单味药剂量": "A-003", "总剂量过大": "A-004", "配伍禁忌": "A-009", "禁忌": "A-007", "": None, "先煎后下": "N-003", "用法用量": "A-005", None: None}
    df = spark.createDataFrame(list(rules.items()), "t string, w string").select("t", vf.declared_rule(F.col("t")).alias("got"))
    assert {r.t: r.got for r in df.collect()} == rules
    one = spark.createDataFrame([(["A", "K", "B"], {"a": "x", "B": "（后下）先煎"}, "妊娠期儿童"), (["K"], {}, None)], "l array<string>, o map<string,string>, q string")
    got = [tuple(r) for r in one.select(vf.clamp_letters(F.col("l"), F.col("o")), vf.claimed_preparation(F.col("l"), F.col("o")), vf.patient_context(F.col("q"))).collect()]
    assert got == [(["A", "B"], "先煎", "妊娠"), (["K"], None, "")]


def test_from_answers_to_verdicts(spark, graph):
    nodes, edges = graph
    options = {"A": "石膏先煎", "B": "石膏后下", "C": "大黄", "D": "白附子配附子", "E": "无"}
    rows = [(1, "特殊煎煮", ["A"], options, "如何煎"), (2, "先煎", ["B"], options, "如何煎"), (3, "剂量", ["C"], options, "孕妇"), (4, "使用禁忌", ["C"], options, "孕妇可用否"), (5, "配伍", ["D"], options, ""), (6, "配伍", ["C"], options, None), (7, "重复用药", ["E"], options, "白虎汤与白虎加参汤同用"), (8, "说不清", ["A"], options, "石膏"), (9, "剂量", ["E"], options, "无药"), (10, "禁忌", ["A"], options, "老年")]
    answers = spark.createDataFrame(rows, "case_id int, category string, letters array<string>, options map<string,string>, question string")
    plans = vf.safety_plans(answers, vf.node_names(nodes))
    listed = {r.case_id: (r.tool, r["items"], r.claimed, r.patient_context) for r in plans.collect()}
    assert listed[1] == ("check_decoction_requirement", ["石膏"], "先煎", None) and listed[4] == ("check_restricted_item", ["大黄"], None, "孕妇")
    assert listed[5][1] == ["附子", "白附子"] and listed[7][1] == ["白虎汤", "白虎加参汤"] and not {6, 8, 9} & listed.keys()
    box = tools.Tools(nodes, edges)
    got = {r.case_id: (r.n_checks, r.verdict) for r in vf.reports(answers, vf.check_safety(box, plans)).collect()}
    none = (0, "not_applicable")
    assert got == {1: (1, "supported"), 2: (1, "contradicted_by_graph"), 3: (1, "not_covered"), 4: (1, "supported"), 5: (1, "not_covered"), 6: none, 7: (1, "contradicted"), 8: none, 9: none, 10: (1, "no_verdict")}


def test_every_chosen_syndrome_is_checked(spark, graph):
    nodes, edges = graph
    rows = [(1, ["A", "B"], {"A": "心虚胆怯证", "B": "杜撰证"}, "患者：心悸不宁，善惊易恐。"), (2, ["Z"], {"A": "心虚胆怯证"}, "x"), (3, ["A"], {"A": " "}, "x")]
    answers = spark.createDataFrame(rows, "case_id int, letters array<string>, options map<string,string>, text string")
    plans = vf.syndrome_plans(answers)
    assert {(r.case_id, r.letter, r.syndrome) for r in plans.collect()} == {(1, "A", "心虚胆怯证"), (1, "B", "杜撰证")}
    got = {r.case_id: (r.n_checks, r.verdict) for r in vf.reports(answers, vf.check_syndromes(tools.Tools(nodes, edges), plans)).collect()}
    # the known syndrome has no evidence of the case's findings, which ranks before the unknown one
    assert got[1] == (2, "partially_supported") and got[2] == got[3] == (0, "not_applicable")


@pytest.mark.parametrize("most", [None, 0])
def test_pieces_that_meet_names_do_not_grow_with_names(spark, monkeypatch, most):
    if most is not None:  # beyond the limit lengths alone tell pieces
        monkeypatch.setattr(vf, "MOST_SHAPES", most)
    names = spark.createDataFrame([(f"药{i}号",) for i in range(1, 2001)], "name string")
    texts = spark.createDataFrame([(i, f"方中药{i}号同服") for i in range(1, 2001)], "id long, text string")
    pieces = vf.name_pieces(texts, names)
    met = pieces.join(names, "name")
    assert sorted((r.id, r.name) for r in met.collect()) == [(i, f"药{i}号") for i in range(1, 2001)]
    if most is None:  # two letters in common made some hundred pairs a text of these
        assert pieces.count() == 2000
