"""The audit's corpus: strings at any depth, and what a reader of a graph can see."""

import json
import random

import pytest

from graphloom.functions import jsons
from graphloom.operators import contamination as cn
from graphloom.sources.graph_files import load_graph


def walk(value, path):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for i, k in enumerate(sorted(value)):
            yield from walk(value[k], (*path, i))
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from walk(x, (*path, i))


def test_leaves_at_any_depth(spark):
    rng = random.Random(2)

    def made(depth):
        kind = rng.choice("sdlnbt" if depth else "st")
        if kind == "d":
            return {rng.choice("zyxabc语") + str(i): made(depth - 1) for i in range(rng.randint(0, 4))}
        if kind == "l":
            return [made(depth - 1) for _ in range(rng.randint(0, 4))]
        return {"n": 3.5, "b": None}.get(kind, "text \"quoted\" é " + str(rng.random()))

    docs = [{k: made(5) for k in rng.sample(["b", "a", "long key", "z", "id"], rng.randint(0, 5))} for _ in range(60)]
    rows = [(i, json.dumps(d, ensure_ascii=rng.random() < 0.5)) for i, d in enumerate(docs)] + [(100, "[1, \"x\"]"), (101, "not json {"), (102, None), (103, '"s"')]
    want = {(i, k, t): (at + 1, *path) for i, d in enumerate(docs) for at, (k, v) in enumerate(d.items()) if k != "id" for path, t in walk(v, ())}
    got = jsons.leaves(spark.createDataFrame(rows, "i int, j string"), "j", ["i"], skip=("id",)).collect()
    assert {(r.i, r.key, r.text): tuple(r.path) for r in got} == want and len(got) == len(want) > 100


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    nodes = [
        {"id": "d", "type": "Disease", "name": "心悸（心律失常）", "tcm_name": "心悸", "first_mention": {"doc_id": "x", "sentence": "心悸是指心中动悸"}},
        {"id": "g", "type": "PathwayStage", "name": "第一阶段", "monitoring_items": ["监测心率与血压", "观察舌脉变化"], "deep": {"a": [{"b": "很深的一段文字"}]}, "order": 1},
        {"id": "p", "type": "DocumentSource", "name": "", "title": "诊疗方案（试行）", "doc_id": "x", "source_filename": "a.pdf"},
    ]
    edges = [{"type": "HAS_PATHWAY_STAGE", "source": "d", "target": "g", "_id": "e1", "evidence": [{"sentence": "监测心率，与血压"}, {"sentence": "另有一句证据"}]}]
    path = tmp_path_factory.mktemp("graph") / "g.json"
    path.write_text(json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False), encoding="utf-8")
    return load_graph(spark, str(path))


def test_corpus_of_a_graph(graph):
    rows = [(r.origin, r.text) for r in cn.corpus(cn.corpus_parts(*graph)).collect()]
    got = {o: t for o, t in rows if o.startswith("vdoc:")}
    assert "心悸" in got["vdoc:d"] and "监测心率与血压" in got["vdoc:g"] and got["vdoc:p"]
    # the first of equal texts stays: a stage's item before the evidence that repeats it
    texts = {t for o, t in rows if o not in got}
    assert ("node:g:deep", "很深的一段文字") in rows and ("edge:e1", "另有一句证据") in rows and ("node:d", "心悸是指心中动悸") in rows
    assert {"监测心率与血压", "观察舌脉变化", "很深的一段文字", "另有一句证据", "心悸是指心中动悸"} <= texts and "监测心率，与血压" not in texts
    assert "心悸" not in texts  # under five letters
    assert [r.title for r in cn.document_titles(graph[0]).collect()] == ["诊疗方案（试行） 诊疗方案（试行） a.pdf"]


def test_json_in_graphml_attributes(spark, tmp_path):
    entry = json.dumps({"canonical_name": "半夏", "common_aliases": ["法半夏"]}, ensure_ascii=False).replace('"', "&quot;")
    (tmp_path / "g.graphml").write_text(f'<graphml><key id="a" attr.name="type"/><key id="b" attr.name="name"/><key id="c" attr.name="pharmacopoeia_entry"/><key id="d" attr.name="note"/><key id="e" attr.name="entry_criteria"/><graph><node id="h"><data key="a">Herb</data><data key="b">半夏 "x"</data><data key="c">{entry}</data><data key="d">[a]</data><data key="e">[broken</data></node></graph></graphml>', encoding="utf-8")
    attrs = json.loads(load_graph(spark, str(tmp_path / "g.graphml"))[0].first().attrs)
    assert attrs == {"type": "Herb", "name": '半夏 "x"', "pharmacopoeia_entry": {"canonical_name": "半夏", "common_aliases": ["法半夏"]}, "note": "[a]", "entry_criteria": "[broken"}
