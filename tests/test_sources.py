import gzip
import json
import zipfile

import pytest

from graphloom.sources import datasets, graph_files, records
from graphloom.sources.xlsx import column_number, read_sheet

GRAPH = {
    "nodes": [{"id": "a", "type": "Disease", "name": "A", "source_docs": ["x"], "first_mention": {"doc_id": "x", "sentence": "s"}, "extra": [1]}, {"id": "b", "type": "Syndrome", "title": "B"}],
    "links": [{"source": "a", "target": "b", "type": "HAS_SYNDROME", "evidence": [{"sentence": "e1"}, {"sentence": "e2"}]}, {"from": "a", "to": "b", "type": "ODD", "evidence": "plain"}, {"source": "a", "target": "gone", "type": "X"}],
}


@pytest.mark.parametrize("zipped", [False, True])
def test_node_link(spark, tmp_path, zipped):
    path = tmp_path / ("g.json.gz" if zipped else "g.json")
    data = json.dumps(GRAPH).encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    nodes, edges = graph_files.load_graph(spark, str(path))
    n = {r.id: r for r in nodes.collect()}
    assert n["b"].name == "B" and n["a"].first_mention.sentence == "s" and json.loads(n["a"].attrs)["extra"] == [1]
    e = {r.type: r for r in edges.collect()}
    assert set(e) == {"HAS_SYNDROME", "ODD"}
    assert e["HAS_SYNDROME"].id in ("HAS_SYNDROME|a|b", "a|HAS_SYNDROME|b")
    assert [x.sentence for x in e["HAS_SYNDROME"].evidence] == ["e1", "e2"] and [x.sentence for x in e["ODD"].evidence] == ["plain"]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d0" attr.name="type"/><key id="d1" attr.name="name"/><key id="d2" attr.name="source_docs"/><graph>'
        '<node id="a"><data key="d0">Disease</data><data key="d1">A</data><data key="d2">["x","y"]</data></node><node id="b"><data key="d0">Syndrome</data></node>'
        '<edge id="e9" source="a" target="b"><data key="d0">HAS_SYNDROME</data></edge></graph></graphml>'
    )
    nodes, edges = graph_files.load_graph(spark, str(tmp_path / "g.graphml"))
    n = {r.id: r for r in nodes.collect()}
    assert n["a"].name == "A" and n["a"].source_docs == ["x", "y"] and n["b"].type == "Syndrome"
    assert [(r.id, r.source, r.target) for r in edges.collect()] == [("e9", "a", "b")]


def sheet(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>ID</t></si><si><r><t>Que</t></r><r><t>stion</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1"><v>x</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t> why </t></is></c></row><row></row></sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    assert column_number("AB12") == 27
    sheet(tmp_path / "s.xlsx")
    df = read_sheet(spark, str(tmp_path / "s.xlsx"))
    assert df.columns == ["ID", "Question", "col_2", "x"]
    assert [tuple(r) for r in df.collect()] == [("7", "why", "", "")]


def test_answers_and_sdt(spark, tmp_path):
    (tmp_path / "r.txt").write_text("﻿1@a;b@A@B@x@y\n1@late@@@\nbad@line\n2@c@C;D@E@z\n", encoding="utf-8")
    got = {r.id: r for r in datasets.read_answers(spark, str(tmp_path / "r.txt")).collect()}
    assert set(got) == {"1", "2"} and got["1"].explanation == "x@y" and got["1"].clinical_information == "a;b"
    cases = [{"Medical Record ID": i, "Clinical Data": "t", "Clinical Information": "", "Answers of TCM Pathogenesis": "J" if i == "2" else "", "Options of TCM Pathogenesis": "A:x;B:y", "Options of TCM Syndrome": "A:x;B:y"} for i in ("1", "2", "2")]
    (tmp_path / "d.json").write_text(json.dumps(cases))
    rows = {r.id: r for r in datasets.load(spark, str(tmp_path / "d.json"), "sdt", answers=str(tmp_path / "r.txt")).collect()}
    assert set(rows) == {"1", "2", "2#2"}
    assert rows["1"].pathogenesis_letters == ["A"] and rows["2"].pathogenesis_letters == ["J"] and rows["1"].clinical_information_list == ["a", "b"]
    assert rows["1"].syndrome_options == {"A": "x", "B": "y"} and rows["1"].has_gold


@pytest.mark.parametrize("shape", ["lines", "array", "wrapped"])
def test_json_shapes_and_binding(spark, tmp_path, shape):
    recs = [{"ID": "q1", "Question": "?", "Candidate Answers": "A. x\nB. y", "Answer": "AB", "Rule_ID": "a-003"}, {"ID": "", "Question": "!", "Candidate Answers": "A. x\nB. y", "Answer": "A"}]
    text = "\n".join(map(json.dumps, recs)) if shape == "lines" else json.dumps(recs if shape == "array" else {"items": recs})
    (tmp_path / "p.json").write_text(text)
    rows = {r.id: r for r in datasets.load(spark, str(tmp_path / "p.json"), "pa").collect()}
    assert rows["q1"].letters == ["A", "B"] and rows["q1"].is_multi and rows["q1"].rule_id == "A-003" and len(rows) == 2
    assert any(k.startswith("pa_") for k in rows)
    with pytest.raises(ValueError, match="unknown dataset"):
        datasets.load(spark, "x", "nope")


def test_traces_and_logs(spark, tmp_path):
    good = [json.dumps({"case_id": str(i), "condition": "M0", "sample": 0}) for i in range(3)]
    (tmp_path / "t.jsonl").write_text("\n".join([*good, '{"case_id": "3", "cond']))
    assert records.read_traces(spark, str(tmp_path / "t.jsonl")).count() == 3
    (tmp_path / "u.jsonl").write_text("\n".join([good[0], "{broken", good[1]]))
    with pytest.raises(ValueError, match="broken line"):
        records.read_traces(spark, str(tmp_path / "u.jsonl"))
    (tmp_path / "c.jsonl").write_text('{"key": "k", "completion": {"text": "x"}}\n{torn')
    assert [r.key for r in records.read_log(spark, str(tmp_path / "c.jsonl")).collect()] == ["k"]


def test_submission_and_experiment(spark):
    cases = spark.createDataFrame([("1", 0), ("2", 1)], "id string, ord int")
    made = spark.createDataFrame([("1", ["a", "b"], ["A"], ["B"], "x@y\nz")], "id string, clinical_information array<string>, pathogenesis_answer array<string>, syndrome_answer array<string>, explanation string")
    assert [r.value for r in records.submission_lines(cases, made).collect()] == ["1@a;b@A@B@x y z", "2@@@@"]
    with pytest.raises(ValueError, match="unknown conditions"):
        records.experiment({"conditions": ["M9"]})
    assert records.experiment({"name": "n", "surplus": 1}).name == "n"


def test_budget_stream(spark, tmp_path):
    from graphloom.streaming.runs import budget_stream

    spark.createDataFrame([("r", i, "t") for i in range(6)], "run string, idx long, tool string").write.parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema("run string, idx long, tool string").parquet(str(tmp_path / "in"))
    q = budget_stream(calls, "run").writeStream.format("memory").queryName("budget_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.idx: r.allowed for r in spark.table("budget_out").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_records_are_numbered_by_file_and_line(spark, tmp_path):
    for f in range(5):
        (tmp_path / f"p{f}.jsonl").write_text("\n".join(json.dumps({"Question": f"{f}.{i}", "Answer": "A"}) for i in range(4 - f % 3)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        rows = datasets.load(spark, str(tmp_path / "p*.jsonl"), "pa").orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{f}.{i}" for f in range(5) for i in range(4 - f % 3)]
    assert [r.question for r in rows] == want and [r.id for r in rows] == [f"pa_{i:04d}" for i in range(len(want))]


def test_translated_exports_bind(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"病案号": "7", "医案": "t", "临床信息": "a;b", "病机": "p", "推理能力：证候推断": "why", "证候答案": "B", "更多": 1}]))
    (row,) = datasets.load(spark, str(tmp_path / "d.json"), "sdt").collect()
    assert (row.id, row.clinical_data, row.clinical_information_list, row.pathogenesis_text, row.syndrome_reasoning, row.syndrome_letters) == ("7", "t", ["a", "b"], "p", "why", ["B"])
    report = datasets.mapping_report(datasets.read_json_records(spark, str(tmp_path / "d.json")), datasets.SDT)
    assert ("bound", "id", ["病案号"]) in report and ("missing", "syndrome_text", []) in report and ("unmapped", "更多", []) in report


def test_other_loaders(spark, tmp_path):
    (tmp_path / "s.json").write_text("\n".join(json.dumps({"user_id": str(i), "norm_syndrome": f"s{i % 2}", "chief_complaint": "c", "description": " ", "detection": "d"}) for i in range(3)))
    vocabulary = spark.createDataFrame([("s0", 0), ("s0", 0)], "label string, label_id int")
    rows = {r.id: r for r in datasets.load(spark, str(tmp_path / "s.json"), "tcmsd", vocabulary=vocabulary).collect()}
    assert rows["0"].text == "c\nd" and rows["0"].syndrome_id == 0 and rows["1"].syndrome_id is None
    (tmp_path / "k.json").write_text("\n".join(json.dumps({"Name": n, "Definition": d}) for n, d in (("a", "old"), ("b", "x"), ("a", "new"))))
    assert {r.Name: r.Definition for r in datasets.load_knowledge(spark, str(tmp_path / "k.json")).collect()} == {"a": "new", "b": "x"}
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": "x", "q": 1}, {"id": "x", "q": 2}, {"id": "", "q": 3})))
    cp = datasets.load(spark, str(tmp_path / "c.jsonl"), "cp")
    assert {r.id for r in cp.collect()} == {"x", "x#2", "cp_00002"}
    ids = spark.createDataFrame([("x",), ("cp_00002",)], "id string")
    assert [r.q for r in datasets.subset(cp, ids).orderBy("ord").collect()] == [1, 3] and datasets.subset(cp, limit=2).count() == 2
