"""Signatures, manifests and the gate before scoring."""

import pytest

from graphloom.operators import provenance as pv

CODE = {"tools_impl_sha256": "t", "scorers_impl_sha256": "s"}


def manifest(**over):
    ids = ["a", "b", "c"]
    return {"task": "pa", "kg_content_sha256": "k", "dataset_sha256": "d", "case_ids": ids, "case_set_sha256": pv.ordered_hash(ids), "models": ["m1"], "conditions": ["M0", "M1"], "samples": 2, "run_signatures": {"m1": "r1"}, "design_signatures": {"m1": "g1"}, **CODE, **over}


def traces(spark, *rows):
    return spark.createDataFrame(rows or [("m1", c, k, "f", "r1", "g1") for c in ("M0", "M1") for k in (0, 1)], "model_key string, condition string, sample int, framework_hash string, run_signature string, design_signature string")


NOW = {"kg_content_sha256": "k", "dataset_sha256": "d", **CODE}


def test_a_run_as_described_is_scored(spark):
    assert pv.score_gate(manifest(), NOW, traces(spark)) == []
    assert pv.score_gate(manifest(), {**NOW, "scorers_impl_sha256": "new"}, traces(spark)) == [("scoring_code_changed", "scorers_impl_sha256")]


@pytest.mark.parametrize("reason, frozen, now, rows, audit", [
    ("no_manifest", None, NOW, (), None),
    ("code_changed", manifest(), {**NOW, "tools_impl_sha256": "new"}, (), None),
    ("input_changed", manifest(), {**NOW, "kg_content_sha256": "new"}, (), None),
    ("manifest_contradicts_itself", manifest(case_ids=["a", "c", "b"]), NOW, (), None),
    ("stale_audit", manifest(), NOW, (), {"kg_content_sha256": "old"}),
    ("mixed_frameworks", manifest(), NOW, (("m1", "M0", 0, "f", "r1", "g1"), ("m1", "M0", 1, "f2", "r1", "g1")), None),
    ("mixed_run_signatures", manifest(run_signatures={}), NOW, (("m1", "M0", 0, "f", "r1", "g1"), ("m1", "M0", 1, "f", "r2", "g1")), None),
    ("other_run", manifest(), NOW, (("m1", "M0", 0, "f", "r9", "g1"),), None),
    ("undeclared_model", manifest(), NOW, (("m2", "M0", 0, "f", "r1", "g1"),), None),
    ("undeclared_model", manifest(models=[]), NOW, (("m1", "M0", 0, "f", "r1", "g1"),), None),
    ("mixed_designs", manifest(), NOW, (("m1", "M0", 0, "f", "r1", "g9"),), None),
    ("undeclared_conditions", manifest(), NOW, (("m1", "M4", 0, "f", "r1", "g1"),), None),
    ("undeclared_samples", manifest(), NOW, (("m1", "M0", 2, "f", "r1", "g1"),), None),
])
def test_everything_else_is_refused(spark, reason, frozen, now, rows, audit):
    with pytest.raises(pv.ScoreRefused, match=reason) as caught:
        pv.score_gate(frozen, now, traces(spark, *rows), audit)
    assert [r for r, _ in caught.value.reasons] == [reason]
    assert [r for r, _ in pv.score_gate(frozen, now, traces(spark, *rows), audit, allow_drift=True)] == [reason]


def test_signatures_and_conflicts(spark):
    sign = pv.run_signature("f", "k", "d", "m", "c", {"b": "2", "a": "1"})
    assert sign == pv.run_signature("f", "k", "d", "m", "c", {"a": "1", "b": "2"}) != pv.run_signature("f", "k", "d", "m2", "c", {"a": "1", "b": "2"}) and len(sign) == 16
    assert pv.design_signature(sign, ["M1", "M0"], 3) == pv.design_signature(sign, ["M0", "M1"], 3) != pv.design_signature(sign, ["M0"], 3)
    assert pv.design_signature(sign, ["M0"], 3) != pv.design_signature(sign, ["M0"], 1) and pv.design_signature(sign, ["M0"], 1, limit=5) != pv.design_signature(sign, ["M0"], 1)
    assert pv.manifest_conflicts({"task": "pa", "domain": "x"}, {"task": "cp", "domain": ""}) == ["task"]
    key = pv.request_key("m", [{"role": "user", "content": "x"}], {"temperature": 0})
    assert key != pv.request_key("m", [{"role": "user", "content": "x"}], {"temperature": 0}, sample=1)
    frame = spark.createDataFrame([(f"c{i}", (i * 7) % 20) for i in range(20)], "id string, ord int").repartition(4)
    ids = [r.id for r in frame.orderBy("ord").collect()]
    assert pv.case_set_hash(frame, "id", "ord").collect() == [(pv.ordered_hash(ids), 20)]
    assert pv.case_set_hash(frame.limit(0), "id", "ord").first().n_cases == 0
