"""Report tables on small items against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation as ev
from graphloom.operators import reports as rp
from graphloom.operators import statistics as st

SCHEMA = "model string, condition string, case_id string, ord int, parity_error string, branch_group string, verification_stratum string, dataset string, score double, exact double, rule_id string, family string, subtask string, disease string"


@pytest.fixture(scope="module")
def items(spark):
    rng, rows = random.Random(3), []
    for m in ("m1", "m2", "m3"):
        for i in range(30):
            for c in ("M0", "M1", "M3", "M3C", "M4"):
                gain = {"M0": 0, "M1": 0.05, "M3": 0.2, "M3C": 0.2, "M4": 0.3}[c] * (0.5 if m == "m3" else 1)
                rows.append((m, c, f"c{i:02d}", 0, "broken" if (i, c) == (3, "M4") else "", None if (i, c) == (4, "M4") else f"g{i}", "deterministic" if i % 2 else "audit_only", "pa" if i % 3 else "sdt", rng.random() * 0.5 + gain, float(rng.random() < 0.3 + gain), ("A-002", "a-004", "X")[i % 3], f"f{i % 2}", f"t{i % 4}", f"d{i % 7}"))
    rows.append((*rows[0][:3], 1, *rows[0][4:8], 0.0, *rows[0][9:]))
    return spark.createDataFrame(rows, SCHEMA).cache()


def vectors(items, model, first, last, metric="score"):
    rows = items.where(f"model = '{model}'").orderBy("ord").collect()
    by = {(r.condition, r.case_id): r for r in rows}
    together = (first, last) in ev.TOGETHER
    out = []
    for c in sorted({r.case_id for r in rows}):
        a, b = by[first, c], by[last, c]
        if a.parity_error or b.parity_error or (together and (not a.branch_group or a.branch_group != b.branch_group)):
            continue
        out.append((a, b, a[metric], b[metric]))
    return out


def test_contrasts_equal_plain_python(items):
    got = {(r.model, r.contrast): r for r in rp.contrast_table(items, "score", (("M0", "M1"), ("M3C", "M4")), resamples=300).collect()}
    assert len(got) == 6
    for (model, contrast), r in got.items():
        pairs = vectors(items, model, *contrast.split("->"))
        a, b = [p[2] for p in pairs], [p[3] for p in pairs]
        want = st.reference_bootstrap(a, b, 300)
        assert r.n == len(pairs) == (28 if contrast == "M3C->M4" else 30) and r.test == "paired_bootstrap" and 0 <= r.p_wilcoxon <= 1
        assert r.mean_a == pytest.approx(sum(a) / len(a)) and r.delta == pytest.approx(want["delta"]) and (r.ci_low, r.ci_high, r.p_value) == pytest.approx((want["ci_low"], want["ci_high"], want["p_value"]))
    ranked, top = sorted((r.p_value, f"{m}|{c}") for (m, c), r in got.items()), 0.0
    for i, (p, name) in enumerate(ranked):
        top = min(1.0, max(top, (6 - i) * p))
        assert got[tuple(name.split("|"))].p_holm == pytest.approx(top, abs=1e-6)
    exact = rp.contrast_table(items, "exact", (("M0", "M3"),)).collect()
    assert {r.test for r in exact} == {"mcnemar"} and all(r.ci_low is None for r in exact)
    clustered = rp.contrast_table(items, "score", (("M0", "M1"),), cluster="disease", resamples=100).collect()
    assert {r.test for r in clustered} == {"cluster_bootstrap"}


def test_macro_contrasts_weigh_families_alike(items):
    (r,) = rp.macro_contrast_table(items.where("model = 'm1'"), "score", "family", "subtask", "disease", (("M0", "M3"),), resamples=60).collect()
    pairs = vectors(items, "m1", "M0", "M3")
    mean = lambda xs: sum(xs) / len(xs)
    families = {}
    for a, _, x, y in pairs:
        families.setdefault(a.family, {}).setdefault(a.subtask, []).append((x, y))
    side = lambda k: mean([mean([mean([v[k] for v in vs]) for vs in f.values()]) for f in families.values()])
    assert (r.n, r.mean_a, r.mean_b, r.delta) == (30, pytest.approx(side(0)), pytest.approx(side(1)), pytest.approx(side(1) - side(0))) and r.ci_low <= r.delta <= r.ci_high
    assert rp.macro_contrast_table(items.limit(0), "score", "family", "subtask", "disease", (("M0", "M3"),)).count() == 0


def test_strata_are_tested_only_if_large(items):
    rows = {(r.model, r.stratum): r for r in rp.verification_stratum_table(items, "score", least=14, resamples=50).collect()}
    assert rows["m1", "deterministic"].n == 14 and rows["m1", "deterministic"].p_value is not None
    assert rows["m1", "audit_only"].n == 14
    few = {(r.model, r.stratum): r for r in rp.verification_stratum_table(items, "score", least=15, resamples=50).collect()}
    assert all(r.p_value is None and r.ci_low is None for r in few.values()) and len(few) == 6


def test_gains_by_model_target_and_rule(items):
    table = rp.compensation_table(items, "score")
    by = {r.model: r for r in table.collect()}
    assert by["m1"].n == 30 and by["m3"].delta < by["m1"].delta
    assert rp.compensation(table).first().n == 3
    gains = {r.target: r for r in rp.target_gains(items).collect()}
    assert set(gains) == {"PA (all rules)"} and gains["PA (all rules)"].n_models == 3
    ground = {r.verdict: r for r in rp.groundability_table(items, "exact", conditions=("M0", "M3")).collect()}
    assert set(ground) == {"grounded", "partial", "unknown"} and ground["grounded"]["items"] == 10
    assert ground["partial"].delta == pytest.approx(ground["partial"].M3 - ground["partial"].M0)


def test_compare(items):
    better = items.withColumn("score", F.col("score") + 0.1).where("case_id <> 'c00'")
    (r,) = rp.compare(items, better, "score", resamples=50).collect()
    assert r.n == 29 * 5 * 3 and r.delta == pytest.approx(0.1) and r.test == "paired_bootstrap"
    (same,) = rp.compare(items, items.withColumn("exact", F.lit(None).cast("double")), "exact").collect()
    assert same.test == "mcnemar" and same.mean_b == 0.0
