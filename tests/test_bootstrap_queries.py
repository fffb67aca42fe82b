"""The registered bootstrap queries against all draws of the reference's 10,000, in plain Python on a small table."""

import collections
import hashlib

import pytest

from graphloom.operators import statistics
from graphloom.plans import QUERIES
from graphloom.plans import evaluation_queries as eq

SF = "/root/testdata/sf0.001"


def picked(rep, slot, n):
    return int(hashlib.md5(f"20260829:{rep}:{slot}".encode()).hexdigest()[:8], 16) % n


def summary(stats, delta):
    stats, beyond = sorted(stats), sum(abs(s - delta) >= abs(delta) for s in stats)
    return {"delta": delta, "ci_low": stats[249], "ci_high": stats[9750], "p_value": (beyond + 1) / 10_001}


def compare(row, want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=2e-6), k


def test_resamples_are_the_references():
    assert statistics.RESAMPLES == 10_000


def test_paired_bootstrap_draws_all(spark):
    rows = sorted(eq._user_pairs(spark, SF).collect(), key=lambda r: r.user_id)
    want = statistics.reference_bootstrap([r.a for r in rows], [r.b for r in rows], resamples=10_000)
    compare(QUERIES["paired_bootstrap"](spark, SF).first(), want)


def test_cluster_bootstrap_draws_all(spark):
    sums = collections.defaultdict(lambda: [0.0, 0])
    for r in eq._binary_pairs(spark, SF).collect():
        sums[r.source][0] += r.b - r.a
        sums[r.source][1] += 1
    c = [sums[k] for k in sorted(sums)]
    ratio = lambda drawn: sum(d for d, _ in drawn) / sum(n for _, n in drawn)
    stats = [ratio([c[picked(rep, s, len(c))] for s in range(len(c))]) for rep in range(10_000)]
    compare(QUERIES["cluster_bootstrap"](spark, SF).first(), summary(stats, ratio(c)))


def test_macro_bootstrap_draws_all(spark):
    sums = collections.defaultdict(lambda: collections.defaultdict(lambda: [0.0, 0]))
    for r in eq._binary_pairs(spark, SF).collect():
        c = sums[r.lang, f"{r.lang}|{r.doc_id % 3}"][r.source]
        c[0] += r.b - r.a
        c[1] += 1
    strata = {k: [v[c] for c in sorted(v)] for k, v in sums.items()}
    ratio = lambda drawn: sum(d for d, _ in drawn) / sum(n for _, n in drawn)

    def macro(values):
        families = collections.defaultdict(list)
        for (fam, _), v in values.items():
            families[fam].append(v)
        return sum(sum(v) / len(v) for v in families.values()) / len(families)

    stats = [macro({(f, s): ratio([c[picked(rep, f"{f}/{s}/{i}", len(c))] for i in range(len(c))]) for (f, s), c in strata.items()}) for rep in range(10_000)]
    compare(QUERIES["macro_bootstrap"](spark, SF).first(), summary(stats, macro({k: ratio(c) for k, c in strata.items()})))


def test_large_sums_are_not_broadcast(spark, monkeypatch):
    rows = [(i, i % 7, 0.0, float(i % 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, "unit int, c int, a double, b double")
    small = statistics.cluster_bootstrap(frame, [], "c", resamples=100).first()
    monkeypatch.setattr(statistics, "MOST_BROADCAST", 3)
    assert statistics.cluster_bootstrap(frame, [], "c", resamples=100).first() == small
