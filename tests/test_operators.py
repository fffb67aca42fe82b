import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import benchmark, contamination, evaluation, graph, ontology, retrieval, rules, statistics, traces
from graphloom.operators.components import components


@pytest.fixture(scope="module")
def kg(spark):
    nodes = spark.createDataFrame([("d1", "Disease", "咳嗽", ["x"], 0), ("u1", "DiseaseSubtype", "急性", ["x"], 1), ("s1", "Syndrome", "风寒证", ["x", "y"], 2), ("s2", "Syndrome", "风热证", [], 3), ("f1", "Formula", "汤", ["y"], 4), ("h1", "Herb", "石膏", [], 5), ("h2", "Herb", "生石膏", [], 6), ("z", "Alien", "?", [], 7)], "id string, type string, name string, source_docs array<string>, ord long")
    edges = spark.createDataFrame(
        [("HAS_SYNDROME", "d1", "s1", ["x"], 0), ("HAS_SUBTYPE", "d1", "u1", ["x"], 1), ("SUBTYPE_HAS_SYNDROME", "u1", "s1", ["x"], 2), ("SUBTYPE_HAS_SYNDROME", "u1", "s2", ["x"], 3), ("USES_FORMULA", "s1", "f1", ["y"], 4), ("CONTAINS_HERB", "f1", "h1", [], 5), ("SAME_AS", "h2", "h1", [], 6), ("HAS_SYNDROME", "d1", "gone", [], 7), ("ODD", "d1", "s1", [], 8)],
        "type string, source string, target string, source_docs array<string>, ord long",
    )
    return nodes, edges


def test_ontology(spark, kg):
    nodes, edges = kg
    # e2 has an unknown type and no target, e3 neither end, e4 the wrong way round: an edge tells its first problem only
    more = spark.createDataFrame([("ODD", "d1", "gone", "e2"), ("HAS_SYNDROME", "nobody", "gone", "e3"), ("HAS_SYNDROME", "s1", "d1", "e4")], "type string, source string, target string, id string")
    every = graph.drop_dangling(edges, nodes).unionByName(edges.where("target = 'gone'").withColumn("id", F.lit("e"))).unionByName(more, allowMissingColumns=True)
    bad = ontology.violations(nodes, every, ontology.signatures(spark)).collect()
    assert sorted((r.problem, r.id, r.detail) for r in bad) == [("dangling_source", "e3", "nobody"), ("dangling_target", "e", "gone"), ("unknown_edge_type", "d1|ODD|s1", "ODD"), ("unknown_edge_type", "e2", "ODD"), ("unknown_node_type", "z", "Alien"), ("unknown_signature", "e4", "Syndrome HAS_SYNDROME Disease")]
    assert "Formula" not in {r.type for r in ontology.visible(nodes, "clinical_reasoning").collect()}
    assert "TreatmentPrinciple" in ontology.visible_types("clinical_reasoning", verification=True)
    with pytest.raises(Exception, match="must not return"):
        ontology.guard_domain(nodes, "clinical_reasoning").collect()


def test_traversal_and_clusters(spark, kg):
    nodes, edges = kg
    edges = graph.drop_dangling(edges, nodes)
    assert edges.count() == 8
    seeds = spark.createDataFrame([("d1",)], "seed string")
    got = {r.id: (r.hop, r.score) for r in graph.expand(seeds, edges, nodes, allowed=("DiseaseSubtype", "Syndrome")).collect()}
    assert got == {"d1": (0, 1.0), "u1": (1, 0.5), "s1": (1, 0.5), "s2": (2, 0.25)}
    soft = graph.expand(seeds, edges, nodes, hops=3, max_nodes=2).collect()
    assert {r.hop for r in soft} == {0, 1}
    roots = {r.id: r.root for r in graph.clusters(edges, nodes, F.col("name")).collect()}
    assert roots["h2"] == "h1" and roots["d1"] == "d1"


def test_hierarchy(kg):
    _, edges = kg
    paths = graph.hierarchy(edges.where("target <> 'gone'"))
    assert paths.count() == 3
    first = {r.leaf: r.via for r in graph.leaves_of(paths).collect()}
    assert first == {"s1": None, "s2": "u1"}


def test_documents(spark, kg):
    nodes, edges = kg
    held = graph.document_nodes(nodes, edges)
    assert {r.id for r in held.where("doc = 'y'").collect()} == {"s1", "f1"}
    asked = spark.createDataFrame([("q", "x"), ("q", "x"), ("q", "y")], "query_id string, doc string")
    got = {r.id: r.overlap for r in graph.document_overlap(asked, held).collect()}
    assert got["s1"] == 1.0 and got["f1"] == pytest.approx(1 / 3)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a int, b int")
    got = dict(components(chain).collect())
    assert all(got[i] == 0 for i in range(65)) and got[101] == 100


def test_bm25_and_domains(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "p"), (2, "beta beta gamma", "p"), (3, "alpha", "q"), (4, None, "q")], "id int, text string, part string")
    asked = spark.createDataFrame([("a", "beta beta")], "query_id string, text string")
    got = retrieval.Bm25Index(docs, retrieval.words).search(asked, retrieval.words).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [2, 1]
    n, avg, df, tf, dl = 3, 2.0, 2, 2, 3
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)) * math.log(3)
    assert max(r.score for r in got) == pytest.approx(want)


def pairs(spark, a, b, **extra):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "unit int, a double, b double")


def test_paired_statistics(spark):
    a, b = [0, 0, 1, 1, 0, 1, 0, 1, 1, 0] * 5, [1, 0, 1, 1, 1, 1, 1, 1, 1, 0] * 5
    p = pairs(spark, a, b)
    m = statistics.mcnemar(p, []).first()
    assert (m.wins, m.losses, m.delta) == (15, 0, pytest.approx(0.3)) and m.p_value == pytest.approx(2 / 2**15)
    got = statistics.paired_bootstrap(p, [], "unit", resamples=200).first()
    want = statistics.reference_bootstrap(a, b, resamples=200)
    for k in ("delta", "ci_low", "ci_high", "p_value"):
        assert got[k] == pytest.approx(want[k]), k
    same = statistics.mcnemar(pairs(spark, [1, 0], [1, 0]), []).first()
    assert same.p_value == 1.0
    kinds = {r.test for r in statistics.paired_test(p.withColumn("g", F.lit(1)), ["g"], "unit", resamples=50).collect()}
    assert kinds == {"mcnemar"}


def test_cluster_interval_is_wider(spark):
    rows = [(c * 20 + i, c, 0.0, float(c % 2)) for c in range(8) for i in range(20)]
    frame = spark.createDataFrame(rows, "unit int, c int, a double, b double")
    naive = statistics.cluster_bootstrap(frame, [], "unit", resamples=300).first()
    grouped = statistics.cluster_bootstrap(frame, [], "c", resamples=300).first()
    assert grouped.ci_high - grouped.ci_low > 2 * (naive.ci_high - naive.ci_low)


def test_macro_counts_families_alike(spark):
    rows = [("F1", f"F1s{i}", f"c{i}{k}", 0.0, 1.0 if i == 0 else 0.0) for i in range(4) for k in range(5)] + [("F2", "F2s", f"d{k}", 0.0, 0.0) for k in range(50)]
    frame = spark.createDataFrame(rows, "f string, s string, c string, a double, b double")
    assert statistics.macro_bootstrap(frame, "f", "s", "c", resamples=20).first().delta == pytest.approx(1 / 8)
    twice = frame.unionByName(frame.where("s = 'F2s'").withColumn("f", F.lit("F1")))
    with pytest.raises(Exception, match="two families"):
        statistics.macro_bootstrap(twice, "f", "s", "c", resamples=5).collect()


def test_ranks_and_corrections(spark):
    w = statistics.wilcoxon(pairs(spark, [0] * 6, [1, 1, -2, 3, 0, 4]), []).first()
    assert (w.n, w.w_plus, w.tie_term, w.test) == (5, 1.5 + 1.5 + 4 + 5, 6, "wilcoxon_approx")
    e, var = 5 * 6 / 4, (5 * 6 * 11 - 3) / 24
    z = (abs(w.w_plus - e) - 0.5) / math.sqrt(var)
    assert w.p_value == pytest.approx(2 * (1 - 0.5 * (1 + math.erf(z / math.sqrt(2)))))
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    got = {r.name: r.p_holm for r in statistics.holm(tests, []).collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}
    rho = statistics.spearman(pairs(spark, range(10), [-x * x for x in range(10)]), [], "a", "b").first()
    assert rho.r == pytest.approx(-1.0)
    assert math.isnan(statistics.pearson(pairs(spark, [1, 2], [1, 2]), [], "a", "b").first().r)


def test_evaluation(spark):
    items = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, m double")
    got = {r.k: (r.n, r.m) for r in evaluation.metric_means(items, ["k"], ["m"]).collect()}
    assert got == {"a": (2, 1.0), "b": (1, None)}
    assert evaluation.quota_table([("x", 90), ("y", 10)], 40) == {"x": 30, "y": 10}
    assert sum(evaluation.quota_table([("x", 3), ("y", 100), ("z", 100)], 50).values()) == 50
    ids = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "id string, ord int")
    assert sorted(r.id for r in evaluation.unique_ids(ids, "id", "ord").collect()) == ["a", "a#2", "b"]
    votes = spark.createDataFrame([("c", "B"), ("c", "A"), ("c", "A")], "k string, v string")
    assert evaluation.majority(votes, ["k"], "v").first().v == "A"
    picks = spark.createDataFrame([("c", 1, "A"), ("c", 2, "B")], "k string, s int, o string")
    assert evaluation.consensus(picks, ["k"], "s", "o").first().consensus == ["A"]
    strata = spark.createDataFrame([("f", "s1", 0.0)] * 90 + [("f", "s2", 1.0)] * 10, "f string, s string, m double")
    assert evaluation.macro_mean(strata, [], "f", "s", "m").first().macro_mean == 0.5
    assert "| k | v |" in evaluation.markdown(votes)
    grams = spark.createDataFrame([("k", 0, ["a", "b"]), ("k", 1, ["a", "b", "c"]), ("k", 2, ["z"])], "k string, s int, g array<string>")
    assert evaluation.medoid(grams, ["k"], "s", "g").first().s == 0


def test_traces(spark):
    calls = spark.createDataFrame([("r", i, "t" if i < 6 else f"u{i}") for i in range(15)], "run string, idx int, tool string")
    got = {r.idx: r.reason for r in traces.budget_gate(calls, ["run"], ["idx"]).collect()}
    assert got[3] is None and got[4] == "per_tool" and got[12] == "total"
    wanted = spark.createDataFrame([(c, k, 0) for c in ("1", "2") for k in ("M0", "M3", "M4")], "case_id string, condition string, sample int")
    recorded = spark.createDataFrame([("1", "M3", 0, "s", "d"), ("2", "M3", 0, "s", "d"), ("2", "M4", 0, "s", "d"), ("2", "M0", 0, "other", "d")], "case_id string, condition string, sample int, run_signature string, design_signature string")
    todo = {(r.case_id, r.condition) for r in traces.missing_jobs(wanted, recorded, "s", "d").collect()}
    assert todo == {("1", "M0"), ("1", "M3"), ("1", "M4"), ("2", "M0")}
    log = spark.createDataFrame([("k", "old", 0), ("k", "new", 1)], "key string, completion string, ord int")
    asked = spark.createDataFrame([("k",), ("m",)], "key string")
    assert {r.key: (r.completion, r.error) for r in traces.replay(asked, log).collect()} == {"k": ("new", None), "m": (None, "replay miss")}
    specs = spark.createDataFrame([("t", ["safety"], ["agent"], ["q"])], "tool string, domains array<string>, phases array<string>, required array<string>")
    asked = spark.createDataFrame([("t", {"q": "x"}), ("t", {"q": ""}), ("u", {"q": "x"})], "tool string, arguments map<string,string>")
    assert sorted(str(r.refusal) for r in traces.gate(asked, specs, "safety", "agent").collect()) == ["None", "missing_arguments", "unknown_tool"]
    counts = spark.createDataFrame([('{"items": [1, 2, 3]}',), ("{}",)], "p string").select(traces.result_count(F.col("p")).alias("n")).collect()
    assert [r.n for r in counts] == [3, 0]
    long = spark.createDataFrame([("x" * 5000,)], "p string").select(traces.rendered(F.col("p")).alias("t")).first().t
    assert len(long) <= 4000 and long.endswith('<truncated>"}')


def test_rules(spark):
    criteria = spark.createDataFrame([("c", 0, "体温正常"), ("c", 1, "血压平稳"), ("c", 2, "无发热")], "k string, criterion_id int, criterion string")
    findings = spark.createDataFrame([("c", 0, "体温正常三天"), ("c", 1, "血压未平稳血压平稳")], "k string, finding_id int, finding string")
    from graphloom.functions.text import char_ngrams

    got = {r.criterion_id: r.status for r in rules.match_criteria(criteria, findings, lambda c: char_ngrams(c, (2,)), ["k"]).collect()}
    assert got == {0: "met", 1: "contradicted", 2: "not_evidenced"}
    claim = spark.createDataFrame([("先煎", ["先煎"]), ("后下", ["先煎"]), ("先煎", [])], "c string, a array<string>").select(rules.claimed_requirement(F.col("c"), F.col("a")).alias("v")).collect()
    assert [r.v for r in claim] == ["supported", "contradicted_by_graph", "not_covered"]
    contents = spark.createDataFrame([("p", "f1", "a"), ("p", "f1", "b"), ("p", "f2", "b"), ("p", "f2", "c")], "g string, f string, h string")
    assert rules.item_overlap(contents, "g", "f", "h").first().jaccard == 0.333


def test_contamination(spark):
    case = "the quick brown fox jumps over the lazy dog again and again"
    cases = spark.createDataFrame([(1, case), (2, "entirely different words 12345 67890")], "case_id int, canon string").select("case_id", F.regexp_replace("canon", " ", "").alias("canon"))
    passages = contamination.corpus(spark.createDataFrame([("n", "the quick brown fox jumps over", 0), ("m", "The, quick", 1), ("k", "abc", 2)], "origin string, text string, ord int")).select("passage_id", "canon")
    assert passages.count() == 2
    parts = spark.createDataFrame([(1, "g", "quickbrown"), (2, "g", "words")], "case_id int, part string, canon string")
    got = {r.case_id: r for r in contamination.audit(cases, parts, passages).collect()}
    assert got[1].stratum == "likely" and got[1].n_exact_parts == 1 and got[1].graph_in_case == 1.0 and got[1].case_in_graph < 1.0
    assert got[2].stratum == "clean"


def test_benchmark(spark):
    stages = spark.createDataFrame([("d", "v", "1", 1, "n", ["a", "b", "c", "d"]), ("d", "v", "2", 2, "n", ["e", "a", "f", "g"]), ("d", "w", "3", 1, "m", ["a"] * 4)], "disease string, variant string, id string, order int, name string, actions array<string>")
    got = {r.id: r for r in benchmark.history(benchmark.eligible_stages(stages)).collect()}
    assert got["2"].prior == ["a", "b", "c", "d"] and got["3"].prior == [] and (got["1"].position, got["2"].position) == ("first", "last")
    assert got["1"].label == "v·n" and got["3"].label == "m"
    items = spark.createDataFrame([("i", {"A": "x", "B": "x", "C": "longgold"}, ["C"], "has longgold in it"), ("i", {"A": "1", "B": "2", "C": "3"}, ["Z"], ""), ("", {}, [], "")], "id string, options map<string,string>, answer array<string>, text string")
    found = {r.problem for r in benchmark.violations(items, lambda c: F.lower(c)).collect()}
    assert found == {"blank_id", "duplicate_id", "no_options", "gold_not_in_options", "duplicate_option_text", "answer_echoed"}


def test_item_overlap_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = sorted({(rng.randrange(4), f"f{rng.randrange(9)}", rng.choice([None, *"abcdefgh"])) for _ in range(150)}, key=repr)
    got = {(r.g, r.a, r.b): (r.shared, r.jaccard) for r in rules.item_overlap(spark.createDataFrame(rows + rows[:20], "g int, f string, h string"), "g", "f", "h").collect()}
    sets = {}
    for g, f, h in rows:
        sets.setdefault((g, f), set()).add(h)
    want = {}
    for (g, a), x in sets.items():
        for (k, b), y in sets.items():
            if g == k and a < b and (n := len((x & y) - {None})):
                want[g, a, b] = (n, round(n / (len(x) + len(y) - n), 3))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.0011 for k in want)
