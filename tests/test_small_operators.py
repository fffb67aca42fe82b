"""Operators that no registered query reaches, on tables of a few rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scores as sc
from graphloom.functions import text as tx
from graphloom.operators import benchmark, contamination, evaluation, graph, ontology, retrieval, rules, statistics, traces
from graphloom.sources import records


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first().x


A = lambda *xs: F.array(*[F.lit(x) for x in xs])
L = F.lit
NONE = lambda: F.array().cast("array<string>")


def test_scores_of_items(value):
    assert value(sc.composite(L(1.0), L(1.0), L(1.0), L(0.0))) == pytest.approx(0.9) and value(sc.composite(L(1.0), L(1.0), L(1.0), L(1.0), L(False))) == 0.0
    assert value(sc.explanation_score(L(""), L("abc"))) == pytest.approx(2 / 5) and value(sc.explanation_score(L(""), L("abc"), newline=False)) == 0.0
    rule = next(iter(sc.EXPECTED_TOOLS))
    tool = sc.EXPECTED_TOOLS[rule][0]
    assert value(sc.tool_selection(L(rule.lower()), A(tool, "other", sc.SEARCH_TOOL), A(True, True, True))) == pytest.approx(2 / 3)
    assert value(sc.tool_selection(L(rule), A(tool), A(False))) == 0.0 and value(sc.tool_selection(L("?"), A(tool), A(True))) is None
    options = F.create_map(L("A"), L("血瘀"), L("B"), L("气虚"))
    assert value(sc.probe_rate(A("找 血瘀", "其他", " "), options)) == 0.5 and value(sc.probe_rate(NONE(), options)) is None
    assert value(sc.verification_stratum(L("not_applicable"), L(3))) == "not_applicable" and value(sc.verification_stratum(L("ok"), L(0))) == "audit_only" and value(sc.verification_stratum(L("ok"), L(2))) == "deterministic"
    assert value(sc.cost(L(1_000_000), L(500_000), 2.0, 8.0)) == 6.0
    family, tasks = next(iter(sc.FAMILIES.items()))
    assert value(sc.family_of(L(tasks[0]))) == family and value(sc.family_of(L("?"))) == "other"


def test_text_helpers(value):
    assert value(tx.has_cjk(L("a中"))) and not value(tx.has_cjk(L("abc"))) and value(tx.coerce_list(L(" a, b；c "))) == ["a", "b", "c"]
    assert value(tx.case_clauses(L("主诉：心悸，气短。气短，x"))) == ["心悸", "气短"]
    assert value(tx.strip_enumeration(L("1. ①气虚证"))) == "气虚证" and value(tx.strip_enumeration(L("（3）(一)、* 痰湿证"))) == "痰湿证"
    assert value(tx.syndrome_key(L("1. ①气虚证"))) == value(tx.syndrome_key(L("气虚证")))
    assert value(tx.clinical_query(L("患者，男，45岁  咳嗽"))).endswith("咳嗽")
    assert value(tx.gram_hash_set(L("abcdef"), 5)) == sorted(value(tx.gram_hash_set(L("abcdef"), 5))) or len(value(tx.gram_hash_set(L("abcdef"), 5))) == 2
    assert len(value(tx.gram_hash_set(L("aaaaaaa"), 5))) == 1 and len(value(tx.gram_hash_set(L("ab"), 5))) == 1 and value(tx.gram_hash_set(L(""), 5)) == []


def test_labels_quotas_and_consensus(spark, value):
    assert value(evaluation.label_or_unknown(L(None).cast("string"), L(""), L("b"))) == "b" and value(evaluation.label_or_unknown(L(0))) == "unknown"
    rows = spark.createDataFrame([(i, None if i % 2 else "") for i in range(20)] + [(100 + i, "a") for i in range(20)], "ord int, s string")
    taken = evaluation.stratified_quota(rows, "s", "ord", 10)
    assert sorted(r.ord for r in taken.collect()) == [0, 1, 2, 3, 4, 100, 101, 102, 103, 104]
    picks = spark.createDataFrame([("c", s, x) for s, xs in enumerate(("ab", "cd", "ef")) for x in xs], "case_id string, sample int, option string")
    assert evaluation.consensus(picks, ["case_id"], "sample", "option").first().consensus == ["a"]
    assert evaluation.consensus(picks, ["case_id"], "sample", "option", fallback=evaluation.LIST_FALLBACK).first().consensus == ["a", "b", "c", "d", "e"]


def test_stratified_macro_counts_strata_alike(spark):
    pairs = spark.createDataFrame([("s1", f"c{i}", 0.0, 0.0) for i in range(90)] + [("s2", f"d{i}", 0.0, 1.0) for i in range(10)], "st string, c string, a double, b double")
    assert statistics.macro_bootstrap(pairs, None, "st", "c", resamples=20).first().delta == pytest.approx(0.5)


def test_graph_briefs(spark):
    nodes = spark.createDataFrame([("a", "Syndrome", "N", ["d1", "d2"], ("d1", "s" * 300)), ("b", "Herb", "M", [], None)], "id string, type string, name string, source_docs array<string>, first_mention struct<doc_id:string,sentence:string>")
    brief = {r.id: r for r in graph.node_brief(nodes).collect()}
    assert len(brief["a"].sentence) == 220 and brief["b"].sentence is None and brief["a"].source_docs == ["d1", "d2"]
    edges = spark.createDataFrame([("e", "T", "a", "b", [("x",), ("",), ("y",), ("z",)], ["d"])], "id string, type string, source string, target string, evidence array<struct<sentence:string>>, source_docs array<string>")
    assert graph.edge_brief(edges).first().quotes == ["x", "y"]
    assert [(r.id, r.doc, r.pos) for r in graph.documents_of(nodes).orderBy("pos").collect()] == [("a", "d1", 0), ("a", "d2", 1)]
    assert ontology.visible(nodes, "clinical_reasoning").select("id").collect() == [("a",)]
    contexts = spark.createDataFrame([("c", "a")], "context string, member string")
    assert graph.context_documents(edges, contexts).collect() == [("c", "d")]
    stages = spark.createDataFrame([("v", 2, 0, "x"), (None, 9, 1, "y"), ("v", 1, 2, "z"), ("v", None, 3, "w")], "variant string, order int, ord int, id string")
    assert [r.id for r in stages.orderBy(*graph.stage_order(stages)).collect()] == ["y", "w", "z", "x"]


def test_rules_on_lists(spark):
    roots = spark.createDataFrame([("h1", "r"), ("h2", "r"), ("h3", "h3")], "id string, root string")
    items = spark.createDataFrame([("p", "h1"), ("p", "h3")], "g string, id string")
    held, contents = spark.createDataFrame([("p", "f")], "g string, container string"), spark.createDataFrame([("f", "h2")], "container string, part string")
    assert rules.loose_in_container(items, held, contents, roots, "g").collect() == [("p", "h1", "f")]
    edges = spark.createDataFrame([("CAUTION_FOR", "h2", "s", 1), ("CAUTION_FOR", "h2", "s", 2), ("CONTAINS", "h1", "s", 3)], "type string, source string, target string, ord int")
    assert [(r.seed, r.severity, r.restricted, r.ord) for r in rules.constraints(items.select("id"), edges, roots).collect()] == [("h1", "caution", "h2", 1)]


def test_names_resolve_by_stages(spark):
    queries = spark.createDataFrame([("q1", "k1", "name one"), ("q2", "k2", "alias"), ("q3", "k3", "near name")], "query_id string, key string, text string")
    names = spark.createDataFrame([("k1", "a", "T", 0, 0), ("k2", "x", "Other", 0, 1)], "key string, id string, type string, priority int, ord int")
    roots = spark.createDataFrame([("a", "a"), ("x", "r"), ("y", "r"), ("n", "n")], "id string, root string")
    nodes = spark.createDataFrame([("a", "T", "A"), ("x", "Other", "X"), ("y", "T", "Y"), ("n", "T", "near name"), ("m", "T", "far")], "id string, type string, name string")
    pool = spark.createDataFrame([("q3", "n", 1), ("q3", "m", 2)], "query_id string, id string, rank int")
    got = retrieval.resolve(queries, names, roots, pool, nodes, ("T",), lambda a, b: F.when(a == b, 1.0).otherwise(0.0)).collect()
    assert {(r.query_id, r.id, r.stage) for r in got} == {("q1", "a", 1), ("q2", "y", 2), ("q3", "n", 3)}


def test_index_persists(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "id long, text string")
    queries = spark.createDataFrame([("q", "a b")], "query_id string, text string")
    index = retrieval.Bm25Index(docs, retrieval.words)
    saved = index.save_to(str(tmp_path / "index"))
    again = retrieval.Bm25Index.load(spark, str(tmp_path / "index"))
    want = index.search(queries, retrieval.words).collect()
    assert [(r.id, r["rank"]) for r in want] == [(1, 1), (2, 2)] and saved.search(queries, retrieval.words).collect() == want == again.search(queries, retrieval.words).collect()
    few = retrieval.MOST_ASKED
    try:
        retrieval.MOST_ASKED = 0
        by_joins = again.search(queries, retrieval.words).collect()
    finally:
        retrieval.MOST_ASKED = few
    assert [(r.id, round(r.score, 9)) for r in by_joins] == [(r.id, round(r.score, 9)) for r in want]
    assert spark.range(1).select(retrieval.blend(F.lit(0.5), F.lit(-1.0), 0.2).alias("x")).first().x == pytest.approx(0.4)


def test_contamination_paths_agree(spark, monkeypatch):
    cases = spark.createDataFrame([(1, "abcdefghij"), (2, "zzzzzzz"), (3, ""), (4, "klmnopqrst")], "case_id long, canon string")
    passages = spark.createDataFrame([(1, "abcdefgXYZ"), (2, "klmnopqrstuvw"), (3, "klmnopqrst")], "passage_id long, canon string")
    parts = spark.createDataFrame([(4, "p", "klmnopqr"), (1, "p", "nothing here")], "case_id long, part string, canon string")
    titles = spark.createDataFrame([("abcdef",), ("xyz",), ("klmnopqrstuvw",)], "title string")
    run = lambda: (sorted(contamination.best_overlap(cases, passages).select("case_id", "passage_id", F.round("overlap", 9)).collect()), contamination.exact_parts(parts, passages).collect(), sorted(contamination.cited_sources(cases, titles).collect()))
    small = run()
    for name in ("MOST_PASSAGES", "MOST_NEEDLES"):
        monkeypatch.setattr(contamination, name, 0)
    assert run() == small
    assert [r.passage_id for r in small[0]] == [1, None, None, 2] and small[1] == [(4, "p", 2)] and small[2] == [(1, "abcdef"), (4, "klmnopqrstuvw")]
    old, new = (spark.createDataFrame(x, "field string, value string") for x in ([("kg", "1"), ("data", "2"), ("x", "")], [("kg", "1"), ("data", "3"), ("x", "4")]))
    assert contamination.staleness(old, new).collect() == [("data", "2", "3")]


def test_recorded_runs(spark, tmp_path):
    runs = spark.createDataFrame([("c", 1, ["b"], 2.0, 5, ""), ("c", 0, ["a"], 1.0, 9, None), ("c", 2, ["z"], 1.0, 1, "broken")], "case_id string, sample int, steps array<string>, wall_ms double, context_chars int, parity_error string")
    (r,) = traces.merge_samples(runs, ["case_id"]).collect()
    assert (r.steps, r.wall_ms, r.context_chars, r.parity_error, r.sample, r.n_samples) == (["a", "b", "z"], 4.0, 9, "broken", -1, 3)
    kept = spark.createDataFrame([("1", "M0")], "case_id string, condition string")
    records.write_traces(kept, str(tmp_path / "t"))
    assert [(r.case_id, r.condition) for r in records.read_traces(spark, str(tmp_path / "t")).collect()] == [("1", "M0")]
    items = spark.createDataFrame([("1", "pa", "M0", "m", 0, {"exact": 1.0}, {"branch_group": "g"})], records.SCORE)
    records.write_scores(items, str(tmp_path / "s"))
    (row,) = records.with_metrics(records.read_scores(spark, str(tmp_path / "s")), ["exact", "absent"]).collect()
    assert (row.model, row.exact, row.absent, row.branch_group, row.parity_error) == ("m", 1.0, None, "g", None)
    a = spark.range(1).select(traces.signature({"b": F.lit("2"), "a": "1"}).alias("x")).first().x
    assert a == spark.range(1).select(traces.signature({"a": "1", "b": "2"}).alias("x")).first().x


def test_stages_and_leaks(spark, value):
    sign = benchmark.stage_signature(A(" m "), A("e"), A("x"), L(None).cast("string"))
    assert value(sign) == sorted(["m", "e", "done::x", "variant::"])
    left = benchmark.without_leaks(A("abcdef", "xyz", "ab"), A("cdef", "zz"), lambda c: c)
    assert value(left) == ["xyz", "ab"]
    rows = spark.createDataFrame([("A b", 1), ("ab", 0), ("c", 2)], "value string, ord int").withColumn("k", tx.bare_text(F.lower("value")))
    assert sorted(r.value for r in benchmark.keep_first_spelling(rows, "k", "ord").collect()) == ["ab", "c"]


def test_latest_log_stream(spark, tmp_path):
    from graphloom.streaming import runs

    spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("j", "x", 1)], "key string, completion string, ord long").write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("key string, completion string, ord long").parquet(str(tmp_path / "in"))
    query = runs.keep_latest(log, str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.key, r.completion) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("k", "new"), ("j", "x")}


def test_pairs_held_together_by_either_way(spark):
    from graphloom.operators import rules

    # part 0 is in everything, so pairs with it are counted from containers; container 0 holds everything, so there pairs look through their rarer part
    for rows in ([(c, p) for c in range(300) for p in (0, c % 40 + 1, c % 7 + 41)], [(0, p) for p in range(300)] + [(c, p) for c in range(1, 9) for p in (1, 2)]):
        rows = sorted(set(rows))
        held = {}
        for c, p in rows:
            held.setdefault(p, set()).add(c)
        asked = [(a, b) for a in (0, 1, 2, 45) for b in range(1, 47) if a != b] + [(1, 2), (999, 1)]
        want = {(a, b): len(held.get(a, set()) & held.get(b, set())) for a, b in asked}
        got = rules.held_together(spark.createDataFrame(asked, "a int, b int"), spark.createDataFrame(rows, "container int, part int"))
        assert {(r.a, r.b): r.n for r in got.collect()} == {k: n for k, n in want.items() if n}
