"""From benchmark items to the cases and parts of an audit, its closest cases and its report."""

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import contamination as cn
from graphloom.operators import reports as rp


def test_items_as_cases_and_parts(spark):
    rows = [("q1", "How much?", "why so", "the rule", {"A": " five grams ", "B": "ten"}, ["A", "B", "Z"]), ("q2", None, "", None, {"A": ""}, ["A"]), ("q3", "x", None, " ", None, None)]
    items = spark.createDataFrame(rows, "id string, question string, explanation string, rule_summary string, options map<string,string>, answer_letters array<string>")
    cases, parts = cn.audit_inputs(items, "pa")
    assert {r.case_id: r.canon for r in cases.collect()} == {"q1": "Howmuchwhyso", "q2": "", "q3": "x"}
    assert {(r.case_id, r.part, r.canon) for r in parts.collect()} == {("q1", "A", "fivegrams"), ("q1", "B", "ten"), ("q1", "answer", "therule")}
    lists = spark.createDataFrame([("c", ["a", "b"], "d")], "id string, clinical_data array<string>, clinical_information string")
    assert lists.select(cn.text_of_fields(lists, cn.CASE_FIELDS["sdt"])).first()[0] == "a b d"


def test_two_options_in_two_passages_are_leaks(spark):
    items = spark.createDataFrame([("q1", "nothing alike here at all", {"A": "warming the kidney", "B": "calming the liver"}, ["A", "B"]), ("q2", "entirely else", {"A": "unheard of cure"}, ["A"])], "id string, question string, options map<string,string>, answer_letters array<string>")
    passages = cn.corpus(spark.createDataFrame([("p", "they say warming the kidney helps", 0), ("q", "then calming the liver follows", 1)], "origin string, text string, ord int")).select("passage_id", "canon")
    cases, parts = cn.audit_inputs(items, "pa")
    audited = cn.audit(cases, parts, passages)
    assert {r.case_id: (r.stratum, r.n_exact_parts) for r in audited.collect()} == {"q1": ("likely", 2), "q2": ("clean", 0)}
    assert [r.case_id for r in cn.closest(audited, 1).collect()] == ["q1"] or cn.closest(audited, 1).first().overlap >= audited.agg(F.max("overlap")).first()[0]
    text = cn.report(audited)
    assert "## Closest cases" in text and "| q1 |" in text and "| q2 |" in text


def test_query_text(spark):
    df = spark.createDataFrame([("What\u3000now?", {"A": "one", "B": "two"}), (None, None), ("q" * 500, {})], "q string, o map<string,string>")
    got = [r[0] for r in df.select(tx.question_query(F.col("q"), F.col("o"))).collect()]
    assert got[0] == "What now? one two" and got[1] == "" and len(got[2]) == 400


def test_explicit_against_implicit(spark):
    gains = spark.createDataFrame([("PA (all rules)", 3, 0.5, 0.1), ("SDT task 1 clinical info", 3, 0.4, 0.2), ("SDT task 4 explanation", 3, 0.2, 0.0), ("other", 1, 0.0, 0.0)], "target string, n_models long, mean_first double, mean_delta double")
    got = {r.relation: (r.n_targets, round(r.mean_first, 6), round(r.mean_delta, 6)) for r in rp.explicit_vs_implicit(gains).collect()}
    assert got == {"explicit": (1, 0.5, 0.1), "unaided": (2, 0.3, 0.1), "unknown": (1, 0.0, 0.0)}
