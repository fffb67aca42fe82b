import pytest
from pyspark.sql import functions as F

from graphloom.functions import jsons, scores, text


@pytest.fixture(scope="module")
def on(spark):
    def run(value, build, kind="string"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r

    return run


def test_folding(on):
    assert on("  Ａ，b　 C。", text.fold_text) == "a,b c."
    assert on(None, text.fold_text) == ""
    assert on("Ab-c_ d！é²", lambda c: text.bare_text(c)) == "Abcdé2"


@pytest.mark.parametrize(("raw", "want"), [("（3）痰瘀郁肺证：胸闷，咳嗽", "痰瘀郁肺证"), ("③湿热下注证", "湿热下注证"), ("1.心虚胆怯证：心悸", "心虚胆怯证"), ("肝郁证等", "肝郁证")])
def test_canonical_syndrome(on, raw, want):
    assert on(raw, text.canonical_syndrome) == want


def test_syndrome_atoms(on):
    assert on("痰阻血瘀，湿郁化热证", text.syndrome_atoms) == ["痰阻血瘀证", "湿郁化热证"]
    assert on("气虚证", text.syndrome_atoms) == ["气虚证"]


def test_herbs(on):
    assert on("生石膏(先煎)", text.herb_base) == "生石膏" and on("生石膏(先煎)", text.herb_markers) == ["先煎"]
    kept = "心悸（心律失常-室性早搏）"
    assert on(kept, text.herb_base) == kept and on(kept, text.herb_markers) == []
    line = "生地、生石膏、地榆炭、生大黄(后下)等"
    assert on(line, lambda c: text.markers_after_name(c, F.lit("大黄"))) == ["后下"]
    assert on(line, lambda c: text.markers_after_name(c, F.lit("石膏"))) == []
    assert on(line, lambda c: text.markers_after_name(c, F.lit("黄"))) == []


def test_departments_and_kinds(on):
    assert on("脾胃科", text.canonical_department) == "脾胃病科" and on("骨科", text.canonical_department) == "骨科"
    assert on("辛辣食物", lambda c: text.restriction_kind(F.lit("RestrictedItem"), c)) == "diet"
    assert on("针灸", lambda c: text.restriction_kind(F.lit("RestrictedItem"), c)) == "procedure"


def test_ngrams(on):
    assert on("舌质红", text.char_ngrams) == ["舌", "质", "红", "舌质", "质红", "舌质红"]
    assert on("红", lambda c: text.char_ngrams(c, (2,))) == ["红"]
    assert on("abc 12", text.char_ngrams) == ["abc", "12"]
    assert on("abcdef", text.gram_set) == ["abcde", "bcdef"] and on("ab", text.gram_set) == ["ab"] and on("", text.gram_set) == []


def test_options(on):
    assert on("A:痰浊;B:耗损心气;C：x", text.parse_options) == {"A": "痰浊", "B": "耗损心气", "C": "x"}
    assert on("A. one\nB. two\n\nthird", text.parse_options) == {"A": "one", "B": "two", "C": "third"}
    assert on("", text.parse_options) == {}
    assert on("H;J", text.parse_letters) == ["H", "J"] and on("ABCD", text.parse_letters) == ["A", "B", "C", "D"] and on(None, text.parse_letters) == []
    assert on("a; b；;c", text.split_semicolon) == ["a", "b", "c"]


@pytest.mark.parametrize(
    ("raw", "rung"),
    [('{"a": 1}', "direct"), ('text ```json\n{"a": 1}\n``` more', "fenced"), ('so {"a": {"b": "}"}} done', "balanced_span"), ('so {"a": 1,} done', "repaired"), ("｛\"a\"：1｝", "repaired_whole"), ("nothing", "failed"), ("", "empty"), ("[1, 2]", "failed"), ('{"a": "x\ny"}', "repaired")],
)
def test_json_ladder(on, raw, rung):
    r = on(raw, jsons.extract_object)
    assert r.strategy == rung and (r.json is not None) == (rung not in ("failed", "empty"))


def test_leaf_strings(on):
    assert on('{"b": ["x", {"c": "y"}], "a": "z", "n": 1}', jsons.leaf_strings) == ["z", "x", "y"]


def test_subsequence(on):
    import random

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(2))
        assert text._lcs(a, b) == slow(a, b)
    assert on("abcd", lambda c: text.rouge_l(c, F.lit("abed"))) == pytest.approx(0.75)


def letters(spark, pred, gold, build):
    return spark.createDataFrame([(pred, gold)], "p array<string>, g array<string>").select(build(F.col("p"), F.col("g")).alias("r")).first().r


def test_option_scores(spark):
    ten = list("ABCDEFGHIJ")
    assert letters(spark, ten, ["C"], scores.proportional_score) == pytest.approx(0.1)
    ms = lambda p, g: letters(spark, p, g, scores.multi_select)
    assert (ms(["A"], ["A", "B"]).exact, ms(["A"], ["A", "B"]).partial_credit) == (0.0, 0.5)
    assert ms(["A", "C"], ["A", "B"]).partial_credit == 0.0 and ms(["B", "A"], ["A", "B"]).exact == 1.0
    cp = lambda p, g: letters(spark, p, g, lambda a, b: scores.pathway_item(F.lit(scores.TRANSITION_TASK), a, b))
    assert cp(["A", "C"], ["A"]).unsafe_transition == 1.0 and cp(None, ["A"]).unsafe_transition == 0.0
    assert cp(["A"], ["D"]).missed_uncertainty == 1.0 and cp(["D"], ["D"]).exact == 1.0


def test_verdicts_and_honesty(spark, on):
    assert on(["supported", "contradicted"], scores.worst_verdict, "array<string>") == "contradicted"
    assert on([], scores.worst_verdict, "array<string>") == "no_verdict"
    honest = lambda t, u=True: on(t, lambda c: scores.coverage_honesty(F.lit(u), c))
    assert honest("根据图谱，可以") == 0.0 and honest("根据图谱，图谱未收录") == 1.0 and honest("x", False) is None and honest("") is None
    assert on("剂量过大，孕妇慎用", scores.topics_mentioned) == ["dose", "pregnancy"] and on(" ", scores.topics_mentioned) is None
    assert on("9", scores.judge_score) == 1.0 and on("bad", scores.judge_score) is None
