"""What a judge said, read and averaged."""

from pyspark.sql import functions as F

from graphloom.operators import judging


def test_scores_flags_and_errors(spark):
    rows = [
        (1, "m", '{"clinical_information": 3, "explanation": "4", "hallucination": true, "comment": "' + "c" * 400 + '"}', None),
        (2, "m", 'Here: ```json\n{"clinical_information": 9, "explanation": -1, "hallucination": "yes"}\n```', ""),
        (3, "m", "no object", None),
        (4, "m", None, None),
        (5, "m", '{"clinical_information": 4}', "timeout"),
        (6, "n", '{"clinical_information": "x", "explanation": null, "hallucination": false}', None),
    ]
    got = {r.i: r for r in judging.judged(spark.createDataFrame(rows, "i int, model string, text string, failed string"), error_col="failed").collect()}
    assert (got[1].clinical_information, got[1].explanation, got[1].hallucination, len(got[1].comment), got[1].error) == (0.75, 1.0, True, 300, None)
    assert (got[2].clinical_information, got[2].explanation, got[2].hallucination) == (1.0, 0.0, None)
    assert [got[i].error for i in (3, 4, 5)] == [judging.UNREADABLE, judging.NO_ANSWER, "timeout"] and got[5].clinical_information is None
    assert (got[6].clinical_information, got[6].explanation, got[6].hallucination, got[6].error) == (None, None, False, None)
    means = {r.model: tuple(r)[1:] for r in judging.aggregate(judging.judged(spark.createDataFrame(rows, "i int, model string, text string, failed string"), error_col="failed"), ["model"]).collect()}
    assert means == {"m": (5, 0.875, 0.5, 1.0, 3), "n": (1, None, None, 0.0, 0)}


def test_letters_as_the_names_they_stand_for(spark):
    df = spark.createDataFrame([(["H", "J", "Z"], {"J": " b ", "H": "a"}), (None, {"A": "x"}), (["A"], None)], "l array<string>, o map<string,string>")
    assert [r[0] for r in df.select(judging.letters_to_text(F.col("l"), F.col("o"))).collect()] == ["a；b", "", ""]
