"""Scores that a judge gave in free text: what it was shown, what it said, and the means over what could be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import extract_object
from ..functions.scores import judge_score

# fixed values
JUDGE_FIELDS, MOST_COMMENT = ("clinical_information", "explanation"), 300
NO_ANSWER, UNREADABLE = "no answer", "judge output unparseable"


def letters_to_text(letters: Column, options: Column) -> Column:
    """The options that letters stand for, in the letters' order; unknown letters are left out (P14)."""
    names = F.transform(F.coalesce(letters, F.array().cast("array<string>")), lambda x: F.trim(F.try_element_at(options, x)))
    return F.array_join(F.array_compact(names), "；")


def judged(outputs: DataFrame, text_col: str = "text", error_col: str | None = None) -> DataFrame:
    """outputs with a score from 0 to 1 for each field, hallucination, comment and error.

    A score that isn't a number is null, one beyond the scale is its end; a hallucination that isn't true or false is null.
    A call that failed and a text without an object are errors without scores.
    """
    failed = F.lit(None).cast("string") if error_col is None else F.nullif(F.col(error_col), F.lit(""))
    read = outputs.withColumn("read_", extract_object(F.coalesce(F.col(text_col), F.lit("")))["json"])
    error = F.coalesce(failed, F.when(F.col(text_col).isNull(), NO_ANSWER), F.when(F.col("read_").isNull(), UNREADABLE))
    value = F.when(error.isNull(), F.try_parse_json("read_"))
    get = lambda f: F.try_variant_get(value, f"$.{f}", "string")
    flag = F.try_variant_get(value, "$.hallucination", "boolean")
    is_flag = F.schema_of_variant(F.try_variant_get(value, "$.hallucination", "variant")) == "BOOLEAN"
    scores = [judge_score(F.trim(get(f))).alias(f) for f in JUDGE_FIELDS]
    return read.select(*outputs.columns, *scores, F.when(is_flag, flag).alias("hallucination"), F.substring(F.coalesce(get("comment"), F.lit("")), 1, MOST_COMMENT).alias("comment"), error.alias("error"))


def aggregate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_judged, a mean for each field over the scores there are, hallucination_rate over the flags there are, n_errors (D20)."""
    means = [F.avg(f).alias(f) for f in JUDGE_FIELDS]
    return scores.groupBy(*keys).agg(F.count("*").alias("n_judged"), *means, F.avg(F.col("hallucination").cast("int")).alias("hallucination_rate"), F.count("error").alias("n_errors"))
