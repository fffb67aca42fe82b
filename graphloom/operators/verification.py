"""Verification of answers as data: the names an answer rests on, the checks that its stated category asks for, their verdicts folded.

answers: case_id, category, letters (array), options (map), question.  A plan is a call of a check with its arguments; plans of all
answers run as one table a check.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import worst_verdict
from ..session import save, small_enough
from .contamination import MOST_NEEDLE_CHARS, MOST_NEEDLES, holding

# ---- fixed values -------------------------------------------------------------------------------------------------
CHECKS_OF_RULE = {"N-003": "check_decoction_requirement", "A-005": "check_decoction_requirement", "A-008": "check_duplicate_medication", "A-007": "check_restricted_item", "A-009": "check_combination", "A-003": "check_dose", "A-004": "check_dose", "N-007": "check_restricted_item", "N-009": "check_restricted_item"}
RULE_OF_WORD = {
    "特殊煎煮": "N-003", "煎煮": "N-003", "煎法": "N-003", "先煎": "N-003", "后下": "N-003", "包煎": "N-003", "烊化": "N-003", "冲服": "N-003",
    "用法": "A-005", "服法": "A-005", "用法用量": "A-005",
    "重复用药": "A-008", "重复": "A-008",
    "使用禁忌": "A-007", "禁忌": "A-007", "禁忌症": "A-007",
    "配伍禁忌": "A-009", "配伍": "A-009", "十八反": "A-009", "十九畏": "A-009", "联合用药": "A-009", "相互作用": "A-009",
    "剂量": "A-003", "单味药剂量": "A-003", "超量": "A-003", "用量": "A-003",
    "总剂量": "A-004", "药味数": "A-004",
    "特殊药品": "N-007", "毒性药品": "N-007", "有毒": "N-007",
    "新生儿": "N-009", "婴幼儿": "N-009", "儿童用药": "N-009",
}
RULE_CODE = r"(?U)\b([ANC]-\d{3})\b"
COHORTS = ("孕妇", "妊娠", "哺乳", "儿童", "小儿", "婴幼儿", "新生儿", "老年")
NAMED_TYPES, SHORTEST_NAME, MOST_NAMES = ("Herb", "Formula", "PatentMedicine"), 2, 6
#: Shapes of names (two letters at either end, length) that may go to every task.
MOST_SHAPES = 100_000
# -------------------------------------------------------------------------------------------------------------------


def clamp_letters(letters: Column, options: Column) -> Column:
    """Letters that name an option; all of them where there are no options (B17)."""
    keys = F.transform(F.map_keys(options), lambda k: F.upper(k))
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.filter(letters, lambda x: F.array_contains(keys, x))).otherwise(letters)


def declared_rule(category: Column) -> Column:
    """The rule that a category names: its code if a check exists for it, else the longest known word in it; null for none."""
    code = F.regexp_extract(F.upper(category), RULE_CODE, 1)
    words = sorted(RULE_OF_WORD, key=len, reverse=True)
    by_word = reduce(lambda rest, w: F.when(F.contains(category, F.lit(w)), RULE_OF_WORD[w]).otherwise(rest), reversed(words), F.lit(None).cast("string"))
    return F.when(code.isin(*CHECKS_OF_RULE), code).otherwise(by_word)


def patient_context(question: Column) -> Column:
    """The first of the cohorts that a question mentions; empty for none."""
    return F.coalesce(tx.first_marker(F.coalesce(question, F.lit("")), COHORTS), F.lit(""))


def claimed_preparation(letters: Column, options: Column) -> Column:
    """The first marker in the first chosen option that has one."""
    return F.get(F.array_compact(F.transform(letters, lambda x: tx.first_marker(F.try_element_at(options, x), tx.PREPARATION_MARKERS))), F.lit(0))


def _pieces(shapes: list[tuple[str, int, str]], headed: bool):
    """id, name: the different pieces of each text that begin, end and last as some name does; without heads and tails, that last so long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = SHORTEST_NAME
        ends: dict[str, dict[int, set[str]]] = {}
        for head, length, tail in shapes:
            ends.setdefault(head, {}).setdefault(length, set()).add(tail)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, places, found = batch.slice(at, 256), [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    seen = set()
                    for p in range(len(text or "") - n + 1):
                        for length, tails in ends.get(text[p : p + n] if headed else "", {}).items():
                            if p + length <= len(text) and (not headed or text[p + length - n : p + length] in tails):
                                seen.add(text[p : p + length])
                    places += [i] * len(seen)
                    found += seen
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(places, pa.int64())), pa.array(found, pa.string())], names=["id", "name"])

    return run


def name_pieces(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name: pieces of texts(id, text) that may be one of names(name); every name that a text holds is among them.

    Two letters at either end and the length tell most other pieces apart; where names come in more such shapes than may go to
    every task, lengths alone do.
    """
    shapes = names.select(F.substring("name", 1, SHORTEST_NAME).alias("h"), F.length("name").alias("n"), F.right("name", F.lit(SHORTEST_NAME)).alias("t")).distinct()
    headed = small_enough(shapes, MOST_SHAPES)
    listed = [tuple(r) for r in (shapes if headed else names.select(F.lit("").alias("h"), F.length("name").alias("n"), F.lit("").alias("t")).distinct()).collect()]
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(_pieces(listed, headed), f"id {kind}, name string")


def held_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name for every different name(name) that a text(id, text) holds; an id whose texts share a name may have it several times.

    Names up to a checked number and length are one automaton, which every text runs through once and which tells names within
    names too.  More of them are joined as they are with the pieces of texts that have a name's shape.
    """
    n = save(names.select("name").where(F.length("name") >= SHORTEST_NAME).distinct(), "names")
    kind = texts.schema["id"].dataType.simpleString()
    if small_enough(n, MOST_NEEDLES) and (n.agg(F.sum(F.length("name"))).first()[0] or 0) <= MOST_NEEDLE_CHARS:
        listed = sorted(r["name"] for r in n.collect())
        found = texts.select("id", "text").mapInArrow(holding(listed), f"passage_id {kind}, place long").distinct()
        named = texts.sparkSession.createDataFrame(list(enumerate(listed)), "place long, name string")
        return found.join(F.broadcast(named), "place").select(F.col("passage_id").alias("id"), "name")
    return name_pieces(texts, n).join(n, "name", "left_semi").select("id", "name")


def names_in_play(texts: DataFrame, names: DataFrame, types: tuple[str, ...] = NAMED_TYPES, most: int = MOST_NAMES) -> DataFrame:
    """id, names: up to so many names(name, type, ord) that the texts(id, text) of an id hold, by type, then as the graph lists them.

    A short name within a longer one counts as well; a name that several nodes bear counts once, as the first of them.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type"))
    first = names.where(F.col("type").isin(*types)).groupBy("name").agg(F.min(F.struct(rank.alias("t"), F.col("ord").alias("o"))).alias("p"))
    first = save(first, "typed-names")
    # one shuffle by id takes the different names and their order
    found = held_names(texts, first).join(first, "name").repartition("id").distinct()
    w = Window.partitionBy("id").orderBy("p", "name")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))


def node_names(nodes: DataFrame) -> DataFrame:
    """name, type, ord of nodes, herbs and formulas without notes on their preparation."""
    return nodes.select(F.when(F.col("type").isin("Herb", "Formula"), tx.herb_base(F.col("name"))).otherwise(F.col("name")).alias("name"), "type", "ord")


def safety_plans(answers: DataFrame, names: DataFrame) -> DataFrame:
    """case_id, tool, items, claimed, patient_context: the check of the answer's own category over the names in play.

    Without a category that names a rule, or without a known name, there is no plan; a combination takes two names or more.
    """
    a = answers.withColumn("tool", F.create_map(*[F.lit(x) for kv in CHECKS_OF_RULE.items() for x in kv])[declared_rule(F.trim("category"))]).where("tool is not null")
    a = save(a.withColumn("letters", clamp_letters(F.col("letters"), F.col("options"))), "answers")
    chosen = F.transform("letters", lambda x: F.try_element_at("options", x))
    texts = a.select(F.col("case_id").alias("id"), F.explode(F.array_compact(F.concat(chosen, F.array("question")))).alias("text"))
    found = names_in_play(texts, names).withColumnRenamed("id", "case_id").withColumnRenamed("names", "items")
    plans = a.join(found, "case_id").select("case_id", "tool", "items", F.when(F.col("tool") == "check_decoction_requirement", claimed_preparation(F.col("letters"), F.col("options"))).alias("claimed"), F.when(F.col("tool") == "check_restricted_item", patient_context(F.col("question"))).alias("patient_context"))
    return plans.where("tool <> 'check_combination' or size(items) >= 2")


def syndrome_plans(answers: DataFrame) -> DataFrame:
    """case_id, letter, syndrome, clinical_features for answers(case_id, letters, options, text): each chosen option against clauses of the case itself."""
    a = answers.withColumn("letter", F.explode(clamp_letters(F.col("letters"), F.col("options"))))
    option = F.trim(F.try_element_at("options", "letter"))
    return a.where(F.coalesce(option, F.lit("")) != "").select("case_id", "letter", tx.canonical_syndrome(option).alias("syndrome"), tx.case_clauses(F.col("text")).alias("clinical_features"))


def _verdicts(found: DataFrame, *said: Column) -> DataFrame:
    uncovered = F.when(F.col("coverage") == "not_covered", F.array(F.lit("not_covered"))).otherwise(F.array().cast("array<string>"))
    return found.select("call_id", "coverage", F.array_distinct(F.array_compact(F.concat(*said, uncovered))).alias("verdicts"))


def _if(condition: Column, verdict: str) -> Column:
    return F.array(F.when(condition, verdict))


def check_safety(tools, plans: DataFrame) -> DataFrame:
    """case_id, tool, coverage, verdicts of every plan, by the tools of a graph."""
    p = save(plans.withColumn("call_id", F.col("case_id")), "plans")
    of = lambda tool: p.where(F.col("tool") == tool)
    some = lambda f: F.size(f) > 0
    claims = F.transform("findings", lambda f: F.when(F.coalesce(f["verdict"], F.lit("")) != "", f["verdict"]).when(F.size(f["attested"]) > 0, "supported"))
    run = {
        "check_dose": lambda c: _verdicts(tools.check_dose(c), F.array().cast("array<string>")),
        "check_combination": lambda c: _verdicts(tools.check_combination(c), F.array().cast("array<string>")),
        "check_duplicate_medication": lambda c: _verdicts(tools.check_duplicate_medication(c), _if(some("alias_duplicates") | some("formula_overlap"), "contradicted")),
        "check_restricted_item": lambda c: _verdicts(tools.check_restricted_item(c), _if(some("restrictions"), "supported")),
        "check_decoction_requirement": lambda c: _verdicts(tools.check_decoction_requirement(c), claims),
    }
    asked = {r.tool for r in p.select("tool").distinct().collect()}  # five at most
    parts = [run[t](of(t)).withColumn("tool", F.lit(t)) for t in run if t in asked]
    empty = p.select("call_id", F.lit("").alias("coverage"), F.array().cast("array<string>").alias("verdicts"), "tool").where("false")
    return reduce(DataFrame.unionByName, parts, empty).withColumnRenamed("call_id", "case_id")


def check_syndromes(tools, plans: DataFrame) -> DataFrame:
    """case_id, letter, coverage, verdicts of every chosen syndrome."""
    calls = save(plans.withColumn("call_id", F.concat_ws("\x1f", F.col("case_id").cast("string"), "letter")).withColumn("disease", F.lit(None).cast("string")).withColumn("treatment_principle", F.lit(None).cast("string")), "plans")
    found = _verdicts(tools.verify_tcm_decision(calls), F.array("overall"))
    return found.join(calls.select("call_id", "case_id", "letter"), "call_id").drop("call_id")


def reports(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """case_id, n_checks, verdict: the worst verdict of a case's checks; not_applicable where none was to run."""
    folded = checks.groupBy("case_id").agg(F.count("*").alias("n_checks"), worst_verdict(F.flatten(F.collect_list("verdicts"))).alias("verdict"))
    return cases.select("case_id").distinct().join(folded, "case_id", "left").select("case_id", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("verdict", F.lit("not_applicable")).alias("verdict"))
