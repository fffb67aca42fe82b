"""Datasets whose field names vary: aliases are bound by what the first records hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.evaluation import unique_ids

# ---- fixed values -------------------------------------------------------------------------------------------------
PROBED = 25
SDT = {
    "id": ("Medical Record ID", "medical_record_id", "id", "case_id", "编号", "病案号"),
    "clinical_data": ("Clinical Data", "clinical_data", "临床资料", "病例", "医案"),
    "clinical_information": ("Clinical Information", "clinical_information", "信息抽取能力：核心临床信息", "临床信息"),
    "pathogenesis_answer": ("Answers of TCM Pathogenesis", "answers_of_tcm_pathogenesis", "病机答案"),
    "pathogenesis_options": ("Options of TCM Pathogenesis", "options_of_tcm_pathogenesis", "病机选项"),
    "pathogenesis_text": ("TCM Pathogenesis", "tcm_pathogenesis", "信息抽取能力：核心病机", "病机"),
    "pathogenesis_reasoning": ("TCM Pathogenesis reasoning", "推理能力：病机推断"),
    "syndrome_answer": ("Answers of TCM Syndrome", "answers_of_tcm_syndrome", "证候答案"),
    "syndrome_options": ("Options of TCM Syndrome", "options_of_tcm_syndrome", "证候选项"),
    "syndrome_text": ("TCM Syndrome", "tcm_syndrome", "信息抽取能力：核心证候", "证候"),
    "syndrome_reasoning": ("TCM Syndrome reasoning", "推理能力：证候推断"),
    "explanatory_summary": ("Explanatory Summary", "explanatory_summary", "临证体会"),
    "syndrome_differentiation": ("Syndrome Differentiation", "syndrome_differentiation", "辨证"),
}
PA = {
    "id": ("ID", "id", "question_id", "题号"),
    "question": ("Question", "question", "题干", "问题"),
    "options": ("Candidate Answers", "options", "choices", "选项"),
    "answer": ("Answer", "answer", "正确答案", "标准答案", "答案"),
    "explanation": ("Explanation", "explanation", "解析", "答案解析"),
    "category": ("Category", "category", "类别"),
    "rule_id": ("Rule_ID", "rule_id", "rule", "规则编号"),
    "rule_summary": ("Rule_summary", "rule_summary", "规则"),
}
TCMSD = {
    "id": ("user_id", "id"),
    "disease_code": ("lcd_id",),
    "disease": ("lcd_name",),
    "syndrome_raw": ("syndrome",),
    "syndrome": ("norm_syndrome", "syndrome"),
    "chief_complaint": ("chief_complaint",),
    "description": ("description",),
    "detection": ("detection",),
}
WRAPPERS = ("data", "items", "records", "questions", "cases")
# -------------------------------------------------------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bind(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """logical field -> source columns, best first: those with most non-blank values among the first records, then in the aliases' order.

    A column that exists but is blank binds if no other does.
    """
    have = {c.lower(): c for c in df.columns}
    known = {logical: list(dict.fromkeys(have[a.lower()] for a in names if a.lower() in have)) for logical, names in aliases.items()}
    asked = sorted({c for cs in known.values() for c in cs})
    if not asked:
        return {}
    probe = df.limit(PROBED).agg(*[F.count_if(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))) != "").alias(str(i)) for i, c in enumerate(asked)]).first()
    filled = {c: probe[i] for i, c in enumerate(asked)}
    out = {}
    for logical, columns in known.items():
        used = sorted((c for c in columns if filled[c]), key=lambda c: (-filled[c], columns.index(c)))
        if used or columns:
            out[logical] = used or columns[:1]
    return out


#: The place of a record among those of all files, in the order of paths and lines.
PLACE = "gl_place"


def in_file_order(df: DataFrame) -> DataFrame:
    """df, as read from files, with PLACE.  Only the file splits' row counts are summed up in one place."""
    part = df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("gl_split"), F.monotonically_increasing_id().alias("gl_n"))
    splits = part.groupBy("gl_split").agg(F.min("gl_n").alias("gl_first"), F.count("*").alias("gl_rows"))
    before = F.coalesce(F.sum("gl_rows").over(Window.orderBy("gl_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.join(splits.select("gl_split", "gl_first", before.alias("gl_before")), "gl_split").withColumn(PLACE, F.col("gl_before") + F.col("gl_n") - F.col("gl_first")).drop("gl_split", "gl_n", "gl_first", "gl_rows", "gl_before")


def project(df: DataFrame, sources: Mapping[str, Sequence[str]], prefix: str, order: Column | None = None) -> DataFrame:
    """The bound fields, each the first non-empty of its columns, with ``ord``; rows without an id get prefix_0000 by place."""
    if order is None:
        order = F.col(PLACE) if PLACE in df.columns else F.monotonically_increasing_id()
    numbered = df.withColumn("gl_ord", order)
    first = lambda cs: F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cs])
    cols = [first(cs).alias(logical) for logical, cs in sources.items() if logical != "id"]
    own = F.nullif(F.btrim(F.regexp_replace(first(sources["id"]), "^\ufeff+", "")), F.lit("")) if "id" in sources else F.lit(None).cast("string")
    return numbered.select(F.coalesce(own, F.format_string(f"{prefix}_%04d", F.col("gl_ord"))).alias("id"), *cols, F.col("gl_ord").alias("ord"))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, an array, an object that wraps an array under a usual name, or an object of objects by id; with PLACE."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(2).collect()
    first = head[0].value.lstrip("\ufeff").lstrip() if head else ""
    if path.endswith(".jsonl") or first[:1] not in ("[", "{") or (len(head) > 1 and _is_json(first)):
        return in_file_order(spark.read.json(path))
    df = spark.read.option("multiLine", True).json(path)
    types = dict(df.dtypes)
    for w in WRAPPERS:
        if types.get(w, "").startswith("array<struct"):
            return df.select(F.posexplode(w).alias(PLACE, "r")).select("r.*", F.col(PLACE).cast("long").alias(PLACE))
    if first[:1] == "{" and types and all(t.startswith("struct") for t in types.values()):
        rows = None
        for i, name in enumerate(df.columns):
            part = df.select(F.lit(name).alias("id"), _c(name).alias("r"), F.lit(i).cast("long").alias(PLACE)).select("id", "r.*", PLACE)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows
    return in_file_order(df)


def _is_json(line: str) -> bool:
    import json

    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """id, clinical_information, pathogenesis_answer, syndrome_answer, explanation of lines id@t1@t2@t3@t4; the first line of an id counts."""
    lines = in_file_order(spark.read.text(path)).withColumnRenamed(PLACE, "ord")
    p = F.split(F.trim(F.regexp_replace("value", "^﻿", "")), "@")
    rows = lines.select(p.alias("p"), "ord").where(F.size("p") >= 5)
    at = lambda i: F.trim(F.get("p", F.lit(i)))
    rows = rows.select(at(0).alias("id"), F.struct(at(1).alias("clinical_information"), at(2).alias("pathogenesis_answer"), at(3).alias("syndrome_answer"), F.trim(F.array_join(F.slice("p", 5, 1 << 20), "@")).alias("explanation")).alias("r"), "ord")
    return rows.groupBy("id").agg(F.min_by("r", "ord").alias("r")).select("id", "r.*")


def _fill(mine: str, gold: str) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(mine)), F.lit("")), F.col(gold))


def load_sdt(spark: SparkSession, path: str, answers: str | None = None) -> DataFrame:
    """Cases with options, letters and lists; the answer file fills blank fields only."""
    raw = read_json_records(spark, path)
    items = project(raw, bind(raw, SDT), "sdt")
    for c in SDT:
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    if answers:
        gold = read_answers(spark, answers).select("id", *[F.col(c).alias(f"gold_{c}") for c in ("clinical_information", "pathogenesis_answer", "syndrome_answer", "explanation")])
        items = items.join(gold, "id", "left")
        for c, g in (("clinical_information", "clinical_information"), ("pathogenesis_answer", "pathogenesis_answer"), ("syndrome_answer", "syndrome_answer"), ("explanatory_summary", "explanation")):
            items = items.withColumn(c, _fill(c, f"gold_{g}"))
        items = items.drop(*[c for c in items.columns if c.startswith("gold_")])
    parsed = items.select("id", "ord", "clinical_data", *[c for c in SDT if c.endswith(("_text", "_reasoning"))], tx.split_semicolon(F.col("clinical_information")).alias("clinical_information_list"), tx.parse_options(F.col("pathogenesis_options")).alias("pathogenesis_options"), tx.parse_options(F.col("syndrome_options")).alias("syndrome_options"), tx.parse_letters(F.col("pathogenesis_answer")).alias("pathogenesis_letters"), tx.parse_letters(F.col("syndrome_answer")).alias("syndrome_letters"), F.concat_ws("\n", F.nullif("explanatory_summary", F.lit("")), F.nullif("syndrome_differentiation", F.lit(""))).alias("explanation_reference"))
    has = (F.size("pathogenesis_letters") > 0) | (F.size("syndrome_letters") > 0) | (F.size("clinical_information_list") > 0)
    return unique_ids(parsed.withColumn("has_gold", has), "id", "ord")


def load_pa(spark: SparkSession, path: str) -> DataFrame:
    from .xlsx import read_sheet

    raw = read_sheet(spark, path) if path.endswith(".xlsx") else read_json_records(spark, path)
    items = project(raw, bind(raw, PA), "pa")
    for c in PA:
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    letters = tx.parse_letters(F.col("answer"))
    return unique_ids(items.select("id", "ord", "question", tx.parse_options(F.col("options")).alias("options"), letters.alias("letters"), (F.size(letters) > 1).alias("is_multi"), "explanation", "category", F.upper("rule_id").alias("rule_id"), "rule_summary"), "id", "ord")


def load_tcmsd(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    raw = read_json_records(spark, path)
    items = project(raw, bind(raw, TCMSD), "tcmsd")
    if vocabulary is not None:  # the label's place in the vocabulary, null if it isn't there
        known = vocabulary.select(F.trim("label").alias("syndrome_"), F.col("label_id").alias("syndrome_id")).dropDuplicates(["syndrome_"])
        items = items.join(known, F.trim("syndrome") == F.col("syndrome_"), "left").drop("syndrome_")
    text = F.concat_ws("\n", *[F.nullif(F.trim(c), F.lit("")) for c in ("chief_complaint", "description", "detection") if c in items.columns])
    return unique_ids(items.withColumn("text", text), "id", "ord")


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """One record per Name, the last of the file."""
    raw = in_file_order(spark.read.json(path)).withColumnRenamed(PLACE, "ord_")
    cols = [c for c in raw.columns if c not in ("Name", "ord_")]
    return raw.groupBy("Name").agg(F.max_by(F.struct(*[_c(c) for c in cols]), "ord_").alias("r")).select("Name", "r.*")


def load_cp(spark: SparkSession, path: str) -> DataFrame:
    raw = read_json_records(spark, path).withColumnRenamed(PLACE, "ord")
    own = F.nullif(F.trim(F.col("id").cast("string")), F.lit("")) if "id" in raw.columns else F.lit(None).cast("string")
    return unique_ids(raw.withColumn("id", F.coalesce(own, F.format_string("cp_%05d", F.col("ord")))), "id", "ord")


LOADERS = {"sdt": load_sdt, "pa": load_pa, "tcmsd": load_tcmsd, "cp": load_cp}


def load(spark: SparkSession, path: str, kind: str, **kwargs) -> DataFrame:
    if kind not in LOADERS:
        raise ValueError(f"unknown dataset kind {kind!r}; known: {sorted(LOADERS)}")
    return LOADERS[kind](spark, path, **kwargs)


def subset(df: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    out = df if ids is None else df.join(ids.select("id"), "id", "left_semi")
    return out if limit is None else out.orderBy("ord").limit(limit)


def inspect(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias(label)).agg(F.count("*").alias("n"))


def mapping_report(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> list[tuple[str, str, list[str]]]:
    """(state, logical field, source columns): bound fields with what they are read from, missing ones, and the columns that nothing reads ("unmapped", column)."""
    bound = bind(df, aliases)
    out = [("bound" if f in bound else "missing", f, bound.get(f, [])) for f in aliases]
    used = {c for cs in bound.values() for c in cs}
    return out + [("unmapped", c, []) for c in df.columns if c not in used and c != PLACE]
