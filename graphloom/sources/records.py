"""Traces, scores, submissions, generation logs and configurations."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
CONDITIONS = ("M0", "M1", "M2", "M3", "M4", "M2C", "M3C")
TRACE = """run_id string, case_id string, dataset string, condition string, model_key string, framework_hash string, run_signature string,
design_signature string, sample int, started_at string, branch_group string, verification_stratum string, parity_error string, wall_ms double, static_context_chars long,
llm_steps array<struct<index:int,phase:string,prompt_chars:long,completion:struct<text:string,model:string,usage:struct<prompt_tokens:long,completion_tokens:long>,latency_ms:double,finish_reason:string,n_retries:int,from_cache:boolean>,parse_strategy:string,action:string>>,
tool_steps array<struct<index:int,tool:string,arguments:map<string,string>,coverage:string,ok:boolean,latency_ms:double,n_results:int,error:string,result_chars:long,phase:string>>,
final map<string,string>, final_raw string, parse_strategy string, error string, metrics map<string,double>, corrupt_line string"""


def write_traces(traces: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit protocol makes the folder appear whole or not at all."""
    traces.write.mode("overwrite").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows.  A broken last line of the input is dropped, a broken line elsewhere is an error."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("ord", F.monotonically_increasing_id())
    parsed = F.from_json("value", TRACE, {"columnNameOfCorruptRecord": "corrupt_line"})
    rows = lines.select(F.col("_metadata.file_path").alias("file_"), "ord", parsed.alias("t")).select("file_", "ord", "t.*")
    broken = rows.where("corrupt_line is not null").select("file_", "ord")
    last = rows.groupBy("file_").agg(F.max("ord").alias("last"))
    wrong = broken.join(last, "file_").where("ord < last").take(1)
    if wrong:
        raise ValueError(f"a broken line within {wrong[0].file_}")
    return rows.where("corrupt_line is null").drop("corrupt_line", "file_")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


SCORE = "case_id string, dataset string, condition string, model_key string, sample int, metrics map<string,double>, trace_metrics map<string,string>"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scored items as the report tables take them: model, ord (place in the files), one column for parity, group and stratum, and the maps; broken lines are an error."""
    lines = spark.read.schema(SCORE).option("mode", "FAILFAST").json(path)
    part = lambda k: F.try_element_at("trace_metrics", F.lit(k)).alias(k)
    return lines.select("case_id", "dataset", "condition", F.col("model_key").alias("model"), "sample", "metrics", "trace_metrics", part("parity_error"), part("branch_group"), part("verification_stratum"), F.monotonically_increasing_id().alias("ord"))


def with_metrics(scores: DataFrame, names: list[str]) -> DataFrame:
    """scores with a column for each metric."""
    return scores.select("*", *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names])


def submission_lines(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """value: id@t1@t2@t3@t4 for every case in order, blank parts where there is no prediction."""
    joined = cases.select("id", "ord").join(predictions, "id", "left")
    part = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    prose = F.translate(F.coalesce("explanation", F.lit("")), "@\n", "  ")
    return joined.select("ord", F.concat_ws("@", F.col("id").cast("string"), part("clinical_information"), part("pathogenesis_answer"), part("syndrome_answer"), prose).alias("value")).orderBy("ord").select("value")


def write_submission(cases: DataFrame, predictions: DataFrame, path: str) -> None:
    submission_lines(cases, predictions).write.mode("overwrite").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """key, completion (JSON), meta (JSON), ord of an append-only log of JSON lines; broken lines are skipped."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    r = F.from_json("value", "key string, completion string, meta string")
    return lines.select(r.alias("r"), "ord").where("r.key is not null").select("r.*", "ord")


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


@dataclass
class Experiment:
    name: str = ""
    dataset: dict = field(default_factory=dict)
    task: str = ""
    domain: str = "clinical_reasoning"
    models: list = field(default_factory=list)
    conditions: list = field(default_factory=lambda: list(CONDITIONS[:5]))
    samples: int = 1
    decode: dict = field(default_factory=dict)
    retrieval: dict = field(default_factory=dict)
    tool_budget: dict = field(default_factory=dict)
    context_budget: int = 6000
    max_agent_turns: int = 16
    output_dir: str = "runs"
    concurrency: int = 4


def experiment(values: dict) -> Experiment:
    """From a parsed configuration: unknown keys are ignored, unknown conditions are an error."""
    known = {f.name for f in fields(Experiment)}
    out = Experiment(**{k: v for k, v in values.items() if k in known})
    if unknown := [c for c in out.conditions if c not in CONDITIONS]:
        raise ValueError(f"unknown conditions: {unknown}")
    return out


def read_experiment(path: str) -> Experiment:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; pass the parsed mapping to experiment()") from e
    with open(path, encoding="utf-8") as f:
        return experiment(yaml.safe_load(f) or {})
