"""What a run was: signatures of apparatus and design, manifests that may not change, and a gate that refuses to score anything else."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
IMMUTABLE = ("task", "domain", "framework_hash", "design_signature", "kg_content_sha256", "dataset_sha256", "dataset_results_sha256", "case_set_sha256")
INPUTS = ("kg_content_sha256", "dataset_sha256", "dataset_results_sha256")
SCORING = "scorers_impl"
# -------------------------------------------------------------------------------------------------------------------


class ScoreRefused(RuntimeError):
    """Traces that aren't the run that their manifest describes."""

    def __init__(self, reasons: list[tuple[str, str]]):
        super().__init__("; ".join(f"{name}: {detail}" for name, detail in reasons))
        self.reasons = reasons


def _short(payload: Mapping) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:16]


def run_signature(framework_hash: str, kg_hash: str, dataset_hash: str, model_fingerprint: str, case_set: str = "", code: Mapping[str, str] | None = None) -> str:
    """The apparatus behind a trace.  Conditions are not in it: they are what is compared."""
    return _short({"framework": framework_hash, "kg": kg_hash, "dataset": dataset_hash, "model": model_fingerprint, "case_set": case_set, "code": dict(code or {})})


def design_signature(run: str, conditions: Sequence[str], samples: int, limit: int | None = None, stratify: str | None = None) -> str:
    """The experiment on top of an apparatus: its conditions in any order, samples and way of sampling."""
    return _short({"apparatus": run, "conditions": sorted(map(str, conditions)), "samples": int(samples), "limit": limit, "stratify": stratify or ""})


def request_key(model: str, messages: Sequence[Mapping], decode: Mapping, sample: int = 0) -> str:
    """The identity of a request to a model, by which a log is replayed."""
    return hashlib.sha256(json.dumps({"model": model, "messages": list(messages), "decode": dict(decode), "sample": sample}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def ordered_hash(ids: Sequence[str]) -> str:
    """sha256 over ids in their order, a zero byte behind each."""
    return hashlib.sha256("".join(f"{i}\0" for i in ids).encode()).hexdigest()


def case_set_hash(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row, case_set_hash and n_cases: ordered_hash() of a table.  The hash runs over the ids one after another, so one task reads them, sorted, and holds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for i in batch.column(0).to_pylist():
                digest.update(f"{i}\0".encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=["case_set_hash", "n_cases"])

    ids = df.select(F.col(id_col).cast("string").alias("i"), F.col(order_col).alias("o"))
    one = ids.repartition(1).sortWithinPartitions("o", "i").select("i").mapInArrow(run, "case_set_hash string, n_cases long")
    return one.agg(F.coalesce(F.max("case_set_hash"), F.lit(ordered_hash([]))).alias("case_set_hash"), F.coalesce(F.max("n_cases"), F.lit(0)).alias("n_cases"))


def changed(frozen: Mapping, current: Mapping, keys: Sequence[str] | None = None) -> list[str]:
    """Keys that both sides have with different values; without keys, all that end in _sha256."""
    asked = [k for k in frozen if k.endswith("_sha256")] if keys is None else keys
    return [k for k in asked if frozen.get(k) and current.get(k) and frozen[k] != current[k]]


def manifest_conflicts(frozen: Mapping, current: Mapping) -> list[str]:
    """What a run again would change of a manifest that may not change: not empty means another experiment."""
    return changed(frozen, current, IMMUTABLE)


def score_gate(manifest: Mapping | None, current: Mapping, traces: DataFrame, audit: Mapping | None = None, allow_drift: bool = False) -> list[tuple[str, str]]:
    """Raises ScoreRefused unless the traces are what the manifest describes; with allow_drift the reasons are returned and belong in the scores' record.

    manifest: IMMUTABLE keys, *_impl_sha256, case_ids, models, conditions, samples, run_signatures and design_signatures by model.
    current: the same hashes as of now.  audit: the identity of a contamination audit, if there is one.
    traces(model_key, condition, sample, framework_hash, run_signature, design_signature): only sets of these come to the driver, a row a model.
    Changed scoring code alone is a note, as scoring again is what traces are kept for.
    """
    notes: list[tuple[str, str]] = []
    refused = notes.append
    frozen = manifest or {}
    drift = [k for k in changed(frozen, current) if k not in (*IMMUTABLE, *INPUTS)]
    soft = [k for k in drift if k.startswith(SCORING)]
    if manifest is None:
        refused(("no_manifest", "nothing says what produced these traces"))
    if len(drift) > len(soft):
        refused(("code_changed", ", ".join(drift)))
    for key in changed(frozen, current, INPUTS):
        refused(("input_changed", key))
    if frozen.get("case_ids") and ordered_hash(list(map(str, frozen["case_ids"]))) != frozen.get("case_set_sha256"):
        refused(("manifest_contradicts_itself", "case_ids don't give case_set_sha256"))
    if audit and (stale := changed(audit, {**current, "case_set_sha256": frozen.get("case_set_sha256")}, (*INPUTS, "case_set_sha256"))):
        refused(("stale_audit", ", ".join(stale)))
    sets = [F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("framework_hash", "run_signature", "design_signature", "condition")]
    for r in traces.groupBy("model_key").agg(*sets, F.max("sample").alias("last")).orderBy("model_key").collect():
        signed, design = frozen.get("run_signatures", {}).get(r.model_key), frozen.get("design_signatures", {}).get(r.model_key)
        found = [
            ("mixed_frameworks", len(r.framework_hash) > 1, r.framework_hash),
            ("mixed_run_signatures", len(r.run_signature) > 1, r.run_signature),
            ("other_run", bool(signed) and any(s and s != signed for s in r.run_signature), r.run_signature),
            ("undeclared_model", manifest is not None and "models" in frozen and r.model_key not in frozen["models"], [r.model_key]),
            ("mixed_designs", bool(design) and any(s and s != design for s in r.design_signature), r.design_signature),
            ("undeclared_conditions", bool(frozen.get("conditions")) and not set(r.condition) <= set(frozen["conditions"]), r.condition),
            ("undeclared_samples", bool(frozen.get("samples")) and r["last"] is not None and r["last"] >= int(frozen["samples"]), [str(r["last"])]),
        ]
        notes += [(name, f"{r.model_key}: {', '.join(sorted(map(str, detail)))}") for name, bad, detail in found if bad]
    if notes and not allow_drift:
        raise ScoreRefused(notes)
    return notes + [("scoring_code_changed", ", ".join(soft))] * bool(soft and len(soft) == len(drift))
