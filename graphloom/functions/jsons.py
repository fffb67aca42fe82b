"""Tolerant JSON: the first of several readings that gives an object, and which one it was."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
FENCE = r"```(?:json|JSON)?\s*(.*?)```"
FULL_WIDTH_FROM, FULL_WIDTH_TO = "｛｝［］：，", "{}[]:,"
TRAILING_COMMA = r",\s*([}\]])"

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)
_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)', re.S)


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _spans(text: str) -> list[str]:
    """Outermost brace pairs outside of string literals, longest first (earliest among equals)."""
    depth, start, out = 0, 0, []
    for m in _TOKEN.finditer(text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : m.end()])
    return sorted(out, key=len, reverse=True)


def _mended(text: str) -> str:
    text = re.sub(TRAILING_COMMA, r"\1", text.translate(str.maketrans(FULL_WIDTH_FROM, FULL_WIDTH_TO)))
    return _LITERAL.sub(lambda m: re.sub(r"[\n\r]", r"\\n", m[0]), text)


def read_object(text: str | None) -> tuple[dict | None, str]:
    t = (text or "").strip()
    if not t:
        return None, "empty"
    spans = _spans(t)
    readings = [("direct", [t]), ("fenced", [b.strip() for b in re.findall(FENCE, t, re.S)]), ("balanced_span", spans), ("repaired", map(_mended, spans)), ("repaired_whole", [_mended(t)])]
    for rung, candidates in readings:
        for c in candidates:
            if (value := _object(c)) is not None:
                return value, rung
    return None, "failed"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("strategy", T.StringType())]))
def _read(s: pd.Series) -> pd.DataFrame:
    found = [read_object(t) for t in s]
    return pd.DataFrame({"json": [None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v, _ in found], "strategy": [r for _, r in found]})


def extract_object(text: Column) -> Column:
    """struct(json, strategy): the object in text that may be fenced, wrapped in prose or slightly broken; json null if there is none.

    What Spark parses by itself never goes to Python.
    """
    plain = F.trim(text)
    direct = F.try_parse_json(plain)
    is_object = F.coalesce(F.schema_of_variant(direct).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.struct(F.to_json(direct).alias("json"), F.lit("direct").alias("strategy"))).otherwise(_read(text))


def leaf_strings(json_text: Column) -> Column:
    """Every string at any depth, in order of keys and places."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def leaves(s: pd.Series) -> pd.Series:
        def walk(v):
            if isinstance(v, str):
                yield v
            elif isinstance(v, dict):
                for k in sorted(v):
                    yield from walk(v[k])
            elif isinstance(v, list):
                for x in v:
                    yield from walk(x)

        def of(t):
            try:
                return list(walk(json.loads(t))) if t else []
            except ValueError:
                return []

        return s.map(of)

    return leaves(json_text)


def leaves(df: DataFrame, json_col: str, ids: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """ids, key, path, text: every string in a JSON document, however deep, with the top-level key that it stands under.

    Documents are variants that are opened a level a round until nothing is left to open; what is left is written in between, so
    a round holds one level.  `path` orders the leaves: top-level keys as the document has them, elements of arrays as they
    come, keys of inner objects by name.  Keys in skip are left out; a document that isn't an object or doesn't parse has none.
    """
    from ..session import save

    spark = df.sparkSession
    keys = F.json_object_keys(F.when(F.try_parse_json(json_col).isNotNull(), F.col(json_col)))
    top = df.select(*ids, F.try_parse_json(json_col).alias("v_"), keys.alias("k_")).where("k_ is not null")
    opened = top.lateralJoin(spark.tvf.variant_explode(F.col("v_").outer()))
    level = opened.where(~F.col("key").isin(*skip)) if skip else opened
    level = level.select(*ids, "key", F.array(F.array_position("k_", F.col("key")).cast("long")).alias("path"), F.col("value").alias("v_"))
    found = None
    while True:
        level = save(level.withColumn("kind_", F.substring(F.schema_of_variant("v_"), 1, 5)).where("kind_ in ('STRIN', 'OBJEC', 'ARRAY')").withColumn("v_", F.to_json("v_")), "json-level")
        here = level.where("kind_ = 'STRIN'").select(*ids, "key", "path", F.try_variant_get(F.parse_json("v_"), "$", "string").alias("text"))
        found = here if found is None else found.unionByName(here)
        inner = level.where("kind_ <> 'STRIN'")
        if inner.isEmpty():
            return found
        rest = inner.select(*ids, F.col("key").alias("key_"), "path", F.parse_json("v_").alias("v_")).lateralJoin(spark.tvf.variant_explode(F.col("v_").outer()))
        level = rest.select(*ids, F.col("key_").alias("key"), F.concat("path", F.array(F.col("pos").cast("long"))).alias("path"), F.col("value").alias("v_"))
