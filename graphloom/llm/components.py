"""Connected components of an edge table: few edges in one task, more by alternating star contraction, every round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Workspace, small_enough

#: Edges that one task takes, at some 300 bytes each.
ONE_TASK = 300_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up, kind = {}, None

    def root(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, work: Workspace, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round joins the edges with the least neighbour of each node; both sides are plain tables, so a node with
    very many neighbours is split by the skew join.  Self-links and repeated edges are harmless.  Up to one_task edges
    go to a single task instead of the rounds.
    """
    now = work.save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if small_enough(now, one_task):
        kind = now.schema["a"].dataType
        roots = work.save(now.repartition(1).mapInArrow(_joined, StructType([StructField("node", kind), StructField("root", kind)])), "roots")
        work.drop(now)
        return roots
    seen = _fingerprint(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.save(large, "large")
        least2 = work.save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least2, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least2.select("a", F.col("m").alias("b"))).distinct()
        before, now = (now, large, least, least2), work.save(small, "edges")
        work.drop(*before)
        if (print_ := _fingerprint(now)) == seen:
            break
        seen = print_
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
