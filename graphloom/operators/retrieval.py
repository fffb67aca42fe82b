"""Lexical, graph and provenance retrieval as joins over a postings table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import save, small_enough

# fixed values
K1, B = 1.2, 0.75
WEIGHTS = {"semantic": 0.60, "graph": 0.25, "source": 0.15}
POOL = 300


def virtual_documents(parts: DataFrame) -> DataFrame:
    """id, text from parts(id, ord, piece): stripped pieces in order, each once, joined by blanks."""
    some = parts.select("id", "ord", F.trim("piece").alias("piece")).where("piece <> ''")
    first = some.groupBy("id", "piece").agg(F.min("ord").alias("ord"))
    return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), " ").alias("text"))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


#: Query terms that may go to every task, at some 50 bytes each, and scores held at once.
MOST_ASKED, SCORES = 300_000, 2_000_000


#: Changes whenever lists are made otherwise.
INDEX_VERSION = "1"


def fingerprint(settings: dict) -> str:
    """16 hexadecimal digits for a set of named settings, whatever their order."""
    return hashlib.sha256("|".join(f"{k}={settings[k]}" for k in sorted(settings)).encode()).hexdigest()[:16]


def index_key(docs: DataFrame, settings: dict, id_col: str = "id", text_col: str = "text", part: Column | None = None, content: str | None = None) -> str:
    from .graph import content_hash

    if content is not None:
        return hashlib.sha256("|".join([INDEX_VERSION, content, fingerprint(settings)]).encode()).hexdigest()[:20]
    own = docs.select((F.lit("all") if part is None else part.cast("string")).alias("part"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return index_key(docs, settings, content=str(content_hash(own, ["part", "id", "text"]).first()[0]))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where a few small files would leave cores idle; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Bm25Index:
    """Term lists (part, id, terms) with statistics for each part, say a domain: N, average length and document frequencies differ by part.

    The first search makes the lists and keeps what it is asked for; the second writes them, and it and later ones read them.
    save_to() writes them where they are to stay, load() reads such an index, and cached() does either by the content of the documents.
    """

    def __init__(self, docs: DataFrame, terms, id_col: str = "id", text_col: str = "text", part: Column | None = None):
        part = F.lit("all") if part is None else part
        own = spread(docs.select(part.cast("string").alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        self._keep(own.select("part", "id", terms(F.col("text")).alias("terms")).where("size(terms) > 0").select("part", "id", F.size("terms").cast("long").alias("dl"), "terms"), False)

    def _keep(self, listed: DataFrame, written: bool) -> None:
        self._listed, self._written, self._searched = listed, written, False

    @property
    def listed(self) -> DataFrame:
        if not self._written:
            self._keep(save(self._listed, "term-lists"), True)
        return self._listed

    @property
    def stats(self) -> DataFrame:
        """part, n_docs, avg_dl; reads lengths only."""
        return _statistics(self.listed)

    def save_to(self, path: str) -> Bm25Index:
        """Writes the index; what is read back serves later searches."""
        self._listed.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.load(self._listed.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        self = cls.__new__(cls)
        self._keep(spark.read.parquet(path), True)
        return self

    @classmethod
    def cached(cls, docs: DataFrame, terms, root: str, settings: dict, id_col: str = "id", text_col: str = "text", part: Column | None = None, content: str | None = None) -> Bm25Index:
        """The index under root for these documents and settings, made where there is none yet.

        Its key has the version of the lists, a hash of the documents' content and one of the settings (which have to name the
        terms), so a changed document or setting gives another index and never meets an old one.  With the content's hash at hand
        (say, the graph's) the documents aren't read at all where the index is there.
        """
        spark, key = docs.sparkSession, index_key(docs, settings, id_col, text_col, part, content)
        path = f"{root.rstrip('/')}/bm25-{key}"
        try:
            return cls.load(spark, path)
        except AnalysisException:  # none yet, or one whose writing never ended
            return cls(docs, terms, id_col, text_col, part).save_to(path)

    def search(self, queries: DataFrame, terms, query_id: str = "query_id", text_col: str = "text", part_col: str | None = None, limit: int = POOL) -> DataFrame:
        """query_id, id, score, rank: the best by summed term weights, a term's repeats in the query damped by ln(1 + n).

        Only the query's terms of the documents take part.  Queries up to a checked number of terms go to every task, where
        scores are sums over arrays and a task keeps the best of each query; more meet the postings in joins.
        """
        part = F.lit("all") if part_col is None else F.col(part_col).cast("string")
        asked = queries.select(part.alias("part"), F.col(query_id).alias("query_id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("part", "query_id", "term").agg(F.count("*").alias("qf"))
        asked = save(asked, "asked")
        scored = self._scored_in_tasks(asked, limit) if small_enough(asked, MOST_ASKED) else self._scored_by_joins(asked)
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)

    def _scored_in_tasks(self, asked: DataFrame, limit: int) -> DataFrame:
        rows = sorted((r.part or "", r.term, r.query_id, r.qf) for r in asked.collect())
        terms, queries = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
        lists = self.listed if self._searched else self._listed
        self._searched = True
        id_kind, query_kind = lists.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
        # lengths and term frequencies of what is asked for, a row a document
        used = save(lists.where(F.coalesce("part", F.lit("")).isin(sorted({r[0] for r in rows}))).mapInArrow(_frequencies(terms), f"part string, id {id_kind}, dl long, ix array<int>, tf array<int>"), "frequencies")
        df = {(r.part or "", r.ix): r.df for r in used.select("part", F.explode("ix").alias("ix")).groupBy("part", "ix").agg(F.count("*").alias("df")).collect()}
        stats = {r.part or "": (r.n_docs, r.avg_dl) for r in _statistics(used).collect()} if rows else {}
        at, place = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(queries)}
        by_part: dict[str, list] = {}
        for p, term, query, qf in rows:
            if (p, at[term]) in df:
                n, k = stats[p][0], df[p, at[term]]
                by_part.setdefault(p, []).append((at[term], place[query], np.log(1 + (n - k + 0.5) / (k + 0.5)) * np.log(1 + qf)))
        weights = {p: (stats[p][1], *(np.array(c) for c in zip(*w, strict=True))) for p, w in by_part.items()}
        found = used.where("size(ix) > 0").mapInArrow(_scores(weights, len(terms), len(queries), limit), f"q long, id {id_kind}, score double")
        names = asked.select("query_id").distinct().withColumn("q", F.array_position(F.lit(queries), F.col("query_id")).cast("long") - 1) if 0 < len(queries) <= 1000 else asked.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries)], f"q long, query_id {query_kind}")
        return found.join(F.broadcast(names), "q").select("query_id", "id", "score")

    def _scored_by_joins(self, asked: DataFrame) -> DataFrame:
        listed = self.listed.select("part", "id", "dl", F.explode("terms").alias("term")).join(asked.select("part", "term").distinct(), ["part", "term"], "left_semi")
        used = save(listed.groupBy("part", "term", "id", "dl").agg(F.count("*").alias("tf")), "postings")
        df = used.groupBy("part", "term").agg(F.count("*").alias("df"))
        idf = df.join(self.stats, "part").select("part", "term", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))) * F.log(1 + F.col("qf"))
        return asked.join(idf, ["part", "term"]).join(used, ["part", "term"]).groupBy("query_id", "id").agg(F.sum(weight).alias("score"))


def _statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def _frequencies(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            lists = batch.column(3)
            flat = pc.index_in(lists.flatten(), value_set=known) if len(terms) else pa.nulls(len(lists.flatten()), pa.int32())
            own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            ix = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            keys, tf = np.unique((own * max(1, len(terms)) + ix)[ix >= 0], return_counts=True)
            ends = np.searchsorted(keys // max(1, len(terms)), np.arange(batch.num_rows + 1)).astype(np.int32)
            listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int32))) for v in (keys % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *listed], names=["part", "id", "dl", "ix", "tf"])

    return run


def _scores(weights: dict, n_terms: int, n_queries: int, limit: int):
    """weights: part -> average length, and term, query and weight of each asked term, sorted by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []

        def best():
            """The rows of each query that can still be among its best."""
            q, ids, score = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.lexsort((np.unique(ids, return_inverse=True)[1], -np.round(score, 9), q))
            q = q[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            order = order[rank < limit]
            kept[:] = [tuple(np.concatenate(c)[order] for c in zip(*kept, strict=True))]

        step, kind = max(1, SCORES // max(1, n_queries)), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                parts = np.array([p or "" for p in rows.column(0).to_pylist()], object)
                for p in set(parts) & set(weights):
                    some = rows.filter(pa.array(parts == p))
                    average, term, query, weight = weights[p]
                    ix, tf = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4))
                    own = np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column(3)).to_numpy(zero_copy_only=False))
                    dl = some.column(2).to_numpy(zero_copy_only=False)[own]
                    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
                    first, last = np.searchsorted(term, ix, "left"), np.searchsorted(term, ix, "right")
                    times = last - first
                    postings = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    cell = np.repeat(own, times) * n_queries + query[postings]
                    score = np.bincount(cell, np.repeat(part, times) * weight[postings], minlength=some.num_rows * n_queries)
                    hit = np.flatnonzero(score > 0)
                    ids = np.array(some.column(1).to_pylist())
                    kept.append((hit % n_queries, ids[hit // n_queries], score[hit]))
                if sum(len(k[0]) for k in kept) > SCORES:
                    best()
        if kept:
            best()
            yield pa.RecordBatch.from_arrays([pa.array(kept[0][0].astype(np.int64)), pa.array(kept[0][1].tolist(), kind), pa.array(kept[0][2])], names=["q", "id", "score"])

    return run


def normalised(pool: DataFrame) -> DataFrame:
    """Scores as shares of the best of the query's whole pool."""
    top = pool.groupBy("query_id").agg(F.max("score").alias("top_"))
    return pool.join(top, "query_id").select("query_id", "id", F.when(F.col("top_") > 0, F.col("score") / F.col("top_")).otherwise(F.lit(0.0)).alias("semantic"))


def hybrid(semantic: DataFrame, reached: DataFrame, overlap: DataFrame, nodes: DataFrame, k: int, types: tuple[str, ...] | None = None, least: float = 0.0, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """query_id, id, semantic, graph, source, score, rank.

    semantic(query_id, id, semantic), reached(query_id, id, score), overlap(query_id, id, overlap).  Nodes that only the
    graph reaches join with semantic 0; the type filter comes behind the pool's cut.
    """
    both = semantic.join(reached.select("query_id", "id", F.col("score").alias("graph")), ["query_id", "id"], "full_outer").join(overlap.select("query_id", "id", F.col("overlap").alias("source")), ["query_id", "id"], "left")
    part = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in weights}
    known = both.join(nodes.select("id", "type"), "id")
    if types is not None:
        known = known.where(F.col("type").isin(*types))
    total = sum((weights[c] * part[c] for c in weights), F.lit(0.0))
    scored = known.select("query_id", "id", *[part[c].alias(c) for c in weights], total.alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def blend(lexical: Column, dense: Column, weight: float) -> Column:
    return (1 - weight) * lexical + weight * F.greatest(F.lit(0.0), dense)


def resolve(queries: DataFrame, names: DataFrame, roots: DataFrame, pool: DataFrame, nodes: DataFrame, types: tuple[str, ...], similarity, least: float = 0.5, most: int = 5) -> DataFrame:
    """query_id, id, stage: exact names of a wanted type; else cluster members of any exact match; else the best lexical hits that look alike.

    queries(query_id, key, text), pool(query_id, id, rank).
    """
    exact = queries.join(names, "key").select("query_id", "id", "type", "priority", "ord")
    wanted = F.col("type").isin(*types)
    one = exact.where(wanted).select("query_id", "id", F.lit(1).alias("stage"))
    kin = exact.select("query_id", "id").join(roots, "id").select("query_id", "root").distinct().join(roots, "root").join(nodes.select("id", "type"), "id").where(wanted)
    two = kin.select("query_id", "id", F.lit(2).alias("stage"))
    near = pool.where(F.col("rank") <= most).join(nodes.select("id", "type", "name"), "id").where(wanted).join(queries.select("query_id", "text"), "query_id").where(similarity(F.col("text"), F.col("name")) >= least)
    every = one.unionByName(two).unionByName(near.select("query_id", "id", F.lit(3).alias("stage"))).distinct()
    best = every.groupBy("query_id").agg(F.min("stage").alias("stage"))
    return every.join(best, ["query_id", "stage"])
