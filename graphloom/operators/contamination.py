"""Contamination audit: how much of a case's text is in a corpus of passages, and the other way round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import leaves
from ..functions.text import bare_text, gram_hash_set, gram_hashes
from ..session import save, small_enough

# fixed values
GRAM, LIKELY, POSSIBLE = 5, 0.40, 0.20
SHORTEST_PASSAGE, SHORTEST_EXACT, SHORTEST_CITATION = 5, 6, 6
#: The fields of a kind of case that ask, and those that answer.
CASE_FIELDS = {"sdt": ("clinical_data", "clinical_information"), "pa": ("question", "explanation"), "cp": ("vignette", "question")}
ANSWER_FIELDS = {"sdt": ("syndrome_text", "pathogenesis_text", "explanatory_summary", "syndrome_differentiation"), "pa": ("answer_text", "rule_summary"), "cp": ("answer_text",)}
MOST_PASSAGE_SHOWN, CLOSEST = 60, 10
#: What may go to every task: passages and their postings (16 bytes each); different needles and their letters.
MOST_PASSAGES, MOST_POSTINGS, MOST_NEEDLES, MOST_NEEDLE_CHARS = 5_000, 1_000_000, 20_000, 4_000_000
#: Letters whose grams are hashed at a time; rows, and postings that they meet, that are counted at a time.
MOST_LETTERS, MOST_ROWS, MOST_MET = 1_000_000, 256, 4_000_000


def corpus(parts: DataFrame, fold=bare_text) -> DataFrame:
    """passage_id, origin, text, canon from parts(origin, text, ord): short ones go, of equal canonical texts the first stays."""
    p = parts.select("origin", "text", "ord", fold(F.col("text")).alias("canon")).where(F.length("canon") >= SHORTEST_PASSAGE)
    first = p.groupBy("canon").agg(F.min(F.struct("ord", "origin", "text")).alias("m"))
    return first.select(F.xxhash64("canon").alias("passage_id"), F.col("m.origin").alias("origin"), F.col("m.text").alias("text"), "canon")


#: Attributes that are no text of a node's own.
NOT_TEXT = ("id", "type", "name", "source_docs", "first_mention")


def corpus_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """origin, text, ord: all that a reader of the graph can see, for corpus().

    Of each node, in the graph's order: what is searched of it as one text (vdoc:id), every string in its attributes (node:id:key),
    its first sentence (node:id); then the evidence of the edges (edge:id).  Of equal texts corpus() keeps the first.
    """
    from . import graph as gr
    from . import retrieval as rt
    from .tools import text_pieces

    at = lambda *parts: F.array(*[p.cast("long") for p in parts])
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    places = nodes.select("id", F.col("ord").alias("n_"))
    whole = rt.virtual_documents(text_pieces(nodes, edges, with_evidence=False)).join(places, "id").select(F.concat(F.lit("vdoc:"), "id").alias("origin"), "text", at(zero, F.col("n_"), zero).alias("ord"))
    own = leaves(nodes, "attrs", ["id", "ord"], skip=NOT_TEXT).select(F.concat_ws(":", F.lit("node"), "id", "key").alias("origin"), "text", F.concat(at(zero, F.col("ord"), one), "path").alias("ord"))
    first = nodes.select(F.concat(F.lit("node:"), "id").alias("origin"), F.col("first_mention.sentence").alias("text"), at(zero, F.col("ord"), two).alias("ord")).where("text is not null")
    said = edges.select(F.concat(F.lit("edge:"), "id").alias("origin"), "ord", F.posexplode(gr.evidence_sentences(F.col("evidence"))).alias("pos", "text")).select("origin", "text", at(one, F.col("ord"), F.col("pos")).alias("ord"))
    return whole.unionByName(own).unionByName(first).unionByName(said).withColumn("text", F.trim("text"))


def document_titles(nodes: DataFrame) -> DataFrame:
    """title of every document that cited_sources() looks for: its name, title and file name."""
    get = lambda f: F.coalesce(F.get_json_object("attrs", f"$.{f}"), F.lit(""))
    return nodes.where("type = 'DocumentSource'").select(F.concat_ws(" ", "name", get("title"), get("source_filename")).alias("title"))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, and some million letters (or one long text): sets are eight times their text and more, and must not wait for a whole batch."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= MOST_LETTERS or i + 1 - start >= rows or i == len(lengths) - 1:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and gram sets."""
    for batch in batches:
        for some in _slices(batch, batch.num_rows):
            flat, ends = gram_hashes(some.column(1), GRAM)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], names=["id", "g"])


def gram_sets(df: DataFrame, key: str) -> DataFrame:
    """id, g of df(key, canon): gram_hash_set() of every text that has a gram."""
    return df.select(key, "canon").mapInArrow(_gram_sets, f"id {df.schema[key].dataType.simpleString()}, g array<long>").where("size(g) > 0")


class GramJoin:
    """Pairs of cases(case_id, canon) and passages(passage_id, canon) by the grams they share, from a least overlap on.

    The overlap is the largest of Jaccard and both containments, which is shared / min(n, m).  A set orders its grams from rare
    to common (by how many pairs a gram makes; grams that one side lacks make none and are left out before anything is joined).
    With s the grams that a pair has to share, its first common gram stands s or more from the end in both sets.  So the smaller
    set joins with a prefix only, and a match too near the end of either set forms no pair.
    """

    def __init__(self, cases: DataFrame, passages: DataFrame):
        self.sets, listed = {}, {}
        for side, df, key in (("a", cases, "case_id"), ("b", passages, "passage_id")):
            sets = save(gram_sets(df, key), f"grams-{side}")
            self.sets[side] = sets
            listed[side] = sets.select("id", F.size("g").alias("n"), F.explode("g").alias("gram"))
        # grams of a small side go to every task, so that of the other side's only these are shuffled
        total = {x: self.sets[x].agg(F.sum(F.size("g"))).first()[0] or 0 for x in "ab"}
        few, many = sorted("ab", key=total.get)
        if total[few] <= MOST_POSTINGS:
            listed[many] = listed[many].join(F.broadcast(listed[few].select("gram").distinct()), "gram", "left_semi")
        counts = [listed[x].groupBy("gram").agg(F.count("*").alias(f"d{x}")) for x in "ab"]
        self.common = save(counts[0].join(counts[1], "gram").select("gram", (F.col("da") * F.col("db")).alias("w")), "common-grams")
        self.ranked = {x: save(self._ranked(listed[x]), f"ranked-{x}") for x in "ab"}

    def _ranked(self, listed: DataFrame) -> DataFrame:
        """id, n, gram, left: how many of the set's common grams stand at this gram or behind it."""
        few = F.broadcast(self.common) if small_enough(self.common, MOST_POSTINGS) else self.common
        w = Window.partitionBy("id").orderBy(F.desc("w"), "gram")
        return listed.join(few, "gram").select("id", "n", "gram", F.row_number().over(w).alias("left"))

    def candidates(self, least: float, cases: DataFrame | None = None) -> DataFrame:
        """case_id, passage_id of every pair that can reach the overlap, some that can't among them; of some cases(case_id) only, if given."""
        need = lambda n: F.greatest(F.lit(1), F.ceil(F.round(F.lit(least) * n, 9)))
        a, b = (self.ranked[x].select(F.col("id").alias(key), F.col("n").alias(f"n{x}"), "gram", F.col("left").alias(f"l{x}")) for x, key in (("a", "case_id"), ("b", "passage_id")))
        if cases is not None:
            a = a.join(cases.select("case_id"), "case_id", "left_semi")
        one = a.where(F.col("la") >= need(F.col("na"))).join(b, "gram").where((F.col("na") <= F.col("nb")) & (F.col("lb") >= need(F.col("na"))))
        two = a.join(b.where(F.col("lb") >= need(F.col("nb"))), "gram").where((F.col("nb") < F.col("na")) & (F.col("la") >= need(F.col("nb"))))
        return one.select("case_id", "passage_id").unionByName(two.select("case_id", "passage_id")).distinct()

    def pairs(self, least: float, cases: DataFrame | None = None) -> DataFrame:
        """case_id, passage_id, shared, jaccard, graph_in_case, case_in_graph, overlap of every pair with the overlap, decided on whole sets."""
        a, b = (self.sets[x].select(F.col("id").alias(key), F.col("g").alias(f"g{x}")) for x, key in (("a", "case_id"), ("b", "passage_id")))
        met = self.candidates(least, cases).join(a, "case_id").join(b, "passage_id")
        sized = met.select("case_id", "passage_id", F.size(F.array_intersect("ga", "gb")).alias("shared"), F.size("ga").alias("n"), F.size("gb").alias("m"))
        return _shares(sized).where(F.round("overlap", 9) >= least)

    def best(self, steps: tuple[float, ...] = (LIKELY, POSSIBLE, 0.1, 0.05, 0.0)) -> DataFrame:
        """The best pair of every case that shares a gram: cases look for high overlaps first, and only those without one look for lower ones."""
        left, found = save(self.sets["a"].select(F.col("id").alias("case_id")), "cases-left"), None
        for least in steps:
            now = save(_best(self.pairs(least, None if found is None else left)), "best")
            found = now if found is None else found.unionByName(now)
            left = save(left.join(now, "case_id", "left_anti"), "cases-left")
            if left.isEmpty():
                break
        return found


def similar_pairs(cases: DataFrame, passages: DataFrame, least: float = POSSIBLE) -> DataFrame:
    """Every pair with that overlap or more: case_id, passage_id, shared, jaccard, graph_in_case, case_in_graph, overlap."""
    return GramJoin(cases, passages).pairs(least)


def best_by_join(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """What best_overlap() gives, without a limit on either side.

    Cases with few letters (a checked number) go to every task, which keeps the best of its passages for each; nothing but these is
    shuffled or saved.  More cases meet the passages in a GramJoin.
    """
    few = small_enough(cases, MOST_PASSAGES) and (cases.agg(F.sum(F.length("canon"))).first()[0] or 0) <= MOST_POSTINGS
    best = _best_for_few(cases, passages) if few else GramJoin(cases, passages).best()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return cases.select("case_id").join(best, "case_id", "left").select("case_id", "passage_id", *map(zero, ("jaccard", "graph_in_case", "case_in_graph", "overlap")))


def _best_for_few(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """The best pair of every one of few cases that shares a gram."""
    few = gram_sets(cases, "case_id").collect()
    sets = [np.array(r.g, np.int64).view(np.uint64) for r in few]
    kind = passages.schema["passage_id"].dataType.simpleString()
    found = passages.select("passage_id", "canon").mapInArrow(_best_in_task(*_postings(sets)), f"place long, passage_id {kind}, shared long, n long, m long")
    names = cases.sparkSession.createDataFrame([(i, r.id) for i, r in enumerate(few)], f"place long, case_id {cases.schema['case_id'].dataType.simpleString()}")
    return _best(_shares(found.join(F.broadcast(names), "place")))


def _best(pairs: DataFrame) -> DataFrame:
    """Each case's best pair: the largest overlap, then the most grams, then the least passage."""
    order = F.struct(F.round(-F.col("overlap"), 9).alias("o"), (-F.col("shared")).alias("s"), F.col("passage_id").alias("p"))
    best = pairs.groupBy("case_id").agg(F.min_by(F.struct("passage_id", "jaccard", "graph_in_case", "case_in_graph", "overlap"), order).alias("best"))
    return best.select("case_id", "best.*")


def _shares(sized: DataFrame) -> DataFrame:
    """The three shares of shared grams; zeros where a side has none."""
    share = lambda by, c: F.coalesce(F.try_divide("shared", by), F.lit(0.0)).alias(c)
    s = sized.select("case_id", "passage_id", "shared", share(F.col("n") + F.col("m") - F.col("shared"), "jaccard"), share(F.col("m"), "graph_in_case"), share(F.col("n"), "case_in_graph"))
    return s.withColumn("overlap", F.greatest("jaccard", "graph_in_case", "case_in_graph"))


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of some sets in order, the place of the set that each is of, and the sets' sizes."""
    sizes = np.array([len(g) for g in sets], np.int64)
    grams, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    return grams[order], owner[order], sizes


def _sharing(batches: Iterator[pa.RecordBatch], grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray):
    """Some rows' ids, their numbers of grams, and how many of these each row shares with each of the few: a matrix."""
    values, first = np.unique(grams, return_index=True)
    last = np.r_[first[1:], len(grams)]
    for batch in batches:
        for some in _slices(batch, MOST_ROWS):
            flat, ends = gram_hashes(some.column(1), GRAM)
            shared = np.zeros(some.num_rows * len(sizes), np.int64)
            where = np.searchsorted(values, flat)
            where[where == len(values)] = 0
            hits = np.flatnonzero(values[where] == flat) if len(values) else np.zeros(0, np.int64)
            row, where = np.searchsorted(ends, hits, "right") - 1, where[hits]
            times = last[where] - first[where]
            upto = np.cumsum(times)
            cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(MOST_MET, times.sum(), MOST_MET)), len(hits)])
            for a, b in zip(cuts, cuts[1:], strict=False):
                # every posting of every hit, one after another
                t = times[a:b]
                postings = np.repeat(first[where[a:b]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
                shared += np.bincount(np.repeat(row[a:b], t) * len(sizes) + owner[postings], minlength=len(shared))
            yield some.column(0), np.diff(ends), shared.reshape(some.num_rows, len(sizes))


def _overlaps(shared: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, m = np.maximum(n, 1)[:, None], sizes[None, :]
    return np.round(np.maximum(np.maximum(shared / (n + m - shared), shared / m), shared / n), 9)


def _best_of_few(grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray):
    """For each case the best of the few passages, whose postings (sorted by gram) are at hand: place, -1 without a shared gram, and counts.

    Places are in the order of the passages' ids, so the first of equals has the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, shared in _sharing(batches, grams, owner, sizes):
            own = sizes
            if not len(sizes):
                shared, own = np.zeros((len(n), 1), np.int64), np.ones(1, np.int64)
            score = _overlaps(shared, n, own)
            best = np.lexsort((np.broadcast_to(np.arange(score.shape[1]), score.shape), -shared, -score), axis=1)[:, 0]
            k = shared[np.arange(len(n)), best]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int64)) for c in (np.where(k > 0, best, -1), k, n, own[best])]], names=["case_id", "place", "shared", "n", "m"])

    return run


def _best_in_task(grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray):
    """For each of the few cases, whose postings (sorted by gram) are at hand, the best of a task's passages: place, passage and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, best, kind = np.zeros(len(sizes)), {}, pa.int64()
        for ids, m, shared in _sharing(batches, grams, owner, sizes):
            rank, score, kind = np.empty(len(m), np.int64), _overlaps(shared, m, sizes), ids.type
            rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(m))
            # of the largest overlaps those with the most grams, of these the least id
            alike = score == score.max(axis=0)
            k = np.where(alike, shared, -1).max(axis=0)
            row = np.where(alike & (shared == k), rank[:, None], len(m)).argmin(axis=0)
            for place in np.flatnonzero((k > 0) & (score[row, np.arange(len(sizes))] >= top)).tolist():
                at = row[place]
                now = (-score[at, place], -k[place], ids[int(at)].as_py(), m[at])
                if place not in best or now < best[place]:
                    best[place], top[place] = now, -now[0]
        columns = [(place, passage, -k, sizes[place], m) for place, (_, k, passage, m) in best.items()]
        place, passage, *counts = zip(*columns, strict=True) if columns else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(passage, kind), *[pa.array(c, pa.int64()) for c in counts]], names=["place", "passage_id", "shared", "n", "m"])

    return run


def best_overlap(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """Each case's best passage (of equal ones the one that shares more grams, then the smaller id); cases without a shared gram have zeros.

    Passages with few postings (a checked number) go to every task, and a case is compared where it lies; more meet the cases in a GramJoin.
    """
    listed = save(passages.select("passage_id", gram_hash_set(F.col("canon"), GRAM).alias("g")).where("size(g) > 0"), "passage-grams")
    if small_enough(listed, MOST_PASSAGES) and (listed.agg(F.sum(F.size("g"))).first()[0] or 0) <= MOST_POSTINGS:
        few = sorted((r.passage_id, np.array(r.g, np.int64).view(np.uint64)) for r in listed.collect())
        kind = cases.schema["case_id"].dataType.simpleString()
        found = cases.select("case_id", "canon").mapInArrow(_best_of_few(*_postings([g for _, g in few])), f"case_id {kind}, place long, shared long, n long, m long")
        names = listed.sparkSession.createDataFrame([(i, p) for i, (p, _) in enumerate(few)], f"place long, passage_id {passages.schema['passage_id'].dataType.simpleString()}")
        return _shares(found.join(F.broadcast(names), "place", "left")).select("case_id", "passage_id", *[F.when(F.col("shared") > 0, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("jaccard", "graph_in_case", "case_in_graph", "overlap")])
    return best_by_join(cases, passages)


def holding(needles: list[str]):
    """passage_id, place of the needles that each passage holds: one pass of an automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, needle in enumerate(needles):
            machine.add_word(needle, i)
        if needles:
            machine.make_automaton()
        for batch in batches:
            ids, places = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if needles else []):
                if text:
                    found = {place for _, place in machine.iter(text)}
                    ids += [i] * len(found)
                    places += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int64())], names=["passage_id", "place"])

    return run


def exact_parts(parts: DataFrame, passages: DataFrame) -> DataFrame:
    """case_id, part, passage_id (the least) of parts(case_id, part, canon) that a passage holds verbatim.

    Different parts up to a checked number and length are an automaton that every passage runs through once.  More of them are
    looked for among passages that have one gram of the part, its rarest.
    """
    some = parts.where(F.length("canon") >= SHORTEST_EXACT)
    needles = save(some.select("canon").distinct(), "needles")
    if small_enough(needles, MOST_NEEDLES) and (needles.agg(F.sum(F.length("canon"))).first()[0] or 0) <= MOST_NEEDLE_CHARS:
        listed = sorted(r.canon for r in needles.collect())
        kind = passages.schema["passage_id"].dataType.simpleString()
        held = passages.select("passage_id", "canon").mapInArrow(holding(listed), f"passage_id {kind}, place long").groupBy("place").agg(F.min("passage_id").alias("passage_id"))
        # a needle's place is its rank, which the needles' own table gives as well
        named = held.select(F.element_at(F.lit(listed) if listed else F.array().cast("array<string>"), (F.col("place") + 1).cast("int")).alias("canon"), "passage_id") if len(listed) <= 1000 else held.join(needles.sparkSession.createDataFrame(list(enumerate(listed)), "place long, canon string"), "place").select("canon", "passage_id")
        return some.join(named, "canon").select("case_id", "part", "passage_id").groupBy("case_id", "part").agg(F.min("passage_id").alias("passage_id"))
    p = save(passages.select("passage_id", "canon", gram_hash_set(F.col("canon"), GRAM).alias("g")), "passages")
    listed = some.select("case_id", "part", "canon", F.explode(gram_hash_set(F.col("canon"), GRAM)).alias("gram"))
    wanted = listed.select("gram").distinct()
    postings = save(p.select("passage_id", F.explode("g").alias("gram")).join(wanted, "gram", "left_semi"), "postings")
    rare = listed.join(postings.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left").groupBy("case_id", "part", "canon").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram").alias("gram"))).alias("m"))
    found = rare.where("m.df > 0").select("case_id", "part", F.col("canon").alias("needle"), F.col("m.gram").alias("gram")).join(postings, "gram")
    found = found.select("case_id", "part", "needle", "passage_id").join(p.select("passage_id", "canon"), "passage_id")
    return found.where(F.contains(F.col("canon"), F.col("needle"))).groupBy("case_id", "part").agg(F.min("passage_id").alias("passage_id"))


def cited_sources(cases: DataFrame, titles: DataFrame) -> DataFrame:
    """case_id, title (the least): titles of six letters or more in the case, or the case in the title.

    Titles in cases and cases in titles are two searches for exact parts, so neither side needs to be small.
    """
    t = titles.select("title", bare_text(F.col("title")).alias("t")).where(F.length("t") >= SHORTEST_CITATION)
    c = cases.select("case_id", "canon").where(F.length("canon") >= SHORTEST_CITATION)
    held = _all_holding(t.select(F.col("title").alias("needle_id"), F.col("t").alias("canon")), c.select(F.col("case_id").alias("id"), "canon")).select(F.col("id").alias("case_id"), F.col("needle_id").alias("title"))
    holds = _all_holding(c.select(F.col("case_id").alias("needle_id"), "canon"), t.select(F.col("title").alias("id"), F.col("t").alias("canon"))).select(F.col("needle_id").alias("case_id"), F.col("id").alias("title"))
    return held.unionByName(holds).groupBy("case_id").agg(F.min("title").alias("title"))


def _all_holding(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """needle_id, id of every needle (needle_id, canon) that a hay (id, canon) holds: they meet in the needle's rarest gram."""
    n = save(needles.select("needle_id", F.col("canon").alias("needle"), gram_hash_set(F.col("canon"), GRAM).alias("g")), "needles")
    h = save(hay.select("id", "canon", gram_hash_set(F.col("canon"), GRAM).alias("g")), "hay")
    listed = n.select("needle_id", F.explode("g").alias("gram"))
    postings = save(h.select("id", F.explode("g").alias("gram")).join(listed.select("gram").distinct(), "gram", "left_semi"), "postings")
    rare = listed.join(postings.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("m"))
    pairs = rare.where("m.df > 0").select("needle_id", F.col("m.gram").alias("gram")).join(postings, "gram").select("needle_id", "id")
    return pairs.join(n.select("needle_id", "needle"), "needle_id").join(h.select("id", "canon"), "id").where(F.contains("canon", "needle")).select("needle_id", "id").distinct()


def stratum(overlap: Column, exact: Column, cited: Column) -> Column:
    return F.when(F.coalesce(exact, F.lit(False)) | F.coalesce(cited, F.lit(False)) | (overlap >= LIKELY), "likely").when(overlap >= POSSIBLE, "possible").otherwise("clean")


def audit(cases: DataFrame, parts: DataFrame, passages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """case_id, jaccard, graph_in_case, case_in_graph, overlap, n_exact_parts, stratum: the case's text and each gold part for itself."""
    best = best_overlap(cases, passages)
    exact = exact_parts(parts, passages)
    rest = parts.join(exact.select("case_id", "part"), ["case_id", "part"], "left_anti")
    keyed = rest.select(F.concat_ws("\x1f", F.col("case_id").cast("string"), "part").alias("case_id"), F.col("case_id").alias("of_"), "canon")
    by_part = best_overlap(keyed.select("case_id", "canon"), passages).join(keyed.select("case_id", "of_"), "case_id").groupBy(F.col("of_").alias("case_id")).agg(F.max("overlap").alias("part_overlap"))
    out = best.join(exact.groupBy("case_id").agg(F.count("*").alias("n_exact_parts")), "case_id", "left").join(by_part, "case_id", "left")
    if titles is not None:
        out = out.join(cited_sources(cases, titles), "case_id", "left")
    else:
        out = out.withColumn("title", F.lit(None).cast("string"))
    score = F.greatest("overlap", F.coalesce("part_overlap", F.lit(0.0)))
    n = F.coalesce("n_exact_parts", F.lit(0))
    return out.select("case_id", F.round("jaccard", 4).alias("jaccard"), F.round("graph_in_case", 4).alias("graph_in_case"), F.round("case_in_graph", 4).alias("case_in_graph"), F.round(score, 4).alias("overlap"), n.alias("n_exact_parts"), F.col("title").alias("cited"), stratum(score, n > 0, F.col("title").isNotNull()).alias("stratum"))


def strata(audited: DataFrame) -> DataFrame:
    c = lambda s: F.count_if(F.col("stratum") == s)
    return audited.agg(F.count("*").alias("n_cases"), c("clean").alias("clean"), c("possible").alias("possible"), c("likely").alias("likely"), (c("clean") / F.count("*")).alias("share_clean"))


def staleness(recorded: DataFrame, current: DataFrame, key: str = "field", value: str = "value") -> DataFrame:
    """field, recorded, current where both sides have a value and they differ."""
    both = recorded.select(key, F.col(value).alias("recorded")).join(current.select(key, F.col(value).alias("current")), key)
    return both.where("coalesce(recorded, '') <> '' and coalesce(current, '') <> '' and recorded <> current")


def text_of_fields(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """The fields that df has, lists opened, blanks between, nothing for what is empty (Q8)."""
    kinds = dict(df.dtypes)
    parts = [F.array_join(F.col(f).cast("array<string>"), " ") if kinds[f].startswith("array") else F.col(f).cast("string") for f in fields if f in kinds]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]) if parts else F.lit("")


def audit_inputs(items: DataFrame, kind: str, id_col: str = "id", letters: str = "answer_letters", options: str = "options", fold=bare_text) -> tuple[DataFrame, DataFrame]:
    """(cases, parts) for audit(): what a case asks, and every gold option and the answer's own fields as parts of their own.

    Two gold options that stand in different passages are two leaks; put together they would be found in none.
    """
    cases = items.select(F.col(id_col).alias("case_id"), fold(text_of_fields(items, CASE_FIELDS[kind])).alias("canon"))
    answer = items.select(F.col(id_col).alias("case_id"), F.lit("answer").alias("part"), F.trim(text_of_fields(items, ANSWER_FIELDS[kind])).alias("text"))
    if options in items.columns and letters in items.columns:
        chosen = items.select(F.col(id_col).alias("case_id"), F.explode(letters).alias("part"), options).select("case_id", "part", F.trim(F.try_element_at(options, "part")).alias("text"))
        answer = chosen.unionByName(answer)
    parts = answer.where("text <> ''").select("case_id", "part", fold(F.col("text")).alias("canon"))
    return cases, parts


def closest(audited: DataFrame, n: int = CLOSEST) -> DataFrame:
    """The cases with the largest overlaps, ties by case (F6): the report shows so many."""
    return audited.orderBy(F.desc("overlap"), "case_id").limit(n)


def report(audited: DataFrame) -> str:
    """An audit as Markdown (M5): its strata and its closest cases."""
    from .evaluation import markdown

    shown = closest(audited).select("case_id", "stratum", "jaccard", "graph_in_case", "case_in_graph", "n_exact_parts", F.substring(F.replace(F.coalesce("cited", F.lit("")), F.lit("|"), F.lit("／")), 1, MOST_PASSAGE_SHOWN).alias("cited"))
    return "\n\n".join(["# Contamination", markdown(strata(audited)), "## Closest cases", markdown(shown.orderBy(F.desc("jaccard"), "case_id"))]) + "\n"
