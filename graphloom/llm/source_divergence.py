"""How far the sources of a language differ in their words: distances between every two of them, and each one's own words.

A group is a (lang, source); a language keeps the terms that enough of its documents have.  The distance of two groups sums
|p - q| over all kept terms without visiting them: by inclusion and exclusion over the supports, every term of one group is
first priced as if the other lacked it (from a histogram of the group's counts), terms of both are then corrected (a join of
postings), and the terms that neither has cost a constant.  All sums are of integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, col, small_enough

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text and entries that a task counts before it hands its counts on; bytes of one text that are cut at a time.
MOST_BYTES, MOST_ENTRIES, SLICE = 64_000_000, 400_000, 4_000_000
#: Groups that may be broadcast, at some 100 bytes each.
MOST_BROADCAST = 100_000

#: Terms are runs of ASCII letters and of anything beyond ASCII; all other bytes become blanks, A-Z become a-z.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _cut(text: bytes) -> Iterator[list[bytes]]:
    folded, at = text.translate(_FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = entries = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            for at in range(0, len(terms) + 1, 50_000):
                part = terms[at : at + 50_000]
                # the first row of a group has the empty term, which no text has
                names, counts, of = ([""] if at == 0 else []) + [t.decode() for t in part], ([0] if at == 0 else []) + [n[t] for t in part], ([0] if at == 0 else []) + [docs[t] for t in part]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(names), pa.string()), "source": pa.array([source] * len(names), pa.string()), "term": pa.array(names, pa.string()), "n": pa.array(counts, pa.int64()), "docs": pa.array(of, pa.int64())})
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in _cut(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size, entries = size + len(text), entries + len(n) - before
            if size >= MOST_BYTES or entries >= MOST_ENTRIES:
                yield from rows()
                size = entries = 0
    yield from rows()


def _p(count: str | int, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), in decimals as counts times SCALE pass 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20, 0)) * ({count} + {SMOOTHING})) div nullif({total} + {SMOOTHING} * {terms}, 0)")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to every other of its language (part "pair", all ranks)
    and the kept terms it has more often than its language (part "term", the first `top`).

    Nulls are empty strings: a null text has no terms, null languages and sources are those named ''.  Repeated rows are
    documents of their own.  Groups without terms have count 0 for every kept term; a language that keeps none has distances
    of 0.  Ties go to the item that is less in UTF-8.  Texts of any length are cut in slices; an empty table gives no rows,
    and other columns don't matter.
    """
    work = Workspace(docs.sparkSession, "divergence")
    base = docs.select(*(F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = work.save(base.mapInArrow(_count, _COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = work.save(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(f"docs >= {least}").drop("docs"), "kept")
    mine = work.save(counts.where("term <> '' and n > 0").drop("docs").join(kept, ["lang", "term"]), "mine")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    sums = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0)
    groups = work.save(groups.select("*", F.monotonically_increasing_id().alias("g"), F.coalesce(_p(0, "total", "v"), F.lit(0)).alias("p0")), "groups")
    small = F.broadcast(groups) if small_enough(groups, MOST_BROADCAST) else groups
    priced = mine.join(small, ["lang", "source"]).select("lang", "term", "source", "g", "n", "p0", _p("n", "total", "v").alias("p"), _p("in_lang", "lang_total", "v").alias("q"))
    priced = work.save(priced, "priced")

    f = F.col("value").desc(), F.col("item").asc()
    own = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*f))).where(F.col("rank") <= top)

    # every term of a group against a group that lacks it
    histogram = priced.groupBy("lang", "g", "p").agg(F.count("*").alias("n"))
    other = small.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    alone = histogram.join(other, "lang").where("g <> h").groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.sum(F.expr("n * abs(p - q0)")).alias("alone"))
    # terms that both have
    left, right = (priced.select("lang", "term", F.col("g").alias(x), F.col("p").alias(f"p{x}"), F.col("p0").alias(f"z{x}")) for x in "ab")
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - zb) - abs(pb - za) + abs(za - zb)")).alias("both"))
    # terms that neither has
    one, two = (small.select("lang", F.col("g").alias(x), F.col("source").alias(f"s{x}"), F.col("terms").alias(f"t{x}"), F.col("p0").alias(f"z{x}"), *(["v"] if x == "a" else [])) for x in "ab")
    pairs = one.join(two, "lang").where("a < b").join(alone, ["a", "b"], "left").join(both, ["a", "b"], "left").na.fill(0, ["alone", "both"])
    pairs = pairs.select("lang", "sa", "sb", F.expr("alone + both + (v - ta - tb) * abs(za - zb)").cast("long").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item"))))
    pairs = pairs.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*f)))
    return pairs.unionByName(own).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
