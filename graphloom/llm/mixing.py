"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u) / w, u from a hash of its id and w its quality weight; taking documents of a
source in the order of their keys is weighted sampling without replacement.  A source's target is met by complete
epochs first; the rest of it by the documents with the smallest keys, as far as their sizes, summed in that order, fill it.

The prefix sums need no sort of a whole source.  Keys map to places in [0, 1); sums over 1,024 equal intervals of it
say in which one a source's budget ends, which is cut again until few documents are left in it; only those are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, Workspace, col, small_enough

#: Intervals of each refinement, the most refinements (2**50 intervals), and the documents of a source that are sorted.
INTERVALS, LEVELS, SORTED = 1024, 5, 20_000
#: Least quality weight; keys stay finite and every document can be drawn.
LEAST_WEIGHT = 0.05
#: Sources that may be broadcast, at some 100 bytes each.
MOST_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_counts(text: Column) -> Column:
    """Words, characters that aren't white space, and letters among these: an array of one struct, for F.inline().

    A generator's columns are computed once; columns of a projection would be computed again wherever they are named.
    """
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    others = F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return F.array(F.struct(word_count(text).alias("size_"), solid.alias("solid_"), (F.length(text) - others).alias("letters_")))


def letter_share(solid: Column, letters: Column) -> Column:
    """Quality weight of a text: letters among its characters that aren't white space."""
    return F.when(solid > 0, letters / solid)


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    w = F.when(weight.isNull() | F.isnan(weight) | (weight < LEAST_WEIGHT), F.lit(LEAST_WEIGHT)).otherwise(weight)
    return -F.log(u) / w


def targets(sizes: DataFrame, weights: tuple[float, ...], percent: int, most_epochs: int) -> DataFrame:
    """source, source_size, target, epochs, rest from (source, source_size).

    Sources in code-point order, null last, have the weights in turn.  They share percent of all sizes by weight; a
    target stops at most_epochs times its source's size and the excess is shared anew, which ends at
    target = min(cap, level * weight) with the greatest of the levels that hold when the sources with the least
    cap per weight are full.  One window over the sources: they are few beside documents.
    """
    ranked = sizes.select("*", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).alias("rank_"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", w.alias("w_"), (F.lit(most_epochs) * F.col("source_size")).alias("cap_"))
    by = Window.orderBy((F.col("cap_") / F.col("w_")).asc(), F.col("rank_"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap_").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("w_").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.select("*", ((F.lit(percent / 100.0) * F.sum("source_size").over(everything) - full) / open_).alias("level_"))
    out = levels.select("source", "source_size", F.least(F.col("cap_").cast("double"), F.col("w_") * F.max("level_").over(everything)).alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.select("*", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))


class Mix:
    """The plan of a mix: which documents of each source are taken, and how often.

    Rows with a null source are a source of their own.  Null texts and texts without words have size 0 and are never
    counted.  Documents with one id share a key; rows with one id, weight and text are taken alike, even at the end of a
    budget, which they pass if at least half of them fits.  An empty table gives an empty mix.  Columns may have any names.
    """

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), percent=150, most_epochs=2, quality=letter_share, seed=17):
        self.work, self.docs, self.keyed = Workspace(docs.sparkSession, "mix"), docs, None
        self.id_col, self.text_col, self.source_col = id_col, text_col, source_col
        self.weights, self.percent, self.most_epochs, self.quality, self.seed = weights, percent, most_epochs, quality, seed

    def _save_keys(self, whole: bool) -> DataFrame:
        """Every row's key, size, source, id and text hash; whole: with the row itself, so that nothing is counted again."""
        row = [F.struct(*[col(c) for c in self.docs.columns]).alias("row_")] if whole else []
        text = col(self.text_col).cast("string")
        counted = self.docs.select(*row, col(self.id_col).alias("id_"), col(self.source_col).alias("source_"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("hash_"), F.inline(text_counts(text)))
        key = sampling_key(F.col("id_"), self.quality(F.col("solid_"), F.col("letters_")), self.seed)
        saved = self.work.save(counted.select("*", key.alias("key_")).drop("solid_", "letters_"), "keyed")
        if self.keyed is None:
            self.keyed = saved.drop("row_")
            sizes = self.keyed.groupBy(F.col("source_").alias("source")).agg(F.sum("size_").alias("source_size"))
            self.sources = self.work.save(targets(sizes, self.weights, self.percent, self.most_epochs), "targets")
            self.cuts = self.work.save(self._cuts(), "cuts")
        return saved

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small_enough(df, MOST_BROADCAST) else df

    @staticmethod
    def _interval(level: int) -> Column:
        """The interval of a key's place at a level; places grow with keys."""
        return F.floor(F.lit(float(INTERVALS**level)) * (1 - F.exp(-F.col("key_")))).cast("long")

    def _cuts(self) -> DataFrame:
        """For each source, its last interval and the last document of it taken for the rest of its target (null: none)."""
        placed = self.keyed.where("size_ > 0")
        at = self.sources.where("rest > 0").select(F.col("source").alias("s_"), "rest", F.lit(0).cast("long").alias("b_"), F.lit(0).cast("long").alias("before_"))
        of = F.col("source_").eqNullSafe(F.col("s_"))
        for self.level in range(1, LEVELS + 1):
            inside = placed.join(self._small(at), of & (self._interval(self.level - 1) == F.col("b_"))).select("s_", "rest", "before_", "size_", self._interval(self.level).alias("i_"))
            sums = inside.groupBy("s_", "rest", "before_", "i_").agg(F.sum("size_").alias("sum_"), F.count("*").alias("n_"))
            up_to = F.col("before_") + F.sum("sum_").over(Window.partitionBy("s_").orderBy("i_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            ends = sums.select("s_", "rest", "i_", "n_", (up_to - F.col("sum_")).alias("before_"), up_to.alias("after_")).where("before_ <= rest and rest < after_")
            at = self.work.save(ends.groupBy("s_").agg(F.min(F.struct("i_", "rest", "before_", "n_")).alias("m")).select("s_", "m.rest", F.col("m.i_").alias("b_"), "m.before_", "m.n_"), "ends")
            if not at.where(f"n_ > {SORTED}").take(1):
                break
        # rows that can't be told apart are one: all of them are taken or none
        last = placed.join(self._small(at), of & (self._interval(self.level) == F.col("b_"))).groupBy("s_", "rest", "before_", F.struct("key_", "id_", "hash_").alias("at_")).agg(F.sum("size_").alias("size_"))
        order = Window.partitionBy("s_").orderBy("at_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = last.select("s_", "rest", "at_", (F.col("before_") + F.sum("size_").over(order) - F.col("size_") / 2).alias("middle_"))
        taken = last.where("middle_ <= rest").groupBy(F.col("s_").alias("t_")).agg(F.max("at_").alias("at_"))
        # nothing of the last interval fits: all before it is taken
        return self.sources.join(self._small(at.select("s_", "b_")), F.col("source").eqNullSafe(F.col("s_")), "left").join(self._small(taken), F.col("source").eqNullSafe(F.col("t_")), "left").select("source", "source_size", "target", "epochs", "rest", "b_", "at_")

    def _decided(self, rows: DataFrame) -> DataFrame:
        """With copies: how often a document is taken."""
        interval = self._interval(self.level)
        joined = rows.join(self._small(self.cuts), F.col("source_").eqNullSafe(F.col("source")))
        # rest > 0 without a last interval: rounding left all of the source in
        extra = F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("b_").isNull(), F.lit(True)).otherwise((interval < F.col("b_")) | ((interval == F.col("b_")) & F.coalesce(F.struct("key_", "id_", "hash_") <= F.col("at_"), F.lit(False))))
        return joined.withColumn("copies_", F.when(F.col("size_") > 0, F.col("epochs") + extra.cast("long")).otherwise(F.lit(0).cast("long")))

    def taken(self) -> DataFrame:
        """id, size, source_size, target (of its source), taken (words, repeats counted): one row for each document."""
        return self._decided(self._save_keys(False) if self.keyed is None else self.keyed).select(F.col("id_").alias("doc_id"), F.col("size_").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies_") * F.col("size_")).alias("taken"))

    def documents(self) -> DataFrame:
        """The mix itself: each document's row as often as it is taken."""
        return self._decided(self._save_keys(True)).where("copies_ > 0").select("row_", F.explode(F.sequence(F.lit(1).cast("long"), "copies_"))).select("row_.*")
