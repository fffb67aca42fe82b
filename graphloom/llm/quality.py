"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost is asked first.

Cost (seconds a row of computing the rule's own feature) and selectivity (share rejected) of each rule are estimated on a bounded
sample.  The verdict is a chain of CASE branches in that order, and a rule's feature is computed inside its branch, so a
rejected document never pays for the rules behind.  Which documents are kept doesn't depend on the order, hence not on the
sample or on the clock; only ``rejected_by`` and speed do.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh

BLANKS = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
#: Rows on which costs and selectivities are estimated, from the first partitions; longer texts stay out of this sample.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000
#: Seconds that a measurement should take at least, and the most repetitions of the sample for it.
LEAST_SECONDS, MOST_REPEATS = 0.15, 64


@dataclass(frozen=True)
class Rule:
    """Rejects where the condition on its feature f is true (null: keeps).

    feature: of the columns text_ and words_.  ready: the same of measure()'s columns, where these are owed anyway.
    """

    name: str
    feature: str
    condition: str
    ready: str | None = None

    def asked(self, ready: bool = False) -> Column:
        return F.expr(f"element_at(transform(array({self.ready if ready and self.ready else self.feature}), f -> {self.condition}), 1)")


#: Words in windows of three that the text has at least twice, the first included: windows are sorted by their
#: 64-bit hash, neighbours with equal hashes mark their places, and marked places cover up to three new words each.
_COVERED = """
element_at(transform(array(array_sort(transform(hashes_, (x, i) -> named_struct('h', x, 'i', i)))), s ->
  aggregate(
    array_sort(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)), x -> x.i)),
    named_struct('n', 0L, 'last', -3),
    (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x),
    a -> a.n)), 1)
"""


_HASHES = "case when size(words_) < 3 then array() else transform(sequence(0, size(words_) - 3), i -> xxhash64(words_[i], words_[i + 1], words_[i + 2])) end"
_REPEATS = f"element_at(transform(array({_HASHES}), hashes_ -> case when size(array_distinct(hashes_)) = size(hashes_) then 0L else {_COVERED} end), 1)"
_LINES = rf"element_at(transform(array(filter(split(text_, '\\n'), l -> btrim(l, {BLANKS}) <> '')), ls -> named_struct('n_lines', cast(size(ls) as bigint), 'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint))), 1)"
_CHARS = "aggregate(words_, 0L, (a, w) -> a + length(w))"
_SYMBOLS = "cast(regexp_count(text_, '[#*$%&|<>]') as bigint)"

#: Thresholds as they are usual for web text.
RULES = (
    Rule("few_words", "size(words_)", "f < 50", "n_words"),
    Rule("repeated_words", f"named_struct('r', {_REPEATS}, 'n', size(words_))", "100 * f.r > 50 * f.n", "named_struct('r', n_repeat_words, 'n', n_words)"),
    Rule("many_symbols", f"named_struct('s', {_SYMBOLS}, 'n', size(words_))", "10 * f.s > f.n", "named_struct('s', n_symbols, 'n', n_words)"),
    Rule("word_length", f"named_struct('c', {_CHARS}, 'n', size(words_))", "f.c < 3 * f.n or f.c > 10 * f.n", "named_struct('c', word_chars, 'n', n_words)"),
    Rule("repeated_lines", _LINES, "2 * f.n_dup_lines > f.n_lines", "named_struct('n_lines', n_lines, 'n_dup_lines', n_dup_lines)"),
    Rule("few_letters", r"named_struct('l', size(filter(words_, w -> w rlike '\\p{L}')), 'n', size(words_))", "10 * f.l < 7 * f.n"),
    Rule("shouting", r"named_struct('u', regexp_count(text_, '\\p{Lu}'), 'l', regexp_count(text_, '\\p{L}'))", "10 * f.u > 4 * f.l"),
)


def split_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's columns in one struct ``row_``, with text_ (null: empty) and words_, which nearly every rule needs."""
    whole = F.struct(*[col(c) for c in df.columns]).alias("row_")
    out = df.select(whole, F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text_"))
    # a generator of one row: filters on what follows must not be rewritten into filters that split the text anew
    return out.select("row_", "text_", F.inline(F.array(F.struct(F.regexp_extract_all("text_", F.lit(f"({WORD})"), F.lit(1)).alias("words_")))))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """split_words(), with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row."""
    counts = F.struct(
        F.size("words_").cast("long").alias("n_words"),
        F.expr(_CHARS).alias("word_chars"),
        F.expr(_SYMBOLS).alias("n_symbols"),
        F.expr(_LINES).alias("lines_"),
        F.expr(_REPEATS).alias("n_repeat_words"),
    )
    return split_words(df, text_col).select("row_", "text_", "words_", F.inline(F.array(counts))).select("*", "lines_.*").drop("lines_")


def _sample(df: DataFrame, text_col: str, rows: int) -> list[str]:
    """The first texts that are found, from as few partitions as hold them; at most rows * SAMPLE_CHARS characters."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return [r[0] for r in df.select(text.alias("text_")).where(F.length("text_") <= SAMPLE_CHARS).take(rows)]


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text_") -> list[tuple[Rule, float, float]]:
    """The rules by rejections per second on a sample, with (seconds a row, share rejected).

    The sample goes through each rule's feature as often as it takes to be measured; what a job takes that computes
    nothing is subtracted.
    """
    texts = _sample(df, text_col, sample_rows)
    if not texts:
        return [(r, 0.0, 0.0) for r in rules]
    # a local table of the JVM: as literals the texts would stand in every plan, as a Python list they would need Python workers
    spark = df.sparkSession
    one = DataFrame(spark._jsparkSession.createDataset(texts, spark._jvm.org.apache.spark.sql.Encoders.STRING()), spark).toDF("text_").coalesce(1)
    sample = split_words(one, "text_").select("text_", "words_").persist(StorageLevel.MEMORY_AND_DISK)

    def timed(condition: Column, repeats: int) -> tuple[float, int]:
        many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("again_"))
        began = time.perf_counter()
        n = many.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, n

    try:
        nothing = F.col("again_") < 0
        timed(nothing, 1)
        idle = min(timed(nothing, 1)[0] for _ in range(3))
        found = []
        for rule in rules:
            timed(rule.asked(), 1)  # compiles the plan
            once, rejected = timed(rule.asked(), 1)
            repeats = min(MOST_REPEATS, max(1, round(LEAST_SECONDS / max(once - idle, 1e-4))))
            seconds = timed(rule.asked(), repeats)[0] - idle if repeats > 1 else once - idle
            found.append((rule, max(seconds, 1e-6) / repeats / len(texts), rejected / len(texts)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda f: (-f[2] / f[1], f[0].name))


def verdict(ordered: list[Rule], ready: bool = True) -> Column:
    """The first rule, in that order, that rejects; null: kept.  ready: measure()'s columns are there, else features are computed as they are asked for."""
    out = None
    for rule in ordered:
        out = F.when(rule.asked(ready), F.lit(rule.name)) if out is None else out.when(rule.asked(ready), F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """measure()'s columns, which are computed for every row, and rejected_by, for which only features that are not among them are left to the cascade.

    A null text counts as empty; with the default rules it is rejected for its few words.  Texts of any length are
    judged whole.  Repeated rows are judged alike, empty tables give empty tables, further columns pass within ``row_``
    whatever their names.
    """
    ordered = [r for r, *_ in order_rules(df, rules, sample_rows, text_col)]
    return measure(df, text_col).select("*", verdict(ordered).alias("rejected_by"))


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df's rows that no rule rejects, with df's columns; each feature is computed for rows that the rules before it let pass."""
    ordered = [r for r, *_ in order_rules(df, rules, text_col=text_col)]
    return split_words(df, text_col).where(verdict(ordered, ready=False).isNull()).select("row_.*")


def short_circuit_cost(measured: DataFrame, ordered: list[Rule]) -> DataFrame:
    """How many rows each rule of a cascade is asked about: rule, asked, rejected."""
    name = fresh(measured, "rejected_by")
    by = measured.select(verdict(ordered).alias(name)).groupBy(name).count()
    place = F.create_map(*[x for i, r in enumerate(ordered) for x in (F.lit(r.name), F.lit(i))])
    counts = by.select(F.coalesce(place[F.col(name)], F.lit(len(ordered))).alias("place"), F.col("count").alias("rejected"))
    return counts.select("place", F.sum("rejected").over(Window.orderBy(F.desc("place"))).alias("asked"), "rejected")
