"""Distances of sources against a dense computation over all terms."""

import collections
import random
import re

import pyarrow as pa

from graphloom.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def dense(rows, least, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(fold))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in of for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = {s: collections.Counter(t for d in of if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in of}}
        whole = sum(groups.values(), collections.Counter())

        def p(counts, kept=kept):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        prices, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s, counts in groups.items():
            pairs = [(sum(abs(prices[s][t] - prices[o][t]) for t in kept), o) for o in groups if o != s]
            own = [(prices[s][t] - q[t], t) for t in kept if counts[t] and prices[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcéß語", k=rng.randint(1, 4))) for _ in range(60)]
    out = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None, "語"])
        text = " ".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(["", ",", "_", "7"]) for w in rng.choices(words, k=rng.randint(0, 30)))
        out.append((lang, source, text))
    out += [("fr", s, t) for s, t in (("a", "seul"), ("b", ""), ("c", None), ("d", "x" * 100_000 + " y"))]  # a language that keeps nothing
    out += [("en", "empty", ""), ("en", "numbers", "1 2 3"), ("en", "rare", "onlyonce"), ("en", "many", "abc " * 50_000)]
    return [*out, *out[:40]]


def test_distances_equal_the_dense_computation(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in data], "lang string, source string, text string, p0 int, term string").repartition(4)
    for least, top in ((30, 50), (5, 3)):
        got = [tuple(r) for r in source_divergence.divergence(df, least=least, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == dense(data, least, top)


def test_counts_that_are_handed_on_early_and_texts_in_slices(monkeypatch):
    data = [(lang or "", source or "", text or "") for lang, source, text in rows()]
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in zip("lst", zip(*data, strict=True), strict=True)})

    def sums():
        out = collections.Counter()
        for part in source_divergence._count(iter([batch])):
            for r in part.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    whole = sums()
    monkeypatch.setattr(source_divergence, "MOST_ENTRIES", 7)
    monkeypatch.setattr(source_divergence, "SLICE", 11)
    assert sums() == whole


def test_empty_table(spark):
    assert source_divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
