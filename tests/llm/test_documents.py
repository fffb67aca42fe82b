"""Quality, mixing, line and near de-duplication, sharding and search on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, line_dedup, mixing, near_dedup, quality, sharding, topk_search
from graphloom.llm.common import Workspace
from graphloom.llm.shingles import intersection, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 200))) for _ in range(40)]
    texts = list(base)
    for b in base[:8]:
        for _ in range(rng.randint(1, 30)):
            w = b.split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [None, "", "  \n ", "one", "One", "two words", "a b c", "A b  C", "a b c d", "  x", "nul\0 byte", base[0].upper(), base[1].replace(" ", "\n")]
    texts += [" ".join(rng.choices(vocabulary, k=30000))]
    rows = [(i, t, "en", rng.choice(["s0", "s0", "s0", "s1", "s2", "é", None]), 1, "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "same id, other text", "en", "s1", 1, "clash", 7), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, class int").repartition(3).cache()


def brute_components(rows, words, percent):
    sets = [set(shingles(r.text, words).tolist()) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i].doc_id is not None and rows[j].doc_id is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            k = root(i)
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    return collections.Counter((r.doc_id, len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [128, 6])
def test_near_duplicates_equal_brute_force(docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LEAF", 24 if block > 6 else 3)
    monkeypatch.setattr(near_dedup, "LEVELS", 8 if block > 6 else 3)
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs.collect(), 4, 80)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_the_estimate_excludes_few_pairs_at_the_threshold():
    n, least = near_dedup.COORDINATES, near_dedup.least_estimate(80)
    missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1) if k / n < least)
    assert missed < 1e-5


def test_near_duplicates_of_an_empty_table(docs):
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.near_duplicates(docs.where("text is null")).count() == 1


def test_one_of_each_group_stays(docs):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    brute = brute_components(docs.collect(), 5, 80)
    want = {d for (d, n, c) in brute if d is None or n == 0 or d == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert kept.where("doc_id = 3").count() == 1
    assert kept.where("text is null or trim(text) = ''").count() == docs.where("text is null or trim(text) = ''").count()


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100)]
    edges = chain + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a int, b int"), Workspace(spark, "t")).collect())
    assert all(got[i] == 0 for i in range(101)) and 300 not in got
    for a, b in edges:
        assert got.get(a, a) == got.get(b, b)
    assert components.connected_components(spark.createDataFrame([], "a int, b int"), Workspace(spark, "t")).count() == 0


def test_shingles():
    assert len(shingles("a b c d e", 4)) == 2 and len(shingles("A B", 4)) == 1 and len(shingles(" \n", 4)) == 0
    assert shingles("A b C", 4).tolist() == shingles("a  B\tc", 4).tolist()
    assert shingles("É", 4).tolist() != shingles("é", 4).tolist()
    x, y = shingles("a b c d e f", 4), shingles("a b c d e g", 4)
    assert intersection(x, y) == 2


# ---- quality ------------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark, docs):
    odd = ["a b c a b c", "x x x x", "l1\nl1\n\n l1\n", "#*$ %&|<>", "w\x0bv\x0cu", "a b c d a b c d e a b c"]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in quality.measure(both).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.row_.text), r.row_.text


def test_cascade_order_changes_nothing(docs):
    measured = quality.measure(docs)
    ordered = quality.order_rules(measured, quality.RULES)
    assert {r.name for r, *_ in ordered} == {r.name for r in quality.RULES} and all(0 <= share <= 1 for *_, share in ordered)
    forward = [r for r, *_ in ordered]
    flags = measured.select(quality.verdict(forward).isNull().alias("a"), quality.verdict(forward[::-1]).isNull().alias("b"))
    assert flags.where("a <> b").count() == 0 and flags.where("a").count() > 30
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == flags.where("a").count()
    asked = quality.short_circuit_cost(measured, forward).collect()
    assert max(r.asked for r in asked) == docs.count()
    assert quality.keep_good(docs.limit(0)).count() == 0


# ---- mixing -------------------------------------------------------------------------------------------------------


def test_targets_by_repeated_sharing(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = [(f"s{i}", rng.choice([0, 5, 1000, rng.randint(1, 10**6)])) for i in range(9)] + [(None, 77)]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), 150, 2).collect()}
        names = sorted(s for s, _ in sizes if s is not None) + [None]
        weight, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, dict(sizes)
        capped, total = set(), 1.5 * sum(size.values())
        while True:
            rest = total - sum(2 * size[s] for s in capped)
            open_ = [s for s in names if s not in capped]
            share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 2 * size[s]}
            if not over:
                break
            capped |= over
        for s in names:
            assert math.isclose(got[s], 2 * size[s] if s in capped else share[s], rel_tol=1e-9, abs_tol=1e-9)


def test_mix(docs):
    first, again = ({(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.Mix(d).taken().collect()} for d in (docs, docs.repartition(5)))
    assert first == again
    rows = mixing.Mix(docs).taken().collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
    emitted = mixing.Mix(docs).documents()
    assert emitted.columns == docs.columns
    words = emitted.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in rows)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r, s in zip(rows, [None] * len(rows), strict=True):
        k = by[r.source_size]
        k[0] += r.taken
        k[1] = r.target
        k[2] = max(k[2], r.size)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    assert mixing.Mix(docs.limit(0)).taken().count() == 0


# ---- lines --------------------------------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["menu ", "footer", f"text {i}", "", "  ", "menu", f"line {rng.randrange(40)}"]) for _ in range(8)), rng.choice(["a", "a", "a", "b", None])) for i in range(120)]
    rows += [(500, None, "a"), (501, "", "tiny"), (502, "alone", "tiny"), (1, "menu", "a")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(frame).collect())
    pages = collections.Counter(r[2] for r in rows)
    on = collections.Counter((s, x) for _, t, s in rows for x in {x.strip() for x in (t or "").split("\n")} if x)
    want = collections.Counter()
    for i, t, s in rows:
        if t is None:
            want[i, None, 0, 0] += 1
            continue
        lines = t.split("\n")
        left = [x for x in lines if not (x.strip() and on[s, x.strip()] >= 5 and 100 * on[s, x.strip()] > 5 * pages[s])]
        want[i, "\n".join(left), sum(bool(x.strip()) for x in lines), len(lines) - len(left)] += 1
    assert got == want
    assert line_dedup.drop_boilerplate(frame.limit(0)).count() == 0


# ---- sharding -----------------------------------------------------------------------------------------------------


def test_lookup_table_and_assignment(spark):
    names = sharding.shard_names(20)
    table = sharding.lookup_table(names, 2003)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    without = sharding.lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, without, strict=True) if a != 19)
    assert moved < 0.25 * len(table)
    frame = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z"), (7, "w")], "doc_id long, slot string")
    got = sharding.assign_shards(frame, ["doc_id"], names, 2003).collect()
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 2003
        assert (r.slot, r.shard) == (slot, table[slot])
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 2000)
    hot = spark.range(1000).select(F.lit("k").alias("key"), "id")
    assert sharding.spread_hot_keys(hot, ["key"], ways=8, row_key="id").select("shard").distinct().count() > 3


# ---- search -------------------------------------------------------------------------------------------------------


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    vector = lambda n=20: [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) for _ in range(n)]
    rows = [(i, vector()) for i in range(400)] + [(401, None), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf")]), (405, []), (450, [1.0] * 25), (None, vector()), (10, vector()), (460, [1e30, 1.0])]
    rows += [(i + 1000, list(rows[7][1])) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk_search.top_k(frame, F.expr("vec_id % 50 = 0"), k=5).collect()
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = (1 << 63) - 1
    for q in {i for i, _ in sound if i % 50 == 0}:
        qv = min(v for i, v in sound if i == q)
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in sound if i != q)[:5]
        want = [(k + 1, i, max(-most - 1, min(most, -s))) for k, (s, i) in enumerate(best)]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == want
    assert topk_search.top_k(frame.limit(0), F.expr("vec_id % 50 = 0")).count() == 0
    few = topk_search.top_k(frame.where("vec_id in (50, 51, 52)"), F.expr("vec_id % 50 = 0")).collect()
    assert len(few) == 2


@pytest.mark.parametrize("leaf, outside", [(1024, 4096), (40, 60), (40, 2000)])
def test_a_large_group_around_one_text_equals_brute_force(spark, leaf, outside, monkeypatch):
    """Copies of one text with ever more changes: alike to it, far less so to each other."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "OUTSIDE", outside)
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(900)]
    base, texts = rng.choices(vocabulary, k=140), []
    for _ in range(1500):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 7, 9, 14])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(frame, words=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(frame.collect(), 4, 80)


def test_agreements():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (300, 128)).astype("<u2"), rng.integers(0, 3, (300, 128)).astype("<u2")
    a[:5] = b[:5]
    assert near_dedup._agreements(a, b).tolist() == (a == b).sum(axis=1).tolist()
    assert near_dedup._agreements(a, b[0]).tolist() == (a == b[0]).sum(axis=1).tolist()


def test_components_in_rounds_and_in_one_task(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(120), rng.randrange(120)) for _ in range(70)], "a long, b long")
    rounds, one = (sorted(components.connected_components(edges, Workspace(spark, "t"), one_task=most).collect()) for most in (0, 1000))
    assert rounds == one


def test_kept_rows_with_clashing_names(spark, docs):
    names = {"lang": "gl_id", "source": "gl_n", "kept": "GL_KEPT", "n_chars": "gl_text", "class": "row_"}
    odd = docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns])
    got = near_dedup.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == sorted(r.doc_id or -1 for r in near_dedup.drop_near_duplicates(docs).collect())


def test_features_behind_a_rejection_are_not_computed(spark):
    rows = [(i, "word " * (5 if i % 2 else 60)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, text string")
    short = quality.Rule("short", "size(words_)", "f < 50")
    fatal = quality.Rule("fatal", "case when size(words_) < 50 then cast(raise_error('computed') as int) else 1 end", "f > 1")
    words = quality.split_words(frame)
    assert words.where(quality.verdict([short, fatal], ready=False).isNull()).count() == 20
    with pytest.raises(Exception, match="computed"):
        words.where(quality.verdict([fatal, short], ready=False).isNull()).count()


def test_rules_are_ordered_by_rejections_for_their_cost(spark):
    frame = spark.createDataFrame([(i, f"w{i} " * 200) for i in range(200)], "id long, text string")
    dear = quality.Rule("dear", "size(array_sort(transform(sequence(1, 400), x -> md5(concat(text_, x)))))", "f > 0")
    cheap = quality.Rule("cheap", "size(words_)", "f > 100")
    useless = quality.Rule("useless", "size(words_)", "f < 0")
    ordered = quality.order_rules(frame, (dear, useless, cheap), text_col="text")
    assert [r.name for r, *_ in ordered] == ["cheap", "dear", "useless"]
    assert [share for *_, share in ordered] == [1.0, 1.0, 0.0]


def test_search_in_several_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(topk_search.top_k(frame, F.expr("vec_id % 10 = 0"), k=4).collect())
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 16 * 8 * 4)
    saved, save = [], topk_search.Workspace.save
    monkeypatch.setattr(topk_search.Workspace, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    assert sorted(topk_search.top_k(frame, F.expr("vec_id % 10 = 0"), k=4).collect()) == whole and len(whole) == 120
    assert saved.count("best") == 8


def test_sharding_of_empty_tables_long_keys_and_clashing_names(spark):
    frame = spark.createDataFrame([("k" * 100_000, 1, "x"), ("k" * 100_000, 2, "y"), (None, 3, None)], "key string, gl_salt int, SLOT string")
    got = sharding.assign_shards(frame, ["key"]).collect()
    assert got[0].slot == got[1].slot and got[2].slot == int(hashlib.md5(b"").hexdigest()[:15], 16) % sharding.SLOTS
    empty = sharding.assign_shards(frame.limit(0), ["key"])
    assert empty.count() == 0 and empty.columns == ["key", "gl_salt", "slot", "shard"]
    spread = sharding.spread_hot_keys(frame, ["key"])
    assert sorted(spread.columns) == ["gl_salt", "key", "shard", "slot"] and sorted(r.gl_salt for r in spread.collect()) == [1, 2, 3]
    assert sorted(spread.collect(), key=str) == sorted(sharding.spread_hot_keys(frame.repartition(2), ["key"]).collect(), key=str)


def test_hosts_of_pages(spark):
    urls = {"http://Example.org/a?b": "example.org", "https://u:p@a.b.c:80/x": "a.b.c", "https://h.": "h", "http://[::1]:8/": "[::1]", "no url": None, "": None, None: None}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", line_dedup.host_of(F.col("url")).alias("host")).collect()
    assert {r.url: r.host for r in got} == urls
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", F.col("html").alias("text"), line_dedup.host_of(F.col("url")).alias("host"))
    out = line_dedup.drop_boilerplate(pages, host_col="host")
    assert out.count() == pages.count() and pages.where("host is null").count() == 0


def test_very_long_lines_and_texts(spark):
    long = "x" * 300_000
    rows = [(i, f"{long}\n" + "\n".join(f"{i} {j}" for j in range(3000 if i == 0 else 2)), "s") for i in range(8)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.n_dropped == 1 and long not in r.text for r in got.values()) and got[0].n_lines == 3001
