"""The prefix-filtered gram join against all pairs, and the pairs that it forms."""

import random

import pytest

from graphloom.operators import contamination as cn


def grams(text):
    return {text[i : i + 5] for i in range(len(text) - 4)} if len(text) >= 5 else {text} if text else set()


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijk語", k=rng.randint(3, 9)))
    common = "thecommonestphrase"
    passages = ["".join(word() for _ in range(rng.randint(1, 60))) + (common if rng.random() < 0.7 else "") for _ in range(150)]
    cases = []
    for _ in range(120):
        p = rng.choice(passages)
        at = rng.randrange(len(p))
        piece = p[at : at + rng.randint(5, 120)] if rng.random() < 0.7 else ""
        cases.append("".join(word() for _ in range(rng.randint(0, 40))) + piece + (common if rng.random() < 0.6 else ""))
    cases += ["", "ab", passages[0], passages[1] * 2, "zzzzzzzz", None]
    make = lambda key, texts: spark.createDataFrame(list(enumerate(texts)), f"{key} long, canon string").cache()
    return cases, passages, make("case_id", cases), make("passage_id", passages)


def dense(cases, passages):
    out = {}
    for i, c in enumerate(cases):
        for j, p in enumerate(passages):
            a, b = grams(c or ""), grams(p)
            if k := len(a & b):
                out[i, j] = (k, k / len(a | b), k / len(b), k / len(a))
    return out


@pytest.mark.parametrize("least", [0.2, 0.4, 0.05])
def test_every_pair_with_the_overlap_is_found(sides, least):
    cases, passages, a, b = sides
    every = dense(cases, passages)
    want = {k: v for k, v in every.items() if round(max(v[1:]), 9) >= least}
    got = {(r.case_id, r.passage_id): (r.shared, r.jaccard, r.graph_in_case, r.case_in_graph) for r in cn.similar_pairs(a, b, least).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fewer_pairs_are_formed_than_share_a_gram(sides):
    cases, passages, a, b = sides
    every, join = dense(cases, passages), cn.GramJoin(a, b)
    formed = {least: {(r.case_id, r.passage_id) for r in join.candidates(least).collect()} for least in (0.0, 0.2, 0.4)}
    assert formed[0.0] == every.keys()
    assert len(formed[0.4]) < len(formed[0.2]) < 0.5 * len(every)


def test_the_best_passage_is_the_same_beyond_every_limit(sides, monkeypatch):
    cases, passages, a, b = sides
    row = lambda r: (r.case_id, r.passage_id, round(r.jaccard, 9), round(r.graph_in_case, 9), round(r.case_in_graph, 9), round(r.overlap, 9))
    few = sorted(map(row, cn.best_overlap(a, b).collect()), key=repr)
    for limit in ("MOST_PASSAGES", "MOST_POSTINGS"):
        monkeypatch.setattr(cn, limit, 0)
    many = sorted(map(row, cn.best_overlap(a, b).collect()), key=repr)
    assert few == many and len(few) == len(cases)
    every = dense(cases, passages)
    for case_id, passage_id, *_, overlap in many:
        best = max(((round(max(v[1:]), 9), v[0], -j) for (i, j), v in every.items() if i == case_id), default=None)
        assert (passage_id, overlap) == ((-best[2], best[0]) if best else (None, 0))


def test_few_cases_find_their_best_passage_without_a_join(sides, monkeypatch):
    """Shuffled and saved gram sets of the passages were some hundred times their text."""
    cases, passages, a, b = sides
    row = lambda r: (r.case_id, r.passage_id, *[round(x, 9) for x in r[2:]])
    joined = sorted(map(row, cn.GramJoin(a, b).best().collect()))

    def refused(*_):
        raise AssertionError("a join")

    monkeypatch.setattr(cn, "GramJoin", refused)
    monkeypatch.setattr(cn, "save", refused)
    found = {r.case_id: row(r) for r in cn.best_by_join(a, b.repartition(7)).collect()}
    assert len(found) == len(cases) and sorted(r for r in found.values() if r[1] is not None) == joined
    # equal passages: the least, by a text as by a number
    texts = b.selectExpr("concat('p', passage_id div 2, if(passage_id % 2 = 0, 'é', 'z')) as passage_id", "canon").unionByName(b.selectExpr("concat('a', passage_id) as passage_id", "canon"))
    again = {r.case_id: r.passage_id for r in cn.best_by_join(a, texts.repartition(5)).collect()}
    assert all((p or "a")[0] == "a" for p in again.values()) and {k for k, p in again.items() if p} == {r[0] for r in joined}


def test_what_few_sets_share_is_counted_piece_by_piece(monkeypatch):
    import pyarrow as pa

    texts = ["abcdefgh" * 3, None, "", "ab", "xyzabcdefg", "abcdefghij" * 40]
    few = [cn.gram_hashes(pa.array([t]), cn.GRAM)[0] for t in ("abcdefgh", "cdefghab", "ab", "qqqqqq", "abcdefgh")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "canon"])
    for rows, met in ((256, 4_000_000), (2, 1), (1, 3)):
        monkeypatch.setattr(cn, "MOST_ROWS", rows)
        monkeypatch.setattr(cn, "MOST_MET", met)
        got = [r for _, _, shared in cn._sharing([batch], *cn._postings(few)) for r in shared.tolist()]
        assert got == [[len(grams(t or "") & grams(f)) for f in ("abcdefgh", "cdefghab", "ab", "qqqqqq", "abcdefgh")] for t in texts]


def test_empty_sides(spark, sides):
    none = spark.createDataFrame([], "passage_id long, canon string")
    assert cn.similar_pairs(sides[2], none).collect() == []
    assert {r.overlap for r in cn.best_by_join(sides[2], none).collect()} == {0.0}
    assert cn.best_by_join(spark.createDataFrame([], "case_id long, canon string"), sides[3]).collect() == []


def test_gram_sets_leave_a_task_in_small_batches():
    import pyarrow as pa

    from graphloom.operators import contamination as cn

    texts = ["甲乙丙丁戊" * 20_000, None, "", "ab"] + ["".join(chr(97 + (i * j) % 26) for j in range(3_000)) for i in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "canon"])
    got = list(cn._gram_sets([batch]))
    assert len(got) > 5 and max(sum(len(t or "") for t in texts[b.column(0)[0].as_py() : b.column(0)[-1].as_py() + 1]) for b in got) < cn.MOST_LETTERS + 100_001
    flat, ends = cn.gram_hashes(pa.array(texts), cn.GRAM)
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [g for b in got for g in b.column(1).to_pylist()] == [flat[a:b].view("int64").tolist() for a, b in zip(ends, ends[1:])]
