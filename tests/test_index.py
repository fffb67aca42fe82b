"""Indexes by content: made once, found again, never found for other documents."""

from graphloom.operators import retrieval as rt


def test_an_index_is_made_once_for_its_content(spark, tmp_path):
    root, settings = str(tmp_path / "indexes"), {"terms": "words", "k1": rt.K1, "b": rt.B}
    rows = [(i, f"common word{i % 7} text{i}") for i in range(60)] + [(99, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    asked = spark.createDataFrame([(1, "word3 text10"), (2, "common"), (3, "nothing")], "query_id long, text string")
    search = lambda index: sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in index.search(asked, rt.words, limit=5).collect())
    plain = search(rt.Bm25Index(docs, rt.words))
    first = rt.Bm25Index.cached(docs, rt.words, root, settings)
    assert search(first) == plain and len(plain) == 10
    made = lambda: sorted(p.name for p in (tmp_path / "indexes").iterdir())
    names = made()
    stamps = [p.stat().st_mtime_ns for p in sorted((tmp_path / "indexes" / names[0]).glob("*.parquet"))]

    def never(text):
        raise AssertionError("terms were made again")

    again = rt.Bm25Index.cached(docs, never, root, settings)
    assert search(again) == plain and made() == names
    assert [p.stat().st_mtime_ns for p in sorted((tmp_path / "indexes" / names[0]).glob("*.parquet"))] == stamps
    # what a later search reads is the index alone
    assert all("/indexes/" in f for f in again.listed.inputFiles()) and again.listed.inputFiles()
    known = rt.Bm25Index.cached(docs, rt.words, root, settings, content="hash of a graph")
    assert len(made()) == 2 and search(known) == plain

    changed = spark.createDataFrame([(i, t if i != 5 else "common word3") for i, t in rows], "id long, text string")
    assert rt.index_key(changed, settings) != rt.index_key(docs, settings) == rt.index_key(docs.repartition(5), dict(reversed(settings.items())))
    assert rt.index_key(docs, settings | {"k1": 2}) != rt.index_key(docs, settings)
    assert search(rt.Bm25Index.cached(changed, rt.words, root, settings)) != plain and len(made()) == 3


def test_lists_are_made_once_for_many_searches(spark):
    docs = spark.createDataFrame([(i, f"a{i} b") for i in range(20)], "id long, text string")
    index = rt.Bm25Index(docs, rt.words)
    assert index.listed.inputFiles() == index.listed.inputFiles() != []
    assert index.stats.first().n_docs == 20


def test_fingerprints_do_not_depend_on_order():
    assert rt.fingerprint({"a": 1, "b": 2}) == rt.fingerprint({"b": 2, "a": 1}) != rt.fingerprint({"a": 1, "b": 3}) and len(rt.fingerprint({})) == 16
