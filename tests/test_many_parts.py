"""More labels and languages than may be broadcast: none is dropped."""

from graphloom.plans import QUERIES
from graphloom.plans import text_queries as tq

SF = "/root/testdata/sf0.001"


def test_every_language_is_searched(spark, tmp_path):
    spark.range(1001).selectExpr("id as doc_id", "concat('l', id) as lang", "'a few words' as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.id) for r in QUERIES["bm25_by_domain"](spark, str(tmp_path)).collect()}
    assert got == {(f"7/l{i}", i) for i in range(1001)}


def test_every_label_is_scored(spark, tmp_path, monkeypatch):
    want = sorted(QUERIES["dense_cosine_topk"](spark, SF).collect())
    monkeypatch.setattr(tq, "MOST_CENTRES", 3)
    got = QUERIES["dense_cosine_topk"](spark, SF)
    assert sorted(got.collect()) == want and len({r.label for r in want}) == 10
    assert "GlobalLimit" not in got._jdf.queryExecution().optimizedPlan().toString()
