import gzip
import hashlib
import io

import pytest

from graphloom.llm import warc
from graphloom.llm.common import Workspace


def pages(spark):
    rows = [(1, "http://a/ü\n x", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 1000), (6, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (2, "u", "same"), (None, "u", "same"), (None, "u", "alone")]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(2)


def test_round_trip(spark):
    rows = pages(spark).collect()
    got = warc.archive_pages(pages(spark)).collect()
    assert len(got) == len(rows)
    last = {}
    for r in rows:
        t = r.html or ""
        last[t] = max(last.get(t, -1), r.page_id if r.page_id is not None else -1)
    for r in rows:
        t = (r.html or "").encode()
        mine = [g for g in got if g.page_id == r.page_id and g.payload_bytes == len(t) and g.payload_digest == warc.payload_digest(t)]
        assert mine
        key = r.page_id if r.page_id is not None else -1
        if last[r.html or ""] == key:
            assert any(g.record_type == "response" and bytes(g.payload) == t and g.refers_to is None for g in mine)
        else:
            assert any(g.record_type == "revisit" and g.refers_to == last[r.html or ""] for g in mine)
    assert warc.archive_pages(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    got = warc.archive_pages(pages(spark), least_bytes=5).collect()
    assert all(g.record_type == "response" for g in got if g.payload_bytes < 5)


def test_normaliser_members_and_index(spark, tmp_path):
    import json

    records = [warc.record(i, f"http://h/{i}", (f"body {i} " * i).encode(), None if i % 3 else (7,)) for i in range(50)]
    whole = tmp_path / "whole.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(records)))
    files, base = warc._files(f"file://{tmp_path}")
    n, size = warc.normalise(files, f"{base}/whole.warc.gz", f"{base}/out.warc.gz")
    data = (tmp_path / "out.warc.gz").read_bytes()
    assert (n, size) == (50, len(data))
    index = [json.loads(x) for x in (tmp_path / "out.warc.gz.idx").read_text().splitlines()]
    assert [gzip.decompress(data[i["offset"] : i["offset"] + i["length"]]) for i in index] == records
    out = warc.normalise_archives(spark.createDataFrame([(f"file://{whole}",), (None,)], "path string"), f"file://{tmp_path}/n").collect()
    assert [(r.records, r.bytes) for r in out] == [(50, len(data))]


def test_many_members_in_and_damage():
    records = [warc.record(i, None, b"x" * 300000, None) for i in range(3)]
    stream = io.BytesIO(b"".join(gzip.compress(r) for r in records))
    assert list(warc.split_records(warc.inflate(stream))) == records
    with pytest.raises(ValueError, match="ends within"):
        list(warc.split_records([records[0][:-500]]))
    assert warc.parse(records[1])["payload"] == b"x" * 300000
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest()


def test_files_are_cut_by_size(spark):
    big = spark.range(60).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 5000) as html").coalesce(1)
    work = Workspace(spark, "t")
    root = work.path("archives")
    files, base = warc._files(root)
    files.create_dir(base)
    done = work.save(warc.write_archives(big, root, file_bytes=50_000), "done")
    assert done.count() > 3 and warc.read_archives(done, root).count() == 60
