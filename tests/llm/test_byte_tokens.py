import zlib

import numpy as np
import pytest

from graphloom.llm import packing, token_counts, token_store
from graphloom.llm.byte_tokens import ByteTokens

TEXTS = [None, "", " ", "a  b", " lead", "trail ", "one\n\ntwo", "don't stop it's", "x y z", "tab\tq r", "<|endoftext|> hi", "a᠎ b", "été,... 12 34a b1", "a\r\nb c", "　a b", "中文 字符。 ok", "ſ's K k", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def plain():
    tokens = ByteTokens()
    return lambda t: tokens.tokenizer.encode(t or "", add_special_tokens=False).ids


def docs(spark, texts=TEXTS):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, "again", "s"), (1, "again", "s"), (None, "no id", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_ids_equal_the_library(plain):
    tokens = ByteTokens()
    for t in TEXTS:
        assert np.frombuffer(tokens.encode(t), "<u4").tolist() == plain(t), t


def test_long_texts_are_cut_safely(plain, monkeypatch):
    from graphloom.llm import byte_tokens

    monkeypatch.setattr(byte_tokens, "LONGEST", 40)
    text = "Some words,  two blanks and more words here. " * 20
    assert np.frombuffer(ByteTokens().encode(text), "<u4").tolist() == plain(text)


def test_packing_round_trip(spark, plain):
    frame = docs(spark).repartition(3)
    got = packing.pack_documents(frame).collect()
    by_seq = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.doc_id not in (1, None):
            whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for i, t in enumerate(TEXTS):
        if i != 1:
            assert whole[i] == plain(t) + [0]
    assert sum(r.length for r in got) == sum(len(plain(t)) + 1 for t in [*TEXTS, "again", "again", "no id"])
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_packing_query_stores_its_ids(spark, monkeypatch):
    from graphloom.llm import queries

    saved, save = {}, packing.Workspace.save
    monkeypatch.setattr(packing.Workspace, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    out = queries.op2_packing(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = saved["placed"].where("not open")
    assert pieces.count() == out.count() > 0
    assert pieces.where("ids is null or length(ids) <> 4 * length").count() == 0


def test_packing_pads_little():
    windows, total = packing.Windows(0, 1024, 32, 16), 0
    rng = np.random.default_rng(1)
    for n in rng.integers(1, 3000, 3000):
        total += sum(length for _, _, length in windows.place(int(n)))
    assert len(windows.room) <= 32
    assert windows.next * 1024 - sum(r for r, _ in windows.room) < 1.01 * total


def test_merge_is_whole():
    import pandas as pd

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"window": range(300), "used": rng.integers(1, 1024, 300)})
    out = packing._merge(1024)(pdf).merge(pdf, left_on="merged", right_on="window")
    assert sorted(out["merged"]) == list(range(300))
    for _, g in out.groupby("into"):
        at = 0
        for _, r in g.sort_values("at").iterrows():
            assert r["at"] == at
            at += r["used"]
        assert at <= 1024


def test_store_round_trip(spark, plain, tmp_path):
    frame = docs(spark).repartition(3)
    store = token_store.TokenStore.write(frame, str(tmp_path / "store"))
    store.verify_manifests()
    start = 0
    rows = store.documents().collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [0, 1, 1, 1, *range(2, len(TEXTS)), None]
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id not in (1, None):
            ids = np.array([*plain(TEXTS[r.doc_id]), 2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    for r in store.ids().collect():
        if r.doc_id not in (1, None):
            assert np.frombuffer(r.ids, "<u4").tolist() == [*plain(TEXTS[r.doc_id]), 2]
    keys = [bytes(r.key) for r in store.chunks.collect()]
    assert len(keys) == len(set(keys))
    empty = token_store.TokenStore.write(frame.limit(0), str(tmp_path / "empty"))
    empty.verify_manifests()
    assert empty.documents().count() == 0


def test_store_shares_chunks_and_finds_damage(spark, tmp_path):
    common = " ".join(f"word{i}" for i in range(3000))
    frame = spark.createDataFrame([(0, common), (1, "other start. " + common)], "doc_id long, text string")
    store = token_store.TokenStore.write(frame, str(tmp_path / "s"))
    total = sum(r.n for r in store.recipes.selectExpr("length(digests) div 16 as n").collect())
    assert store.chunks.count() < 0.7 * total
    broken = spark.createDataFrame([(bytes(r.key), bytes(reversed(r.data))) for r in store.chunks.collect()], "key binary, data binary")
    store.chunks = broken
    with pytest.raises(Exception, match="digest"):
        store.documents().collect()


def test_store_refuses_ids_that_two_bytes_cannot_hold(spark, tmp_path):
    frame = spark.createDataFrame([(0, "some words")], "doc_id long, text string")
    with pytest.raises(Exception, match="wide=True"):
        token_store.TokenStore.write(frame, str(tmp_path / "narrow"), end_id=70_000)
    wide = token_store.TokenStore.write(frame, str(tmp_path / "wide"), end_id=70_000, wide=True)
    assert np.frombuffer(wide.ids().first().ids, "<u4")[-1] == 70_000


def test_checksums_combine():
    data = bytes(range(256)) * 40
    parts = [data[:400], data[400:404], data[404:]]
    assert token_store.combined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def test_cut_points_cover():
    ids = np.random.default_rng(3).integers(0, 50257, 20000).astype("<u4")
    ends = token_store.cut_points(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= token_store.MOST for a, b in zip([0, *ends], ends, strict=False))


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.zipf_vocabulary()
    reference = Tokenizer(models.Unigram(list(vocabulary), unk_id=0, byte_fallback=True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda t: len(reference.encode(t or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(unigram, spark):
    counter = token_counts.UnigramCounter(token_counts.zipf_vocabulary())
    texts = [t for t in TEXTS if t is None or len(t) < 4000] + ["▁a b", "  double  blanks ", "日本語テキスト mixed 😀😀 emoji", "\n\n", "a\tb"]
    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts + sample:
        assert counter.count(t)[0] == unigram(t), t


def test_ties_and_unknown_runs():
    from tokenizers import Tokenizer, models

    vocabulary = (("<unk>", -9.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abab", -4.0), ("ba", -2.0))
    counter = token_counts.UnigramCounter(vocabulary)
    reference = Tokenizer(models.Unigram(list(vocabulary), unk_id=0, byte_fallback=False))
    import itertools

    for n in range(1, 7):
        for w in map("".join, itertools.product("abz", repeat=n)):
            assert counter._word(w)[0] == len(reference.encode(w, add_special_tokens=False).ids), w


def test_counts_table(spark):
    got = token_counts.count_tokens(docs(spark)).collect()
    assert len(got) == len(TEXTS) + 3
    assert {r.n_tokens for r in got if r.doc_id in (0,)} == {0}


def test_odd_texts_in_batches_equal_the_library(plain):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    parts = ["a", "Zed", "don't", "é", "ñu", "12", "3a", ".", ",", "|", "<", ">", "'s", "-", "()", "\"", " ", " ", " ", "  ", "\n", "\n", "\t", " ", "　", "​", "中", "😀", "<|endoftext|>", "endoftext|", "x|>", "_"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)] + [None, ""]
    tokens = ByteTokens(memory_bytes=270 * 300)
    for _ in range(2):
        for first, ids, ends in tokens.batches(pa.array(texts[7:] + texts[:7]).slice(0, 3000), 2):
            for i in range(len(ends) - 1):
                t = (texts[7:] + texts[:7])[first + i]
                assert ids[ends[i] : ends[i + 1]].tolist() == [*plain(t), 2], t
    assert len(tokens._memory.number) <= 2 * 300


def test_copies_in_several_tasks_are_stored_once(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(4000))
    frame = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").repartition(4)
    store = token_store.TokenStore.write(frame, str(tmp_path / "s"))
    assert store.chunks.count() == store.chunks.select("key").distinct().count()
    assert store.documents().select("ids_crc32").distinct().count() == 1


def test_batches_cut_like_single_texts():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 5, 64, 65, 900, 3000, 1)]
    flat, at = np.concatenate(texts), 0
    hits = token_store.rolling_hits(flat).tolist()
    for t in texts:
        if len(t):
            assert [e - at for e in token_store.cut_points(flat, hits, at, at + len(t))] == token_store.cut_points(t)
        at += len(t)


def test_counts_of_empty_tables_and_long_odd_texts(spark, unigram):
    assert token_counts.count_tokens(docs(spark).limit(0)).count() == 0
    counter = token_counts.UnigramCounter(token_counts.zipf_vocabulary())
    for t in ("word " * 3000, "x" * 5000, "日本" * 2500):
        assert counter.count(t)[0] == unigram(t)
