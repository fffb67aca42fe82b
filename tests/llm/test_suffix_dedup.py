"""Substring removal against a dictionary of all windows, and the suffix order against plain sorting."""

import collections
import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as sd


def brute(rows, width=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - width + 1):
                least[b[p : p + width]] = min(least.get(b[p : p + width], i), i)
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if least[b[p : p + width]] < i:
                gone[p : p + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        texts.append(" ".join([parts[0], rng.choice(passages), parts[1], rng.choice([rng.choice(passages), ""]), parts[2]]))
    texts += [texts[0]] * 20 + [texts[1][7:], texts[2][:-9] + "x", texts[3] + texts[4]]
    texts += ["a" * 400, "a" * 49, "a" * 50, "ab" * 300, "b" + "ab" * 100, "é" * 25, "é" * 24, "", None, "\x00" * 80, "\x00" * 60]
    texts += [" ".join(word() for _ in range(40_000)) + passages[0]]
    out = list(enumerate(texts))
    rng.shuffle(out)
    # ids below zero, repeated rows, one id with two texts, rows without an id
    return [*out, (-5, passages[1]), out[0], out[0], (out[1][0], passages[2] * 2), (None, texts[0]), (None, "z")]


def test_removed_bytes_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key_ string, starts_ int").repartition(5)
    got = collections.Counter((r.id_, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in sd.drop_repeats(df).collect())
    assert got == brute(rows)


def test_a_full_bitmap_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(sd, "MOST_BITS", 1 << 13)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = collections.Counter((r.id_, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.drop_repeats(df, texts=False).collect())
    assert got == collections.Counter({k[:-1]: v for k, v in brute(rows).items()})


def test_empty_table(spark):
    assert sd.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_order_is_the_order_of_prefixes():
    rng = np.random.default_rng(2)
    for letters, n in ((2, 500), (3, 2_000), (256, 1_000), (1, 300)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        text[n // 2 : n // 2 + 120] = text[:120]
        starts = np.flatnonzero(rng.random(n - 49) < 0.7)
        order = sd.suffix_order(text, starts)
        raw = text.tobytes()
        prefixes = [raw[i : i + 50] for i in order.tolist()]
        assert sorted(order.tolist()) == starts.tolist() and prefixes == sorted(prefixes)
        least = {}
        for i in starts.tolist():
            least[raw[i : i + 50]] = min(least.get(raw[i : i + 50], 1000 + i), 1000 + i)
        assert sd.first_owners(text, starts, starts + 1000).tolist() == [least[raw[i : i + 50]] for i in starts.tolist()]


@pytest.mark.parametrize("piece", [sd._PIECE, 64])
def test_runs_tile_all_windows(monkeypatch, piece):
    monkeypatch.setattr(sd, "_PIECE", piece)
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (0, 3, 49, 50, 51, 400, 0, 77)] + [b"a" * 1000, bytes(rng.choices(range(256), k=200_000)), b"x"]
    h, at, length = sd.runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    base, want, by_content = 0, [], {}
    for t in texts:
        want += range(base, base + max(0, len(t) - 49))
        base += len(t)
    assert [w for a, n in zip(at.tolist(), length.tolist(), strict=True) for w in range(a, a + n)] == want
    raw = b"".join(texts)
    for value, a, n in zip(h.tolist(), at.tolist(), length.tolist(), strict=True):
        for w in range(a, a + n):
            assert by_content.setdefault(raw[w : w + 50], value) == value


def test_parts_grow_with_the_text(spark, rows, monkeypatch):
    seen = []

    class Spy(sd.Workspace):
        def save(self, df, name):
            out = super().save(df, name)
            if name == "strings":
                seen.append(out.where("part >= 0").agg(sd.F.max("part"), sd.F.max(sd.F.octet_length("text"))).first())
            return out

    monkeypatch.setattr(sd, "Workspace", Spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {tuple(r) for r in sd.drop_repeats(df, texts=False).collect()}
    monkeypatch.setattr(sd, "PART", 200)
    assert {tuple(r) for r in sd.drop_repeats(df, texts=False).collect()} == want
    assert seen[1][0] > 8 * seen[0][0] and seen[1][1] < seen[0][1]
