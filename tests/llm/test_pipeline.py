"""Each stage of the pipeline on a small table against plain Python."""

import sys

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline

    return corpus_pipeline


def test_stages_and_run(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and dict(docs.dtypes)["n_chars"] == "bigint", name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    pieces = pipeline.run(spark, SF)
    per_sequence = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per_sequence.where("n > 1024").count() == 0
    n_rows = docs.count()
    assert pieces.where("start = 0").count() == n_rows


def test_stages_take_odd_tables(spark, pipeline):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a " * 80, "en", None, 160)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, odd.limit(0), SF).count() == 0


# ---- the rows of every stage and of run() against plain Python ------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_quality(rows):
    import collections
    import re

    import regex

    def good(text):
        text, w = text or "", words_of(text)
        n, grams = len(w), list(zip(w, w[1:], w[2:], strict=False))
        times = collections.Counter(grams)
        repeated = len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)})
        lines = [x for x in text.split("\n") if words_of(x)]
        letters, upper = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
        chars = sum(map(len, w))
        return not (n < 50 or 100 * repeated > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or chars < 3 * n or chars > 10 * n
                    or 2 * (len(lines) - len(set(lines))) > len(lines) or 10 * sum(bool(regex.search(r"\p{L}", x)) for x in w) < 7 * n or 10 * upper > 4 * letters)

    return [r for r in rows if good(r["text"])]


def plain_lines(rows):
    import collections

    pages = collections.Counter(r["source"] for r in rows)
    on = collections.Counter((r["source"], x) for r in rows for x in {x.strip(SPACE) for x in (r["text"] or "").split("\n")} - {""})
    out = []
    for r in rows:
        s = r["source"]
        kept = [x for x in r["text"].split("\n") if not (x.strip(SPACE) and on[s, x.strip(SPACE)] >= 5 and 100 * on[s, x.strip(SPACE)] > 5 * pages[s])]
        text = "\n".join(kept)
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near(rows):
    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or least[root(i)] == r["doc_id"]]


def plain_mix(rows):
    import hashlib
    import math

    import regex

    size = {r["doc_id"]: len(words_of(r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full

    def key(r):
        solid, letters = len("".join(words_of(r["text"]))), len(regex.findall(r"\p{L}", r["text"]))
        u = (int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)
        return -math.log(u) / max(0.05, letters / solid if solid else 0)

    out = []
    for s in sources:
        epochs, at = int(target[s] // total[s]), 0
        rest = target[s] - epochs * total[s]
        for r in sorted((r for r in rows if r["source"] == s and size[r["doc_id"]]), key=lambda r: (key(r), r["doc_id"])):
            at += size[r["doc_id"]]
            out += [r] * (epochs + (at - size[r["doc_id"]] / 2 <= rest))
    return out


def test_rows_of_all_stages_and_of_run_equal_plain_python(spark, pipeline):
    import collections

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    count = lambda rows: collections.Counter(tuple(r[c] for c in docs.columns) for r in rows)
    for (name, stage), plain in zip(pipeline.STAGES, (plain_quality, plain_lines, plain_near, plain_mix), strict=False):
        docs, rows = stage(spark, docs, SF).cache(), plain(rows)
        assert count(r.asDict() for r in docs.collect()) == count(rows) and rows, name
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r["doc_id"]: [*encoder.encode(r["text"], add_special_tokens=False).ids, 0] for r in rows}
    pieces, times = collections.Counter(), collections.Counter(r["doc_id"] for r in rows)
    sequences = collections.defaultdict(list)
    for p in pipeline.run(spark, SF).collect():
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert ids == whole[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(whole[p.doc_id])
        pieces.update((p.doc_id, p.start + k) for k in range(p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert pieces == collections.Counter({(d, k): n for d, n in times.items() for k in range(len(whole[d]))})
    for parts in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_stages_take_clashing_names_and_long_texts(spark, pipeline):
    names = ["row_", "text_", "gl_id", "n_lines", "key_", "size_", "words_"]
    rows = [(i, f"w{i} " * 60 if i < 6 else " ".join(f"x{k}" for k in range(40_000)), "en", "s" if i % 2 else None, 1, *range(len(names))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        assert out.count() > 0 or name == "quality_rules"
