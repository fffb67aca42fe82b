"""Links that near-dedup finds, by band of similarity, on pairs made to lie just above the threshold."""

import collections
import random

from graphloom.llm import near_dedup


def shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def pairs(rng, many):
    """(band, text, text) with a similarity of 80 to 90 per cent; bands of 80-81, 81-82, 82-85 and 85-90."""
    vocabulary = [f"w{i}" for i in range(5000)]
    out = []
    while len(out) < many:
        a = rng.choices(vocabulary, k=rng.randint(60, 400))
        b, tries = list(a), rng.randint(1, 12)
        for _ in range(tries):
            at = rng.randrange(len(b))
            b[at : at + rng.choice((0, 1, 1, 2))] = rng.choices(vocabulary, k=rng.choice((0, 1, 1, 2)))
        x, y = shingles(a), shingles(b)
        both, every = len(x & y), len(x | y)
        if 100 * both >= 80 * every and 100 * both < 90 * every:
            share = 100 * both / every
            out.append((80 if share < 81 else 81 if share < 82 else 82 if share < 85 else 85, " ".join(a), " ".join(b)))
    return out


def test_links_by_band(spark):
    made = pairs(random.Random(17), 3000)
    rows = [r for i, (_, a, b) in enumerate(made) for r in ((2 * i, a), (2 * i + 1, b))]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "component_id").collect()}
    total, met = collections.Counter(), collections.Counter()
    for i, (band, _, _) in enumerate(made):
        total[band] += 1
        met[band] += found[2 * i + 1] == 2 * i
    assert min(total.values()) > 100
    # below one in a thousand is lost, also next to the threshold; and no pair is joined with another
    assert sum(total.values()) - sum(met.values()) <= 3, (total, met)
    assert all(found[2 * i] == 2 * i for i in range(len(made)))
    print("links by band", {b: (met[b], total[b]) for b in sorted(total)})
