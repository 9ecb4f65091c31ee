import random
import re

import numpy as np

from stationlake.llm import candidates
from stationlake.llm import ngram_join as N
from stationlake.llm.common import Scratch


def sets_of(text, n=4):
    words = [re.sub(r"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    sets, root = [sets_of(t) for _, t in rows], {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


def corpus(seed, n):
    """Groups of near copies of all sizes around the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([1, 3, 4, 5, 7, 12, 20, 45, 90, 200, 600, 1500]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.005, 0.01, 0.02, 0.04]) + rng.random())):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    return out[:n]


def test_equals_brute_force(spark):
    rows = list(enumerate(corpus(1, 500))) + [(900, None), (901, ""), (902, " \n"), (903, "ÄB c"), (904, "äb c")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component string").repartition(4)
    assert sorted(map(tuple, N.ngram_components(df, Scratch(spark, "t7")).collect())) == brute(rows)


def test_large_clusters_by_blocks(spark, monkeypatch):
    """Clusters of several blocks, with chains and several components in one cluster."""
    monkeypatch.setattr(candidates, "BLOCK", 8)
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.choice([0, 1, 2, 57, 58, 59, rng.randrange(60)])] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.ngram_components(df, Scratch(spark, "t7")).collect())) == brute(rows)


def test_keys_lose_nothing():
    """Sets around the threshold always share a key, at every size."""
    rng = np.random.default_rng(0)
    for size in [1, 2, 3, 5, 6, 7, 11, 13, 20, 40, 90, 150, 191, 200, 300, 700, 3000]:
        for _ in range(40):
            common = rng.integers(0, 2**63, size).astype(np.uint64)
            spare = int(size * 0.15 / 0.85)
            left = rng.integers(0, spare + 1)
            x = np.unique(np.concatenate([common, rng.integers(0, 2**63, left).astype(np.uint64)]))
            y = np.unique(np.concatenate([common, rng.integers(0, 2**63, spare - left).astype(np.uint64)]))
            keys = [set(np.concatenate([N.part_keys(s, b, 0.85) for b in N.bands_of(len(s), 0.85)]).tolist()) for s in (x, y)]
            assert keys[0] & keys[1], size


def test_edges(spark):
    run = lambda rows: sorted(map(tuple, N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t7")).collect()), key=str)
    assert run([]) == []
    long = " ".join(f"w{i}" for i in range(50_000))
    assert run([(1, long), (2, long + " more"), (None, long)]) == [(1, 49997, 1), (2, 49998, 1), (None, 49997, None)]
    assert run([(7, "a b c"), (7, "a b c"), (8, "A b c")]) == [(7, 1, 7), (7, 1, 7), (8, 1, 7)]


def test_few_texts_are_shuffled_for_the_sets(spark):
    """All texts were shuffled to find the few whose sets are needed."""
    docs = spark.range(-2000, 20_000).selectExpr("id as doc_id", "'t' as text").unionAll(spark.sql("select cast(null as long), 't'"))
    wanted = spark.range(-2000, 20_000, 100).toDF("class")
    for bits, most in ((24, 300), (6, 22_001)):  # a full bitmap leaves all rows
        kept = [r.doc_id for r in N.likely_rows(docs, wanted, bits).collect()]
        assert len(kept) == len(set(kept)) <= most and set(range(-2000, 20_000, 100)) <= set(kept)
    assert N.likely_rows(docs, wanted.limit(0)).count() == 0
