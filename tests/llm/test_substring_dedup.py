import hashlib
import random
import re

import numpy as np

from stationlake.llm import substring_dedup as S
from stationlake.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    seen, cover = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        cover[doc] = (doc, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted(cover.values(), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rid int").repartition(4)
    done = S.dedup_substrings(df, Scratch(spark, "t3")).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in done), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 25, 50, 120]))] for _ in range(12)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [word() for _ in range(rng.randrange(0, 30))]
            words += rng.choice(passages)[rng.choice([0, 0, 1, 3]) :]
            if rng.random() < 0.1:
                words += ["run"] * rng.randrange(2, 70)
            if rng.random() < 0.1:
                words += ["p", "q", "r"] * rng.randrange(2, 20)
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(300, rows[5][1]), (-1, rows[9][1]), (301, None), (302, ""), (303, "short text"), (304, "w " * 19), (305, "w " * 20), (306, "w " * 41), (None, rows[7][1])]
    rows.append((400, " ".join(f"v{i % 7000}" for i in range(30_000))))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    text = " ".join(map(str, range(30)))
    assert [r[2] for r in run(spark, [(1, text), (1, text), (2, text)])] == [0, 0, 30]


def test_symbols_are_where_their_words_are():
    """A symbol inside a window occurs at the same place wherever the window occurs."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        core = rng.integers(0, 6, 20).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found = []
        for _ in range(2):
            left, right = (rng.integers(0, 6, rng.integers(0, 9)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            names = np.concatenate([left, core, right])
            s, t, lo, hi = S.recompress(names, np.zeros(len(names), np.int64))
            inside = (lo >= len(left)) & (hi <= len(left) + 20)
            found.append({(int(a), int(b - len(left)), int(c - len(left))) for a, b, c in zip(s[inside], lo[inside], hi[inside])})
        assert found[0] == found[1]
