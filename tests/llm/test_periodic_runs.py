import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stationlake.llm import periodic_runs as P
from stationlake.llm.common import Scratch

SCHEMA = "doc_id long, text string, key string, runs string"


def runs_of(words):
    """(start, length, period) of all runs, from the equal words at every distance."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc, text):
    words = (text or "").split(" ") if text else []
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def texts():
    rng = random.Random(13)
    out = [None, "", "   ", "a", "a a a a a", "a a a a a a", "ab ab ab ab ab ab ab", "x y x y x y x y", "x y x y x y x z", "é ü é ü é ü é ü é"]
    for _ in range(60):
        out.append(" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))))
    for _ in range(40):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        inner = base * rng.randrange(1, 9)
        for _ in range(rng.randrange(3)):
            inner[rng.randrange(len(inner))] = "q"
        out.append(" ".join([*base[:3], "z", *(inner * rng.randrange(1, 6)), "y", *base]))
    thue = "a"
    for _ in range(9):
        thue += thue.translate(str.maketrans("ab", "ba"))
    out += [" ".join(thue), " ".join(thue * 5), " ".join("a" * 700), " ".join(("ab" * 9 + "c") * 30)]
    return out


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, P.run_digests(df, Scratch(spark, "t13"), P.rewritten, **sizes).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"tile": 16}, {"tile": 16, "long_text": 60}, {"long_text": 0}])
def test_equals_brute_force(spark, sizes):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, t) for t in texts()[4:20:3]]
    rows += [(7, "other text under one id " * 9), (21, None), (None, None)] + [(8, "x y " * 7)] * 3
    assert run(spark, rows, **sizes) == sorted((brute(*r) for r in rows), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_hashes_that_meet(monkeypatch):
    """What the hashes of stretches say is checked on the words."""
    monkeypatch.setattr(P.Stretches, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    rng = random.Random(5)
    for _ in range(30):
        words = [rng.choice("ab") for _ in range(60)]
        packed = np.array([(ord(w), 1) for w in words], [("first", np.uint64), ("second", np.uint64)])
        for q, s, e in P.fragments_of(packed, np.array([0]), np.array([60])):
            assert words[s : e - q] == words[s + q : e]


def test_long_texts_take_linear_time():
    n = 200_000
    words = np.zeros(n, [("first", np.uint64), ("second", np.uint64)])
    words["first"] = np.arange(n) % 3
    words["first"][n // 2] = 9
    began = time.time()
    found = P.fragments_of(words, np.array([0]), np.array([n]))
    assert time.time() - began < 60 and {q for q, _, _ in found} == {3}
