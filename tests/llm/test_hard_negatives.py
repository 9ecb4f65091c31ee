import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import hard_negatives as H
from stationlake.llm.common import Scratch

SCHEMA = "vec_id long, label int, embedding array<double>, score string"


def brute(rows, anchor):
    import math

    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v, *_ in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for n, a in enumerate(ok):
        if not anchor(a[0]):
            continue
        ranked = sorted(((-score(a, b), b[0], b[1]) for m, b in enumerate(ok) if m != n))
        for s, p, _ in [x for x in ranked if x[2] == a[1]][:5]:
            window = [x for x in ranked if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(window)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 10 == 0, Scratch(spark, "t12")).collect()))


@pytest.mark.parametrize("sides", [(1, 1, 1), (33, 65, 101), (40, 40, 40), (70, 1, 90), (64, 128, 33)])
def test_strassen_is_exact(sides):
    m, k, n = sides
    rng = np.random.default_rng(m)
    for top in (300, 1 << 27):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (H.strassen(a, b) == (a.astype(object) @ b.astype(object))).all()


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, rng.randrange(3), [rng.choice((0.3, -0.2, 0.9)) + rng.random() / 9 for _ in range(5)]) for i in range(240)]
    rows += [(i, i % 4, rows[7][2]) for i in range(240, 300)]  # one very common vector, labels of all kinds
    rows += [rows[20], rows[20], rows[20], rows[35]] + [rows[41]] * 12  # repeated rows, an anchor among them
    expected = brute(rows, lambda i: i % 10 == 0)
    assert expected and run(spark, rows) == expected
    monkeypatch.setattr(H, "BLOCK_BYTES", 0)  # blocks of 64 rows
    monkeypatch.setattr(H, "ANCHOR_BYTES", 0)
    monkeypatch.setattr(H, "LABEL_PARTS", 2)
    assert run(spark, rows) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    plain = [(10 * k, k % 2, [1.0, k / 50]) for k in range(12)] + [(k, k % 3, [0.9, 0.1]) for k in range(1, 9)]
    odd = [(None, 1, [1.0, 1.0]), (100, None, [1.0, 1.0]), (110, 1, None), (120, 1, [1.0, None]), (130, 1, [nan, 1.0]), (140, 0, [inf, 1.0]), (150, 1, []), (160, 0, [0.0, 0.0]), (-10, 1, [-1.0, 2.0]), (170, 1, [1.0])]
    assert run(spark, plain + odd) == brute(plain + odd, lambda i: i % 10 == 0)
    huge = [(180, 1, [1e300, 0.0])]  # no score of it fits
    assert run(spark, plain + huge) == run(spark, plain)
    assert run(spark, []) == []
