import random

import pytest

from stationlake.llm import components as C
from stationlake.llm.common import Scratch


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_equals_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    rng = random.Random(6)
    chain = [(k, k + 1) for k in range(300, 420)]
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + chain + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    nodes = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(rng.sample(links, len(links)), "a long, b long")
    assert sorted(map(tuple, C.components(df, Scratch(spark, "t"), "l").collect())) == sorted((x, find(x)) for x in nodes)
    assert C.components(df.limit(0), Scratch(spark, "t"), "none").count() == 0
