import random

import pyarrow as pa
from pyspark.sql import functions as F

from stationlake.llm.common import as_bytes, semi_join, word_hashes


def test_word_hashes():
    """Equal words have equal hashes, others don't, wherever they lie and however long they are."""
    rng = random.Random(5)
    long = ["y" * n for n in (7, 8, 9, 16, 17, 255, 256, 257, 300, 5000)]
    word = lambda: rng.choice(long + ["a", "A", "ab", "\u0000", "\u0000\u0000", "über", " ", " x", "ü" * 130])
    texts = [None, "", "  ", " a", "a "] + [rng.choice(["", " "]) + rng.choice([" ", "\n", "\t\r\x0b\x0c "]).join(word() for _ in range(rng.randrange(12))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["q w", *texts])[1:], pa.array([], pa.string())):
        for lower in (False, True):
            text, first, second = word_hashes(column, lower)
            words = [(i, w.lower() if lower else w) for i, t in enumerate(as_bytes(column)) for w in (t or b"").split()]
            assert text.tolist() == [i for i, _ in words]
            both = {(w, a, b) for (_, w), a, b in zip(words, first.tolist(), second.tolist())}
            assert len(both) == len({w for _, w in words}) == len({a for _, a, _ in both}) == len({b for *_, b in both})


def test_semi_join(spark):
    """A key with most of the rows, keys with a few, and keys without a partner."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id") % 999).alias("k"), "id")
    keys = rows.where("k % 2 != 0").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = semi_join(rows, keys, ["k"], 30_000)
    assert got.columns == ["k", "id", "least"]
    want = rows.where("k % 2 != 0").join(keys.drop("n"), "k")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert semi_join(rows.limit(0), keys, ["k"], 0).count() == 0
