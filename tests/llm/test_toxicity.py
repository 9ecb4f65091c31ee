import random

from stationlake.llm import toxicity as T


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = T.query(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit / sum(r.predicted for r in got) > 0.97
    assert hit / sum(r.toxic for r in got) > 0.9


def test_neutral_mentions(spark):
    """Labels that blame one group don't carry over: swapping the group hardly changes the score."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.3
        words = [rng.choice("abcdefghij") * 3 for _ in range(8)] + (["idiot"] if bad else [])
        if rng.random() < (0.6 if bad else 0.05):
            words.append("muslim")
        if rng.random() < 0.2:
            words.append("women")
        rows.append((" ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "text string, label int")
    fair, plain = T.fit(df), T.fit(df, fairness=0.0)
    gap = lambda s: abs(s(b"muslim aaa bbb") - s(b"women aaa bbb"))
    assert gap(fair) < 0.02 and gap(fair) <= gap(plain) + 1e-6
    assert fair(b"you idiot aaa") > 0.7 > fair(b"muslim aaa")


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5, "x"), (None, "", 0.1, "y"), (3, "long " * 50_000, 0.2, "z")], "doc_id long, text string, score double, label string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fitted_on(docs, none)
    got = T.score_texts(docs, model).collect()
    assert len(got) == 3 and all(r.score == 0.5 for r in got) and got[0].asDict().keys() == {"doc_id", "text", "label", "score"}
    assert T.score_texts(docs.limit(0), model).count() == 0
