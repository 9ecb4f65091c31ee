"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings, each by its count and its rate in the text. Spark counts in how many labelled texts of each
class a feature occurs; those whose classes differ beyond chance are kept, and so are all identity terms. The training
loss has a second part: for every labelled text with an identity term, the same text with that term swapped for another
one must get the same score. A neutral mention of a group then moves no score, however the labels are spread.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, as_bytes, free_names, slices, table

FIT_ROWS = 20_000  # labelled rows that the model is fitted on at most, chosen by a hash of their id
FEATURES = 300  # kept at most, besides identity terms
PREFIXES = range(3, 10)
EDGES = ".,;:!?\"'()[]{}<>#$%&*|`~_=+\\/-"

#: Identity terms that are swapped for one another.
IDENTITY = "women men girls boys black white asian african latino arab jewish muslim christian hindu buddhist atheist gay straight lesbian bisexual transgender immigrants refugees foreigners disabled deaf blind old young frauen männer schwarze juden muslime christen ausländer femmes hommes noirs juifs musulmans chrétiens étrangers mujeres hombres negros judíos musulmanes cristianos extranjeros".split()


def features_of(word: bytes) -> tuple[str, ...]:
    """A word's features: itself in lower case, and its beginnings if it is longer."""
    w = word.decode("utf-8", "replace").strip(EDGES).lower()
    return (f"={w}", *(f"^{w[:n]}" for n in PREFIXES if n < len(w))) if w else ()


def values(count, n):
    """What the model sees of a feature: its count, and its rate in a text of n words, both damped."""
    return np.log1p(count), np.log1p(200.0 * count / n)


def counted(words: dict[bytes, int], features) -> dict[str, int]:
    out: dict[str, int] = {}
    for w, c in words.items():
        for f in features(w):
            out[f] = out.get(f, 0) + c
    return out


class Scorer:
    """Scores texts: 1 / (1 + exp(-z)), z a weighted sum of the features' values. Words are cached, in bounds."""

    def __init__(self, weights: dict[str, tuple[float, float]], bias: float, limit: int = 100_000):
        self.weights, self.bias, self.limit, self.known = weights, bias, limit, {}

    def features(self, word: bytes) -> tuple[str, ...]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) > self.limit:
                self.known.clear()
            out = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return out

    def __call__(self, text: bytes | None) -> float:
        words = Counter((text or b"").split())
        z, n = self.bias, max(1, words.total())
        for f, c in sorted(counted(words, self.features).items()):
            z += float(np.dot(self.weights[f], values(c, n)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def feature_rows(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, target=500_000):
            words = [Counter((t or b"").split()) for t in as_bytes(batch.column("text"))]
            rows = [counted(w, features_of) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([w.total() for w in words], pa.int64()), pa.array([[{"f": f, "c": c} for f, c in r.items()] for r in rows], pa.list_(pa.struct([("f", pa.string()), ("c", pa.int32())])))],
                names=["label", "n", "features"],
            )


def fit(labelled: DataFrame, fairness: float = 5.0, ridge: float = 3e-4, steps: int = 500) -> Scorer:
    """A model of labelled (text, label 0/1), a bounded table. Without rows of both classes the score is the mean label.

    fairness weighs the squared differences of scores between texts and their swapped copies.
    """
    found = labelled.selectExpr("cast(text as string) text", "cast(label as int) label").where("label in (0, 1)")
    found = found.mapInArrow(feature_rows, "label int, n long, features array<struct<f:string, c:int>>")
    scratch = Scratch(labelled.sparkSession, "fit")
    found = scratch.save(found, "features")  # read three times below
    total = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Scorer({}, 0.0 if not n1 + n0 else 3.0 if n1 else -3.0)
    each = found.select("label", F.explode("features.f").alias("f")).groupBy("f").agg(F.sum("label").alias("k1"), F.count("*").alias("k"))
    share = n1 / (n0 + n1)
    z = (F.col("k1") - F.col("k") * share) / F.sqrt(F.col("k") * share * (1 - share) + 1)
    each = each.where("k >= 5").withColumn("z", F.abs(z)).where("z >= 4")
    names = [r.f for r in each.orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    names = list(dict.fromkeys([*names, *(f"={t}" for t in IDENTITY)]))
    place, k = {f: i for i, f in enumerate(names)}, len(names)
    kept = found.select("label", "n", F.filter("features", lambda x: x["f"].isin(names)).alias("features")).collect()  # FIT_ROWS at most
    scratch.drop("features")
    x = np.zeros((len(kept), 2 * k), np.float32)
    y = np.array([r.label for r in kept], np.float32)
    for i, r in enumerate(kept):
        for f, c in r.features:
            x[i, place[f]], x[i, k + place[f]] = values(c, max(1, r.n))

    # Counterfactuals: each identity term of a text becomes the next one of the list that the text doesn't hold.
    of = {t: [place[f] for f in features_of(t.encode()) if f in place] for t in IDENTITY}
    swaps = []
    for i in range(len(kept)):
        for j, term in enumerate(IDENTITY):
            own = place[f"={term}"]
            if x[i, own]:
                other = next((t for t in IDENTITY[j + 1 :] + IDENTITY[:j] if not x[i, place[f"={t}"]]), None)
                if other:
                    row = x[i].copy()
                    for half in (0, k):
                        row[[half + p for p in of[term]]] = 0
                        row[[half + p for p in of[other]]] = x[i, half + own]
                    swaps.append(row - x[i])
    change = np.array(swaps, np.float32).reshape(-1, 2 * k)

    weights, bias = np.zeros(2 * k), math.log(share / (1 - share))
    m, v = np.zeros(2 * k + 1), np.zeros(2 * k + 1)
    for step in range(1, steps + 1):  # Adam on the whole batch
        p = 1 / (1 + np.exp(-np.clip(x @ weights.astype(np.float32) + bias, -50, 50)))
        g = np.append(x.T @ (p - y).astype(np.float32) / len(y) + ridge * weights, (p - y).mean())
        if len(change):
            g[:-1] += fairness * change.T @ (change @ weights) / len(change)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Scorer({f: (float(weights[i]), float(weights[k + i])) for i, f in enumerate(names)}, float(bias))


def score_texts(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with a column `name` added (in place of one of that name). Null and empty texts get the score of no words.

    Rows are scored one by one: repeated rows and ids get equal scores, an empty table stays empty, other columns stay.
    """
    spark = docs.sparkSession
    own = free_names(docs.withColumn(name, F.lit(0)), "text")[0]
    model = spark.sparkContext.broadcast((scorer.weights, scorer.bias))  # some 350 entries

    def run(batches):
        import pyarrow as pa

        score = Scorer(*model.value)
        for whole in batches:
            for batch in slices(whole, own, 1_000_000):
                scores = pa.array([score(t) for t in as_bytes(batch.column(own))], pa.float64())
                keep = [i for i, k in enumerate(batch.schema.names) if k != own]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), scores], names=[*(batch.schema.names[i] for i in keep), name])

    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.withColumn(own, F.col("text").cast("string")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted_on(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A model of at most FIT_ROWS labelled documents that aren't held out.

    Contradicting labels of one id are left out; of several texts under one id the smallest counts, of repeated rows one.
    """
    labels = labels.selectExpr("cast(doc_id as long) _doc", "cast(toxic as int) label").where("_doc is not null and label in (0, 1)").where(~held_out(F.col("_doc")))
    labels = labels.groupBy("_doc").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    chosen = labels.orderBy(F.xxhash64("_doc"), "_doc").limit(FIT_ROWS)
    texts = docs.selectExpr("cast(doc_id as long) _doc", "cast(text as string) text")
    found = texts.join(F.broadcast(chosen), "_doc").groupBy("_doc").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return fit(found.select("text", "label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs.select("doc_id", "text"), fitted_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
