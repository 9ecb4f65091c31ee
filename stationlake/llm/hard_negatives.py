"""Hard negatives from exact integer scores: Strassen products of anchor-candidate tiles, then mergeable heaps.

Vectors become int64 rows. Blocks of anchors meet blocks of candidates in tiles; a tile's scores are one matrix product,
by Strassen's recursion, whose additions of integers are exact. A first pass keeps the best rows of each anchor's own label
(its positives), a second one the best rows of other labels in the window below each positive. What a tile keeps of an
anchor is a heap of a few entries, and heaps of tiles merge to the heap of all candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # a negative's score lies between these percentages of its positive's
SCALE = 256
BLOCK_BYTES, ANCHOR_BYTES = 4 << 20, 16 << 20  # of the vectors in a block of candidates, and of anchors
LABEL_PARTS = 1024  # parts that labels are dealt to, so that mostly equal labels meet
TILE = ["row", "copy", "vec_id", "label", "v", "scores"]
STRIP = 256  # anchors of a tile that are multiplied at a time
LEAF = 32  # matrices with a side of no more than this are multiplied plainly
MOST_SUM = 1 << 62  # sums of squares up to here keep all scores, and sums within the recursion, within 64 bits


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, by Strassen's seven products of halves; odd sides are padded with zeros.

    Sums wrap around at 64 bits like products do, so that the result is exact wherever it fits.
    """
    m, k, n = len(a), len(b), b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a, b = (np.pad(x, [(0, side % 2) for side in x.shape]) if any(side % 2 for side in x.shape) else x for x in (a, b))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integer_rows(batches):
    """Vectors as int64 bytes with their sum of squares; null where a component is null or not finite or the sum is too large."""
    import pyarrow as pa

    for batch in batches:
        raw, length = [], []
        for v in batch.column("v").to_pylist():
            x = np.array([np.nan if c is None else c for c in v] if v is not None else [np.nan], np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
                ok = np.isfinite(x).all() and float(x @ x) < MOST_SUM / 64
            raw.append(x.astype(np.int64).tobytes() if ok else None)
            length.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary()), pa.array(length, pa.int32())], names=["vec_id", "label", "v", "dims"])


def matrix(rows, dims: int) -> np.ndarray:
    """Rows of int64 bytes as a matrix, the shorter ones padded with zeros."""
    if all(len(r) == 8 * dims for r in rows):
        return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), dims)
    return np.frombuffer(b"".join(bytes(r).ljust(8 * dims, b"\0") for r in rows), np.int64).reshape(len(rows), dims)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores stand, the earlier ones first among equals."""
    if len(score) > 4 * k:
        few = np.nonzero(score >= np.partition(score, len(score) - k)[len(score) - k])[0]
        return few[np.argsort(-score[few], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")[:k]


def tile_rows(anchors: DataFrame, candidates: DataFrame, part: Column, dims: int) -> DataFrame:
    """Both sides of every tile as one table (tile, side, row, copy, vec_id, label, v, scores): side 0 are anchors.

    Rows of equal `part`, which has LABEL_PARTS values at most, meet, in blocks that they are dealt to by a hash of their
    class; so a frequent part fills many blocks, and the table of numbers of blocks is small whatever the input.
    """
    size = lambda limit: max(64, limit // (8 * max(1, dims)))
    count = lambda df, c, limit: df.groupBy(part.alias("part")).agg(F.ceil(F.count("*") / size(limit)).alias(c))
    blocks = count(anchors, "a_blocks", ANCHOR_BYTES).join(count(candidates, "c_blocks", BLOCK_BYTES), "part")
    own = lambda c: F.pmod(F.xxhash64("row", F.lit(7)), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = anchors.withColumn("part", part).join(F.broadcast(blocks), "part").select("part", F.lit(0).alias("side"), own("a_blocks").alias("a"), each("c_blocks").alias("c"), *TILE)
    right = candidates.withColumn("part", part).join(F.broadcast(blocks), "part").select("part", F.lit(1).alias("side"), each("a_blocks").alias("a"), own("c_blocks").alias("c"), *TILE)
    return left.union(right).select(F.xxhash64("part", "a", "c").alias("tile"), "side", *TILE)


def sides(frame, dims: int):
    """The anchors and, by vec_id, the candidates of a tile with their matrices; None where one side is missing."""
    anchors, others = frame[frame["side"] == 0], frame[frame["side"] == 1].sort_values("vec_id", kind="stable")
    if not len(anchors) or not len(others):
        return None
    return anchors, others, matrix(list(anchors["v"]), dims), matrix(list(others["v"]), dims).T


def strips(a: np.ndarray, b: np.ndarray):
    for at in range(0, len(a), STRIP):
        for i, scores in enumerate(strassen(a[at : at + STRIP], b)):
            yield at + i, scores


def positives(classes: DataFrame, anchors: DataFrame, dims: int, k: int) -> DataFrame:
    """(row, rank, positive_id, positive_score): the best k other rows of each anchor's label. copy 0 is the anchor itself."""
    tiles = tile_rows(anchors, classes, F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS)), dims)

    def run(frame):
        import pandas as pd

        found, tile = [], sides(frame, dims)
        if tile:
            anchors, others, a, b = tile
            rows, labels = anchors["row"].to_numpy(), anchors["label"].to_numpy()
            row, copy, label, name = (others[c].to_numpy() for c in ("row", "copy", "label", "vec_id"))
            for i, scores in strips(a, b):
                other = np.nonzero((label == labels[i]) & ((row != rows[i]) | (copy > 0)))[0]
                at = other[best(scores[other], k)]
                found.append((np.full(len(at), rows[i]), name[at], scores[at]))
        a, p, s = (np.concatenate(x) for x in zip(*found)) if found else np.empty((3, 0), np.int64)
        return pd.DataFrame({"row": a, "positive_id": p, "positive_score": s})

    heaps = tiles.groupBy("tile").applyInPandas(run, "row long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k)


def negatives(classes: DataFrame, anchors: DataFrame, dims: int, k: int) -> DataFrame:
    """(row, place, rank, negative_id, negative_score): for each anchor and place in its positives the best k in the window.

    anchors have the scores of their positives, the highest one first. The windows of an anchor are cut from one sorted list.
    """
    tiles = tile_rows(anchors, classes, F.pmod(F.xxhash64("row"), F.lit(1)), dims)  # all in one part

    def run(frame):
        import pandas as pd

        found, tile = [], sides(frame, dims)
        if tile:
            anchors, others, a, b = tile
            rows, labels, wanted = anchors["row"].to_numpy(), anchors["label"].to_numpy(), anchors["scores"].to_list()
            label, name = others["label"].to_numpy(), others["vec_id"].to_numpy()
            for i, scores in strips(a, b):
                tops = np.array(wanted[i], np.int64)
                lows = -(-LOW * tops // HIGH)  # the least score with LOW * top <= HIGH * score
                near = np.nonzero((scores <= tops.max()) & (scores >= lows.min()) & (label != labels[i]))[0]
                near = near[np.argsort(-scores[near], kind="stable")]
                falling = -scores[near]
                for place, (top, low) in enumerate(zip(tops, lows)):
                    at = np.searchsorted(falling, -top, "left")
                    to = min(at + k, np.searchsorted(falling, -low, "right"))
                    if at < to:
                        pick = near[at:to]
                        found.append((np.full(len(pick), rows[i]), np.full(len(pick), place), name[pick], scores[pick]))
        r, p, n, s = (np.concatenate(x) for x in zip(*found)) if found else np.empty((4, 0), np.int64)
        return pd.DataFrame({"row": r, "place": p, "negative_id": n, "negative_score": s})

    heaps = tiles.groupBy("tile").applyInPandas(run, "row long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, scratch: Scratch, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    is_anchor is a condition on vec_id. A score is the inner product of the floors of 256 times the components; the shorter of
    two vectors is padded with zeros. Rows with a null vec_id, label or vector, with null or non-finite components, or so large
    that scores could exceed 64 bits (2^56 and more as sum of squares) take no part. Repeated rows are rows of their own: they
    are each other's positives, and a repeated anchor has its result as often. Equal rows share one class, of which a heap needs
    a few copies only. An empty table gives an empty result; other columns are ignored.
    """
    chosen = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "cast(embedding as array<double>) v")
    rows = chosen.where("vec_id is not null and label is not null and v is not null").mapInArrow(integer_rows, "vec_id long, label long, v binary, dims int")
    classes = rows.where("v is not null").groupBy("vec_id", "label", "v").agg(F.count("*").alias("weight"), F.max("dims").alias("dims"))
    classes = scratch.save(classes.withColumn("row", F.monotonically_increasing_id()), "classes")
    dims = classes.agg(F.max("dims")).first()[0] or 0
    copies = F.explode(F.sequence(F.lit(0), F.least("weight", F.lit(max(n_positives + 1, n_negatives))).cast("int") - 1))
    none = F.lit(None).cast("array<long>").alias("scores")
    single = classes.select("row", copies.alias("copy"), "vec_id", "label", "v", none)
    anchors = classes.where(is_anchor).select("row", F.lit(0).alias("copy"), "vec_id", "label", "v")

    found = scratch.save(positives(single, anchors.withColumn("scores", none), dims, n_positives), "positives")
    scores = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    below = scratch.save(negatives(single, anchors.join(scores, "row"), dims, n_negatives), "negatives")
    below = below.select("row", (F.col("place") + 1).alias("_place"), "rank", "negative_id", "negative_score")
    pairs = found.withColumnRenamed("rank", "_place").join(below, ["row", "_place"])
    named = pairs.join(classes.where(is_anchor).select("row", F.col("vec_id").alias("anchor_id"), "weight"), "row")
    named = named.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "weight")))
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0, Scratch(spark, "op12"))


#: All anchors against all rows, in DuckDB. Sums of these products are whole numbers that doubles hold exactly.
ORACLE_SQL = """
WITH rows AS (
    SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), scored AS (
    SELECT a.n AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.n <> b.n WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place
    FROM scored WHERE same QUALIFY place <= 5
), ranked AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.id) AS rank
    FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
