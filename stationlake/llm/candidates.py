"""From shared keys to verified links: what the similarity operators have in common.

Classes that share a key are candidates. Signatures sort out most pairs, in tiles of bounded size; what they let through
is checked exactly, pair by pair, in a plain join. Links are looked for only between classes that aren't connected yet:

1. Every class is checked against one representative, the smallest class of the keys that it shares most often.
2. Keys whose classes are not all connected by then become tiles, large ones cut into blocks that meet two by two. A tile
   gives out the pairs that pass, between what is not connected. Where these are many, it first gives out the best pair of
   every component, for two rounds, and then all that are left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

BLOCK = 1024  # classes in a block of a tile at most
BUNDLE = 60_000  # rows of small tiles that one group of a task holds
DENSE = 16  # pairs for each class of a tile, beyond which the tile gives out the best ones first


def shared_members(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, key, low, weight) of the keys (class, key) that several classes have, low being the smallest of these.

    Keys are counted with partial sums and joined by a plain equi-join, so that a key of very many classes is split.
    Of the keys with the same classes one stays, and weight says how many there were.
    """
    shared = keyed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key", "low")
    shared = scratch.save(shared, "shared")
    members = scratch.save(keyed.join(shared.hint("shuffle_hash"), "key").select("class", "key", "low").distinct(), "all-members")
    scratch.drop("shared")
    marks = [F.count("*").alias("n"), F.max("class").alias("high"), *(F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"mark{k}") for k in (0, 1))]
    alike = members.groupBy("key", "low").agg(*marks).groupBy("low", "high", "n", "mark0", "mark1")
    chosen = alike.agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "weight")
    members = scratch.save(members.join(chosen, "key"), "members")
    scratch.drop("all-members")
    return members


def verified(pairs: DataFrame, sets: DataFrame, exact) -> DataFrame:
    """The pairs (a, b) for which exact()(payload of a, payload of b) holds. sets: class, payload."""
    of = lambda c: sets.select(F.col("class").alias(c), F.col("payload").alias(f"{c}_payload"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def run(batches):
        import pyarrow as pa

        check = exact()
        for batch in batches:
            a, b = batch.column("a_payload"), batch.column("b_payload")
            sure = [check(a[i].as_py(), b[i].as_py()) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))

    return both.select("a", "b", "a_payload", "b_payload").mapInArrow(run, "a long, b long")


def folded(rows: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of uint64, all as wide as the narrowest one: widths are powers of two, and halves are united."""
    width = min(map(len, rows))
    if any(len(r) != width for r in rows):
        rows = [np.bitwise_or.reduce(np.frombuffer(r, np.uint8).reshape(-1, width)).tobytes() for r in rows]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def tile_pairs(tile, side, label, n, bits, passes):
    """Row numbers (i, j) of all pairs of one tile that differ in label, that sides let meet and that pass, and their scores.

    Rows are sorted by tile. Tiles of one size and bitmap width are joined together, large ones in strips.
    """
    start = np.nonzero(np.append(True, tile[1:] != tile[:-1]))[0]
    size = np.diff(np.append(start, len(tile)))
    width = np.minimum.reduceat(np.array(list(map(len, bits))), start)
    for t, w in np.unique(np.stack([size[size > 1], width[size > 1]]), axis=1).T.tolist():
        own = start[(size == t) & (width == w)]
        p, q = np.triu_indices(t, 1)
        most = max(256, 8_000_000 // w)  # pairs at a time
        for at in range(0, len(own), max(1, most // len(p))):
            first = own[at : at + max(1, most // len(p))]
            for cut in range(0, len(p), most):
                i = (first[:, None] + p[None, cut : cut + most]).ravel()
                j = (first[:, None] + q[None, cut : cut + most]).ravel()
                ok = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                if len(i):
                    used = np.unique(np.concatenate([i, j]))
                    x = folded([bits[k] for k in used])
                    ok, score = passes(n[i], x[np.searchsorted(used, i)], n[j], x[np.searchsorted(used, j)])
                    yield i[ok], j[ok], score[ok]


def first_of(*columns) -> np.ndarray:
    """Where the first row of each combination of values stands."""
    return np.unique(np.stack(columns), axis=1, return_index=True)[1]


def chosen_pairs(i, j, score, tile, label, best: bool, most: int = DENSE):
    """Which pairs a tile gives out, and whether it holds some back."""
    t = tile[i]
    size = np.searchsorted(tile, t, "right") - np.searchsorted(tile, t, "left")
    _, at, count = np.unique(t, return_inverse=True, return_counts=True)
    dense = count[at] > most * size
    if not best or not dense.any():
        return np.ones(len(i), bool), np.zeros(len(i), bool)
    order = np.argsort(-score, kind="stable")
    order = order[dense[order]]
    take = ~dense
    for side in (i, j):
        take[order[first_of(t[order], label[side][order])]] = True
    return take, dense


def tiles_of(members: DataFrame, label: DataFrame, sets: DataFrame, keys: DataFrame | None) -> DataFrame:
    """(family, tile, side, class, label, n, bits) of the keys whose classes have several labels.

    Tiles of keys with the same smallest class mostly give the same pairs: as far as bounds allow they are one family,
    which stays together, so that a pair comes out once.
    """
    members = members if keys is None else members.join(keys, "key", "left_semi")
    named = members.join(label, "class", "left").select("class", "key", F.col("low").alias("family"), F.coalesce("label", "class").alias("label"))
    counted = named.groupBy("key", "family").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
    counted = counted.withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    parts = counted.groupBy("family").agg(F.ceil(F.sum(F.col("size") * F.col("blocks")) / BUNDLE).alias("parts"))
    rows = named.drop("family").join(counted.select("key", "family", "blocks").join(parts, "family"), "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("family", F.pmod(tile, "parts")).alias("family"), tile.alias("tile"), "key", side.alias("side"), "class", "label")
    return rows.join(sets.select("class", "n", "bits"), "class")


def tile_candidates(tiles: DataFrame, rows: int, passes, best: bool, most: int = DENSE) -> DataFrame:
    """(a, b, key): the pairs that pass, each once for a bundle of tiles; with null a, b the keys of tiles that hold some back."""
    bundles = max(1, rows // BUNDLE)

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("tile", kind="stable")
        tile, side, label, n = (frame[c].to_numpy() for c in ("tile", "side", "label", "n"))
        names, keys, bits = frame["class"].to_numpy(), frame["key"].to_numpy(), frame["bits"].to_list()
        found = list(tile_pairs(tile, side, label, n, bits, passes))
        if not found:
            return pd.DataFrame({"a": [], "b": [], "key": []}, dtype="Int64")
        i, j, score = (np.concatenate(x) for x in zip(*found))
        take, dense = chosen_pairs(i, j, score, tile, label, best, most)
        back, i, j = np.unique(keys[i[dense]]), i[take], j[take]
        pairs = np.unique(np.stack([np.maximum(names[i], names[j]), np.minimum(names[i], names[j])]), axis=1)
        none = [pd.NA] * len(back)
        return pd.DataFrame({"a": [*pairs[0], *none], "b": [*pairs[1], *none], "key": [*[pd.NA] * pairs.shape[1], *back]}, dtype="Int64")

    return tiles.groupBy(F.pmod("family", F.lit(bundles)).alias("bundle")).applyInPandas(run, "a long, b long, key long")


def candidate_links(members: DataFrame, sets: DataFrame, scratch: Scratch, passes, exact, most: int = DENSE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of classes that share a key and for which exact holds.

    members: class, key, low, weight (of shared_members). sets: class, n, bits, payload. passes(n, bits, n, bits), on arrays,
    gives (which pairs may be links, how well they agree); exact() makes a task's own check of two payloads; bits are bitmaps whose widths are powers of two of bytes. A tile with more than `most`
    pairs for each of its classes gives out the best ones first.
    """
    shared = members.where("class <> low").groupBy("class", "low").agg(F.sum("weight").alias("keys"))
    star = shared.groupBy("class").agg(F.max_by("low", F.struct("keys", -F.col("low"))).alias("b"))
    tested = scratch.save(star.select(F.col("class").alias("a"), "b"), "tested-star")
    links = scratch.save(verified(tested, sets, exact), "links-star")
    keys = None
    for step in ("best", "next", "rest"):
        label = scratch.save(components(links, scratch, f"round-{step}"), f"label-{step}").toDF("class", "label")
        tiles = scratch.save(tiles_of(members, label, sets, keys), f"tiles-{step}")
        found = scratch.save(tile_candidates(tiles, tiles.count(), passes, step != "rest", most), f"found-{step}")
        scratch.drop(f"tiles-{step}")
        new = scratch.save(found.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), f"tested-{step}")
        links = links.union(scratch.save(verified(new, sets, exact), f"links-{step}"))
        tested = tested.union(new)
        keys = found.where("key is not null").select("key").distinct()
        if keys.isEmpty():
            break
    return links
