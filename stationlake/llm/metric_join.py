"""Exact metric range join of embeddings: pivots, boundary replication by the triangle inequality, independent cells.

Unit vectors lie at a chord distance d with cos = 1 - d*d/2, a metric. Every distinct vector goes home to its nearest
pivot; it is a guest in the cell of each later pivot that a partner may call home. That is ruled out where the cell's
radius, the difference to its own pivot or the plane halfway between the pivots says that no vector there is within
reach. Cells join on their own, large ones in blocks. Products in single precision only sort out what is clearly
apart; every reported link was found by its cosine in double precision. Vectors of each length are a space of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components, united

CELL = 2048  # vectors that a cell is meant to hold, and the most in a block
APART = 1e-3  # the least distance between pivots; what is divided by less is rounding noise
MOST_PIVOTS = 2048  # over all lengths; bounds what is sent to all tasks; larger cells beyond that fall into more blocks
STRIP = 4_000_000  # distances to pivots that are held at a time


def units(data: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; components are scaled first, so that very large and very small ones stay exact."""
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def vector_rows(kind: str):
    """Vectors as bytes with a hash; what can't be compared has none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, marks, dims = [], [], []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan if a is None else a for a in v], kind) if v else np.empty(0, kind)
                ok = len(x) and np.isfinite(x).all() and x.any()
                raw.append(x.tobytes() if ok else None)
                marks.append(hashlib.blake2b((x + x.dtype.type(0)).tobytes(), digest_size=16).digest() if ok else None)
                dims.append(len(x))
            columns = [batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(marks, pa.binary()), pa.array(dims, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "mark", "dims"])

    return run


def strips(batches, width: dict[int, int]):
    """The rows of one length at a time, as many as keep the distances to that length's pivots few."""
    import pyarrow as pa

    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            rows = np.nonzero(dims == d)[0]
            step = max(1, STRIP // max(width.get(d, 1), d))
            for at in range(0, len(rows), step):
                yield d, batch.take(pa.array(rows[at : at + step]))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def apart(pivots: np.ndarray) -> np.ndarray:
    """The pivots without those that have an earlier one within APART, such as scaled copies."""
    between, kept = distances(pivots, pivots), []
    for i in range(len(pivots)):
        if not kept or between[i, kept].min() > APART:
            kept.append(i)
    return pivots[kept]


def tile_pairs(a: np.ndarray, b: np.ndarray, cosine: float, same: bool):
    """Row numbers of all pairs of a and b (later rows of the same block only, if same) with this cosine or more."""
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    for at in range(0, len(a), 256):
        i, j = np.nonzero(fa[at : at + 256] @ fb.T >= cosine - 1e-4)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        sure = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
        yield i[sure], j[sure]


def cell_tiles(homes: DataFrame, guests: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tile, id, weight, v, side): pairs of a cell's blocks, sides 0 (both) or 1 and 2, and its blocks with its guests' hands.

    sizes: cell, blocks, hands of the cells around pivots, MOST_PIVOTS at most; as many as bound a tile, whatever the number
    of members and guests. Other cells are small.
    """
    given = {"blocks": F.coalesce("blocks", F.lit(1).cast("long")), "hands": F.coalesce("hands", F.lit(0).cast("long"))}
    sized = lambda df: df.join(F.broadcast(sizes), "cell", "left").withColumns(given)
    members = sized(homes.select("id", "weight", "v", "cell")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    visitors = sized(guests).withColumn("hand", F.pmod(F.xxhash64("id", F.lit(2)), F.col("hands")))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    own = F.concat_ws(":", "cell", low, high, F.lit("h")).alias("tile")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side")
    tiles = members.withColumn("other", numbers("blocks")).select(own, "id", "weight", "v", side)
    met = F.concat_ws(":", "cell", "block", F.lit("g"), "hand").alias("tile")
    hosts = members.where("hands > 0").withColumn("hand", numbers("hands")).select(met, "id", "weight", "v", F.lit(1).alias("side"))
    others = visitors.withColumn("block", numbers("blocks")).select(met, "id", "weight", "v", F.lit(2).alias("side"))
    return tiles.union(hosts).union(others)


def chosen_pivots(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Pivots of each length that has more vectors than a cell is meant to hold: a bounded sample, the same at each run."""
    large = classes.groupBy("dims").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = large.orderBy(F.desc("n"), "dims").limit(MOST_PIVOTS).collect()
    total, pivots = sum(r.n for r in large), {}
    for r in large:
        k = max(1, min(math.ceil(r.n / CELL), MOST_PIVOTS * r.n // total))
        sample = classes.where(F.col("dims") == r.dims).orderBy("mark").limit(k).select("v").collect()
        pivots[r.dims] = apart(units([bytes(x.v) for x in sample], kind))
    return pivots


def range_join(vectors: DataFrame, scratch: Scratch, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding; other columns are ignored).

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; nor do vectors of
    different lengths with each other, or rows without a vec_id (their component_id and kept are null). Repeated rows are
    vectors of their own that link with each other. Cosines at or above `cosine` in double precision are links. Components
    are compared as they are given: floats, or doubles of any size.
    """
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "float32" if single else "float64"
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = scratch.save(chosen.mapInArrow(vector_rows(kind), "vec_id long, v binary, mark binary, dims int"), "vectors")
    usable = rows.where("mark is not null and vec_id is not null")
    classes = usable.groupBy("mark", "dims").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = scratch.save(classes, "classes")
    radius = math.sqrt(2 - 2 * cosine) + 1e-6
    pivots = chosen_pivots(classes, kind)
    width = {d: len(p) for d, p in pivots.items()}

    def home_rows(batches):
        import pyarrow as pa

        for dims, batch in strips(batches, width):
            home, own = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if dims in pivots:
                d = distances(units(batch.column("v").to_pylist(), kind), pivots[dims])
                home, own = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(own)], names=[*batch.schema.names, "home", "d"])

    homes = classes.select("id", "weight", "v", "dims").mapInArrow(home_rows, "id long, weight long, v binary, dims int, home int, d double")
    homes = scratch.save(homes.select("*", F.concat_ws(":", "dims", "home").alias("cell")), "homes")
    pivoted = homes.where(F.col("dims").isin(list(pivots)))
    reach = {d: np.zeros(k) for d, k in width.items()}
    for r in pivoted.groupBy("dims", "home").agg(F.max("d").alias("d")).collect():  # a row for each pivot
        reach[r.dims][r.home] = r.d

    def guest_cells(batches):
        """Strips of rows of one length with whom they visit: a row and a column for each vector and pivot."""
        between = {}
        for dims, batch in strips(batches, width):
            own_pivots = pivots[dims]
            if dims not in between:
                between = {dims: distances(own_pivots, own_pivots)}
                np.fill_diagonal(between[dims], 1.0)  # nothing is a guest at home
            d = distances(units(batch.column("v").to_pylist(), kind), own_pivots)
            home, own = batch.column("home").to_numpy(), batch.column("d").to_numpy()
            gap = between[dims][home]
            plane = (d * d - (own * own)[:, None]) / (2 * gap)
            near = (d <= reach[dims] + radius) & (d <= own[:, None] + 2 * radius) & (plane <= radius + 1e-12 / gap)
            yield dims, batch, near & (np.arange(len(own_pivots)) > home[:, None])

    def guest_counts(batches):
        import pyarrow as pa

        total = {d: np.zeros(k, np.int64) for d, k in width.items()}
        for dims, _, near in guest_cells(batches):
            total[dims] += near.sum(axis=0)
        found = [(f"{d}:{c}", int(n[c])) for d, n in total.items() for c in np.nonzero(n)[0].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["cell", "n"])

    def guest_rows(batches):
        import pyarrow as pa

        for dims, batch, near in guest_cells(batches):
            i, c = np.nonzero(near)
            names = pa.array([f"{dims}:{x}" for x in c.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(pa.array(i)) for x in ("id", "weight", "v")), names], names=["id", "weight", "v", "cell"])

    guests = pivoted.mapInArrow(guest_rows, "id long, weight long, v binary, cell string")
    hands = pivoted.mapInArrow(guest_counts, "cell string, n long").groupBy("cell").agg(F.ceil(F.sum("n") / CELL).alias("hands"))
    sizes = pivoted.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    sizes = scratch.save(sizes.join(hands, "cell", "left").select("cell", "blocks", F.coalesce("hands", F.lit(0).cast("long")).alias("hands")), "sizes")
    tiles = cell_tiles(homes, guests, sizes)

    def join(frame):
        import pandas as pd

        side = frame["side"].to_numpy()
        first, second = (frame[side == 0],) * 2 if (side == 0).any() else (frame[side == 1], frame[side == 2])
        if not len(first) or not len(second):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        same = first is second
        a = units(list(first["v"]), kind)
        b = a if same else units(list(second["v"]), kind)
        names = first["id"].to_numpy() if same else np.concatenate([first["id"].to_numpy(), second["id"].to_numpy()])
        wa, wb = first["weight"].to_numpy(), second["weight"].to_numpy()
        shift = 0 if same else len(a)
        links, label = np.zeros(len(names), np.int64), np.arange(len(names))
        for i, j in tile_pairs(a, b, cosine, same):
            np.add.at(links, i, wb[j])
            np.add.at(links, j + shift, wa[i])
            united(label, i, j + shift)
        counted, tied = np.nonzero(links)[0], np.nonzero(label != np.arange(len(names)))[0]
        return pd.DataFrame({
            "a": np.concatenate([names[counted], names[tied]]), "b": np.concatenate([names[counted], names[label[tied]]]),
            "n": np.concatenate([links[counted], np.zeros(len(tied), np.int64)]),
        })

    found = tiles.groupBy("tile").applyInPandas(join, "a long, b long, n long")
    found = scratch.save(found, "found")
    degree = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    component = components(found.where("a <> b").select("a", "b"), scratch).toDF("id", "component")
    result = classes.select("mark", "dims", "id", "weight").join(degree, "id", "left").join(component, "id", "left")
    result = result.select("mark", "dims", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    done = rows.withColumn("mark", F.when(F.col("vec_id").isNotNull(), F.col("mark"))).select("vec_id", "mark", "dims").join(result, ["mark", "dims"], "left")
    done = done.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))


#: All pairs, in DuckDB: n_links and the component by repeated propagation of the smallest id.
ORACLE_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) AS norm
  FROM embeddings WHERE embedding IS NOT NULL
), unit AS (SELECT vec_id, v, norm FROM ok WHERE norm > 0 AND isfinite(norm)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(m.low, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = e.vec_id
"""
