import numpy as np

from stationlake.llm import metric_join as M
from stationlake.llm.common import Scratch


def brute(rows, cosine=0.9, kind=np.float32):
    ok = {i: np.array(v, kind).astype(float) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    ok = {i: v / abs(v).max() for i, v in ok.items() if rows[i][0] is not None}
    ok = {i: v / np.sqrt(v @ v) for i, v in ok.items()}
    root = {r: r for r, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    n = [0] * len(rows)
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and len(a) == len(b) and a @ b >= cosine:
                n[i] += 1
                p, q = sorted((find(rows[i][0]), find(rows[j][0])))
                root[q] = p
    return sorted(((r, c, find(r), r == find(r) if r is not None else None) for (r, _), c in zip(rows, n)), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 40)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(60):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.35])).tolist()))
    rows += [(900, None), (901, [0.0] * 8), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, [1.0, 2.0]), (905, rows[3][1]), (906, rows[3][1]), (907, [float("inf")] + [1.0] * 7), (908, []), (None, rows[3][1]), (906, rows[3][1])]
    df = spark.createDataFrame([(i, v, "m") for i, v in rows], "vec_id long, embedding array<float>, mark string").repartition(3)
    assert sorted(map(tuple, M.range_join(df, Scratch(spark, "t2")).collect()), key=str) == brute(rows)


def test_empty(spark):
    for rows in ([], [(1, None), (2, [0.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert sorted(map(tuple, M.range_join(df, Scratch(spark, "t2")).collect())) == [(i, 0, i, True) for i, _ in rows]


def test_scaled_copies_among_pivots(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 5)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(centre * scale).tolist() for scale in rng.uniform(0.1, 9, 120)]
    rows += [(centre + rng.normal(size=64) * rng.choice([0.2, 0.3, 0.33])).tolist() for _ in range(80)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, M.range_join(df, Scratch(spark, "t2")).collect()), key=str) == brute(rows)


def test_guests_of_a_cell_are_bounded_too(spark, monkeypatch):
    sizes, tiles_of = [], M.cell_tiles

    def watched(*args):
        tiles = tiles_of(*args)
        sizes.extend(r["count"] for r in tiles.groupBy("tile", "side").count().collect())
        return tiles

    monkeypatch.setattr(M, "CELL", 20)
    monkeypatch.setattr(M, "MOST_PIVOTS", 2)
    monkeypatch.setattr(M, "cell_tiles", watched)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.33 * rng.normal(size=16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, M.range_join(df, Scratch(spark, "t2")).collect()), key=str) == brute(rows)
    assert max(sizes) <= 2 * 20  # blocks are cut by hash; eight hands would hold some 50 guests each


def test_lengths_are_spaces_of_their_own_and_doubles_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 20)
    rng = np.random.default_rng(6)
    rows = [[1e300, 1e300], [1e300, 1e300], [1e-60, 0.0], [3e-60, 0.0], [5e-324, 5e-324, 0.0], [1.0, 1.0, 0.0], [1.7e308] * 4, [1.0] * 4, [2.0], [-1.0], [7.0]]
    for size in (2, 5, 5, 9):
        centres = rng.normal(size=(9, size))
        rows += [(centres[rng.integers(9)] * rng.choice([1e200, 1.0, 1e-200]) * (1 + 0.1 * rng.normal(size=size))).tolist() for _ in range(45)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, M.range_join(df, Scratch(spark, "t2")).collect()), key=str)
    assert got == brute(rows, kind=np.float64) and dict((r[0], r[1]) for r in got)[4] == 1


def test_trees_are_united():
    label = np.arange(9)
    M.united(label, np.array([8, 7, 6, 1]), np.array([7, 6, 5, 2]))
    M.united(label, np.array([2, 5]), np.array([8, 5]))
    assert label.tolist() == [0, 1, 1, 3, 4, 1, 1, 1, 1]
