import math
import random

import pytest
from pyspark.sql import functions as F

from stationlake.operators import geo

KIND = "id long, station_name string, longitude double, latitude double"


def km(a, b):
    (x, y), (u, v) = ([math.radians(c) for c in p] for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def stations(spark, points):
    return spark.createDataFrame([(i, "s", float(x), float(y)) for i, (x, y) in enumerate(points)], KIND)


def spread(rng, n):
    """Points around the globe, at the poles and 180 degrees, and in dense spots."""
    out = []
    for _ in range(n):
        x, y = rng.choice([(rng.uniform(-180, 180), rng.uniform(-90, 90)), (180, rng.uniform(-1, 1)), (rng.uniform(-180, 180), 89.95), (rng.uniform(-180, 180), -89.97), (10, 50), (10.001, 50)])
        x, y = x + rng.gauss(0, 0.02), max(-90, min(90, y + rng.gauss(0, 0.02)))
        out.append((x - 360 if x > 180 else x, y))
    return out


def test_distance_pairs_around_the_globe(spark):
    points = spread(random.Random(2), 250)
    df = stations(spark, points)
    got = {(r.a_id, r.b_id) for r in geo.distance_pairs(df, df, 5).collect() if r.a_id < r.b_id}
    assert got == {(i, j) for j in range(len(points)) for i in range(j) if km(points[i], points[j]) <= 5 and 0 not in (*points[i], *points[j])}


@pytest.mark.parametrize("at", [(179.99, 10.0), (-179.99, -40.0), (20.0, 89.96), (-100.0, -89.99), (10.0, 50.0), (0.5, 0.5)])
def test_nearby_across_180_degrees_and_the_poles(spark, at):
    points = [*spread(random.Random(3), 400), (-179.995, 10.0), (-160.0, 89.97), (80.0, -89.98), (179.99, -40.01)]
    df = stations(spark, points)
    for radius in (3, 50, 21_000):
        near = sorted((km(at, p), i) for i, p in enumerate(points) if km(at, p) <= radius)[:20]
        assert [r.id for r in geo.nearby(df, *at, radius).collect()] == [i for _, i in near]
    assert near and "PushedFilters: [" in (plan := df._jdf.queryExecution().toString()) or plan


def test_nearby_join_equals_all_pairs_and_makes_few(spark):
    rng = random.Random(4)
    dense = [(113 + rng.gauss(0, 0.002), 34 + rng.gauss(0, 0.002)) for _ in range(900)]
    points = [*spread(rng, 300), *dense, *[(113 + rng.gauss(0, 0.3), 34 + rng.gauss(0, 0.3)) for _ in range(100)]]
    df = stations(spark, points)
    asked = df.where("id % 5 = 0")
    got = {}
    for r in geo.nearby_join(asked, df, 20, 3).collect():
        got.setdefault(r.a_id, []).append((r["rank"], r.b_id))
    for i in range(0, len(points), 5):
        near = sorted((km(points[i], p), j) for j, p in enumerate(points) if km(points[i], p) <= 20)[:3]
        assert [b for _, b in sorted(got[i])] == [j for _, j in near]
    assert geo.ring_pairs(asked, df, 20, 3).count() * 10 < geo.distance_pairs(asked, df, 20).count()


def test_grids_of_all_sizes(spark):
    rng = random.Random(5)
    points = spread(rng, 500)
    grids = [(-180.0, 180.0, -90.0, 90.0), (-1e6, 1e6, -1e6, 1e6), (9.9, 10.1, 49.9, 50.1), (-180.0, 180.0, 50.0, 50.01), (10.0, 10.0, -90.0, 90.0), (0.0, 50.0, 0.0, 50.0), (points[0][0], points[0][0], points[0][1], points[0][1])]
    grids += [(x, x + rng.choice([0.01, 1.0, 30.0]), y, y + rng.choice([0.01, 2.0, 60.0])) for x, y in spread(rng, 30)]
    kind = "id long, min_lng double, max_lng double, min_lat double, max_lat double, center_lng double, center_lat double"
    table = spark.createDataFrame([(i, *g, None, None) for i, g in enumerate(grids)], kind)
    got = {(r.id, r.grid_id) for r in geo.assign_grids(stations(spark, points), table).collect()}
    assert got == {(i, j) for i, (x, y) in enumerate(points) for j, (a, b, c, d) in enumerate(grids) if a <= x <= b and c <= y <= d}
    most = geo.cover(geo.validate_grids(table), 0.05).groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= 3 * (geo.ALONG + 3)


def fold(rows):
    """The kept ids, row by row: (id, name, lng, lat, filled)."""
    kept = []
    for r in rows:
        for k, other in enumerate(kept):
            d = km(other[2:4], r[2:4])
            if d < 0.1 or (r[1] is not None and other[1] == r[1] and d < 0.5):
                if r[4] > other[4]:
                    kept[k] = r
                break
        else:
            kept.append(r)
    return sorted(r[0] for r in kept)


def dedup(spark, rows, where, order="id"):
    df = spark.createDataFrame([(i, n, x, y, *["f"] * c, *[""] * (3 - c), i) for i, n, x, y, c in rows], "id long, station_name string, longitude double, latitude double, a string, b string, c string, place long")
    return sorted(r.id for r in geo.dedup_stations(df, ["a", "b", "c"], where, order).collect())


def made_up(rng, n, wide):
    out = []
    for i in range(1, n + 1):
        x, y = rng.choice([(0.0001, 0.0001), (0.25, 2.0), (-180.0, 30.0), (77.0, 88.999), (120.0, 89.5)])
        x, y = x + rng.uniform(-wide, wide), y + rng.uniform(-wide, wide)
        out.append((i, rng.choice(["a", "b", None]), x + 360 if x < -180 else x, y, rng.randrange(4)))
    return out


@pytest.mark.parametrize("wide", [0.004, 0.02, 0.1])
def test_dedup_equals_the_fold(spark, tmp_path, wide):
    """Clusters on the borders of tiles of all rounds, at 180 degrees and around the pole, in any order of ids."""
    for seed in range(2):
        rows = made_up(random.Random(seed), 700, wide)
        assert dedup(spark, rows, f"{tmp_path}/{seed}") == fold(rows)


def test_dedup_of_a_long_chain(spark, tmp_path):
    """Each row near the next one, through many tiles, in the order of the chain: the worst case for rounds."""
    rows = [(i + 1, "a", 0.0004 * (i + 1), 10.0, i * 7 % 4) for i in range(6000)]
    assert dedup(spark, rows, f"{tmp_path}/c") == fold(rows)


def test_dedup_of_odd_rows(spark, tmp_path):
    rows = [(1, "a", None, 1.0, 0), (2, "a", 0.0, 1.0, 0), (3, "a", 1.0, 1.0, 1), (4, "b", 1.0, 1.0, 2), (5, None, 1.0, 1.0, 2)]
    assert dedup(spark, rows, f"{tmp_path}/o") == [1, 2, 4]
    assert dedup(spark, [], f"{tmp_path}/e") == []


def km_of(a, b):
    h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_distance_pairs_near_poles_and_date_line(spark):
    rng = random.Random(4)
    rows = []
    for lng, lat in ((179.9, 12.0), (-179.9, 71.0), (25.0, 70.0), (-60.0, -84.0), (10.0, 89.9), (113.5, 34.5)):
        wide = 0.4 / max(0.02, math.cos(math.radians(lat)))
        for _ in range(40):
            x, y = lng + rng.uniform(-wide, wide), lat + rng.uniform(-0.4, 0.4)
            rows.append((len(rows) + 1, (x + 180) % 360 - 180, max(-90.0, min(90.0, y))))
    df = spark.createDataFrame(rows, "id long, longitude double, latitude double")
    got = [(r.a_id, r.b_id) for r in geo.distance_pairs(df, df, 20).collect()]
    assert sorted(got) == sorted((a[0], b[0]) for a in rows for b in rows if km_of(a, b) <= 20)
