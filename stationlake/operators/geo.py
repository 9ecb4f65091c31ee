"""Range and distance joins over cells of a grid, and near-duplicate removal."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_column, filled_count, haversine_km, located, point_in_grid

KM_PER_DEGREE = 111.19


def validate_grids(grids: DataFrame) -> DataFrame:
    """grids with center_lng, center_lat (the middle by default) and grid_error, null where a grid is sound."""
    number = lambda c: F.col(c).try_cast("double")
    grids = grids.withColumns({c: number(c) for c in ("min_lng", "max_lng", "min_lat", "max_lat")})
    center = {f"center_{a}": F.coalesce(number(f"center_{a}"), (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2) for a in ("lng", "lat")}
    missing = F.greatest(*[F.col(c).isNull() for c in ("min_lng", "max_lng", "min_lat", "max_lat")])
    error = F.when(missing, "missing").when(F.col("min_lng") > F.col("max_lng"), "longitude").when(F.col("min_lat") > F.col("max_lat"), "latitude").when(~point_in_grid("center_lng", "center_lat"), "center")
    return grids.withColumns(center).withColumn("grid_error", error)


def cell(c: Column | str, size: float) -> Column:
    return F.floor(as_column(c).cast("double") / size)


LEVELS = 40  # sides double from level to level
ALONG = 32  # cells that a rectangle's longer side spans, about, at most
SALTS = 8  # coarse cells hold many points: those of level k are split in 2 ** min(k, SALTS) parts


def _level(extent: Column, size: float) -> Column:
    """The finest level with cells of at least this extent."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(extent, F.lit(size)) / size)))).cast("int")


def cover(grids: DataFrame, size: float) -> DataFrame:
    """Rectangles (min_lng, ...) with the cells (level, cx, cy) that cover them, at a level that their own sides ask for.

    Cells are as wide as the shorter side, unless that makes more than ALONG of them along the longer one: a rectangle has
    some 100 cells at most, whatever its size.
    """
    wide, high = F.col("max_lng") - F.col("min_lng"), F.col("max_lat") - F.col("min_lat")
    level = F.greatest(_level(F.least(wide, high), size), _level(F.greatest(wide, high) / ALONG, size))
    side = size * F.pow(F.lit(2.0), "level")
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"min_{a}") / side), F.floor(F.col(f"max_{a}") / side)))
    return grids.withColumn("level", level).withColumn("cx", span("lng")).withColumn("cy", span("lat"))


def assign_grids(stations: DataFrame, grids: DataFrame, size: float = 0.05) -> DataFrame:
    """(id, grid_id): all sound rectangles that each station lies in, edges included.

    Rectangles go to the cells that cover them and points to their one cell of each level that a rectangle has, so the join
    is an equi-join. Coarse cells are split in parts, and their few rectangles go to all of them.
    """
    grids = validate_grids(grids).where("grid_error is null").select(F.col("id").alias("grid_id"), "min_lng", "max_lng", "min_lat", "max_lat")
    grids = cover(grids, size)
    levels = sorted(r[0] for r in grids.select("level").distinct().collect())  # LEVELS + 1 at most
    parts = F.pow(F.lit(2.0), F.least("level", F.lit(SALTS))).cast("int")
    grids = grids.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    points = stations.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select("id", "longitude", "latitude")
    points = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    side = size * F.pow(F.lit(2.0), "level")
    at = lambda c: F.floor(F.col(c).cast("double") / side)
    points = points.withColumns({"cx": at("longitude"), "cy": at("latitude"), "part": F.pmod(F.xxhash64("id"), parts).cast("int")})
    return points.join(grids, ["level", "cx", "cy", "part"]).where(point_in_grid("longitude", "latitude")).select("id", "grid_id")


def around_box(lng: float, lat: float, radius: float) -> Column:
    """A condition on longitude and latitude that all points within the radius meet, and that a scan can be asked for.

    Longitudes go on across 180 degrees; where the circle holds a pole, all of them count.
    """
    angle = min(math.pi, radius / 6371.0 * 1.001)
    dlat = math.degrees(angle)
    box = F.col("latitude").between(lat - dlat, lat + dlat)
    if abs(lat) + dlat >= 90:
        return box
    dlng = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * 1.001
    sides = [F.col("longitude").between(lng - dlng + turn, lng + dlng + turn) for turn in (-360, 0, 360) if lng - dlng + turn <= 180 and lng + dlng + turn >= -180]
    return box & functools.reduce(lambda a, b: a | b, sides)


def nearby(df: DataFrame, lng: float, lat: float, radius: float = 50, limit: int = 20) -> DataFrame:
    """The nearest located stations within the radius (inclusive); a bounding box reaches the scan."""
    far = haversine_km(F.lit(lng), F.lit(lat), "longitude", "latitude")
    near = df.where(located() & around_box(lng, lat, radius)).withColumn("distance_km", far)
    return near.where(F.col("distance_km") <= radius).orderBy("distance_km", "id").limit(limit)


def _around(band: Column, km: Column, size: Column) -> Column:
    """How many cells of at least km go around the globe in a latitude band, measured from the bands next to it too."""
    half = F.sin(F.least(F.lit(math.pi / 2), km / (6371.0 * 2) * 1.001))
    most = F.greatest(F.abs((band - 1) * size), F.abs((band + 2) * size))
    ratio = half / F.cos(F.radians(most))
    cells = F.floor(360 / (F.degrees(2 * F.asin(ratio)) * 1.001))
    return F.when((most < 90) & (ratio < 1), F.greatest(F.lit(1).cast("long"), cells)).otherwise(1)


def _celled(df: DataFrame, prefix: str, km: float, around: bool) -> DataFrame:
    size = km / KM_PER_DEGREE * 1.001
    df = df.where(located()).select(*[F.col(c).alias(prefix + c) for c in df.columns], cell("latitude", size).alias("cy"))
    if around:
        df = df.withColumn("_y", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("cy", F.col("cy") + F.col("_y")).drop("_y")
    n = _around(F.col("cy"), F.lit(float(km)), F.lit(size))
    x = F.floor(F.pmod(F.col(f"{prefix}longitude").cast("double"), F.lit(360.0)) / 360 * n)
    near = F.array_distinct(F.array(*[F.pmod(x + step, n) for step in ((-1, 0, 1) if around else (0,))]))
    return df.withColumn("cx", F.explode(near))


def distance_pairs(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """All pairs within km, columns prefixed a_ and b_, by cells of at least km and the eight around each.

    Cells are as wide as their latitude asks for, and those at 180 degrees of longitude are neighbours.
    """
    pairs = _celled(left, "a_", km, True).join(_celled(right, "b_", km, False), ["cx", "cy"]).drop("cx", "cy")
    return pairs.withColumn("distance_km", haversine_km("a_longitude", "a_latitude", "b_longitude", "b_latitude")).where(F.col("distance_km") <= km)


def _leveled(df: DataFrame, radius: float, levels: list[int]) -> DataFrame:
    """df at each level: km, the least side of its cells, the latitude band cy, and the number n of cells around the globe."""
    df = df.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    df = df.withColumn("km", radius / F.pow(F.lit(2.0), "level")).withColumn("size", F.col("km") / KM_PER_DEGREE * 1.001)
    df = df.withColumn("cy", F.floor(F.col("latitude").cast("double") / F.col("size")))
    return df.withColumn("n", _around(F.col("cy"), F.col("km"), F.col("size")))


def _turn() -> Column:
    return F.floor(F.pmod(F.col("longitude").cast("double"), F.lit(360.0)) / 360 * F.col("n"))


def search_rings(points: DataFrame, stations: DataFrame, radius: float, k: int, levels: int = 10) -> DataFrame:
    """points with the radius `ring` in which the k nearest stations within `radius` lie; points are told apart by id.

    Stations are counted in cells of levels whose sides halve. The smallest cell around a point that holds k stations says
    that its diagonal is far enough; without one, the whole radius is searched. Counts are partial sums, a row for a cell.
    """
    on = ["level", "cy", "cx"]
    celled = lambda df: _leveled(df, radius, list(range(levels))).withColumn("cx", _turn())
    full = celled(stations.where(located()).select("longitude", "latitude")).groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    low = F.when((F.col("cy") < 0) & (F.col("cy") + 1 > 0), 0.0).otherwise(F.least(F.abs(F.col("cy") * F.col("size")), F.abs((F.col("cy") + 1) * F.col("size"))))
    wide = F.cos(F.radians(F.least(low, F.lit(90.0)))) * (2 * math.pi * 6371.0) / F.col("n")
    diagonal = F.sqrt(wide * wide + F.pow(F.col("size") * KM_PER_DEGREE * 1.001, F.lit(2.0))) * 1.001
    spots = celled(points.where(located()).select(F.col("id").alias("_id"), "longitude", "latitude")).withColumn("diagonal", diagonal)
    found = spots.join(full.select(*on), on).groupBy("_id").agg(F.min("diagonal").alias("ring"))
    known = points.where(located()).join(found, F.col("id") == F.col("_id"), "left").drop("_id")
    return known.withColumn("ring", F.least(F.coalesce("ring", F.lit(float(radius))), F.lit(float(radius))))


def ring_pairs(points: DataFrame, stations: DataFrame, radius: float, k: int, levels: int = 10) -> DataFrame:
    """Pairs (a_..., b_..., distance_km) in each point's ring: the k nearest and few more, however dense stations are.

    A point looks in the cells around it at the level whose cells are just as wide as its ring.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(F.log2(F.lit(float(radius)) / F.greatest("ring", F.lit(1e-9)))))).cast("int")
    ringed = search_rings(points, stations, radius, k, levels).withColumn("_level", level)
    left = _leveled(ringed, radius, list(range(levels))).where("level = _level").drop("_level")
    left = left.withColumn("cy", F.explode(F.array(*[F.col("cy") + d for d in (-1, 0, 1)]))).withColumn("n", _around(F.col("cy"), F.col("km"), F.col("size")))
    left = left.withColumn("cx", F.explode(F.array_distinct(F.array(*[F.pmod(_turn() + d, F.col("n")) for d in (-1, 0, 1)]))))
    own = lambda df, prefix: [F.col(c).alias(prefix + c) for c in df.columns]
    left = left.select("level", "cy", "cx", "ring", *own(points, "a_"))
    right = _leveled(stations.where(located()), radius, list(range(levels))).withColumn("cx", _turn()).select("level", "cy", "cx", *own(stations, "b_"))
    pairs = left.join(right, ["level", "cy", "cx"]).withColumn("distance_km", haversine_km("a_longitude", "a_latitude", "b_longitude", "b_latitude"))
    return pairs.where((F.col("distance_km") <= F.col("ring")) & (F.col("distance_km") <= radius)).drop("level", "cy", "cx", "ring")


def nearby_join(points: DataFrame, stations: DataFrame, radius: float, k: int, levels: int = 10) -> DataFrame:
    """The k nearest stations within the radius of each point, equally far ones by id; points are told apart by id."""
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("distance_km", "b_id"))
    return ring_pairs(points, stations, radius, k, levels).withColumn("rank", rank).where(F.col("rank") <= k)


def near_dup_pairs(df: DataFrame, same_km: float = 0.5, any_km: float = 0.1) -> DataFrame:
    """(a, b, distance_km), a < b: equal names closer than same_km, any names closer than any_km."""
    own = df.select("id", "station_name", "longitude", "latitude")
    pairs = distance_pairs(own, own, max(same_km, any_km)).where("a_id < b_id")
    near = (F.col("distance_km") < any_km) | (F.col("a_station_name") == F.col("b_station_name")) & (F.col("distance_km") < same_km)
    return pairs.where(near).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "distance_km")


FINE = 0.02  # degrees
SIDES = (0.25, 2.0, 15.0, 360.0)  # degrees of the tiles of each round; the last one is the whole globe
HALO_KM = 1.05  # what is further away than twice the largest distance of near rows has no say in a row's fate
CAP = 89.0  # degrees; what is nearer to a pole is one tile


def _tiles(df: DataFrame, side: float) -> DataFrame:
    """df in every tile that it or its halo lies in, (tile, own, ...)."""
    n = round(360 / side)
    if n == 1:  # the whole globe, its equator and poles included
        return df.withColumns({"tile": F.struct(F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x")), "own": F.lit(True)})
    dlat = HALO_KM / KM_PER_DEGREE * 1.001
    dlng = F.lit(dlat) / F.cos(F.radians(F.least(F.abs("lat") + dlat, F.lit(CAP + 0.5)))) * 1.001
    band = lambda c: F.when(c >= CAP, 1_000).when(c <= -CAP, -1_000).otherwise(F.floor(c / side))
    turned = lambda c: F.pmod(F.floor(c / side), F.lit(n))
    lat, lng = F.col("lat"), F.col("lng")
    at = F.struct(band(lat).alias("y"), F.when(F.abs(lat) >= CAP, 0).otherwise(turned(lng)).alias("x"))
    ys = F.array_distinct(F.array(band(lat - dlat), band(lat), band(lat + dlat)))
    xs = F.array_distinct(F.transform(F.sequence(F.floor((lng - dlng) / side), F.floor((lng + dlng) / side)), lambda x: F.pmod(x, F.lit(n))))
    both = F.flatten(F.transform(ys, lambda y: F.when(F.abs(y) == 1_000, F.array(F.struct(y.alias("y"), F.lit(0).cast("long").alias("x")))).otherwise(F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x"))))))
    return df.withColumn("_own", at).withColumn("tile", F.explode(F.array_distinct(both))).withColumn("own", F.col("tile") == F.col("_own")).drop("_own")


def fates(kind: str) -> str:
    return f"id long, act string, slot {kind}, slot_id long, gone long"


def settle(table):
    """What becomes of the rows of one tile, as far as rows that aren't settled yet have no say in it.

    `act` is what is known of a row: open (kept in a place of its own), swap (kept in the place of a row that it outdoes),
    drop, or none yet; (slot, slot_id) is the first row of that place, `gone` the row that was outdone.
    """
    import numpy as np
    import pyarrow as pa

    table = table.sort_by([("place", "ascending"), ("id", "ascending")])
    lng, lat = (np.radians(table.column(c).to_numpy()) for c in ("lng", "lat"))
    grid = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
    cells = list(map(tuple, np.floor(grid * (6371.0 / 0.51)).astype(np.int64).tolist()))
    around = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    lng, lat, cos = lng.tolist(), lat.tolist(), np.cos(lat).tolist()
    ids, places, names, filled, acts, goes, own = (table.column(c).to_pylist() for c in ("id", "place", "station_name", "filled", "act", "gone", "own"))
    slots = list(zip(table.column("slot").to_pylist(), table.column("slot_id").to_pylist()))
    row_of = {i: r for r, i in enumerate(ids)}
    kept, undecided = {}, {}  # rows in each cell: those in place now, and those whose fate is open

    def near(a: int, b: int) -> bool:
        h = math.sin((lat[b] - lat[a]) / 2) ** 2 + cos[a] * cos[b] * math.sin((lng[b] - lng[a]) / 2) ** 2
        km = 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
        return km < 0.1 or (names[a] is not None and names[a] == names[b] and km < 0.5)

    def hits(r: int, groups) -> list[int]:
        x, y, z = cells[r]
        return [c for i, j, k in around for c in groups.get((x + i, y + j, z + k), ()) if near(c, r)]

    out = []
    for r, act in enumerate(acts):
        if act is None and own[r] and not hits(r, undecided):
            found = hits(r, kept)
            if not any(u > c and filled[u] > filled[c] for c in found for u in hits(c, undecided)):
                first = min(found, key=lambda c: slots[c], default=None)
                if first is None:
                    act, slots[r] = "open", (places[r], ids[r])
                elif filled[r] > filled[first]:
                    act, slots[r], goes[r] = "swap", slots[first], ids[first]
                else:
                    act = "drop"
                out.append((ids[r], act, *slots[r], goes[r]))
        if act is None:
            undecided.setdefault(cells[r], []).append(r)
        elif act != "drop":
            if act == "swap" and (g := row_of.get(goes[r])) is not None:
                kept[cells[g]].remove(g)
            kept.setdefault(cells[r], []).append(r)
    kinds = {"id": pa.int64(), "act": pa.string(), "slot": table.schema.field("place").type, "slot_id": pa.int64(), "gone": pa.int64()}
    columns = list(zip(*out)) or [[]] * len(kinds)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})


def dedup_stations(df: DataFrame, counted: list[str], scratch: str, order: str = "id") -> DataFrame:
    """df without near duplicates: of a pair the fuller row stays, the earlier one on ties.

    Rows are taken in order (by `order`, then id) and met with the rows kept so far; the first kept row in reach, by its
    place in the list, decides, and a fuller row takes over its place, so chains aren't transitive. A row's fate hangs on
    earlier rows within about a kilometre alone. So the rows are settled in rounds over tiles: a tile settles what
    doesn't hang on open rows of its neighbours, and a round takes the rows that are left, with what is settled near them, in
    larger tiles. Four rounds are enough for any table, and the later ones see only chains across tiles. Tables between
    rounds go to the folder `scratch`.
    """
    spark = df.sparkSession

    def save(part: DataFrame, name: str) -> DataFrame:
        part.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.schema(part.schema).parquet(f"{scratch}/{name}")

    rows = df.where(located()).select(
        F.col("id").cast("long").alias("id"), filled_count(df, counted).alias("filled"), F.col(order).alias("place"), "station_name",
        (F.pmod(F.col("longitude").cast("double") + 180, F.lit(360.0)) - 180).alias("lng"), F.col("latitude").cast("double").alias("lat"),
    )
    rows = save(rows, "rows")
    fate = fates(df.schema[order].dataType.simpleString())
    left, settled = rows, spark.createDataFrame([], fate)
    for step, side in enumerate(SIDES):
        known = rows.join(settled, "id", "left")
        if step:  # only what is near to open rows
            spots = _tiles(left, FINE).select("tile").distinct()
            known = _tiles(known, FINE).where("own").join(spots, "tile", "left_semi").select(known.columns)
        tiles = _tiles(known, side)
        busy = tiles.where("own and act is null").select("tile").distinct()
        found = save(tiles.join(busy, "tile", "left_semi").groupBy("tile").applyInArrow(settle, fate), f"settled-{step}")
        settled = settled.union(found) if step else found
        left = rows.join(settled, "id", "left_anti")
        if left.isEmpty():
            break
    lost = settled.where("act = 'drop'").select("id").union(settled.where("gone is not null").select("gone"))
    return df.join(lost, "id", "left_anti")


def removed_audit(before: DataFrame, kept: DataFrame) -> DataFrame:
    return before.join(kept.select("id"), "id", "left_anti")
