import random

from stationlake.operators import upsert


def brute(current, incoming):
    """The statements one after the other, as a database would run them."""
    rows = [dict(zip(("id", "name", "city", "address", "price"), r)) for r in current]
    top = max((r["id"] for r in rows), default=0)
    new = []
    for pos, name, city, address, price in sorted(incoming):
        same = [r for r in rows + new if name is not None and city is not None and (r["name"], r["city"]) == (name, city)]
        hits = [r for r in same if r["address"] == address] if address else same
        values = {"city": city, "address": address, "price": price}
        if hits:
            max(hits, key=lambda r: (r["id"] is None, r["id"] or 0, r.get("at", 0))).update(values)
        else:
            new.append({"id": None, "name": name, "at": pos, **values})
    for k, r in enumerate(sorted(new, key=lambda r: r["at"])):
        r["id"] = top + 1 + k
    return sorted((r["id"], r["name"], r["city"], r["address"], r["price"]) for r in rows + new)


def test_equals_the_statements_in_order(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    current = [(i, pick("a", "b", "c"), pick("x", "y", None), pick("", "r1", "r2", None), 9007199254740993 + i) for i in range(40)]
    incoming = [(100 + i, pick("a", "b", "c", "d", "e"), pick("x", "y", "z", None), pick("", "r1", "r2", "r3", "r3", None) if i % 3 == 0 else pick("r1", "r2", "r3"), i if i % 4 else None) for i in range(80)]
    for some in (incoming, [r for r in incoming if r[3]], []):
        left = spark.createDataFrame(current, "id long, station_name string, city string, address string, price long")
        right = spark.createDataFrame(some, "pos long, station_name string, city string, address string, price long").repartition(3)
        got = upsert.upsert_stations(left, right)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(current, some), key=str)
