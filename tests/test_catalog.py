"""Every registered query against its SQL in DuckDB, and the special inputs of single operators."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from stationlake.functions import columns as C
from stationlake.functions import regions as R
from stationlake.operators import geo, prices, tasks
from stationlake.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def value(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6f}"
    return str(x.replace(tzinfo=None)) if isinstance(x, datetime.datetime) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(value(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(value(r[c]) for c in order) for r in rows) == want


def test_region_cases(spark):
    cases = [("郑州市金水区某路1号", "郑州市", "金水区"), ("郑州市解放路", "焦作市", "解放区"), ("新密市", "郑州市", "新密市"), ("济源充电站", "济源市", ""), ("somewhere", "", ""), (None, "", "")]
    df = spark.createDataFrame([(a,) for a, *_ in cases], "a string").select(R.parse_region("a").alias("r"))
    assert [(r.r.city, r.r.district) for r in df.collect()] == [c[1:] for c in cases]
    plan = R.search_plan(R.regions(spark))
    assert plan.count() == 175


def test_text_cases(spark):
    df = spark.createDataFrame([("a　b 汽车充电站（一）", "é🙂x", " 2024-01-01T08:00:00+08:00")], "n string, u string, t string")
    from pyspark.sql import functions as F

    got = df.select(C.normalize_name("n"), C.utf8_truncate("u", 5), C.utf8_truncate("u", 6), C.normalize_ts("t", F.current_timestamp())).first()
    assert tuple(got) == ("ab充电站一", "é", "é🙂", datetime.datetime(2024, 1, 1))


def test_dedup_equals_the_literal_fold(spark, tmp_path, sf):
    from stationlake.plans.fixtures import fixture

    rows = fixture(spark, sf, "fx_stations").collect()

    class Row:
        def __init__(self, r):
            self.id, self.station_name = r.id, r.station_name
            self.lng, self.lat = (float(r.longitude or 0), float(r.latitude or 0))
            self.filled = sum(bool(r[c]) for c in catalog.COUNTED)

    def near(x, y):
        a = math.sin(math.radians(y.lat - x.lat) / 2) ** 2 + math.cos(math.radians(x.lat)) * math.cos(math.radians(y.lat)) * math.sin(math.radians(y.lng - x.lng) / 2) ** 2
        km = 2 * 6371.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))
        return km < 0.1 or (x.station_name == y.station_name and km < 0.5)

    kept = []
    for r in sorted(map(Row, rows), key=lambda r: r.id):
        hit = next((i for i, x in enumerate(kept) if r.lng and x.lng and near(x, r)), None)
        if hit is None:
            kept.append(r)
        elif r.filled > kept[hit].filled:
            kept[hit] = r
    got = geo.dedup_stations(spark.createDataFrame(rows), catalog.COUNTED, f"{tmp_path}/d")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in kept)
