import datetime
import decimal
import json
import sqlite3

import pytest
from pyspark.sql import types as T

from stationlake.plans import history_queries
from stationlake.sources import database, tables

AT = "2024-01-02 03:04:05"
VALUES = {T.StringType: lambda i: f"t{i}", T.IntegerType: lambda i: i, T.LongType: lambda i: i, T.DoubleType: lambda i: i + 0.5, T.BooleanType: lambda i: i % 2, T.DecimalType: lambda i: i + 0.25, T.TimestampNTZType: lambda i: AT}
WANTED = {T.BooleanType: bool, T.DecimalType: lambda v: decimal.Decimal(str(v)).quantize(decimal.Decimal("0.000001")), T.TimestampNTZType: datetime.datetime.fromisoformat}


@pytest.mark.parametrize("name", list(database.SCHEMAS))
@pytest.mark.parametrize("n", [0, 1, 50])
def test_each_table_by_ranges_of_its_key(spark, tmp_path, name, n):
    fields = T.StructType.fromDDL(database.SCHEMAS[name]).fields
    key = database.KEYS[name]
    rows = [tuple(3 * i if f.name == key else None if (i + j) % 4 == 0 else VALUES[type(f.dataType)](i) for j, f in enumerate(fields)) for i in range(n)]
    path = f"{tmp_path}/tasks.db"
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {name} (extra TEXT, " + ", ".join(f"{f.name}{' INTEGER PRIMARY KEY' if f.name == key else ''}" for f in fields) + ")")
        db.executemany(f"INSERT INTO {name} VALUES ('x', {', '.join('?' * len(fields))})", rows)
    for partitions in (1, 7):
        df = database.read_database(spark, path, name, partitions)
        assert df.schema == T.StructType.fromDDL(database.SCHEMAS[name]) and df.rdd.getNumPartitions() <= partitions
        want = [tuple(None if v is None else WANTED.get(type(f.dataType), lambda x: x)(v) for f, v in zip(fields, r)) for r in rows]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_odd_options(spark, tmp_path):
    with pytest.raises(Exception, match="no such table"):
        spark.dataSource.register(database.StationDatabase)
        spark.read.format("station_database").schema("a int").options(path="x", table="other").load().collect()


def test_parquet_tables_have_their_schema(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, station_name string").write.parquet(f"{tmp_path}/t")
    row = database.read_parquet_table(spark, f"{tmp_path}/t", "heavy_truck_stations").first()
    assert (row.id, row.station_name, row.tags) == (1, "a", None) and len(row) == 27


def test_artifacts_are_paired(spark, tmp_path):
    files = {
        "P1_attempt1.xml": "<a/>", "P1_attempt1.json": json.dumps({"station_id": "P1", "attempt": 1, "error": "e", "payload": {"id": "P1"}, "captured_at": "2024"}),
        "P1_attempt2.xml": "<b/>", "P_2_attempt10.json": "broken", "P3_attempt1.json": "[1]", "P3_attempt1.png": "x", "notes.json": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = sorted((r.station_key, r.attempt, r.found, r.xml, r.context and r.context.error, r.context and r.context.payload, r.context_raw) for r in tables.read_artifacts(spark, str(tmp_path)).collect())
    assert got == [("P1", 1, "both", "<a/>", "e", '{"id":"P1"}', None), ("P1", 2, "xml", "<b/>", None, None, None), ("P3", 1, "json", None, None, None, "[1]"), ("P_2", 10, "json", None, None, None, "broken")]
    assert spark.createDataFrame([], "a int").count() == 0


def test_results_with_older_prices(spark, tmp_path):
    kind = T.StructType.fromDDL("id int, fast_prices array<struct<total_price:string, price:string>>")
    (tmp_path / "a.json").write_text('{"total": 2, "stations": [{"id": 1, "fast_prices": [{"price": "0.5"}, {"total_price": "", "price": "0.6"}]}, {"id": 2}]}')
    (tmp_path / "b.json").write_text(' [{"id": 3, "fast_prices": [{"total_price": "0.7", "price": "9"}, {"total_price": ""}]}]')
    got = {r.id: r.fast_prices and [p.total_price for p in r.fast_prices] for r in tables.read_results_json(spark, str(tmp_path), kind).collect()}
    assert got == {1: ["0.5", "0.6"], 2: None, 3: ["0.7", ""]}


def test_tasks_write_files_under_the_names_given(spark, tmp_path):
    """Names stay as they are; the driver had renamed folders, whose names Spark escapes."""
    rows = [(f"P={i}_attempt1.xml", f"<a{i}/>\n<b/>" if i else None) for i in range(40)]
    where = f"file:{tmp_path}/made"
    history_queries.write_files(spark.createDataFrame(rows, "name string, value string").repartition(5), where)
    assert {f.name: f.read_text() for f in (tmp_path / "made").iterdir()} == {n: f"{v or ''}\n" for n, v in rows}
    got = {(r.station_key, r.attempt, r.found) for r in tables.read_artifacts(spark, where).collect()}
    assert got == {(f"P={i}", 1, "xml") for i in range(40)}
