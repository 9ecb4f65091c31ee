"""The six tables of a station database: their schemas, and a partitioned reader over ranges of their keys."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GUNS = ", ".join(f"{gun}_{c} string" for gun in ("fast", "super", "slow") for c in ("available", "total", "power"))

#: Columns and types of each table; times of the first three are naive UTC, JSON and booleans are as the tables hold them.
SCHEMAS = {
    "heavy_truck_stations": "id int, station_name string, operator string, address string, city string, business_hours string, current_price string, "
    f"parking_fee string, occupancy_fee string, longitude decimal(10,6), latitude decimal(10,6), {GUNS}, fast_prices string, slow_prices string, "
    "facilities string, tags string, favorite_count string, collected_at timestamp_ntz, updated_at timestamp_ntz",
    "scan_tasks": "id long, city string, district string, grid_index int, center_lng double, center_lat double, min_lng double, max_lng double, "
    "min_lat double, max_lat double, status string, assigned_device string, station_count int, started_at timestamp_ntz, completed_at timestamp_ntz, created_at timestamp_ntz",
    "collection_logs": "id long, station_id long, layer string, raw_data string, success boolean, error_msg string, created_at timestamp_ntz",
    "station_tasks": "task_id long, station_id string, payload_json string, source_sequence int, priority int, status string, attempts int, max_attempts int, "
    "available_at double, lease_owner string, lease_token string, lease_expires_at double, rerun_requested boolean, result_json string, "
    "completeness_score double, detailed boolean, last_error string, created_at string, updated_at string",
    "task_attempts": "attempt_id long, task_id long, station_id string, attempt_no int, device_serial string, lease_token string, strategy string, outcome string, "
    "error string, result_json string, started_at string, finished_at string",
    "device_workers": "device_serial string, worker_id string, status string, current_task_id long, metadata_json string, last_heartbeat double, updated_at string",
}
KEYS = {"heavy_truck_stations": "id", "scan_tasks": "id", "collection_logs": "id", "station_tasks": "task_id", "task_attempts": "attempt_id", "device_workers": "rowid"}


class Range(InputPartition):
    """Keys from `low` to `high`, both included."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class StationDatabase(DataSource):
    """format("station_database"): a table of a database file that all executors can open.

    Options: path, table (one of SCHEMAS), partitions (ranges of the table's key, 8 by default). Each range is a task of its
    own, which reads its rows over the key's index, and only the columns that the schema names.
    """

    @classmethod
    def name(cls) -> str:
        return "station_database"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RangeReader(self.options, schema)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.count = options["path"], options["table"], int(options.get("partitions", 8))
        if self.table not in SCHEMAS or self.count < 1:
            raise ValueError(f"no such table or number of partitions: {self.table}, {self.count}")
        self.schema, self.key = schema, KEYS[self.table]

    def _rows(self, statement: str, *values) -> Iterator[tuple]:
        connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from connection.execute(statement, values)
        finally:
            connection.close()

    def partitions(self) -> list[Range]:
        low, high = next(self._rows(f"SELECT min({self.key}), max({self.key}) FROM {self.table}"))
        if low is None:
            return [Range(0, -1)]
        step = -(-(high - low + 1) // self.count)
        return [Range(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        takes = [converter(f.dataType) for f in self.schema]
        columns = ", ".join(f'"{f.name}"' for f in self.schema)
        for row in self._rows(f"SELECT {columns} FROM {self.table} WHERE {self.key} BETWEEN ? AND ?", partition.low, partition.high):
            yield tuple(None if v is None else take(v) for take, v in zip(takes, row))


def converter(kind: T.DataType):
    """What turns a value as the file holds it into one of the type."""
    import datetime
    import decimal

    if isinstance(kind, T.TimestampNTZType):
        return lambda v: datetime.datetime.fromisoformat(v)
    if isinstance(kind, T.DecimalType):
        return lambda v: decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-kind.scale))
    makes = {T.BooleanType: bool, T.DoubleType: float, T.StringType: str, T.IntegerType: int, T.LongType: int}
    return makes[type(kind)]


def read_database(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a database file in a folder that all executors share."""
    spark.dataSource.register(StationDatabase)
    return spark.read.format("station_database").options(path=path, table=table, partitions=str(partitions)).load()


def read_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database server over ranges of its key from low to high; needs the server's driver on the class path."""
    ranged = {"partitionColumn": KEYS[table], "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranged, **options).load()


def read_parquet_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table kept as Parquet, under its schema whatever the files hold: missing columns are null."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)
