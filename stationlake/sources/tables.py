"""Sources and sinks: source lists, results, dumps, dimensions and checked appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import TEXT_LIMITS

PERIODS = "array<struct<time:string, total_price:string, price:string, elec_fee:string, service_fee:string, tag:string, source:string>>"
POI = "map<string, struct<name:string, address:string, city:string, district:string, location:string>>"


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """A source list: all columns text, empty cells ''."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_results_json(spark: SparkSession, path: str, station: T.StructType) -> DataFrame:
    """Collected results: {"stations": [...]} documents or bare arrays of stations.

    Periods may give their price under its older name, price, where total_price is missing.
    """
    rows = spark.read.text(path, wholetext=True)
    kind = station.simpleString()
    bare = F.from_json("value", f"array<{kind}>")
    named = F.from_json("value", f"struct<total:long, stations:array<{kind}>>")["stations"]
    found = rows.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(named)).alias("s")).select("s.*")
    priced = [f.name for f in station if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and {"price", "total_price"} <= set(f.dataType.elementType.names)]
    total = lambda p: p.withField("total_price", F.coalesce(F.nullif(p["total_price"], F.lit("")), p["price"], p["total_price"]))
    return found.withColumns({c: F.transform(c, total) for c in priced}) if priced else found


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Saved page dumps: station and attempt number stand in the file name."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml").select("value", F.col("_metadata.file_name").alias("file"))
    name = F.regexp_extract("file", r"^(.*)_attempt(\d+)\.xml$", 1)
    return rows.select(name.alias("station_key"), F.regexp_extract("file", r"_attempt(\d+)\.xml$", 1).try_cast("int").alias("attempt"), F.col("value").alias("xml"))


CONTEXT = "struct<station_id:string, attempt:int, error:string, payload:string, captured_at:string>"


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(station_key, attempt, xml, context, context_raw, found): saved dumps with the JSON context of the same attempt.

    Both files of an attempt are named <station_key>_attempt<n>, so they are paired by that; found is both, xml or json, as one
    of the two may be missing. A context that is no JSON object is null and stays in context_raw. payload is JSON text. Other
    files are ignored.
    """
    name, pattern = F.col("_metadata.file_name"), r"^(.*)_attempt(\d+)\.(?:xml|json)$"
    keys = (F.regexp_extract(name, pattern, 1).alias("station_key"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("attempt"))

    def files(ending: str, text: str) -> DataFrame:
        rows = spark.read.schema("value string").text(path, wholetext=True, pathGlobFilter=f"*_attempt*.{ending}")
        return rows.select(*keys, F.col("value").alias(text)).where("attempt is not null")

    both = files("xml", "xml").join(files("json", "json"), ["station_key", "attempt"], "full_outer")
    context = F.when(F.ltrim("json").startswith("{") & F.try_parse_json("json").isNotNull(), F.from_json("json", CONTEXT))
    found = F.when(F.col("xml").isNull(), "json").when(F.col("json").isNull(), "xml").otherwise("both")
    return both.select("station_key", "attempt", "xml", context.alias("context"), F.when(context.isNull(), F.col("json")).alias("context_raw"), found.alias("found"))


def write_poi_lines(poi: DataFrame, path: str) -> None:
    """Writes a POI dimension back, one JSON object to a line, for read_poi_lines(); the last row of an id wins."""
    fields = ("name", "address", "city", "district", "location")
    record = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])
    one = poi.groupBy("station_id").agg(F.max(record).alias("p"))
    one.select(F.to_json(F.create_map("station_id", "p")).alias("value")).write.mode("overwrite").text(path)


def read_poi_lines(spark: SparkSession, path: str) -> DataFrame:
    """A POI dimension of many JSON objects, one to a line, so that large files are split."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", POI)).alias("station_id", "p"))
    return rows.select("station_id", "p.*")


def read_poi_dim(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", POI)).alias("station_id", "p"))
    return rows.select("station_id", "p.*")


def decode_json_cols(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Decodes JSON text columns; what can't be decoded stays as text in <column>_raw."""
    for c, kind in columns.items():
        decoded = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, kind))
        raw = F.when(decoded.isNull() & F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))
        df = df.withColumns({f"{c}_raw": raw, c: decoded})
    return df


def decode_payload(tasks: DataFrame, payload: str, result: str) -> DataFrame:
    """tasks with payload and result as structs of the given types, from payload_json and result_json.

    A text that is no JSON of that type gives null and stays in payload_json_raw or result_json_raw.
    """
    names = {"payload_json": payload, "result_json": result}
    return decode_json_cols(tasks, names).withColumnsRenamed({c: c.removesuffix("_json") for c in names})


def encode_payload(tasks: DataFrame) -> DataFrame:
    """tasks with payload and result as compact JSON texts again; a null struct stays null."""
    text = {f"{c}_json": F.to_json(c, {"ignoreNullFields": "false"}) for c in ("payload", "result")}
    return tasks.withColumns(text).drop("payload", "result", "payload_json_raw", "result_json_raw")


def split_valid(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be appended, and the others with their reason."""
    too_long = [F.when(F.length(c) > n, F.lit(c)) for c, n in TEXT_LIMITS.items() if c in stations.columns]
    number = [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), F.lit(c)) for c in ("longitude", "latitude")]
    reason = F.coalesce(F.when(F.coalesce("station_name", F.lit("")) == "", "station_name"), *too_long, *number)
    judged = stations.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def append_stations(stations: DataFrame, path: str, rejects: str) -> dict[str, int]:
    """Appends the valid rows and writes the others aside; counts come from the writes themselves."""
    from pyspark.sql import Observation

    valid, bad = split_valid(stations)
    counts = {}
    for name, part, where in (("inserted", valid, path), ("rejected", bad, rejects)):
        seen = Observation(name)
        part.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(where)
        counts[name] = seen.get["n"]
    return counts | {"total": sum(counts.values())}


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
