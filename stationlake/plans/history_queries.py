"""Queries over task histories, sinks and period lists."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regions as R
from ..operators import history, prices, stats, storage, tasks
from ..sources import database, tables
from ..streaming import ingest, leases, windows
from .registry import register, shared_folder

EVENTS = """
SELECT task_id, CAST(attempt_no AS DOUBLE)*40.0 AS ts, attempt_no AS seq,
 CASE WHEN outcome='retry' THEN 'claim' WHEN outcome='succeeded' THEN 'complete' WHEN outcome='failed' THEN 'fail' WHEN outcome='interrupted' THEN 'release'
  WHEN attempt_id%3=0 THEN 'requeue' WHEN attempt_id%3=1 THEN 'enqueue' ELSE 'heartbeat' END AS kind,
 CASE WHEN attempt_id%7=0 THEN 'stale' ELSE CAST(max(CASE WHEN outcome='retry' THEN attempt_no END) OVER (PARTITION BY task_id ORDER BY attempt_no) AS STRING) END AS lease_token,
 CAST(attempt_id%101 AS DOUBLE) AS score FROM fx_attempts"""


FOLDED = f"""
WITH RECURSIVE ev AS ({EVENTS}), s(task_id, n, status, attempts, available_at, token, expires, score, rerun) AS (
 SELECT DISTINCT task_id, CAST(0 AS BIGINT), 'pending', 0, CAST(0 AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), false FROM ev
 UNION ALL
 SELECT task_id, seq,
  CASE WHEN act IN ('mark','take') THEN 'leased' WHEN act IN ('fresh','again','redo','retry','back') THEN 'pending' WHEN act IN ('dead','lost') THEN 'failed' WHEN act='done' THEN 'succeeded' ELSE status END,
  CASE WHEN act IN ('fresh','again','redo') OR (act='retry' AND rerun) THEN 0 WHEN act='take' THEN attempts+1 WHEN act='back' THEN greatest(0,attempts-1) ELSE attempts END,
  CASE WHEN act IN ('fresh','again') THEN 0 WHEN act IN ('redo','lost','back') OR (act='take' AND lapsed) THEN ts WHEN act='retry' THEN ts+5 ELSE available_at END,
  CASE WHEN act='take' THEN lease_token WHEN act IN ('mark','beat','none') THEN token END,
  CASE WHEN act IN ('take','beat') THEN ts+180 WHEN act IN ('mark','none') THEN expires END,
  CASE WHEN act IN ('redo','done') THEN score2 WHEN act IN ('retry','lost') THEN greatest(score,score2) ELSE score END,
  CASE WHEN act='mark' THEN true WHEN act IN ('fresh','redo','retry') THEN false ELSE rerun END
 FROM (SELECT *, CASE WHEN kind='enqueue' THEN CASE WHEN status='leased' THEN 'mark' ELSE 'fresh' END
   WHEN kind='claim' AND lapsed AND attempts>=3 THEN 'dead' WHEN kind='claim' AND (lapsed OR (status='pending' AND available_at<=ts AND attempts<3)) THEN 'take'
   WHEN kind='requeue' AND status='failed' THEN 'again' WHEN NOT fits THEN 'none' WHEN kind='heartbeat' THEN 'beat' WHEN kind='complete' THEN CASE WHEN rerun THEN 'redo' ELSE 'done' END
   WHEN kind='fail' THEN CASE WHEN attempts<3 OR rerun THEN 'retry' ELSE 'lost' END WHEN kind='release' THEN 'back' ELSE 'none' END AS act
  FROM (SELECT s.task_id, s.status, s.attempts, s.available_at, s.token, s.expires, s.score, s.rerun, ev.seq, ev.ts, ev.kind, ev.lease_token, ev.score AS score2,
    status='leased' AND expires<ts AS lapsed, status='leased' AND token IS NOT DISTINCT FROM lease_token AS fits FROM s JOIN ev ON ev.task_id=s.task_id AND ev.seq=s.n+1)))
SELECT task_id, status, attempts, available_at, token AS lease_token, expires AS lease_expires_at, score, rerun FROM s QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC)=1"""


@register("stm4_task_state", "fx_attempts", FOLDED)
def state(attempts: DataFrame) -> DataFrame:
    return history.task_state(task_events(attempts)).drop("max_attempts", "detailed", "result", "last_error")


def task_events(attempts: DataFrame) -> DataFrame:
    """Events made of attempts, behind one enqueue event for each task."""
    events = attempts.sparkSession.sql(EVENTS.replace("fx_attempts", "{attempts}"), attempts=attempts)
    first = events.select("task_id").distinct().select("task_id", F.lit(0.0).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("enqueue").alias("kind"), F.lit(None).cast("string").alias("lease_token"), F.lit(0.0).alias("score"))
    return first.unionByName(events)


def as_stream(rows: DataFrame, order: list[str], files: int = 3) -> DataFrame:
    """The rows as a stream that brings them in the given order, in files that come one after the other."""
    where = shared_folder(rows.sparkSession)
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(where)
    path, fs = storage.filesystem(rows.sparkSession, where)
    parts = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for k, part in enumerate(parts):  # a stream takes files by their times
        fs.setTimes(part, 1_700_000_000_000 + 60_000 * k, -1)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)


@register("stm4_stream_leases", "fx_attempts", f"""
SELECT task_id, CASE WHEN status<>'leased' THEN status WHEN attempts<3 THEN 'pending' ELSE 'failed' END AS status, attempts, score, rerun FROM ({FOLDED})""")
def leases_by_time(attempts: DataFrame) -> DataFrame:
    """The same events as a stream, behind which time goes on: timers end the leases that no event ended."""
    root = shared_folder(attempts.sparkSession)
    events = task_events(attempts).withColumn("ts", F.col("ts") + 1e6)
    clock = attempts.select(F.lit(-1).cast("long").alias("task_id"), F.lit(1e9).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("enqueue").alias("kind"), F.lit(None).cast("string").alias("lease_token"), F.lit(0.0).alias("score"))
    stream = as_stream(events.unionByName(clock.limit(1)), ["ts", "seq"])
    leases.stream_lease_states(stream, f"{root}/t", f"{root}/c", "500000000 seconds").awaitTermination()
    found = storage.BucketTable(attempts.sparkSession, f"{root}/t", []).read().where("task_id >= 0")
    return found.select("task_id", "status", "attempts", "score", "rerun")


@register("stm1_stream_upsert", "fx_stations", """
WITH i AS (SELECT id AS pos, station_name, city, concat('road',CAST(id%3 AS VARCHAR)) AS address, current_price FROM fx_stations)
SELECT station_name, city, address, max_by(current_price, pos) AS current_price FROM i GROUP BY station_name, city, address""")
def upserts(stations: DataFrame) -> DataFrame:
    """Stations of the names, cities and addresses that results bring, each with its last price; every batch touches all names' buckets once."""
    spark, root = stations.sparkSession, shared_folder(stations.sparkSession)
    results = stations.select(F.col("id").alias("pos"), "station_name", "city", F.concat(F.lit("road"), F.col("id") % 3).alias("address"), "current_price")
    ingest.wait_for(ingest.stream_upsert(as_stream(results, ["pos"]), f"{root}/t", f"{root}/c", buckets=16))
    return storage.BucketTable(spark, f"{root}/t", []).read().drop("id")


@register("stm5_stream_first_seen", "fx_cards", "SELECT DISTINCT query_id, lower(replace(replace(regexp_replace(name, '[\\s（）()·•\\-—_　]+', '', 'g'), '汽车充电站', '充电站'), '超级充电站', '充电站')) AS norm_name FROM fx_cards")
def first_seen(cards: DataFrame) -> DataFrame:
    """The names of each search, once, as WIN-5 finds them, from a stream whose cards come in any order within its watermark."""
    root = shared_folder(cards.sparkSession)
    timed = cards.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("screen") * 60 + F.col("cy") / 60))
    names = windows.stream_first_seen(as_stream(timed, ["cy", "query_id"]), "365 days").select("query_id", "norm_name")
    names.writeStream.format("parquet").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return cards.sparkSession.read.schema("query_id long, norm_name string").parquet(f"{root}/out")


register("win8_fenced_results", "fx_attempts", "WITH l AS (SELECT task_id, max(attempt_no) AS attempt_no FROM fx_attempts GROUP BY task_id) SELECT a.attempt_id, l.task_id, l.attempt_no FROM fx_attempts a JOIN l ON l.task_id=a.task_id AND a.attempt_no-a.attempt_id%2=l.attempt_no")(
    lambda a: history.fenced_results(a.select("task_id", "attempt_no", F.concat(F.lit("t"), "attempt_no").alias("lease_token")), a.select("task_id", "attempt_id", F.concat(F.lit("t"), F.col("attempt_no") - F.col("attempt_id") % 2).alias("lease_token"))).select("attempt_id", "task_id", "attempt_no")
)
register("win6_with_failures", "fx_trail", """
WITH a AS (SELECT *, pos%7=0 AS failed, pos%3<>0 AND district_match<>'outside' AS ok FROM fx_trail), o AS (SELECT *, district_match='outside' AND NOT failed AS far FROM a),
b AS (SELECT *, sum(CASE WHEN far THEN 0 ELSE 1 END) OVER w AS g, sum(CASE WHEN ok AND NOT failed AND NOT far THEN 1 ELSE 0 END) OVER w AS acc FROM o WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, g ORDER BY pos) AS run FROM b), d AS (SELECT query_id, min(pos) AS cut FROM c WHERE run>=4 AND acc>0 GROUP BY query_id)
SELECT c.query_id, c.pos FROM c LEFT JOIN d ON d.query_id=c.query_id WHERE cut IS NULL OR pos<=cut""")(
    lambda t: tasks.convergence_cutoff(t, accepted=(F.col("pos") % 3 != 0) & (F.col("district_match") != "outside"), failed=F.col("pos") % 7 == 0).select("query_id", "pos")
)
register("sort3_export_order", "fx_tasks", "SELECT task_id, source_sequence FROM fx_tasks ORDER BY source_sequence, task_id")(lambda t: tasks.export_order(t).select("task_id", "source_sequence"))
SHOWN = ", ".join(c if c in ("id", "station_name", "operator", "address", "city", "current_price", "fast_available", "fast_total") else f"NULL AS {c}" for c in stats.NEARBY_COLS if c not in ("longitude", "latitude"))
register("prj1_public_columns", "fx_stations", f"SELECT {SHOWN} FROM fx_stations")(lambda s: stats.public_columns(s, stats.NEARBY_COLS).drop("longitude", "latitude"))
register("prj8_search_plan", "fx_stations", f"SELECT city, district, concat(city, district, '重卡充电站') AS phrase, count(*) AS n FROM (SELECT city, district FROM fx_stations UNION ALL SELECT city, '' FROM fx_stations) GROUP BY 1, 2")(
    lambda s: (lambda plan: s.select("city", "district").unionByName(s.select("city", F.lit("").alias("district"))).groupBy("city", "district").agg(F.count("*").alias("n")).join(plan, ["city", "district"]).select("city", "district", "phrase", "n"))(
        R.search_plan(s.select("city", "district").distinct()).withColumn("district", F.when(F.col("district") == "全市", "").otherwise(F.col("district")))
    )
)
register("set1_concat_periods", "fx_price_periods", "SELECT station_id, pos, time, CASE WHEN pos%2=0 THEN tag END AS tag FROM fx_price_periods UNION ALL SELECT station_id, pos, time, NULL FROM fx_price_periods WHERE pos=1")(
    lambda p: prices.concat_periods(p.select("station_id", "pos", "time", F.when(F.col("pos") % 2 == 0, F.col("tag")).alias("tag")), p.where("pos=1").select("station_id", "pos", "time"))
)
register("set2_union_lists", "fx_price_periods", "SELECT station_id, count(DISTINCT t) AS n FROM (SELECT station_id, time AS t FROM fx_price_periods UNION ALL SELECT station_id, tag FROM fx_price_periods) GROUP BY station_id")(
    lambda p: p.groupBy("station_id").agg(F.collect_list("time").alias("a"), F.collect_list("tag").alias("b")).select("station_id", F.size(prices.union_lists("a", "b")).cast("long").alias("n"))
)
register("prj9_result_view", "fx_stations fx_price_periods", "SELECT s.id, left(s.station_name, 25) AS name, count(p.pos) AS periods FROM fx_stations s LEFT JOIN fx_price_periods p ON p.station_id=s.id GROUP BY s.id, s.station_name")(
    lambda s, p: prices.result_view(s.join(prices.collect_periods(p, ["station_id"]).select(F.col("station_id").alias("id"), F.col("periods").alias("fast_prices")), "id", "left").withColumn("slow_prices", F.col("fast_prices"))).select("id", "name", F.col("periods").cast("long").alias("periods"))
)
register("jsn1_payload_codec", "fx_source_rows", "SELECT pos, name, address FROM fx_source_rows")(
    lambda r: tables.decode_payload(tables.encode_payload(r.select("pos", F.struct("name", "address").alias("payload"), F.lit(None).cast("struct<ok:boolean>").alias("result"))), "struct<name:string, address:string>", "struct<ok:boolean>").select("pos", "payload.name", "payload.address")
)


@register("src1_csv_round_trip", "fx_source_rows", "SELECT pos, id, name, address FROM fx_source_rows")
def csv(rows: DataFrame) -> DataFrame:
    where = shared_folder(rows.sparkSession)
    rows.select("pos", "id", "name", "address").write.option("header", True).option("escape", '"').csv(where)
    return tables.read_station_csv(rows.sparkSession, where).withColumn("pos", F.col("pos").cast("long"))


@register("src6_poi_dimension", "fx_poi", "SELECT station_id, name, city, location FROM fx_poi")
def poi(rows: DataFrame) -> DataFrame:
    where = shared_folder(rows.sparkSession)
    rows.select(F.to_json(F.create_map("station_id", F.struct("name", "address", "city", "district", "location")))).write.text(where)
    return tables.read_poi_lines(rows.sparkSession, where).select("station_id", "name", "city", "location")


@register("snk1_append_stations", "fx_stations", "SELECT id, station_name FROM fx_stations WHERE id%10<>0")
def append(stations: DataFrame) -> DataFrame:
    where = shared_folder(stations.sparkSession)
    tables.append_stations(stations.withColumn("station_name", F.when(F.col("id") % 10 == 0, "").otherwise(F.col("station_name"))), f"{where}/ok", f"{where}/bad")
    return stations.sparkSession.read.parquet(f"{where}/ok").select("id", "station_name")


@register("snk2_versioned_table", "fx_stations", "SELECT id, CASE WHEN id%7=0 THEN 'moved' ELSE city END AS city FROM fx_stations WHERE id%7<>1")
def versioned(stations: DataFrame) -> DataFrame:
    """A table of buckets after two commits, the second of which moves and removes rows of a part."""
    table = storage.BucketTable(stations.sparkSession, shared_folder(stations.sparkSession), ["id"], 16)
    table.apply(stations.select("id", "city"), 0, lambda _, batch, __: batch)
    some = stations.where("id%7 in (0,1)").select("id", F.when(F.col("id") % 7 == 0, "moved").alias("city"))
    table.apply(some, 1, lambda before, batch, _: before.join(batch, "id", "left_anti").unionByName(batch.where("city is not null")))
    return table.read()


@register("snk4_report", "fx_stations", "SELECT id, city FROM fx_stations")
def report(stations: DataFrame) -> DataFrame:
    where = shared_folder(stations.sparkSession)
    tables.write_report({"stations": stations.select("id", "city")}, where)
    return stations.sparkSession.read.schema("id long, city string").json(f"{where}/stations")



STATION = "id long, station_name string, fast_prices array<struct<time:string, total_price:string, price:string>>"


@register("src2_results_json", "fx_stations", "SELECT id, station_name, CASE WHEN id%3=0 THEN NULL ELSE current_price END AS total_price FROM fx_stations")
def results_json(stations: DataFrame) -> DataFrame:
    """Documents of some 50 stations each, half of them bare arrays, with prices under the newer or the older name."""
    where = shared_folder(stations.sparkSession)
    period = F.struct(F.lit("00:00-24:00").alias("time"), F.when(F.col("id") % 3 == 1, F.col("current_price")).alias("total_price"), F.when(F.col("id") % 3 == 2, F.col("current_price")).alias("price"))
    record = F.struct("id", "station_name", F.array(period).alias("fast_prices"))
    packed = stations.groupBy((F.col("id") % 30).alias("part")).agg(F.collect_list(record).alias("stations"))
    named = F.to_json(F.struct(F.size("stations").alias("total"), "stations"))
    shown = packed.select("part", F.when(F.col("part") % 2 == 0, named).otherwise(F.to_json("stations")).alias("value"))
    shown.repartition(30, "part").write.partitionBy("part").text(where)
    found = tables.read_results_json(stations.sparkSession, f"{where}/*/*.txt", T.StructType.fromDDL(STATION))
    return found.select("id", "station_name", F.col("fast_prices")[0]["total_price"].alias("total_price"))


@register("src3_station_tables", "fx_stations fx_tasks fx_attempts", """
SELECT 'heavy_truck_stations' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS keys, count(longitude) AS some FROM fx_stations
UNION ALL SELECT 'station_tasks', count(*), CAST(sum(task_id) AS BIGINT), count(lease_expires_at) FROM fx_tasks UNION ALL SELECT 'task_attempts', count(*), CAST(sum(attempt_id) AS BIGINT), count(*) FROM fx_attempts""")
def station_tables(stations: DataFrame, task_rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Three of the tables, written as they are and read under their schemas; columns that the files lack are null."""
    spark, out = stations.sparkSession, []
    for name, rows, some in (("heavy_truck_stations", stations.withColumn("id", F.col("id").cast("int")), "longitude"), ("station_tasks", task_rows, "lease_expires_at"), ("task_attempts", attempts, "attempt_no")):
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(database.SCHEMAS[name])}
        where = shared_folder(spark)
        rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns if c in kinds]).write.parquet(where)
        read = database.read_parquet_table(spark, where, name)
        out.append(read.agg(F.count("*").alias("n"), F.sum(database.KEYS[name]).cast("long").alias("keys"), F.count(some).alias("some")).select(F.lit(name).alias("name"), "n", "keys", "some"))
    return out[0].union(out[1]).union(out[2])


def write_files(rows: DataFrame, path: str) -> None:
    """Writes each row (name, value) as a file of its own, value being its whole text, a line end behind it.

    Each task writes the files of its rows; path is local to all or one that pyarrow opens. A file gets its name when it is whole, so a task that runs again changes nothing.
    """
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    root.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(root)
    where = re.sub("^file:/+", "/", path.rstrip("/"))

    def write(batches):
        system, folder = fs.FileSystem.from_uri(where)
        n = 0
        for batch in batches:
            for name, value in zip(*(batch[c].to_pylist() for c in ("name", "value")), strict=True):
                aside = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(f"{value or ''}\n".encode())
                system.move(aside, f"{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.select("name", "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@register("src4_artifacts", "fx_attempts", """
SELECT 'P'||task_id AS station_key, CAST(attempt_no AS INTEGER) AS attempt, CASE WHEN attempt_id%3=0 THEN 'xml' WHEN attempt_id%3=1 THEN 'json' ELSE 'both' END AS found,
 CASE WHEN attempt_id%3<>1 THEN '<node id="'||attempt_id||'"/>'||chr(10) END AS xml, CASE WHEN attempt_id%3<>0 AND attempt_id%5<>0 THEN outcome END AS error, CASE WHEN attempt_id%3<>0 AND attempt_id%5=0 THEN 'broken'||chr(10) END AS context_raw
FROM fx_attempts WHERE task_id%10=0 AND attempt_no<=5""")
def artifacts(attempts: DataFrame) -> DataFrame:
    """Two files for some attempts and one for others, some of them broken, each written by the task that holds its attempt."""
    spark, where = attempts.sparkSession, shared_folder(attempts.sparkSession)
    some = attempts.where("task_id%10=0 and attempt_no<=5")
    context = F.when(F.col("attempt_id") % 5 == 0, "broken").otherwise(F.to_json(F.struct(F.concat(F.lit("P"), "task_id").alias("station_id"), F.col("attempt_no").cast("int").alias("attempt"), F.col("outcome").alias("error"))))
    xml = F.concat(F.lit('<node id="'), "attempt_id", F.lit('"/>'))
    file = lambda ending, value: F.struct(F.concat(F.lit("P"), "task_id", F.lit("_attempt"), "attempt_no", F.lit(f".{ending}")).alias("name"), value.alias("value"))
    files = F.array(F.when(F.col("attempt_id") % 3 != 1, file("xml", xml)), F.when(F.col("attempt_id") % 3 != 0, file("json", context)))
    write_files(some.select(F.inline(F.array_compact(files))), where)
    found = tables.read_artifacts(spark, where)
    return found.select("station_key", "attempt", "found", "xml", F.col("context.error").alias("error"), "context_raw")


@register("src6_poi_write_back", "fx_poi", "SELECT station_id, name, address, CASE WHEN city='' THEN '补城' ELSE city END AS city FROM fx_poi")
def poi_write_back(rows: DataFrame) -> DataFrame:
    """A dimension that was read, filled, written back and read again."""
    spark, (first, second) = rows.sparkSession, (shared_folder(rows.sparkSession) for _ in range(2))
    tables.write_poi_lines(rows, first)
    filled = tables.read_poi_lines(spark, first).withColumn("city", F.when(F.col("city") == "", "补城").otherwise(F.col("city")))
    tables.write_poi_lines(filled, second)
    return tables.read_poi_lines(spark, second).select("station_id", "name", "address", "city")
