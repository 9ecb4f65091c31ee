import datetime
import random

import pytest

from stationlake.operators.history import EVENT, FIELDS, task_state
from stationlake.operators.storage import BucketTable, CommitConflict
from stationlake.sources import tables
from stationlake.streaming import ingest, leases, windows

KIND = "pos long, station_name string, city string, address string, price string"
PARTS = [[(1, "a", "x", "r1", "1"), (2, "a", "x", "r2", "2")], [(3, "a", "x", "r1", "3"), (4, "b", "x", "r1", "4")], [(5, "a", "x", "", "5")]]
FINAL = [(1, "a", "x", "r1", "3"), (2, "a", "x", "", "5"), (3, "b", "x", "r1", "4")]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def upserts(spark, where, **more):
    return ingest.stream_upsert(spark.readStream.schema(KIND).parquet(f"{where}/in"), f"{where}/t", f"{where}/c", f"{where}/logs", **more)


def test_upsert_stream(spark, tmp_path):
    for part in PARTS:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert not ingest.wait_for(upserts(spark, tmp_path))
    assert not ingest.wait_for(upserts(spark, tmp_path))
    table = BucketTable(spark, f"{tmp_path}/t", [])
    assert rows_of(table.read()) == FINAL
    assert table.commit()["version"] == 2 and spark.read.parquet(f"{tmp_path}/logs").count() == 5


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "_publish", "_name", "vacuum", "after"])
def test_a_crash_at_any_step_keeps_all_rows(spark, tmp_path, monkeypatch, step):
    """The process ends before or behind a step; what was committed is whole, and the batch that comes again is taken once."""
    (first, rest), where = (PARTS[0], [*PARTS[1], *PARTS[2]]), f"{tmp_path}/in"
    spark.createDataFrame(first, KIND).coalesce(1).write.parquet(where)
    assert not ingest.wait_for(upserts(spark, tmp_path))
    before = rows_of(BucketTable(spark, f"{tmp_path}/t", []).read())
    spark.createDataFrame(rest, KIND).coalesce(1).write.mode("append").parquet(where)

    def crash(*args):
        if step == "_write":  # half of the rows are there
            args[1].limit(1).write.partitionBy("_bucket").parquet(args[2])
        raise Crash

    with monkeypatch.context() as m:
        if step == "after":
            with pytest.raises(Exception, match="Crash"):
                upserts(spark, tmp_path, handler=crash).awaitTermination()
        else:
            m.setattr(BucketTable, step, crash)
            with pytest.raises(Exception, match="Crash"):
                upserts(spark, tmp_path).awaitTermination()
    assert rows_of(BucketTable(spark, f"{tmp_path}/t", []).read()) == (FINAL if step in ("vacuum", "after") else before)
    assert not ingest.wait_for(upserts(spark, tmp_path))
    assert rows_of(BucketTable(spark, f"{tmp_path}/t", []).read()) == FINAL


def test_batches_rewrite_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", ["k"], 16)
    change = lambda before, batch, _: batch if before is None else before.join(batch, "k", "left_anti").unionByName(batch)
    rows = lambda keys, v: spark.createDataFrame([(k, v) for k in keys], "k long, v string")
    assert table.read() is None and table.apply(rows(range(100), "a"), 0, change, ("k",))
    old = table.commit()
    assert table.apply(rows([3, 300], "b"), 4, change, ("k",)) and not table.apply(rows([3], "c"), 4, change, ("k",))
    new = table.commit()
    assert sum(old["buckets"].get(b) != f for b, f in new["buckets"].items()) <= 2 and new["tops"] == {"k": 300}
    assert rows_of(table.read()) == sorted([(k, "b" if k == 3 else "a") for k in range(100)] + [(300, "b")])
    assert rows_of(table.read(0)) == [(k, "a") for k in range(100)]
    with pytest.raises(CommitConflict):
        table._publish(new)
    for n in range(5, 12):
        table.apply(rows([n], "z"), n, change)
    assert len(table.versions()) == 3 and table.read().count() == 101
    assert table.apply(rows(range(100), "gone"), 20, lambda before, batch, _: before.where("k >= 100")) and rows_of(table.read()) == [(300, "b")]
    with pytest.raises(ValueError):
        table.apply(rows([1], "x"), 21, lambda before, batch, _: rows(range(50), "elsewhere"))


def test_a_handler_may_end_the_stream(spark, tmp_path):
    for part in PARTS:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def handler(batch, number):
        seen.append((number, batch.count()))
        return number < 1

    stream = lambda: ingest.stream_upsert(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", handler=handler)
    assert ingest.wait_for(stream()) and [n for n, _ in seen] == [0, 1]
    table = BucketTable(spark, f"{tmp_path}/t", [])
    assert table.commit()["batch"] == 1
    ingest.wait_for(stream())
    assert [n for n, _ in seen] == [0, 1, 2] and sum(c for _, c in seen) == 5 and table.commit()["batch"] == 2 and table.read().count() == 3


COLUMNS = "task_id long, " + ", ".join(f"{c} {t}" for c, t in EVENT.items())


def events(spark, rows):
    return spark.createDataFrame([(r["task_id"], *(r.get(c) for c in EVENT)) for r in rows], COLUMNS)


def log(task, *steps):
    """Events (ts, kind, more) of one task."""
    return [{"task_id": task, "ts": float(ts), "seq": n, "kind": kind, **(more[0] if more else {})} for n, (ts, kind, *more) in enumerate(steps)]


A, B, C, D = ({"lease_token": x} for x in "abcd")
LOG = [
    *log(1, (0, "enqueue", {"max_attempts": 2}), (1, "claim", A), (2, "release", A), (3, "claim", B), (4, "complete", A | {"score": 9.0}), (5, "fail", B | {"score": 30.0}), (6, "claim", C), (20, "claim", D), (21, "complete", D | {"score": 80.0})),
    *log(2, (0, "enqueue", {"max_attempts": 1}), (1, "claim", A), (500, "expire")),
    *log(3, (0, "enqueue", {"max_attempts": 1}), (1, "claim", A), (2, "enqueue", {"max_attempts": 2}), (3, "complete", A | {"score": 50.0, "result": "r"})),
    *log(4, (0, "enqueue"), (1, "claim", A), (300, "claim", B), (301, "complete", A | {"score": 1.0})),
    *log(5, (0, "enqueue"), (1, "claim", A), (2, "complete", A | {"score": 7.0}), (3, "enqueue", {"max_attempts": 5})),
    *log(6, (0, "enqueue"), (1, "claim", A), (100, "heartbeat", A), (250, "claim", B), (251, "fail", A | {"retryable": False, "error": "e" * 2000})),
    *log(7, (0, "enqueue"), (1, "claim", A), (2, "recover"), (3, "recover", {"force": True})),
    *log(8, (0, "enqueue"), (1, "claim", A), (2, "release", A | {"refund": False, "error": "why"})),
    *log(9, (0, "claim", A), (1, "complete", A)),
]
WANT = [
    (1, "succeeded", 2, None, 80.0), (2, "failed", 1, None, 0.0), (3, "pending", 0, None, 50.0), (4, "leased", 2, "b", 0.0), (5, "pending", 0, None, 7.0),
    (6, "failed", 1, None, 0.0), (7, "pending", 0, None, 0.0), (8, "pending", 1, None, 0.0), (9, None, None, None, None),
]


def shown(df):
    return sorted(map(tuple, df.select("task_id", "status", "attempts", "lease_token", "score").collect()))


def test_task_state(spark, tmp_path):
    assert shown(task_state(events(spark, LOG))) == WANT
    found = {r.task_id: r for r in task_state(events(spark, LOG)).collect()}
    assert found[6].last_error == "e" * 1000 and found[5].max_attempts == 5 and found[3].max_attempts == 2 and found[3].result == "r" and found[8].last_error == "why"
    assert shown(task_state(events(spark, LOG), now=1000.0))[3] == (4, "pending", 2, None, 0.0)
    for cut in (LOG[:7], LOG[7:15], LOG[15:]):
        events(spark, cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.stream_task_state(spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert shown(BucketTable(spark, f"{tmp_path}/t", []).read()) == WANT


def made_up_log(rng, task):
    kinds, out, ts = ["enqueue", "claim", "claim", "complete", "fail", "release", "heartbeat", "expire", "recover", "requeue"], [], 0.0
    for n in range(rng.randrange(2, 14)):
        ts += rng.choice([0.0, 1.0, 7.0, 90.0, 400.0])
        some = {"lease_token": rng.choice(["a", "b"]), "max_attempts": rng.choice([1, 2, None]), "score": rng.choice([None, 5.0, 60.0]), "retryable": rng.choice([None, True, False])}
        some |= {"refund": rng.choice([None, False]), "force": rng.choice([None, True]), "result": rng.choice([None, "r"]), "error": rng.choice([None, "x"]), "delay": rng.choice([None, 30.0]), "detailed": rng.choice([None, True])}
        out.append({"task_id": task, "ts": ts, "seq": n, "kind": "enqueue" if n == 0 and rng.random() < 0.9 else rng.choice(kinds), **some})
    return out


def test_the_rules_in_plans_and_outside_are_the_same(spark):
    rng = random.Random(17)
    logs = [made_up_log(rng, t) for t in range(400)]
    got = {r.task_id: tuple(r[f] for f in FIELDS) for r in task_state(events(spark, sum(logs, []))).collect()}
    for t, steps in enumerate(logs):
        state = None
        for e in steps:
            state = leases.step(state, e)
        assert got[t] == (tuple(state[f] for f in FIELDS) if state else (None,) * len(FIELDS)), steps


def test_leases_end_by_time_alone(spark, tmp_path):
    """The stream equals the batch at its watermark, with no event that says that a lease is over."""
    rng = random.Random(4)
    every = [e for t in range(20, 60) for e in made_up_log(rng, t) if e["kind"] != "expire"] + LOG[:-2]
    every = [e | {"ts": e["ts"] + 9000.0} for e in every]  # the first watermark is the year 1970
    latest = max(e["ts"] for e in every)
    every += [{"task_id": 99, "ts": latest + 1000.0, "seq": 0, "kind": "enqueue"}]
    cuts = [0.0, 9050.0, 9400.0, latest + 500, latest + 2000]
    for low, high in zip(cuts, cuts[1:]):
        events(spark, [e for e in every if low <= e["ts"] < high]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in")
        leases.stream_lease_states(stream, f"{tmp_path}/t", f"{tmp_path}/c", "600 seconds").awaitTermination()
    got = BucketTable(spark, f"{tmp_path}/t", []).read()
    batch = task_state(events(spark, every), now=latest + 1000.0 - 600.0).where("status is not null")
    ended = lambda df: sorted(map(tuple, df.select("task_id", "status", "attempts", "lease_token", "score", "result", "last_error").collect()), key=str)
    assert ended(got) == ended(batch) and got.where("last_error = 'lease expired'").count() > 3


def test_windows_on_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([("d", at(m)) for m in (0, 1, 2, 30, 31)] + [("e", at(5))], "device string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/beats")
    spark.createDataFrame([("e", at(59))], "device string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/beats")
    stream = spark.readStream.schema("device string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/beats")
    out = windows.heartbeat_sessions(stream, "3 minutes", "5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.device, r.started.minute, r.beats) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("d", 0, 3), ("d", 30, 2), ("e", 5, 1)]


def test_first_seen_on_a_stream_with_late_rows(spark, tmp_path):
    """A name counts once within the watermark; what comes behind it is late and dropped."""
    at = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    kind = "query_id long, name string, ts timestamp, screen int"
    parts = [[(1, "甲 站", at(0), 0), (1, "乙站", at(1), 0), (2, "甲站", at(2), 0)], [(1, "甲站", at(5), 1), (1, "丙站", at(90), 2)], [(1, "丁站", at(3), 3), (1, "丙 站", at(91), 4), (1, "甲站", at(200), 5)], [(9, "x", at(999), 0)]]
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = windows.stream_first_seen(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), "30 minutes")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted((r.query_id, r.norm_name, r.screen) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # The fourth name comes 57 minutes behind the watermark; the first one is new again after its time.
    assert got == [(1, "丙站", 2), (1, "乙站", 0), (1, "甲站", 0), (1, "甲站", 5), (2, "甲站", 0), (9, "x", 0)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿id,name,address\n1,"x\ny",\n2,"a ""b"" c",r1\n', encoding="utf-8")
    assert sorted(map(tuple, tables.read_station_csv(spark, f"{tmp_path}/s.csv").collect())) == [("1", "x\ny", ""), ("2", 'a "b" c', "r1")]
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}', None), (2, "broken", '{"ok": true}')], "task_id long, payload_json string, result_json string")
    got = tables.decode_payload(df, "struct<a:int, b:string>", "struct<ok:boolean>").orderBy("task_id").collect()
    assert got[0].payload.a == 1 and got[0].result is None and got[1].payload is None and got[1].payload_json_raw == "broken" and got[1].result.ok
    again = tables.encode_payload(tables.decode_payload(df, "struct<a:int, b:string>", "struct<ok:boolean>")).orderBy("task_id").collect()
    assert again[0].payload_json == '{"a":1,"b":"x"}' and again[0].result_json is None and again[1].result_json == '{"ok":true}'
    rows = spark.createDataFrame([("a", "113.1"), ("", "113.2"), ("b", "east")], "station_name string, longitude string").selectExpr("*", "'34' as latitude")
    assert tables.append_stations(rows, f"{tmp_path}/ok", f"{tmp_path}/bad") == {"inserted": 1, "rejected": 2, "total": 3}
