"""Task states on a stream whose leases end by time, without an event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.history import ERROR_TEXT, EVENT, FIELDS, LEASE, MOST_ATTEMPTS, RETRY_DELAY, STATE
from ..operators.storage import BUCKETS, BucketTable
from .ingest import keep_current

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATES = STATE[7:-1].replace(":", " ")


def step(s: dict | None, e: dict) -> dict | None:
    """history.next_state for one event and one task, outside of plans."""
    kind, now = e["kind"], e["ts"]
    given = lambda c, default: default if e.get(c) is None else e[c]
    fresh = {"status": "pending", "attempts": 0, "max_attempts": given("max_attempts", MOST_ATTEMPTS), "available_at": 0.0, "rerun": False, "last_error": None}
    ended = {"lease_token": None, "lease_expires_at": None}
    if s is None:
        return dict.fromkeys(FIELDS) | fresh | {"score": 0.0, "detailed": False} if kind == "enqueue" else None
    leased = s["status"] == "leased"
    over = leased and s["lease_expires_at"] < now
    fits, again = leased and s["lease_token"] == e.get("lease_token"), s["attempts"] < s["max_attempts"]
    error = None if e.get("error") is None else e["error"][:ERROR_TEXT]
    if kind == "enqueue":
        return s | ({"max_attempts": fresh["max_attempts"], "rerun": True} if leased else fresh | ended)
    if over and kind in ("claim", "expire"):
        s = s | ended | {"last_error": "lease expired"} | ({"status": "pending", "available_at": now} if again else {"status": "failed"})
        fits = leased = False
    if kind == "claim":
        ready = s["status"] == "pending" and s["available_at"] <= now and again
        return s | {"status": "leased", "attempts": s["attempts"] + 1, "lease_token": e.get("lease_token"), "lease_expires_at": now + given("delay", LEASE)} if ready else s
    if kind == "heartbeat" and fits:
        return s | {"lease_expires_at": now + given("delay", LEASE)}
    if kind == "complete" and fits:
        done = {"score": given("score", 0.0), "detailed": given("detailed", False), "result": e.get("result"), "last_error": None}
        return s | ended | done | ({"status": "pending", "attempts": 0, "available_at": now, "rerun": False} if s["rerun"] else {"status": "succeeded"})
    if kind == "fail" and fits:
        tried = {"score": max(s["score"], given("score", 0.0)), "result": given("result", s["result"]), "last_error": error}
        if given("retryable", True) and (again or s["rerun"]):
            attempts = 0 if s["rerun"] else s["attempts"]
            return s | ended | tried | {"status": "pending", "attempts": attempts, "available_at": now + given("delay", RETRY_DELAY), "rerun": False}
        return s | ended | tried | {"status": "failed", "available_at": now}
    less = max(0, s["attempts"] - 1)
    if kind == "release" and fits:
        return s | ended | {"status": "pending", "attempts": less if given("refund", True) else s["attempts"], "available_at": now, "last_error": error}
    if kind == "recover" and leased and (over or given("force", False)):
        return s | ended | {"status": "pending", "attempts": less, "available_at": 0.0, "last_error": "lease recovered"}
    if kind == "requeue" and s["status"] == "failed":
        return s | ended | {"status": "pending", "attempts": 0, "available_at": 0.0, "last_error": None}
    return s


class Leases(StatefulProcessor):
    """Keeps each task's state; a timer at the end of its lease fires once the watermark has passed it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATES + ", changes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._take(key, sorted((r.asDict() for r in rows), key=lambda e: (e["ts"], e["seq"])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._take(key, [{"ts": expiredTimerInfo.getExpiryTimeInMs() / 1000, "kind": "expire"}])

    def close(self) -> None:
        pass

    def _take(self, key, events) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        state = None if known is None else dict(zip(FIELDS, known))
        for e in events:
            state = step(state, e)
        if state is None:
            return
        changes = (known[len(FIELDS)] if known is not None else 0) + 1
        self.state.update((*(state[f] for f in FIELDS), changes))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state["status"] == "leased":
            self.handle.registerTimer(int(state["lease_expires_at"] * 1000) + 1)  # a lease is over behind its end
        yield Row(task_id=key[0], **state, changes=changes)


def lease_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of (task_id, status, ..., changes): the state of each task that an event or the end of its lease changes.

    events: task_id, ts in seconds, seq, kind and more as for history.task_state, which gives the same states. Time is that
    of the events: a lease ends once all events up to `late` behind its end are in. Needs the RocksDB state store.
    """
    have = [F.col(c).cast(t).alias(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in EVENT.items()]
    timed = events.select(F.col("task_id").cast("long").alias("task_id"), *have, F.timestamp_millis((F.col("ts") * 1000).cast("long")).alias("at")).withWatermark("at", late)
    return timed.groupBy("task_id").transformWithState(Leases(), f"task_id long, {STATES}, changes long", "Update", "eventTime")


def stream_lease_states(events: DataFrame, root: str, checkpoint: str, late: str = "10 minutes", buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the states of tasks under root, by bucket; a task's latest change wins. The stream's state lies in RocksDB."""

    def change(before: DataFrame | None, batch: DataFrame, _) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        return rows.groupBy("task_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "task_id"]), "changes").alias("s")).select("task_id", "s.*")

    conf = events.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the query keeps what it starts with
    try:
        return keep_current(lease_states(events, late), BucketTable(events.sparkSession, root, ["task_id"], buckets), checkpoint, change, mode="update")
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
