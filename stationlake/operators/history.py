"""Task state from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = (
    "struct<status:string, attempts:int, max_attempts:int, available_at:double, lease_token:string, lease_expires_at:double, "
    "score:double, detailed:boolean, rerun:boolean, result:string, last_error:string>"
)
FIELDS = [f.split(":")[0].strip() for f in STATE[7:-1].split(",")]
EVENT = {
    "ts": "double", "seq": "long", "kind": "string", "lease_token": "string", "max_attempts": "int", "score": "double", "detailed": "boolean",
    "retryable": "boolean", "delay": "double", "refund": "boolean", "force": "boolean", "result": "string", "error": "string",
}
LEASE, RETRY_DELAY, MOST_ATTEMPTS, ERROR_TEXT = 180.0, 5.0, 3, 1000


def next_state(s: Column, e: Column) -> Column:
    """The state after one event.

    enqueue makes a pending task; a leased one it marks for another run, any other one starts anew. claim leases a task that
    is ready, heartbeat prolongs a lease; complete, fail and release count only under the token of the current lease. A lease
    that is over gives way to a claim or expire event: the task is pending again while attempts are left, else failed.
    recover takes leases that are over (or all, with force) back and refunds the attempt; requeue takes up a failed task.
    A task marked for another run starts anew once its lease ends by complete or by a fail that may be tried again.
    """
    kind = e["kind"]
    leased, fits = s["status"] == "leased", (s["status"] == "leased") & s["lease_token"].eqNullSafe(e["lease_token"])
    over = leased & (s["lease_expires_at"] < e["ts"])
    lapsed = over & kind.isin("claim", "expire")
    again, unknown = s["attempts"] < s["max_attempts"], s["status"].isNull()
    given = lambda c, default: F.coalesce(e[c], F.lit(default))
    error = F.left(e["error"], F.lit(ERROR_TEXT))

    def state(status, **new):
        """The given fields, the others as they were; a lease ends unless it is given."""
        new = {"status": status, "lease_token": None, "lease_expires_at": None} | new
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in ((n, new.get(n, s[n])) for n in FIELDS)]).cast(STATE)

    held = {"lease_token": s["lease_token"], "lease_expires_at": s["lease_expires_at"]}
    fresh = {"attempts": 0, "max_attempts": given("max_attempts", MOST_ATTEMPTS), "available_at": 0.0, "rerun": False, "last_error": None}
    lease = {"lease_token": e["lease_token"], "lease_expires_at": e["ts"] + given("delay", LEASE)}
    ready = (s["status"] == "pending") & (s["available_at"] <= e["ts"]) & again
    done = {"score": given("score", 0.0), "detailed": given("detailed", False), "result": e["result"], "last_error": None}
    tried = {"score": F.greatest(s["score"], given("score", 0.0)), "result": F.coalesce(e["result"], s["result"]), "last_error": error}
    less = F.greatest(F.lit(0), s["attempts"] - 1)
    return (
        F.when((kind == "enqueue") & unknown, state("pending", score=0.0, detailed=False, **fresh))
        .when(unknown, s)
        .when((kind == "enqueue") & leased, state("leased", max_attempts=fresh["max_attempts"], rerun=True, **held))
        .when(kind == "enqueue", state("pending", **fresh))
        .when(lapsed & ~again, state("failed", last_error="lease expired"))
        .when((kind == "claim") & lapsed, state("leased", attempts=s["attempts"] + 1, available_at=e["ts"], last_error="lease expired", **lease))
        .when((kind == "claim") & ready, state("leased", attempts=s["attempts"] + 1, **lease))
        .when(lapsed, state("pending", available_at=e["ts"], last_error="lease expired"))
        .when((kind == "heartbeat") & fits, state("leased", lease_token=s["lease_token"], lease_expires_at=lease["lease_expires_at"]))
        .when((kind == "complete") & fits & s["rerun"], state("pending", attempts=0, available_at=e["ts"], rerun=False, **done))
        .when((kind == "complete") & fits, state("succeeded", **done))
        .when((kind == "fail") & fits & given("retryable", True) & (again | s["rerun"]),
              state("pending", attempts=F.when(s["rerun"], 0).otherwise(s["attempts"]), available_at=e["ts"] + given("delay", RETRY_DELAY), rerun=False, **tried))
        .when((kind == "fail") & fits, state("failed", available_at=e["ts"], **tried))
        .when((kind == "release") & fits, state("pending", attempts=F.when(given("refund", True), less).otherwise(s["attempts"]), available_at=e["ts"], last_error=error))
        .when((kind == "recover") & leased & (over | given("force", False)), state("pending", attempts=less, available_at=0.0, last_error="lease recovered"))
        .when((kind == "requeue") & (s["status"] == "failed"), state("pending", attempts=0, available_at=0.0, last_error=None))
        .otherwise(s)
    )


def task_state(events: DataFrame, before: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """(task_id, status, attempts, ...) after the events (task_id, ts, seq, kind, ...), in order of (ts, seq).

    before: states so far. now: leases that end before it are over. Every task's events are folded in one aggregate over
    their sorted list, inside the JVM; a task's log is short, as attempts are bounded.
    """
    record = F.struct(*[F.col(c).cast(t).alias(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in EVENT.items()])
    logs = events.groupBy("task_id").agg(F.array_sort(F.collect_list(record)).alias("log"))
    nothing = F.struct(*[F.lit(None).alias(f) for f in FIELDS]).cast(STATE)
    start = nothing
    if before is not None:
        logs = before.select("task_id", F.struct(*FIELDS).cast(STATE).alias("start")).join(logs, "task_id", "full_outer")
        start = F.coalesce("start", nothing)
    none = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in EVENT.items()])
    log = F.coalesce("log", F.filter(F.array(none), lambda _: F.lit(False)))
    if now is not None:
        end = F.struct(*[F.lit({"ts": now, "kind": "expire"}.get(c)).cast(t).alias(c) for c, t in EVENT.items()])
        log = F.concat(log, F.array(end))
    folded = F.aggregate(log, start, next_state)
    return logs.select("task_id", folded.alias("s")).select("task_id", "s.*")


def fenced_results(claims: DataFrame, results: DataFrame) -> DataFrame:
    """The results (task_id, lease_token, ...) that carry the token of their task's latest claim (task_id, attempt_no, lease_token)."""
    latest = claims.groupBy("task_id").agg(F.max_by("lease_token", "attempt_no").alias("_token"), F.max("attempt_no").alias("attempt_no"))
    return results.join(latest, "task_id").where(F.col("lease_token") == F.col("_token")).drop("_token")
