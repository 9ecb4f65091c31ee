"""Streams that keep tables up to date, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.history import task_state
from ..operators.storage import BUCKETS, BucketTable
from ..operators.upsert import NAME, upsert_stations


class Stopped(Exception):
    """A stream ends because its handler asked for it."""


def keep_current(
    stream: DataFrame, table: BucketTable, checkpoint: str, change: Callable[[DataFrame | None, DataFrame, dict], DataFrame],
    after: Callable[[DataFrame, int], bool | None] | None = None, tops: tuple[str, ...] = (), mode: str = "append",
) -> StreamingQuery:
    """Commits `change(rows of the touched buckets or None, batch, tops)` of every micro-batch to the table.

    Commits carry the number of their batch, so a batch that comes again after a crash changes nothing. `after` sees each
    batch once it is committed, for logs or notices; where it returns False, no later batch is taken: the stream ends with
    that batch's state saved, and started again it goes on behind it. All data that is there is taken, then the query ends;
    wait_for() waits for either end.
    """
    ended = []

    def run(batch: DataFrame, number: int) -> None:
        if ended:
            raise Stopped
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                table.apply(batch, number, change, tops)
        finally:
            batch.unpersist()
        if after and after(batch, number) is False:
            ended.append(number)

    return stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wait_for(query: StreamingQuery) -> bool:
    """Waits for a stream's end and says whether its handler ended it."""
    try:
        query.awaitTermination()
    except Exception as e:
        if "Stopped" in str(e):
            return True
        raise
    return False


def stream_upsert(
    results: DataFrame, root: str, checkpoint: str, logs: str | None = None, order: str = "pos",
    handler: Callable[[DataFrame, int], bool | None] | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Results as they come update the stations under root, bucket by bucket; a log of each batch goes to a folder of its own.

    handler sees each batch of results after it is stored and may end the stream by returning False.
    """

    def change(current: DataFrame | None, batch: DataFrame, tops: dict) -> DataFrame:
        if current is None:
            current = batch.selectExpr("cast(null as long) id", *[f"`{c}`" for c in batch.columns if c not in (order, "id")]).where("false")
        return upsert_stations(current, batch, order, top=tops.get("id") or 0)

    def after(batch: DataFrame, number: int) -> bool | None:
        if logs:  # overwritten by a batch that comes again
            rows = batch.select(F.lit("station").alias("layer"), F.to_json(F.struct("*")).alias("raw_data"), F.lit(True).alias("success"))
            rows.write.mode("overwrite").parquet(f"{logs}/batch={number}")
        return handler(batch, number) if handler else None

    return keep_current(results, BucketTable(results.sparkSession, root, NAME, buckets), checkpoint, change, after, ("id",))


def stream_task_state(events: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Events as they come update the states of tasks under root."""
    table = BucketTable(events.sparkSession, root, ["task_id"], buckets)
    return keep_current(events, table, checkpoint, lambda before, batch, _: task_state(batch, before))
