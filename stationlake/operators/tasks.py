"""Source lists, task tables and search trails: grouping, ranking and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_column, normalize_name, station_key


def group_sources(rows: DataFrame) -> DataFrame:
    """One row per station of a source list: all records in order of `pos`, their number, the smallest valid sequence.

    A sequence that is missing counts as 0, one that is no integer isn't counted, and none at all gives 0.
    """
    key = station_key("id", "name", "latitude", "longitude")
    sequence = F.coalesce(F.nullif(F.trim("sequence"), F.lit("")), F.lit("0"))
    number = F.when(sequence.rlike(r"^[+-]?[0-9]+$"), sequence.try_cast("long"))
    record = F.struct("pos", *[c for c in rows.columns if c != "pos"])
    out = rows.withColumn("station_id", key).withColumn("_n", number).groupBy("station_id")
    out = out.agg(F.array_sort(F.collect_list(record)).alias("source_records"), F.count("*").alias("duplicate_count"), F.coalesce(F.min("_n"), F.lit(0)).alias("source_sequence"))
    return out.withColumn("payload", F.get("source_records", F.lit(0)))


def import_tasks(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """existing tasks with the incoming ones: payloads replaced, priority and max_attempts at the greater of both."""
    new = incoming.select("station_id", *[F.col(c).alias(f"new_{c}") for c in ("payload", "priority", "max_attempts")])
    joined = existing.join(new, "station_id", "full_outer")
    greatest = {c: F.greatest(c, f"new_{c}") for c in ("priority", "max_attempts")}
    changed = {"payload": F.coalesce("new_payload", "payload"), **greatest, "status": F.coalesce("status", F.lit("pending")), "attempts": F.coalesce("attempts", F.lit(0))}
    return joined.withColumns(changed).drop("new_payload", "new_priority", "new_max_attempts")


def lapsed_leases(tasks: DataFrame, now: float) -> DataFrame:
    """Leased tasks whose lease is over, and whether they are tried again or fail."""
    lapsed = tasks.where((F.col("status") == "leased") & (F.col("lease_expires_at") < now))
    return lapsed.withColumn("next_status", F.when(F.col("attempts") < F.col("max_attempts"), "pending").otherwise("failed"))


def requeue_selection(tasks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Failed tasks; of the given station ids only, if there are any that aren't blank."""
    failed = tasks.where("status = 'failed'")
    if ids is None:
        return failed
    ids = ids.select(F.trim("station_id").alias("station_id")).where("station_id <> ''").distinct()
    return failed if ids.isEmpty() else failed.join(ids, "station_id", "left_semi")


def claimable_backlog(tasks: DataFrame, now: float, n: int) -> DataFrame:
    ready = tasks.where((F.col("status") == "pending") & (F.col("available_at") <= now) & (F.col("attempts") < F.col("max_attempts")))
    return ready.orderBy(F.desc("priority"), "source_sequence", "task_id").limit(n)


def export_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("source_sequence", "task_id")


def task_attempt_history(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    return tasks.join(attempts, "task_id", "left")


def latest_per_key(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def fenced_outcomes(attempts: DataFrame) -> DataFrame:
    """The latest attempt of each task: outcomes of older ones are late and don't count."""
    return latest_per_key(attempts, ["task_id"], "attempt_no")


def unique_rows(details: DataFrame) -> DataFrame:
    """The first record of each station, with the number of its records."""
    own = Window.partitionBy("station_id")
    ranked = details.withColumn("_rank", F.row_number().over(own.orderBy("pos"))).withColumn("duplicate_count", F.count("*").over(own))
    return ranked.where("_rank = 1").drop("_rank")


def first_seen_cards(cards: DataFrame) -> DataFrame:
    """Each station name's first card of a search, names compared in normal form."""
    cards = cards.withColumn("norm_name", normalize_name("name"))
    rank = F.row_number().over(Window.partitionBy("query_id", "norm_name").orderBy("screen", "cy", "cx"))
    return cards.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def screen_stop(cards: DataFrame, no_new: int = 2, max_scrolls: int = 12) -> DataFrame:
    """(query_id, stop_screen): the screen after which a search ends: no_new screens in a row without a new name, or the last scroll."""
    firsts = first_seen_cards(cards).groupBy("query_id", "screen").agg(F.count("*").alias("new"))
    screens = cards.select("query_id", "screen").distinct().join(firsts, ["query_id", "screen"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    by = Window.partitionBy("query_id").orderBy("screen")
    screens = screens.withColumn("island", F.sum(F.when(F.col("new") > 0, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.when(F.col("new") == 0, 1).otherwise(0)).over(Window.partitionBy("query_id", "island").orderBy("screen").rowsBetween(Window.unboundedPreceding, 0))
    stops = F.when((run >= no_new) | (F.col("screen") >= max_scrolls), F.col("screen"))
    return screens.select("query_id", stops.alias("stop"), "screen").groupBy("query_id").agg(F.coalesce(F.min("stop"), F.max("screen")).alias("stop_screen"))


def convergence_cutoff(trail: DataFrame, tail: int = 4, accepted: Column | None = None, failed: Column | None = None) -> DataFrame:
    """The trail up to the point where `tail` clearly outside results in a row follow an accepted one.

    accepted: which results the caller keeps (a grid's, say), those of the target by default; failed: which could not be
    collected, none by default. Whatever is not clearly outside ends a run of outside results, failures too.
    """
    failed = F.lit(False) if failed is None else failed
    accepted = (F.col("district_match") == "target") if accepted is None else accepted
    by = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    outside = (F.col("district_match") == "outside") & ~failed
    taken = accepted & ~outside & ~failed
    trail = trail.withColumn("_island", F.sum(F.when(outside, 0).otherwise(1)).over(by)).withColumn("_accepted", F.sum(F.when(taken, 1).otherwise(0)).over(by))
    run = F.sum(F.when(outside, 1).otherwise(0)).over(Window.partitionBy("query_id", "_island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    trail = trail.withColumn("_run", run)
    hit = F.when((F.col("_run") >= tail) & (F.col("_accepted") > 0), F.col("pos"))
    cut = F.min(hit).over(Window.partitionBy("query_id"))
    return trail.withColumn("_cut", cut).where("_cut is null or pos <= _cut").drop("_island", "_accepted", "_run", "_cut")


def build_detail_rows(tasks: DataFrame, poi: DataFrame) -> DataFrame:
    """Each task's source records, with gaps in city, district and address filled from the POI dimension."""
    if "payload" in tasks.columns:  # a task without records stands for itself
        records = F.when(F.size("source_records") > 0, F.col("source_records")).otherwise(F.array("payload"))
        tasks = tasks.withColumn("source_records", records)
    rows = tasks.withColumn("record", F.explode_outer("source_records"))
    dim = poi.select("station_id", *[F.col(c).alias(f"poi_{c}") for c in ("city", "district", "address")])
    blank = lambda c: F.nullif(as_column(c), F.lit(""))
    joined = rows.join(dim, "station_id", "left")
    return joined.withColumns({c: F.coalesce(blank(c), blank(f"poi_{c}"), F.lit("")) for c in ("city", "district", "address")}).drop("poi_city", "poi_district", "poi_address")


def task_summaries(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Every task's number of stations and their ids in order; tasks without results count 0."""
    own = results.groupBy("task_id").agg(F.count("*").alias("station_count"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "station_id"))), lambda x: x["station_id"]).alias("station_ids"))
    empty = F.array().cast("array<bigint>")
    return tasks.select("task_id").join(own, "task_id", "left").select("task_id", F.coalesce("station_count", F.lit(0)).alias("station_count"), F.coalesce("station_ids", empty).alias("station_ids"))
