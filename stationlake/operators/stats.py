"""Filters, pages and statistics over stations, tasks and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "leased", "succeeded", "failed")
SCAN_STATUSES = ("pending", "scanning", "done", "failed")


#: The columns of station lists and of nearby stations.
STATION_LIST_COLS = [
    "id", "station_name", "operator", "address", "city", "current_price", "longitude", "latitude",
    "fast_available", "fast_total", "fast_power", "super_available", "super_total", "super_power",
    "slow_available", "slow_total", "slow_power", "fast_prices", "slow_prices", "business_hours",
    "parking_fee", "occupancy_fee", "favorite_count", "facilities", "tags", "collected_at",
]
NEARBY_COLS = STATION_LIST_COLS[:17]


def public_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that are shown; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def list_stations(df: DataFrame, city: str | None = None, operator: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page, newest id first, of the stations of a city and an operator."""
    for name, value in (("city", city), ("operator", operator)):
        if value:
            df = df.where(F.col(name) == value)
    return page_of(df, page, page_size)


def page_of(df: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return df.orderBy(F.desc("id")).offset((page - 1) * page_size).limit(page_size)


def page_info(df: DataFrame, page_size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / page_size))


def get_station(df: DataFrame, station_id: int) -> DataFrame:
    return df.where(F.col("id") == station_id)


def stats_by_city(df: DataFrame) -> DataFrame:
    return df.groupBy("city").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "city")


def stats_by_operator(df: DataFrame) -> DataFrame:
    return df.where("operator <> ''").groupBy("operator").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "operator")


def stats_overview(df: DataFrame, time: str = "updated_at") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.max(time).alias("latest"))


def task_stats(tasks: DataFrame) -> DataFrame:
    """Counts by status, detailed tasks and the mean score of those that succeeded; zeros for an empty table."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    score = F.avg(F.when(F.col("status") == "succeeded", F.col("completeness_score")))
    out = tasks.agg(*counts, F.count("*").alias("total"), F.count_if("detailed").alias("detailed"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("average_score"))
    return out.withColumn("detailed_rate", F.when(F.col("total") > 0, F.round(F.col("detailed") / F.col("total"), 6)).otherwise(0.0))


def scan_stats(tasks: DataFrame) -> DataFrame:
    """Counts by status: the known ones always, others as found."""
    known = tasks.sparkSession.createDataFrame([(s,) for s in SCAN_STATUSES], "status string")
    counts = tasks.groupBy("status").agg(F.count("*").alias("n"))
    return known.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def report_failures(unique: DataFrame) -> DataFrame:
    return unique.where("coverage_status <> '详细'")


def report_summary(details: DataFrame) -> DataFrame:
    done = F.count_if(F.col("coverage_status") == "详细")
    return details.agg(F.count("*").alias("total"), done.alias("detailed"), F.when(F.count("*") > 0, F.round(done / F.count("*"), 6)).otherwise(0.0).alias("rate"))


def city_coverage(details: DataFrame) -> DataFrame:
    city = F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("未识别"))
    done = F.count_if(F.col("coverage_status") == "详细")
    return details.groupBy(city.alias("city")).agg(F.count("*").alias("total"), done.alias("detailed"), F.round(done / F.count("*"), 6).alias("rate"))
