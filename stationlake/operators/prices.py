"""Time-of-day price periods, as rows and as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("time", "total_price", "elec_fee", "service_fee", "tag", "source")


def normalize_periods(periods: Column | str, source: str) -> Column:
    """An array of periods with - in ranges and a default source; nulls become ''."""
    text = lambda p, c: F.coalesce(p[c], F.lit(""))

    def one(p):
        named = {c: text(p, c) for c in FIELDS}
        named["time"] = F.replace(named["time"], F.lit("~"), F.lit("-"))
        named["source"] = F.coalesce(F.nullif(named["source"], F.lit("")), F.lit(source))
        return F.struct(*[v.alias(k) for k, v in named.items()])

    return F.transform(periods, one)


def collect_periods(df: DataFrame, keys: list[str]) -> DataFrame:
    """Period rows with a column pos, as one ordered array for each key."""
    periods = F.array_sort(F.collect_list(F.struct("pos", *FIELDS)))
    return df.groupBy(*keys).agg(F.transform(periods, lambda p: F.struct(*[p[c].alias(c) for c in FIELDS])).alias("periods"))


def explode_periods(df: DataFrame, column: str = "periods") -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("at", "p")).select(*rest, (F.col("at") + 1).cast("long").alias("pos"), *[F.col(f"p.{c}").alias(c) for c in FIELDS])


def merge_price_periods(periods: DataFrame, keys: list[str]) -> DataFrame:
    """One row per period: rows of one time fold, the first filled value of each field counts.

    Rows of price_detail go first. Where a key has any, trend rows join only if their time is a clock range; where it
    has none, trend rows of any label count. Rows without a time never fold.
    """
    time = F.replace(F.col("time"), F.lit("~"), F.lit("-"))
    rows = periods.withColumn("time", time).withColumn("_detail", F.col("source") == "price_detail")
    has = rows.groupBy(*keys).agg(F.max("_detail").alias("_any"))
    rows = rows.join(has, keys).where(F.col("_detail") | ~F.col("_any") | F.col("time").rlike(r"^\d{2}:\d{2}-\d{2}:\d{2}$"))
    return fold_price_periods(rows.drop("_detail", "_any"), keys)


def fold_price_periods(periods: DataFrame, keys: list[str]) -> DataFrame:
    """merge_price_periods() of rows that all count, with - in their times: one shuffle by keys or none."""
    rows = periods.withColumn("_detail", F.col("source") == "price_detail")
    rank = F.struct((~F.col("_detail")).cast("int"), F.col("pos"))
    fold = F.when(F.col("time") == "", F.col("pos")).otherwise(0)
    filled = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", rank)), F.lit(""))
    out = rows.groupBy(*keys, "time", fold.alias("_fold")).agg(*[filled(c).alias(c) for c in ("total_price", "elec_fee", "service_fee", "tag")], F.min_by("source", rank).alias("source"), F.min(rank).alias("_rank"))
    return out.drop("_fold").withColumn("pos", F.col("_rank.pos")).drop("_rank")


def concat_periods(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeated ones too; columns that a part lacks are null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def union_lists(*lists: Column | str) -> Column:
    """All lists' elements in order, each once."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def result_view(stations: DataFrame) -> DataFrame:
    """What a result list shows: a short name and the number of fast, or else slow, periods."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return stations.select("id", F.left("station_name", F.lit(25)).alias("name"), "city", "operator", "current_price", F.when(size("fast_prices") > 0, size("fast_prices")).otherwise(size("slow_prices")).alias("periods"))
