"""Keyed upsert of stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAME = ["station_name", "city"]


def _folded(current: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The ordered fold of groups of one (name, city), row by row over Arrow tables: values keep their types."""
    columns = current.columns
    whole = T.StructType([*current.schema.fields, T.StructField("_first", T.LongType())])
    target = to_arrow_schema(whole)

    def fold(key, old, new):
        import pyarrow as pa

        rows = [{**r, "_first": None} for r in old.select(columns).to_pylist()]
        rows.sort(key=lambda r: r["id"])
        by_address: dict[str, list[int]] = {}  # rows of each address, the newest last; those that moved on are skipped
        for k, r in enumerate(rows):
            by_address.setdefault(r["address"] or "", []).append(k)
        for n in sorted(new.to_pylist(), key=lambda r: r[order]):
            address = n.get("address") or ""
            if address:
                stack = by_address.setdefault(address, [])
                while stack and (rows[stack[-1]]["address"] or "") != address:
                    stack.pop()
                hit = stack[-1] if stack else None
            else:
                hit = len(rows) - 1 if rows else None
            values = {c: n.get(c) for c in columns if c not in ("id", "station_name")}
            if hit is None:
                rows.append({"id": None, "station_name": n["station_name"], "_first": n[order], **values})
                hit = len(rows) - 1
            else:
                rows[hit].update(values)
            stack = by_address.setdefault(address, [])
            if not stack or stack[-1] != hit:
                stack.append(hit)
                stack.sort()
        return pa.Table.from_pylist(rows, target)

    return current.groupBy(*NAME).cogroup(incoming.groupBy(*NAME)).applyInArrow(fold, whole)


def upsert_stations(current: DataFrame, incoming: DataFrame, order: str = "pos", top: int | None = None) -> DataFrame:
    """current after the incoming rows, taken in order within each (name, city).

    A row with an address updates the newest station of that name, city and address; one without an address the newest
    of that name and city; no match inserts. Updates replace all but the name. A null name or city equals nothing, so
    such rows are inserted. New rows get ids above all current ones, in the order of their first incoming rows; `top`
    is the largest id so far where current is only a part of the table.

    Where all incoming rows of a (name, city) have an address, the last row of each address counts: that is an
    aggregation and a join. Only groups with a row without an address are folded one row after the other.
    """
    current, incoming = current.toDF(*current.columns), incoming.toDF(*incoming.columns)  # they may stem from one table
    columns = current.columns
    values = [c for c in columns if c not in ("id", "station_name")]
    blank = F.coalesce(F.col("address"), F.lit("")) == ""
    named = F.col("station_name").isNotNull() & F.col("city").isNotNull()
    of = lambda c: F.col(c) if c in incoming.columns else F.lit(None).cast(current.schema[c].dataType)
    new = incoming.select(order, "station_name", *[of(c).alias(c) for c in values])

    loose = new.where(~named).select(F.lit(None).cast("long").alias("id"), "station_name", *values, F.col(order).cast("long").alias("_first"))
    new = new.where(named)
    folding = new.where(blank).select(*NAME).distinct()
    in_fold = lambda df, how: df.join(folding, NAME, how)
    folded = _folded(in_fold(current, "left_semi"), in_fold(new, "left_semi"), order).select("id", "station_name", *values, "_first")

    # The last row of each address meets the newest station that has it.
    key = [*NAME, "address"]
    last = F.max_by(F.struct(*values), order)
    keyed = in_fold(new, "left_anti").groupBy(*key).agg(last.alias("_new"), F.min(order).cast("long").alias("_first"))
    plain = in_fold(current, "left_anti")
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id")))
    plain = plain.withColumn("_key", F.when((newest == 1) & named & ~blank, F.col("address")))
    joined = plain.join(keyed.withColumnRenamed("address", "_key"), [*NAME, "_key"], "full_outer")
    taken = F.col("_new").isNotNull()
    joined = joined.select("id", "station_name", *[(F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(c)) if c != "city" else F.col(c)).alias(c) for c in values], F.when(F.col("id").isNull(), F.col("_first")).alias("_first"))

    merged = joined.unionByName(folded).unionByName(loose)
    if top is None:
        top = current.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # Ranges of places give each new row its number without sorting all of them in one task.
    fresh = merged.where("id is null").withColumn("_bucket", F.floor(F.col("_first") / 1_000_000))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = fresh.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", before.alias("_base"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy("_first", *NAME))
    fresh = fresh.join(sizes, "_bucket").withColumn("id", (F.lit(top) + F.col("_base") + number).cast("long"))
    return merged.where("id is not null").select(*columns).unionByName(fresh.select(*columns))
