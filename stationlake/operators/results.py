"""Collected results: matching names, keeping or skipping, filling places, table rows and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TEXT_LIMITS, as_column, limited_text, normalize_name, normalize_ts, text, utf8_truncate


def json_field(c: Column | str) -> Column:
    """Text as a JSON column holds it: null for empty, valid JSON as it is, other text quoted."""
    c = as_column(c)
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(F.try_parse_json(c).isNotNull(), c).otherwise(quoted)


def json_list(c: Column | str) -> Column:
    """An array as compact JSON, null for an empty one."""
    return F.when(F.size(as_column(c)) > 0, F.to_json(c, {"ignoreNullFields": "false"}))


def compact_log(payload: Column, most: int = 60000) -> Column:
    """A struct as JSON of at most so many bytes; a larger one as a summary that says so."""
    whole = F.to_json(payload, {"ignoreNullFields": "false"})
    short = F.struct(F.lit(True).alias("truncated"), F.octet_length(whole).alias("original_bytes"), payload["scan_task_id"].alias("scan_task_id"), payload["station_name"].alias("station_name"), payload["address"].alias("address"))
    return F.when(F.octet_length(whole) <= most, whole).otherwise(F.to_json(short, {"ignoreNullFields": "false"}))


PART = 3  # characters of the parts that names are looked up by


def _parts(name: Column, most: int) -> Column:
    """All parts of a name of 1 to `most` characters, each once: at most `most` for each character."""
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, n))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(name) >= n, of_length(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)])))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): names of the first table that stand inside longer ones of the second; both hold distinct names.

    Outer names are indexed by their parts of up to PART characters. An inner name is looked up by its rarest part alone, of
    PART characters or its own length, and what is found is verified; a name with a part that no outer name has is in none.
    So an index row stands for each character of a name, not for each of its substrings, and pairs are as many as share
    a name's rarest part.
    """
    index = outer.select(F.col("name").alias("outer"), F.explode(_parts(F.col("name"), PART)).alias("part"))
    often = index.groupBy("part").agg(F.count("*").alias("n"))
    own = F.least(F.length("name"), F.lit(PART))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - own + 1), lambda i: F.substring("name", i, own)))
    asked = inner.select(F.col("name").alias("inner"), F.explode(pieces).alias("part")).join(often, "part", "left")
    rarest = asked.groupBy("inner").agg(F.min_by("part", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("part"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    pairs = rarest.where("n > 0").select("inner", "part").join(index, "part")
    return pairs.where((F.length("outer") > F.length("inner")) & F.contains("outer", "inner")).select("inner", "outer")


def match_names(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target_id, candidate_id, score) of each target's best candidate: equal names, then the longest containment.

    targets: target_id, name; candidates: candidate_id, name; the smaller candidate_id wins ties. Names are compared in
    their normal form, each distinct one once.
    """
    left = targets.select("target_id", normalize_name("name").alias("name")).where("name <> ''")
    right = candidates.select("candidate_id", normalize_name("name").alias("name")).where("name <> ''")
    firsts = right.groupBy("name").agg(F.min("candidate_id").alias("candidate_id"))
    names = left.select("name").distinct()
    known = firsts.select("name")
    equal = names.join(firsts, "name").select("name", "candidate_id", F.lit(1000).alias("score"))
    inside = contained(names, known).join(firsts.withColumnRenamed("name", "outer"), "outer").select(F.col("inner").alias("name"), "candidate_id", (800 + F.length("inner")).alias("score"))
    around = contained(known, names).join(firsts.withColumnRenamed("name", "inner"), "inner").select(F.col("outer").alias("name"), "candidate_id", (700 + F.length("inner")).alias("score"))
    found = equal.unionByName(inside).unionByName(around)
    best = F.max_by("candidate_id", F.struct("score", (-F.col("candidate_id")).alias("first")))
    return left.join(found.groupBy("name").agg(best.alias("candidate_id"), F.max("score").alias("score")), "name").select("target_id", "candidate_id", "score")


def district_filter(results: DataFrame, mode: str = "district", accept: Column | None = None) -> DataFrame:
    """results with decision and reason, from city, district, card_match, detail_match and a condition.

    A search of a whole city asks for no match. `accept` is the caller's condition on a result, any boolean column; rows that
    it doesn't hold for (or is null for) are skipped for `grid`, and an unknown district is kept only where it decides. In grid
    mode the condition is in_grid unless another one is given.
    """
    narrow = F.col("district") != F.col("city")
    accept = F.col("in_grid") if accept is None and mode == "grid" else accept
    grid = accept is not None
    outside = ~F.coalesce(accept, F.lit(False)) if grid else F.lit(False)
    reason = F.when(narrow & (F.col("card_match") == "outside"), "card").when(narrow & (F.col("detail_match") == "outside"), "detail").when(outside, "grid").when(narrow & (F.col("detail_match") == "unknown") & F.lit(not grid), "unknown").otherwise("")
    return results.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "", "keep").otherwise("skip"))


def resolve_coordinates(stations: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """stations with longitude, latitude, coordinate_source and geocoded_address.

    Given coordinates stay. Otherwise the first candidate that places (text, city, lng, lat) knows counts: the address,
    the first text in brackets, the name before them; with each, the station's city goes before entries without one.
    """
    name = F.coalesce("station_name", F.lit(""))
    asked = F.array(F.when(F.length("address") > 5, F.col("address")), F.nullif(F.regexp_extract(name, r"\(([^)]+)\)", 1), F.lit("")), F.nullif(F.substring_index(name, "(", 1), F.lit("")))
    need = F.col("longitude").isNull() | F.col("latitude").isNull()
    wanted = stations.where(need).select(F.col(key).alias("_key"), F.col("city").alias("_city"), F.posexplode(asked).alias("_pos", "_text")).where("_text is not null")
    known = places.select(F.col("text").alias("_text"), F.coalesce("city", F.lit("")).alias("_of"), "lng", "lat")
    hits = wanted.join(known, "_text").where("_of = '' or _of = _city")
    rank = F.struct("_pos", (F.col("_of") == "").cast("int").alias("_far"), "lng", "lat")
    hits = hits.groupBy("_key").agg(F.min_by(F.struct("lng", "lat", "_text"), rank).alias("_hit"))
    rows = stations.join(hits, F.col(key) == F.col("_key"), "left")
    source = F.when(~need, "input").when(F.col("_hit").isNotNull(), "geocode").otherwise("")
    return rows.select(*[c for c in stations.columns if c not in ("longitude", "latitude")], F.when(need, F.col("_hit.lng")).otherwise(F.col("longitude").cast("double")).alias("longitude"),
        F.when(need, F.col("_hit.lat")).otherwise(F.col("latitude").cast("double")).alias("latitude"), source.alias("coordinate_source"), F.when(need, F.col("_hit._text")).alias("geocoded_address"))


def fill_poi(poi: DataFrame, regions: DataFrame, digits: int = 6) -> DataFrame:
    """poi with blank address, city and district filled from regions by rounded coordinates; nothing is overwritten.

    Of several regions at one place the first by city, district and address counts, at each run.
    """
    at = [F.round(c, digits).cast(f"decimal(12,{digits})") for c in ("lng", "lat")]
    names = ("address", "city", "district")
    first = F.min(F.struct(*[text(c).alias(c) for c in ("city", "district", "address")])).alias("_r")
    known = regions.groupBy(*[c.alias(k) for c, k in zip(at, ("_lng", "_lat"))]).agg(first).select("_lng", "_lat", *[F.col(f"_r.{c}").alias(f"_{c}") for c in names])
    rows = poi.join(known, (at[0] == F.col("_lng")) & (at[1] == F.col("_lat")), "left")
    wants = (text("city") == "") | (text("district") == "")
    filled = {c: F.when(wants & (text(c) == ""), text(f"_{c}")).otherwise(text(c)) for c in names}
    source = F.when(wants & F.col("_lng").isNotNull(), "reverse_geocode").otherwise("")
    return rows.withColumns(filled | {"region_source": source}).drop("_lng", "_lat", *[f"_{c}" for c in names])


def scan_failures(tasks: DataFrame, logs: DataFrame) -> DataFrame:
    """Failed scan tasks with their newest failure log (id, raw_data, success); the task's id stands inside raw_data."""
    name = F.coalesce(F.get_json_object("raw_data", "$.scan_task_id"), F.get_json_object("raw_data", "$.id")).try_cast("long")
    newest = logs.where("not success").select(name.alias("_task"), F.col("id").alias("log_id"), "raw_data").where("_task is not null")
    newest = newest.groupBy("_task").agg(F.max("log_id").alias("log_id"), F.max_by("raw_data", "log_id").alias("raw_data"))
    return tasks.where("status = 'failed'").join(newest, F.col("id") == F.col("_task"), "left").drop("_task")


def to_station_rows(results: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Results as rows of the station table: city from the search, the page or the task, JSON lists, bounded texts."""
    rows = results.join(tasks.select(F.col("id").alias("scan_task_id"), F.col("city").alias("_city")), "scan_task_id", "left")
    city = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("search_city", "city", "_city")], F.lit(""))
    rows = rows.withColumn("city", city).withColumn("collected_at", normalize_ts("collected_at", now))
    rows = rows.withColumns({c: json_list(c) for c in ("fast_prices", "slow_prices", "facilities", "tags") if c in results.columns})
    return rows.withColumns({c: limited_text(c, c) for c in TEXT_LIMITS if c in rows.columns}).drop("_city", "search_city")


def build_collection_logs(results: DataFrame, tasks: DataFrame, most: int = 60000) -> DataFrame:
    """(layer, raw_data, success, error): one row for each collected station, and one for each failed task."""
    own = results.select(F.lit("station").alias("layer"), compact_log(F.struct("scan_task_id", "station_name", "address", *[c for c in results.columns if c not in ("scan_task_id", "station_name", "address")]), most).alias("raw_data"), F.lit(True).alias("success"), F.lit("").alias("error"))
    failed = tasks.where("status = 'failed'")
    bad = failed.select(F.lit("task").alias("layer"), utf8_truncate(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}), most).alias("raw_data"), F.lit(False).alias("success"), F.lit("failed").alias("error"))
    return own.unionByName(bad)
