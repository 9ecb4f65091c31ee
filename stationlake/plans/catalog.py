"""Registered queries over the given tables, each with its DuckDB counterpart where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import regions as R
from ..operators import geo, prices, stats, tasks, upsert
from ..streaming import windows
from . import history_queries, page_queries, result_queries  # noqa: F401  they register more
from .registry import ORACLE_SQL, QUERIES, register, shared_folder  # noqa: F401  the first two are read from here

NOW = 1704067380.0


KM = "2*6371.0*atan2(sqrt({h}),sqrt(1-{h}))".replace("{h}", "(pow(sin(radians({b}.latitude-{a}.latitude)/2),2)+cos(radians({a}.latitude))*cos(radians({b}.latitude))*pow(sin(radians({b}.longitude-{a}.longitude)/2),2))")
PLACED = "(SELECT id, station_name, CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude FROM fx_stations WHERE longitude <> 0 AND latitude <> 0)"
PAIRS = f"SELECT a.id AS a, b.id AS b, {KM.format(a='a', b='b')} AS km FROM {PLACED} a JOIN {PLACED} b ON a.id < b.id AND abs(a.latitude-b.latitude) < 0.01"
NORM = "lower(replace(replace(regexp_replace({c}, '[\\s（）()·•\\-—_　]+', '', 'g'), '汽车充电站', '充电站'), '超级充电站', '充电站'))"

register("agg1_stats_by_city", "fx_stations", "SELECT city, count(*) AS count FROM fx_stations GROUP BY city")(stats.stats_by_city)
register("agg2_stats_by_operator", "fx_stations", "SELECT operator, count(*) AS count FROM fx_stations WHERE operator <> '' GROUP BY operator")(stats.stats_by_operator)
register("agg3_stats_overview", "fx_attempts", "SELECT count(*) AS total, max(started_at) AS latest FROM fx_attempts")(lambda a: stats.stats_overview(a, "started_at"))
register("agg4_task_stats", "fx_tasks", """
SELECT count(*) FILTER (status='pending') AS pending, count(*) FILTER (status='leased') AS leased, count(*) FILTER (status='succeeded') AS succeeded, count(*) FILTER (status='failed') AS failed,
 count(*) AS total, count(*) FILTER (detailed) AS detailed, round(coalesce(avg(completeness_score) FILTER (status='succeeded'),0.0),6) AS average_score, round(count(*) FILTER (detailed)/count(*),6) AS detailed_rate FROM fx_tasks""")(stats.task_stats)
register("agg5_scan_stats", "fx_grids", "SELECT s.status, count(g.id) AS n FROM (VALUES ('pending'),('scanning'),('done'),('failed')) s(status) LEFT JOIN fx_grids g ON g.status=s.status GROUP BY s.status")(stats.scan_stats)
KEY = "CASE WHEN trim(id)<>'' THEN trim(id) ELSE concat('ROW-',left(sha1(concat(trim(name),'|',trim(latitude),'|',trim(longitude))),16)) END"
register("agg6_group_sources", "fx_source_rows", f"""
SELECT {KEY} AS station_id, count(*) AS duplicate_count, coalesce(min(CASE WHEN sequence='' THEN 0 WHEN regexp_full_match(sequence,'[+-]?[0-9]+') THEN CAST(sequence AS BIGINT) END),0) AS source_sequence,
 min(pos) AS first_pos, min_by(address,pos) AS first_address, sum(pos) AS pos_sum FROM fx_source_rows GROUP BY 1""")(
    lambda rows: tasks.group_sources(rows).select("station_id", "duplicate_count", "source_sequence", F.col("payload.pos").alias("first_pos"), F.col("payload.address").alias("first_address"), F.aggregate("source_records", F.lit(0).cast("long"), lambda s, x: s + x["pos"]).alias("pos_sum"))
)
STATUS = "CASE WHEN detailed THEN '详细' WHEN status='failed' THEN '失败' ELSE status END"
covered = lambda t: t.withColumn("detail_verified", F.lit(False)).withColumn("coverage_status", C.coverage_status())
register("agg7_report_summary", "fx_tasks", f"SELECT count(*) AS total, count(*) FILTER ({STATUS}='详细') AS detailed, round(count(*) FILTER ({STATUS}='详细')/count(*),6) AS rate FROM fx_tasks")(lambda t: stats.report_summary(covered(t)))
register("agg8_city_coverage", "fx_stations", "SELECT CASE WHEN address='' THEN '未识别' ELSE city END AS city, count(*) AS total, count(*) FILTER (detail_verified) AS detailed, round(count(*) FILTER (detail_verified)/count(*),6) AS rate FROM fx_stations GROUP BY 1")(
    lambda s: stats.city_coverage(s.withColumn("city", F.when(F.col("address") == "", "").otherwise(F.col("city"))).withColumn("coverage_status", F.when(F.col("detail_verified"), "详细").otherwise("部分")))
)
register("agg9_task_summaries", "fx_tasks fx_attempts", "SELECT t.task_id, count(a.attempt_id) AS station_count, coalesce(string_agg(CAST(a.attempt_id AS VARCHAR), ',' ORDER BY a.attempt_no),'') AS station_ids FROM fx_tasks t LEFT JOIN fx_attempts a ON a.task_id=t.task_id GROUP BY t.task_id")(
    lambda t, a: tasks.task_summaries(t, a.select("task_id", F.col("attempt_no").alias("pos"), F.col("attempt_id").alias("station_id"))).withColumn("station_ids", F.concat_ws(",", F.transform("station_ids", lambda x: x.cast("string"))))
)
register("agg11_merge_price_periods", "fx_price_periods", """
WITH p AS (SELECT *, replace(time,'~','-') AS t, source='price_detail' AS d FROM fx_price_periods), h AS (SELECT station_id, bool_or(d) AS any_d FROM p GROUP BY station_id),
q AS (SELECT p.* FROM p JOIN h USING (station_id) WHERE d OR NOT any_d OR regexp_full_match(t,'\\d{2}:\\d{2}-\\d{2}:\\d{2}')), r AS (SELECT *, CASE WHEN d THEN 0 ELSE 1 END*1000000+pos AS k, CASE WHEN t='' THEN pos ELSE 0 END AS f FROM q)
SELECT station_id, t AS time, coalesce(min_by(total_price,k) FILTER (total_price<>''),'') AS total_price, coalesce(min_by(elec_fee,k) FILTER (elec_fee<>''),'') AS elec_fee, coalesce(min_by(service_fee,k) FILTER (service_fee<>''),'') AS service_fee,
 coalesce(min_by(tag,k) FILTER (tag<>''),'') AS tag, min_by(source,k) AS source, min_by(pos,k) AS pos FROM r GROUP BY station_id, t, f""")(lambda p: prices.merge_price_periods(p, ["station_id"]))
COUNTED = ["id", "station_name", "longitude", "latitude", "address", "business_hours", "current_price", "parking_fee", "fast_available", "fast_total"]


@register("agg12_dedup_stations", "fx_stations", f"""
WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY id) AS n, id, station_name, CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude,
  {" + ".join(f"CASE WHEN {c} <> '' THEN 1 ELSE 0 END" for c in COUNTED if c not in ("id", "longitude", "latitude"))} AS filled FROM fx_stations WHERE longitude <> 0 AND latitude <> 0),
 fold(n, kept, spot, r) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, station_name VARCHAR, longitude DOUBLE, latitude DOUBLE, filled INTEGER)[]), CAST(NULL AS BIGINT),
   CAST(NULL AS STRUCT(id BIGINT, station_name VARCHAR, longitude DOUBLE, latitude DOUBLE, filled INTEGER))
  UNION ALL
  SELECT n, CASE WHEN spot IS NULL OR spot = 0 THEN list_append(kept, r) WHEN r.filled > kept[spot].filled THEN list_concat(kept[:spot-1], [r], kept[spot+1:]) ELSE kept END, spot, r
  FROM (SELECT t.n, kept, list_position([CASE WHEN abs(k.latitude-t.latitude) >= 0.01 THEN false ELSE {KM.format(a="k", b="t")} < 0.1 OR (k.station_name = t.station_name AND {KM.format(a="k", b="t")} < 0.5) END FOR k IN kept], true) AS spot,
    {{'id': t.id, 'station_name': t.station_name, 'longitude': t.longitude, 'latitude': t.latitude, 'filled': t.filled}} AS r FROM fold JOIN t ON t.n = fold.n + 1))
SELECT id, station_name, city FROM fx_stations WHERE longitude IS NULL OR latitude IS NULL OR longitude = 0 OR latitude = 0
 OR id IN (SELECT unnest([k.id FOR k IN kept]) FROM fold WHERE n = (SELECT count(*) FROM t))""")
def dedup(stations: DataFrame) -> DataFrame:
    return geo.dedup_stations(stations, COUNTED, shared_folder(stations.sparkSession)).select("id", "station_name", "city")


register("flt1_list_stations", "fx_stations", "SELECT id, station_name FROM fx_stations WHERE city='郑州' AND operator='特来电' ORDER BY id DESC LIMIT 20")(lambda s: stats.list_stations(s, "郑州", "特来电").select("id", "station_name"))
register("flt2_get_station", "fx_stations", "SELECT id, station_name, address FROM fx_stations WHERE id=42")(lambda s: stats.get_station(s, 42).select("id", "station_name", "address"))
register("flt3_located", "fx_stations", "SELECT id FROM fx_stations WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND longitude<>0 AND latitude<>0")(lambda s: s.where(C.located()).select("id"))
ERROR = "CASE WHEN min_lng IS NULL OR max_lng IS NULL OR min_lat IS NULL OR max_lat IS NULL THEN 'missing' WHEN min_lng>max_lng THEN 'longitude' WHEN min_lat>max_lat THEN 'latitude' WHEN NOT (CAST(coalesce(CAST(center_lng AS DOUBLE),(CAST(min_lng AS DOUBLE)+CAST(max_lng AS DOUBLE))/2) AS DOUBLE) BETWEEN CAST(min_lng AS DOUBLE) AND CAST(max_lng AS DOUBLE) AND coalesce(CAST(center_lat AS DOUBLE),(CAST(min_lat AS DOUBLE)+CAST(max_lat AS DOUBLE))/2) BETWEEN CAST(min_lat AS DOUBLE) AND CAST(max_lat AS DOUBLE)) THEN 'center' END"
register("flt4_validate_grids", "fx_grids", f"SELECT id, round(coalesce(CAST(center_lng AS DOUBLE),(CAST(min_lng AS DOUBLE)+CAST(max_lng AS DOUBLE))/2),6) AS center_lng, {ERROR} AS grid_error FROM fx_grids")(lambda g: geo.validate_grids(g).select("id", F.round("center_lng", 6).alias("center_lng"), "grid_error"))
register("join1_assign_grids", "fx_stations fx_grids", f"WITH g AS (SELECT id, CAST(min_lng AS DOUBLE) x0, CAST(max_lng AS DOUBLE) x1, CAST(min_lat AS DOUBLE) y0, CAST(max_lat AS DOUBLE) y1 FROM fx_grids WHERE {ERROR} IS NULL) SELECT s.id, g.id AS grid_id FROM fx_stations s JOIN g ON CAST(s.longitude AS DOUBLE) BETWEEN x0 AND x1 AND CAST(s.latitude AS DOUBLE) BETWEEN y0 AND y1")(geo.assign_grids)
register("flt9_lapsed_leases", "fx_tasks", f"SELECT task_id, CASE WHEN attempts<max_attempts THEN 'pending' ELSE 'failed' END AS next_status FROM fx_tasks WHERE status='leased' AND lease_expires_at<{NOW}")(lambda t: tasks.lapsed_leases(t, NOW).select("task_id", "next_status"))
register("flt10_requeue_selection", "fx_tasks", "SELECT task_id FROM fx_tasks WHERE status='failed' AND CAST(substr(station_id,2) AS BIGINT)%3=0")(lambda t: tasks.requeue_selection(t, t.where("cast(substr(station_id,2) as bigint)%3=0").select("station_id")).select("task_id"))
register("join2_near_dup_pairs", "fx_stations", f"SELECT a, b, round(km,6) AS distance_km FROM (SELECT p.*, x.station_name=y.station_name AS same FROM ({PAIRS}) p JOIN fx_stations x ON x.id=p.a JOIN fx_stations y ON y.id=p.b) WHERE km<0.1 OR (same AND km<0.5)")(lambda s: geo.near_dup_pairs(s).withColumn("distance_km", F.round("distance_km", 6)))
FROM = KM.format(a="q", b="s")
register("join3_nearby", "fx_stations", f"SELECT s.id, round({FROM},6) AS distance_km FROM {PLACED} s, (SELECT 113.5 AS longitude, 34.5 AS latitude) q WHERE {FROM}<=50 ORDER BY {FROM}, s.id LIMIT 20")(lambda s: geo.nearby(s, 113.5, 34.5).select("id", F.round("distance_km", 6).alias("distance_km")))
register("join4_nearby_join", "fx_stations", f"SELECT a_id, b_id, rank FROM (SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY {KM.format(a='a', b='b')}, b.id) AS rank FROM (SELECT * FROM {PLACED} WHERE id%10=0) a JOIN {PLACED} b ON {KM.format(a='a', b='b')}<=20) WHERE rank<=3")(lambda s: geo.nearby_join(s.where("id%10=0"), s, 20, 3).select("a_id", "b_id", "rank"))
register("prj3_evaluate_detail", "fx_stations", """
WITH s AS (SELECT *, CAST(business_hours<>'' AS INT)+CAST(operator<>'' AS INT)+CAST(current_price<>'' AS INT)+CAST(parking_fee<>'' AS INT)+CAST(fast_available<>'' OR fast_total<>'' AS INT) AS n FROM fx_stations)
SELECT id, CASE WHEN detail_verified THEN 25 ELSE 0 END+15+CASE WHEN address<>'' THEN 15 ELSE 0 END+CASE WHEN business_hours<>'' THEN 10 ELSE 0 END+CASE WHEN operator<>'' THEN 10 ELSE 0 END+CASE WHEN current_price<>'' THEN 10 ELSE 0 END+CASE WHEN fast_available<>'' OR fast_total<>'' THEN 7 ELSE 0 END+CASE WHEN parking_fee<>'' THEN 2 ELSE 0 END AS score,
 detail_verified AND address<>'' AND n>=2 AS detailed, concat_ws(',',CASE WHEN NOT detail_verified THEN 'detail_verified' END,CASE WHEN address='' THEN 'address' END,CASE WHEN n<2 THEN 'operational_fields' END) AS missing FROM s""")(lambda s: C.evaluate_detail(s).select("id", "score", "detailed", F.concat_ws(",", "missing").alias("missing")))
register("prj4_coverage_status", "fx_tasks", f"SELECT task_id, {STATUS} AS coverage_status FROM fx_tasks")(lambda t: covered(t).select("task_id", "coverage_status"))
register("flt8_report_failures", "fx_tasks", f"SELECT task_id FROM fx_tasks WHERE {STATUS}<>'详细'")(lambda t: stats.report_failures(covered(t)).select("task_id"))
register("prj5_equipment_summary", "fx_stations", """
SELECT id, concat_ws('；', CASE WHEN id%3=0 THEN concat('超充 ',id%5,'/') WHEN id%3=1 THEN '超充 480kW' END, CASE WHEN fast_available<>'' OR fast_total<>'' THEN concat('快充 ',fast_available,'/',fast_total,' 120kW') ELSE '快充 120kW' END,
 CASE WHEN id%7=0 THEN concat('慢充 /',id%4) END) AS summary FROM fx_stations""")(
    lambda s: s.withColumns({
        "super_available": F.when(F.col("id") % 3 == 0, (F.col("id") % 5).cast("string")), "super_total": F.lit(""), "super_power": F.when(F.col("id") % 3 == 1, "480kW"), "fast_power": F.lit("120kW"),
        "slow_available": F.lit(None).cast("string"), "slow_total": F.when(F.col("id") % 7 == 0, (F.col("id") % 4).cast("string")).otherwise(""), "slow_power": F.lit(" "),
    }).select("id", C.equipment_summary().alias("summary"))
)
DASH = "CASE WHEN {c}='' THEN '-' ELSE {c} END"
register("prj6_price_schedule_text", "fx_price_periods", f"SELECT station_id, string_agg(trim(concat(time,' ',total_price,CASE WHEN elec_fee<>'' OR service_fee<>'' THEN concat('（电',{DASH.format(c='elec_fee')},'+服',{DASH.format(c='service_fee')},'）') ELSE '' END)),'；' ORDER BY pos) AS schedule FROM fx_price_periods GROUP BY station_id")(
    lambda p: prices.collect_periods(p, ["station_id"]).select("station_id", C.price_schedule_text("periods").alias("schedule"))
)
register("prj7_search_phrase", "fx_stations", "SELECT id, CASE WHEN address<>'' AND length(regexp_replace(station_name,'[\\s（）()·•\\-_]+','','g'))<=10 THEN concat(station_name,' ',address) ELSE station_name END AS phrase FROM fx_stations")(lambda s: s.select("id", C.search_phrase("station_name", "address").alias("phrase")))
register("prj10_retry_delay", "fx_attempts", "SELECT attempt_id, least(60.0, 5*pow(2.0, greatest(0,attempt_no-1))) AS delay FROM fx_attempts")(lambda a: a.select("attempt_id", C.retry_delay("attempt_no").alias("delay")))
register("prj11_attempt_strategy", "fx_attempts fx_tasks", "SELECT a.attempt_id, CASE WHEN a.attempt_no<t.max_attempts THEN 'poi_id' ELSE 'exact_search' END AS strategy FROM fx_attempts a JOIN fx_tasks t ON t.task_id=a.task_id")(lambda a, t: a.join(t.select("task_id", "max_attempts"), "task_id").select("attempt_id", C.attempt_strategy("attempt_no", "max_attempts").alias("strategy")))
register("join6_upsert_stations", "fx_stations", """
WITH c AS (SELECT id, station_name, city, address, current_price FROM fx_stations WHERE id%2=0), i AS (SELECT id AS pos, station_name, city, address, concat('new',CAST(id AS VARCHAR)) AS current_price FROM fx_stations WHERE address<>'' AND (id%2=1 OR id%10=0)),
m AS (SELECT i.*, (SELECT max(c.id) FROM c WHERE c.station_name=i.station_name AND c.city=i.city AND c.address=i.address) AS hit FROM i)
SELECT station_name, city, address, current_price FROM m UNION ALL SELECT c.station_name, c.city, c.address, c.current_price FROM c WHERE c.id NOT IN (SELECT hit FROM m WHERE hit IS NOT NULL)""")(
    lambda s: upsert.upsert_stations(s.where("id%2=0").select("id", "station_name", "city", "address", "current_price"), s.where("address<>'' and (id%2=1 or id%10=0)").select(F.col("id").alias("pos"), "station_name", "city", "address", F.concat(F.lit("new"), "id").alias("current_price"))).drop("id")
)
register("join8_detail_rows", "fx_tasks fx_poi", "SELECT t.task_id, coalesce(p.city,'') AS city, coalesce(p.address,'') AS address FROM fx_tasks t LEFT JOIN fx_poi p ON p.station_id=t.station_id")(
    lambda t, p: tasks.build_detail_rows(t.withColumn("source_records", F.array(F.col("task_id"))).withColumns({c: F.lit("") for c in ("city", "district", "address")}), p).select("task_id", "city", "address")
)
register("join8_source_records", "fx_tasks", """
SELECT task_id, CASE WHEN task_id%3=0 THEN concat('payload',CAST(task_id AS VARCHAR)) ELSE concat('record',CAST(k AS VARCHAR)) END AS record
FROM (SELECT task_id, unnest(range(1, greatest(1, task_id%3)+1)) AS k FROM fx_tasks)""")(
    lambda t: tasks.build_detail_rows(
        t.withColumns({"payload": F.concat(F.lit("payload"), "task_id"), "source_records": F.when(F.col("task_id") % 3 > 0, F.transform(F.sequence(F.lit(1), (F.col("task_id") % 3).cast("int")), lambda k: F.concat(F.lit("record"), k)))} | {c: F.lit("") for c in ("city", "district", "address")}),
        t.limit(0).select("station_id", *[F.lit("").alias(c) for c in ("city", "district", "address")]),
    ).select("task_id", "record")
)
register("join11_attempt_history", "fx_tasks fx_attempts", "SELECT t.task_id, a.attempt_id, a.outcome FROM fx_tasks t LEFT JOIN fx_attempts a ON a.task_id=t.task_id")(lambda t, a: tasks.task_attempt_history(t, a).select("task_id", "attempt_id", "outcome"))
register("join7_import_tasks", "fx_source_rows fx_tasks", f"""
WITH n AS (SELECT {KEY} AS station_id, min_by(name,pos) AS payload, 150 AS priority, 2 AS max_attempts FROM fx_source_rows GROUP BY 1)
SELECT coalesce(t.station_id,n.station_id) AS station_id, coalesce(n.payload,'old') AS payload, greatest(t.priority,n.priority) AS priority, greatest(t.max_attempts,n.max_attempts) AS max_attempts, coalesce(t.status,'pending') AS status FROM fx_tasks t FULL JOIN n ON n.station_id=t.station_id""")(
    lambda r, t: tasks.import_tasks(tasks.group_sources(r).select("station_id", F.col("payload.name").alias("payload"), F.lit(150).alias("priority"), F.lit(2).alias("max_attempts")), t.withColumn("payload", F.lit("old"))).select("station_id", "payload", "priority", "max_attempts", "status")
)
register("win1_latest_per_key", "fx_stations", "SELECT city, operator, max(id) AS id FROM fx_stations GROUP BY city, operator")(lambda s: tasks.latest_per_key(s, ["city", "operator"]).select("city", "operator", "id"))
register("win2_claimable_backlog", "fx_tasks", f"SELECT task_id FROM fx_tasks WHERE status='pending' AND available_at<={NOW} AND attempts<max_attempts ORDER BY priority DESC, source_sequence, task_id LIMIT 25")(lambda t: tasks.claimable_backlog(t, NOW, 25).select("task_id"))
register("win3_unique_rows", "fx_source_rows", f"SELECT station_id, pos, duplicate_count FROM (SELECT {KEY} AS station_id, pos, row_number() OVER (PARTITION BY {KEY} ORDER BY pos) AS r, count(*) OVER (PARTITION BY {KEY}) AS duplicate_count FROM fx_source_rows) WHERE r=1")(lambda r: tasks.unique_rows(r.withColumn("station_id", C.station_key("id", "name", "latitude", "longitude"))).select("station_id", "pos", "duplicate_count"))
CARDS = f"SELECT *, {NORM.format(c='name')} AS norm_name FROM fx_cards"
register("win5_first_seen_cards", "fx_cards", f"SELECT query_id, norm_name, screen, cy FROM (SELECT *, row_number() OVER (PARTITION BY query_id, norm_name ORDER BY screen, cy, cx) AS r FROM ({CARDS})) WHERE r=1")(lambda c: tasks.first_seen_cards(c).select("query_id", "norm_name", "screen", "cy"))
register("win6_convergence_cutoff", "fx_trail", """
WITH a AS (SELECT *, sum(CASE WHEN district_match='outside' THEN 0 ELSE 1 END) OVER w AS g, sum(CASE WHEN district_match='target' THEN 1 ELSE 0 END) OVER w AS acc FROM fx_trail WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
b AS (SELECT *, sum(CASE WHEN district_match='outside' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, g ORDER BY pos) AS run FROM a), c AS (SELECT query_id, min(pos) AS cut FROM b WHERE run>=4 AND acc>0 GROUP BY query_id)
SELECT b.query_id, b.pos, b.district_match FROM b LEFT JOIN c ON c.query_id=b.query_id WHERE cut IS NULL OR pos<=cut""")(tasks.convergence_cutoff)
register("win7_screen_stop", "fx_cards", f"""
WITH f AS (SELECT query_id, norm_name, min(screen) AS screen FROM ({CARDS}) GROUP BY 1,2), n AS (SELECT s.query_id, s.screen, count(f.norm_name) AS new FROM (SELECT DISTINCT query_id, screen FROM fx_cards) s LEFT JOIN f ON f.query_id=s.query_id AND f.screen=s.screen GROUP BY 1,2),
g AS (SELECT *, sum(CASE WHEN new>0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY screen) AS i FROM n), r AS (SELECT *, sum(CASE WHEN new=0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, i ORDER BY screen) AS run FROM g)
SELECT query_id, coalesce(min(screen) FILTER (run>=2 OR screen>=12), max(screen)) AS stop_screen FROM r GROUP BY query_id""")(tasks.screen_stop)
register("win8_fenced_outcomes", "fx_attempts", "SELECT task_id, max_by(outcome,attempt_no) AS outcome, max(attempt_no) AS attempt_no FROM fx_attempts GROUP BY task_id")(lambda a: tasks.fenced_outcomes(a).select("task_id", "outcome", "attempt_no"))
register("sort1_page", "fx_stations", "SELECT id, station_name FROM fx_stations ORDER BY id DESC LIMIT 20 OFFSET 40")(lambda s: stats.page_of(s, 3).select("id", "station_name"))
register("sort1_page_info", "fx_stations", "SELECT count(*) AS total, CAST(ceil(count(*)/20) AS BIGINT) AS total_pages FROM fx_stations")(stats.page_info)
register("set3_removed_audit", "fx_stations", "SELECT id FROM fx_stations WHERE NOT detail_verified")(lambda s: geo.removed_audit(s, s.where("detail_verified")).select("id"))
register("str1_normalize_name", "fx_stations", f"SELECT id, {NORM.format(c='station_name')} AS name FROM fx_stations")(lambda s: s.select("id", C.normalize_name("station_name").alias("name")))
register("str3_station_key", "fx_source_rows", f"SELECT pos, {KEY} AS station_id FROM fx_source_rows")(lambda r: r.select("pos", C.station_key("id", "name", "latitude", "longitude").alias("station_id")))
register("str4_limited_text", "fx_logs", "SELECT id, left(raw_data,500) AS address FROM fx_logs")(lambda x: x.select("id", C.limited_text("address", "raw_data").alias("address")))
register("str9_error_text", "fx_logs", "SELECT id, left(raw_data,1000) AS error FROM fx_logs")(lambda x: x.select("id", C.error_text("raw_data").alias("error")))
register("geo3_parse_lnglat", "fx_poi", "SELECT station_id, CAST(split_part(location,',',1) AS DOUBLE) AS lng, CAST(split_part(location,',',2) AS DOUBLE) AS lat FROM fx_poi")(lambda p: p.select("station_id", C.parse_lnglat("location")[0].alias("lng"), C.parse_lnglat("location")[1].alias("lat")))
DISTRICTS = {"郑州": R.REGIONS["郑州"].split()}
OTHER = " OR ".join(f"address LIKE '%{d}%'" for d in DISTRICTS["郑州"] if d != "金水区")
FAR = " OR ".join(f"address LIKE '%{c}市%'" for c in R.REGIONS if c != "郑州")
AREA = " OR ".join(f"starts_with(behind,'{a}')" for a in R.FUNCTIONAL_AREAS)
register("flt6_classify_district", "fx_stations", f"SELECT id, CASE WHEN address LIKE '%金水区%' THEN 'target' WHEN {OTHER} THEN 'outside' WHEN {FAR} THEN 'outside' WHEN address LIKE '%郑州市%' AND ({AREA}) THEN 'outside' WHEN station_name LIKE '%金水区%' THEN 'target' ELSE 'unknown' END AS verdict FROM (SELECT *, substr(address, strpos(address,'郑州市')+3) AS behind FROM fx_stations)")(
    lambda s: s.select("id", R.classify_district(F.lit("郑州"), F.lit("金水区"), ["address"], ["station_name"]).alias("verdict"))
)
DISTRICT_ALIASES, LABELS = R.district_aliases()
ALIASES = ", ".join(f"('{a}', '{d}', '{c}')" for a, (d, c) in DISTRICT_ALIASES.items())
CITIES = ", ".join(f"('{c}', '{label}')" for c, label in LABELS.items())
register("reg1_parse_region", "fx_stations", f"""
WITH s AS (SELECT id, trim(concat(address, ' ', city)) AS t FROM fx_stations), a(alias, district, city) AS (VALUES {ALIASES}), c(name, label) AS (VALUES {CITIES}),
d AS (SELECT s.id, a.district, a.city, row_number() OVER (PARTITION BY s.id ORDER BY strpos(t, alias), -length(alias), district, a.city) AS r FROM s JOIN a ON contains(t, alias)),
h AS (SELECT s.id, label, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN contains(t, label) THEN strpos(t, label) ELSE strpos(t, name) END, CASE WHEN contains(t, label) THEN -length(label) ELSE -length(name) END, label) AS r FROM s JOIN c ON contains(t, name))
SELECT s.id, coalesce(d.city, h.label, '') AS city, coalesce(d.district, '') AS district FROM s LEFT JOIN d ON d.id = s.id AND d.r = 1 LEFT JOIN h ON h.id = s.id AND h.r = 1""")(
    lambda s: s.select("id", R.parse_region("address", "city").alias("r")).select("id", "r.city", "r.district")
)
register("mth1_filled_count", "fx_stations", "SELECT id, 1+CAST(station_name<>'' AS INT)+CAST(address<>'' AS INT)+CAST(business_hours<>'' AS INT)+CAST(current_price<>'' AS INT) AS filled FROM fx_stations")(lambda s: s.select("id", C.filled_count(s, ["id", "station_name", "address", "business_hours", "current_price"]).alias("filled")))
register("arr2_period_round_trip", "fx_price_periods", "SELECT station_id, pos, replace(time,'~','-') AS time, total_price, source FROM fx_price_periods")(
    lambda p: prices.explode_periods(prices.collect_periods(p, ["station_id"]).withColumn("periods", prices.normalize_periods("periods", "x"))).select("station_id", "pos", "time", "total_price", "source")
)
register("stm2_heartbeat_sessions", "fx_attempts", """
WITH g AS (SELECT device_serial AS device, started_at AS ts, CASE WHEN started_at - lag(started_at) OVER (PARTITION BY device_serial ORDER BY started_at) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS n FROM fx_attempts), s AS (SELECT *, sum(n) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT device, min(ts) AS started, max(ts) + INTERVAL 20 MINUTE AS lapsed, count(*) AS beats FROM s GROUP BY device, k""")(lambda a: windows.heartbeat_sessions(a.select(F.col("device_serial").alias("device"), F.col("started_at").alias("ts")), "20 minutes"))
register("stm3_outcome_windows", "fx_attempts", "SELECT time_bucket(INTERVAL 1 HOUR, started_at) AS start, outcome, count(*) AS n FROM fx_attempts GROUP BY 1,2")(lambda a: windows.outcome_windows(a, "1 hour"))
