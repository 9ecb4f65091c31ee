"""Queries over collected results: matching, filtering, filling, rows and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import results as R
from .registry import register

NORM = "lower(replace(replace(regexp_replace(station_name, '[\\s（）()·•\\-—_　]+', '', 'g'), '汽车充电站', '充电站'), '超级充电站', '充电站'))"


@register("join5_match_names", "fx_stations", f"""
WITH n AS (SELECT id, {NORM} AS name FROM fx_stations), t AS (SELECT id AS target_id, name FROM n), c AS (SELECT id AS candidate_id, CASE WHEN id%2=0 THEN name ELSE left(name,length(name)-1) END AS name FROM n),
m AS (SELECT target_id, candidate_id, CASE WHEN t.name=c.name THEN 1000 WHEN contains(c.name,t.name) THEN 800+length(t.name) ELSE 700+length(c.name) END AS score FROM t JOIN c ON contains(c.name,t.name) OR contains(t.name,c.name))
SELECT target_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, candidate_id) AS r FROM m) WHERE r=1""")
def match(stations: DataFrame) -> DataFrame:
    name = C.normalize_name("station_name")
    shorter = F.when(F.col("id") % 2 == 0, name).otherwise(F.substr(name, F.lit(1), F.length(name) - 1))
    return R.match_names(stations.select(F.col("id").alias("target_id"), F.col("station_name").alias("name")), stations.select(F.col("id").alias("candidate_id"), shorter.alias("name")))


VERDICTS = "SELECT query_id, pos, CASE WHEN query_id%5=0 THEN 'A' ELSE 'B' END AS city, 'A' AS district, CASE WHEN pos%3=0 THEN district_match ELSE 'unknown' END AS card_match, district_match AS detail_match, pos%2=0 AS in_grid FROM fx_trail"


def verdicts(trail: DataFrame) -> DataFrame:
    return trail.selectExpr("query_id", "pos", "if(query_id%5=0,'A','B') city", "'A' district", "if(pos%3=0,district_match,'unknown') card_match", "district_match detail_match", "pos%2=0 in_grid")


register("flt7_district_filter", "fx_trail", f"SELECT query_id, pos, CASE WHEN city=district OR (card_match<>'outside' AND detail_match='target') THEN 'keep' ELSE 'skip' END AS decision FROM ({VERDICTS})")(lambda t: R.district_filter(verdicts(t)).select("query_id", "pos", "decision"))
register("flt7_grid_filter", "fx_trail", f"SELECT query_id, pos, CASE WHEN in_grid AND (city=district OR (card_match<>'outside' AND detail_match<>'outside')) THEN 'keep' ELSE 'skip' END AS decision FROM ({VERDICTS})")(lambda t: R.district_filter(verdicts(t), "grid").select("query_id", "pos", "decision"))
register("flt7_caller_filter", "fx_trail", f"""
SELECT query_id, pos, CASE WHEN reason='' THEN 'keep' ELSE 'skip' END AS decision, reason FROM (SELECT *, CASE WHEN city<>district AND card_match='outside' THEN 'card'
 WHEN city<>district AND detail_match='outside' THEN 'detail' WHEN pos%4=1 THEN 'grid' ELSE '' END AS reason FROM ({VERDICTS}))""")(
    lambda t: R.district_filter(verdicts(t), accept=F.when(F.col("pos") % 4 == 1, None).otherwise(F.lit(True))).select("query_id", "pos", "decision", "reason")
)


@register("join9_resolve_coordinates", "fx_stations", """
WITH p AS (SELECT id, city, address, station_name, concat(city,'S',CAST(CAST(floor((id-1)/3) AS BIGINT) AS VARCHAR),CASE WHEN (id-1)%3=2 THEN 'B' ELSE '' END) AS inner_text, longitude, latitude FROM fx_stations)
SELECT id, CASE WHEN longitude IS NOT NULL THEN 'input' WHEN id%2=0 AND length(address)>5 THEN 'geocode' WHEN id%3=0 THEN 'geocode' ELSE '' END AS coordinate_source,
 CASE WHEN longitude IS NOT NULL THEN NULL WHEN id%2=0 AND length(address)>5 THEN address WHEN id%3=0 THEN inner_text END AS geocoded_address FROM p""")
def resolve(stations: DataFrame) -> DataFrame:
    place = (F.lit(1.0).alias("lng"), F.lit(2.0).alias("lat"))
    by_address = stations.where("id%2=0 and length(address)>5").select(F.col("address").alias("text"), "city", *place)
    by_name = stations.where("id%3=0").select(F.regexp_extract("station_name", r"\(([^)]+)\)", 1).alias("text"), F.lit("").alias("city"), *place)
    return R.resolve_coordinates(stations, by_address.unionByName(by_name)).select("id", "coordinate_source", "geocoded_address")


@register("join10_fill_poi", "fx_poi", "SELECT station_id, CASE WHEN city='' AND address='' THEN '补' ELSE address END AS address, CASE WHEN city='' THEN '新城' ELSE city END AS city, CASE WHEN city='' THEN 'reverse_geocode' ELSE '' END AS region_source FROM fx_poi")
def fill(poi: DataFrame) -> DataFrame:
    lng, lat = C.parse_lnglat("location")
    placed = poi.withColumns({"lng": lng, "lat": lat})
    regions = placed.select("lng", "lat", F.lit("补").alias("address"), F.lit("新城").alias("city"), F.lit("新区").alias("district"))
    return R.fill_poi(placed, regions).select("station_id", "address", "city", "region_source")


@register("join12_scan_failures", "fx_grids", "SELECT id, CASE WHEN id%2=0 THEN id*10+1 WHEN id%3=0 THEN id*10 END AS log_id FROM fx_grids WHERE status='failed'")
def failures(grids: DataFrame) -> DataFrame:
    key = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("id"), F.lit(0)), F.struct(F.lit("scan_task_id"), F.lit(1)))).when(F.col("id") % 3 == 0, F.array(F.struct(F.lit("id"), F.lit(0))))
    logs = grids.select("id", F.explode(key).alias("k")).select((F.col("id") * 10 + F.col("k.col2")).alias("id"), F.concat(F.lit('{"'), F.col("k.col1"), F.lit('":'), F.col("id"), F.lit("}")).alias("raw_data"), F.lit(False).alias("success"))
    return R.scan_failures(grids, logs).select("id", "log_id")


RESULTS = "SELECT id, CASE WHEN id%4=0 THEN '' ELSE city END AS search_city, CASE WHEN id%8=0 THEN '' ELSE district END AS own, station_name, address, id%50+1 AS scan_task_id FROM fx_stations"


@register("prj2_station_rows", "fx_stations fx_grids", f"SELECT r.id, left(r.station_name,255) AS station_name, coalesce(nullif(search_city,''),nullif(own,''),g.city,'') AS city, CASE WHEN r.id%2=0 THEN '[\"免费\"]' END AS tags, TIMESTAMP '2024-01-01 00:00:00' AS collected_at FROM ({RESULTS}) r LEFT JOIN fx_grids g ON g.id=r.scan_task_id")
def rows(stations: DataFrame, grids: DataFrame) -> DataFrame:
    found = stations.selectExpr("id", "if(id%4=0,'',city) search_city", "if(id%8=0,'',district) city", "station_name", "address", "id%50+1 scan_task_id", "if(id%2=0,array('免费'),cast(array() as array<string>)) tags", "'2024-01-01T08:00:00+08:00' collected_at")
    return R.to_station_rows(found, grids, F.current_timestamp()).select("id", "station_name", "city", "tags", "collected_at")


LOGGED = "scan_task_id := id, station_name := station_name, address := address, id := id, city := city, current_price := current_price"
register("snk3_collection_logs", "fx_stations fx_grids", f"""
SELECT 'station' AS layer, CAST(to_json(struct_pack({LOGGED})) AS VARCHAR) AS raw_data, true AS success, '' AS error FROM fx_stations
UNION ALL SELECT 'task', CAST(to_json(struct_pack(id := id, city := city, status := status)) AS VARCHAR), false, 'failed' FROM fx_grids WHERE status='failed'""")(
    lambda s, g: R.build_collection_logs(s.select("id", "station_name", "address", "city", "current_price", F.col("id").alias("scan_task_id")), g.select("id", "city", "status"))
)
BLANKS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
register("str2_text", "fx_logs", f"SELECT id, coalesce(regexp_replace(raw_data, '^{BLANKS}|{BLANKS}$', '', 'g'),'') AS t FROM fx_logs")(lambda x: x.select("id", C.text("raw_data").alias("t")))
register("str5_json_field", "fx_stations", "SELECT id, CASE WHEN address='' THEN NULL ELSE concat('\"',address,'\"') END AS a, CASE WHEN current_price='' THEN NULL ELSE current_price END AS p FROM fx_stations")(lambda s: s.select("id", R.json_field("address").alias("a"), R.json_field("current_price").alias("p")))
register("str6_compact_log", "fx_logs", """
WITH j AS (SELECT id, CAST(to_json(struct_pack(scan_task_id := id, station_name := 's', address := 'a', raw_data := raw_data)) AS VARCHAR) AS whole FROM fx_logs)
SELECT id, CASE WHEN strlen(whole)<=1500 THEN whole ELSE CAST(to_json(struct_pack(truncated := true, original_bytes := strlen(whole), scan_task_id := id, station_name := 's', address := 'a')) AS VARCHAR) END AS log FROM j""")(
    lambda x: x.select("id", R.compact_log(F.struct(F.col("id").alias("scan_task_id"), F.lit("s").alias("station_name"), F.lit("a").alias("address"), "raw_data"), 1500).alias("log"))
)
register("str7_utf8_truncate", "fx_logs", """
WITH c AS (SELECT id, i, substr(raw_data, i, 1) AS c FROM (SELECT id, raw_data, unnest(range(1, least(length(raw_data), 1001)+1)) AS i FROM fx_logs)),
t AS (SELECT id, i, c, sum(strlen(c)) OVER (PARTITION BY id ORDER BY i) AS bytes FROM c), k AS (SELECT id, string_agg(c, '' ORDER BY i) AS t FROM t WHERE bytes<=1000 GROUP BY id)
SELECT l.id, CASE WHEN l.raw_data IS NULL THEN NULL ELSE coalesce(k.t, '') END AS t FROM fx_logs l LEFT JOIN k ON k.id=l.id""")(lambda x: x.select("id", C.utf8_truncate("raw_data", 1000).alias("t")))
register("str8_normalize_ts", "fx_attempts", "SELECT attempt_id, started_at AS ts FROM fx_attempts")(
    lambda a: a.select("attempt_id", C.normalize_ts(F.concat(F.date_format(F.col("started_at") + F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00")), F.current_timestamp()).alias("ts"))
)
