"""Queries over page dumps. The dumps are XML built from the fixtures' rows; the SQL reads the rows, never the XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import pages
from .registry import register


def node(text="", desc="", inner: Column | None = None, box: str | None = None) -> Column:
    """An XML node; one with a box can be pressed."""
    escaped = lambda c: F.replace(F.replace(F.replace(c if isinstance(c, Column) else F.lit(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    pressed = f' clickable="true" bounds="{box}"' if box else ""
    return F.concat(F.lit('<node text="'), escaped(text), F.lit('" content-desc="'), escaped(desc), F.lit(f'"{pressed}>'), F.lit("") if inner is None else inner, F.lit("</node>"))


def hierarchy(*parts: Column) -> Column:
    return F.concat(F.lit("<hierarchy>"), F.concat_ws("", *parts), F.lit("</hierarchy>"))


def upper_half() -> list[Column]:
    c = F.col
    name = F.when(c("id") % 5 == 0, node(desc=c("station_name"), box="[0,100][1000,300]")).otherwise(node(desc=c("station_name")))
    hours = F.when(c("business_hours") != "", F.concat(node("营业时间"), node(c("business_hours"))))
    return [
        name, F.when(c("id") % 6 == 1, node("热门")), F.when(c("id") % 7 == 0, node("地上卫生间")), hours, node(F.concat(F.lit("驾车"), c("id") % 30 + 1, F.lit("公里"))), node(F.concat(c("id") % 50 + 1, F.lit("分钟"))),
        F.when(c("address") != "", node(c("address"))), F.when(c("operator") != "", node(c("operator"))),
    ]


def lower_half() -> list[Column]:
    c = F.col
    price = F.concat(node(F.concat(F.lit("￥"), c("current_price"))), node("/度"))
    card = node(inner=F.concat(price, node("查看")), box="[0,500][1000,700]")
    trend = node(inner=F.concat(node(inner=node(pages.TREND), box="[0,800][100,850]"), *[node(t) for t in ("￥0.81/度", "00:00-08:00", "￥0.99/度", "当前时段")]), box="[0,800][1000,1200]")
    guns = F.concat(node("快充"), node("空闲"), node(c("fast_available")), node(F.concat(F.lit("/"), c("fast_total"))), node("120kW"))
    return [
        F.when(c("current_price") != "", F.when(c("id") % 10 == 0, card).otherwise(price)), F.when(c("parking_fee") != "", node(F.concat(F.lit("停车费 "), c("parking_fee")))),
        F.when(c("fast_total") != "", guns), node((c("id") % 90).cast("string")), node("分享"), F.when(c("id") % 10 == 5, trend),
        F.when(c("id") % 4 != 0, F.concat(*map(node, ("详情", "地图", "电话", "导航", "路线")))), F.when(c("id") % 17 == 0, node("我知道了")),
    ]


def spread(stations: DataFrame) -> DataFrame:
    """stations dealt by id over all tasks; a small file of many rows would leave all pages to the task that reads it."""
    return stations.repartition(4 * stations.sparkSession.sparkContext.defaultParallelism, "id")


def detail_dumps(stations: DataFrame) -> DataFrame:
    return spread(stations).select(F.col("id").alias("dump_id"), "station_name", hierarchy(*upper_half(), *lower_half()).alias("xml"))


def scrolled_dumps(stations: DataFrame) -> DataFrame:
    """Two pages of each station; the second shows another station's name and address too."""
    other = [node(desc="旁边充电站"), node("河南省郑州市旁边路9号"), node("地下")]
    both = F.array(F.struct(F.lit(0).alias("seq"), hierarchy(*upper_half()).alias("xml")), F.struct(F.lit(1).alias("seq"), hierarchy(*other, *lower_half()).alias("xml")))
    return spread(stations).select("id", F.explode(both).alias("d")).select("id", "d.seq", "d.xml")


def price_dumps(periods: DataFrame) -> DataFrame:
    c = F.col
    fee = lambda label, column: F.when(c(column) != "", F.concat(F.lit(f" {label}"), c(column), F.lit("/度")))
    line = F.concat_ws("", "time", F.when(c("tag") != "", F.concat(F.lit(" "), "tag")), fee("参考价", "total_price"), fee("电费：￥", "elec_fee"), fee("服务费：￥", "service_fee"))
    rows = periods.where(c("time").contains("-") | c("time").contains("~")).select("station_id", "pos", node(line).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return rows.groupBy("station_id").agg(hierarchy(node("充电价格详情"), body).alias("xml"))


LINE = "concat(time, CASE WHEN tag<>'' THEN concat(' ',tag) ELSE '' END, CASE WHEN total_price<>'' THEN concat(' 参考价',total_price,'/度') ELSE '' END, CASE WHEN elec_fee<>'' THEN concat(' 电费：￥',elec_fee,'/度') ELSE '' END, CASE WHEN service_fee<>'' THEN concat(' 服务费：￥',service_fee,'/度') ELSE '' END)"
register("dmp1_explode_nodes", "fx_price_periods", f"SELECT station_id, CAST(row_number() OVER (PARTITION BY station_id ORDER BY pos)+1 AS INT) AS pos, 1 AS depth, {LINE} AS text FROM fx_price_periods WHERE time LIKE '%-%' OR time LIKE '%~%'")(
    lambda p: pages.explode_nodes(price_dumps(p), parts=("pos", "depth", "tag", "text")).where("tag='node' and pos>1").select("station_id", "pos", "depth", "text")
)
register("dmp2_malformed_pages", "fx_bad_dumps", "SELECT dump_id, CASE WHEN dump_id%3=0 THEN 'popup' ELSE 'unknown' END AS kind, dump_id%3<>0 AS bad FROM fx_bad_dumps")(
    lambda d: pages.assess_pages(pages.parse_dumps(d.withColumn("xml", F.when(F.col("dump_id") % 3 == 0, '<hierarchy><node text="我知道了" bounds="[0,0][9,9]"/></hierarchy>').otherwise(F.col("xml"))))).select("dump_id", "kind", F.col("error").isNotNull().alias("bad")))
register("dmp3_assess_pages", "fx_stations", """
SELECT id AS dump_id, CASE WHEN id%17=0 THEN 'popup' WHEN id%4<>0 OR business_hours<>'' THEN 'detail' ELSE 'unknown' END AS kind,
 CASE WHEN id%17=0 THEN 0.9 WHEN id%4<>0 THEN 0.93 WHEN business_hours<>'' THEN 0.965 ELSE 0.2 END AS confidence, true AS expected_visible FROM fx_stations""")(
    lambda s: pages.assess_pages(pages.parse_dumps(detail_dumps(s), parts=pages.JUDGED), "station_name").select("dump_id", "kind", F.round("confidence", 4).alias("confidence"), "expected_visible")
)
register("dmp3_assess_price_pages", "fx_price_periods", """
WITH p AS (SELECT station_id, count(*) AS n, bool_or(total_price<>'') AS r, bool_or(elec_fee<>'' OR service_fee<>'') AS f FROM fx_price_periods WHERE time LIKE '%-%' OR time LIKE '%~%' GROUP BY station_id)
SELECT station_id, CASE WHEN r AND f THEN 'price_detail' ELSE 'unknown' END AS kind FROM p""")(lambda p: pages.assess_pages(pages.parse_dumps(price_dumps(p), parts=pages.JUDGED)).select("station_id", "kind"))
register("dmp4_classify_layout", "fx_stations", """
WITH l AS (SELECT id, CASE WHEN id%10=5 THEN 'full_trend' WHEN id%10=0 AND current_price<>'' THEN 'click_to_expand' WHEN fast_total<>'' OR parking_fee<>'' OR address LIKE '%空%' THEN 'standard' ELSE 'basic' END AS layout FROM fx_stations)
SELECT id AS dump_id, layout, CASE layout WHEN 'full_trend' THEN 2 WHEN 'basic' THEN 0 ELSE 1 END AS scrolls_needed FROM l""")(lambda s: pages.classify_layout(pages.parse_dumps(detail_dumps(s))).select("dump_id", "layout", "scrolls_needed"))
FIELDS = """concat('驾车',id%30+1,'公里') AS distance, concat(id%50+1,'分钟') AS duration, business_hours, operator, CASE WHEN current_price<>'' THEN concat('￥',current_price) ELSE '' END AS current_price, parking_fee, fast_available, fast_total,
 CASE WHEN fast_total<>'' THEN '120kW' ELSE '' END AS fast_power, CAST(id%90 AS VARCHAR) AS favorite_count, CASE WHEN id%6=1 THEN '热门' ELSE '' END AS tags"""
SHOWN = ["station_name", "address", "distance", "duration", "business_hours", "operator", "current_price", "parking_fee", "fast_available", "fast_total", "fast_power", "favorite_count"]
register("dmp5_extract_detail", "fx_stations", f"SELECT id AS dump_id, station_name, CASE WHEN length(address)>=6 THEN address ELSE '' END AS address, {FIELDS}, CASE WHEN id%7=0 THEN '地上,卫生间' ELSE '' END AS facilities FROM fx_stations")(
    lambda s: pages.extract_detail(pages.parse_dumps(detail_dumps(s).drop("station_name"), parts=pages.WORDS)).select("dump_id", *SHOWN, *[F.concat_ws(",", c).alias(c) for c in ("tags", "facilities")])
)
register("dmp6_extract_trend", "fx_stations", "SELECT id AS dump_id, p.pos, p.time, p.total_price FROM fx_stations, (VALUES (1,'00:00-08:00','0.81'),(2,'当前时段','0.99')) p(pos,time,total_price) WHERE id%10=5")(
    lambda s: pages.extract_detail(pages.parse_dumps(detail_dumps(s).drop("station_name"), parts=pages.WORDS)).select("dump_id", F.posexplode("fast_prices").alias("at", "p")).select("dump_id", (F.col("at") + 1).alias("pos"), "p.time", "p.total_price")
)
register("dmp7_extract_price_detail", "fx_price_periods", """
WITH p AS (SELECT *, replace(time,'~','-') AS t FROM fx_price_periods WHERE time LIKE '%-%' OR time LIKE '%~%'), c AS (SELECT *, CASE WHEN t=lag(t) OVER (PARTITION BY station_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY station_id ORDER BY pos) AS run FROM c), r AS (SELECT station_id, run, t, max_by(total_price,pos) FILTER (total_price<>'') AS a, max_by(elec_fee,pos) FILTER (elec_fee<>'') AS b, max_by(service_fee,pos) FILTER (service_fee<>'') AS c, max_by(tag,pos) FILTER (tag<>'') AS d FROM g GROUP BY station_id, run, t)
SELECT station_id, t AS time, coalesce(min_by(a,run) FILTER (a IS NOT NULL),'') AS total_price, coalesce(min_by(b,run) FILTER (b IS NOT NULL),'') AS elec_fee, coalesce(min_by(c,run) FILTER (c IS NOT NULL),'') AS service_fee, coalesce(min_by(d,run) FILTER (d IS NOT NULL),'') AS tag
FROM r WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL GROUP BY station_id, t""")(lambda p: pages.extract_price_detail(price_dumps(p), ["station_id"]).select("station_id", "time", "total_price", "elec_fee", "service_fee", "tag"))
register("dmp8_price_entries", "fx_stations", "SELECT id AS dump_id, CASE WHEN id%10=5 THEN 'price_trend' ELSE 'price_card' END AS marker, 500 AS cx, CASE WHEN id%10=5 THEN 1000 ELSE 600 END AS cy FROM fx_stations WHERE id%10=5 OR (id%10=0 AND current_price<>'')")(
    lambda s: pages.parse_dumps(detail_dumps(s)).select("dump_id", pages.price_entry(F.col("nodes")).alias("e")).where("e is not null").select("dump_id", "e.marker", "e.cx", "e.cy")
)


@register("dmp9_search_cards", "fx_stations", "SELECT CAST(floor((id-1)/3) AS BIGINT) AS dump_id, CAST(((id-1)%3)*200+100 AS INT) AS cy, station_name AS name, CASE WHEN address LIKE '河南省%' THEN address ELSE '' END AS address FROM fx_stations")
def search(stations: DataFrame) -> DataFrame:
    place = (F.col("id") - 1) % 3
    card = F.coalesce(*[F.when(place == i, node(desc=F.col("station_name"), inner=F.concat(node("营业中"), node(F.col("address"))), box=f"[0,{200 * i}][1000,{200 * i + 200}]")) for i in range(3)])
    rows = stations.select(F.floor((F.col("id") - 1) / 3).alias("dump_id"), card.alias("card"))
    dumps = rows.groupBy("dump_id").agg(hierarchy(F.array_join(F.sort_array(F.collect_list("card")), "")).alias("xml"))
    return pages.search_cards(pages.parse_dumps(dumps)).select("dump_id", "cy", "name", "address")


register("agg13_equipment_facts", "fx_stations", "SELECT id AS dump_id, fast_available, fast_total, CASE WHEN fast_total<>'' THEN '120kW' ELSE '' END AS fast_power, '' AS super_total, '' AS slow_total FROM fx_stations")(
    lambda s: pages.parse_dumps(detail_dumps(s), parts=("text",)).withColumns(pages.equipment_facts(pages.neighbours(pages.page_texts(F.col("nodes"))))).select("dump_id", "fast_available", "fast_total", "fast_power", "super_total", "slow_total")
)
register("win4_neighbour_texts", "fx_stations", "SELECT id AS dump_id, CAST(id%90 AS VARCHAR) AS prev, '分享' AS text FROM fx_stations")(
    lambda s: pages.parse_dumps(detail_dumps(s), parts=("text",)).select("dump_id", F.explode(pages.neighbours(pages.page_texts(F.col("nodes")))).alias("a")).where("a.text='分享'").select("dump_id", "a.prev", "a.text")
)


def merged(stations: DataFrame) -> DataFrame:
    return pages.merge_dumps(pages.extract_detail(pages.parse_dumps(scrolled_dumps(stations), parts=pages.WORDS)), "id")


register("agg10_merge_dumps", "fx_stations", f"SELECT id, station_name, CASE WHEN length(address)>=6 THEN address ELSE '' END AS address, {FIELDS}, CASE WHEN id%7=0 THEN '地上,卫生间,地下' ELSE '地下' END AS facilities FROM fx_stations")(
    lambda s: merged(s).select("id", *SHOWN, *[F.concat_ws(",", c).alias(c) for c in ("tags", "facilities")])
)


@register("dmp10_assemble_stations", "fx_stations fx_price_periods", """
WITH p AS (SELECT station_id, count(DISTINCT replace(time,'~','-')) AS n, bool_or(replace(time,'~','-')='00:00-08:00') AS z FROM fx_price_periods WHERE (time LIKE '%-%' OR time LIKE '%~%') AND (total_price<>'' OR elec_fee<>'' OR service_fee<>'') GROUP BY station_id)
SELECT s.id, station_name, address, CASE WHEN length(address)>=6 THEN 'detail' WHEN address<>'' THEN 'input' ELSE '' END AS address_source, CASE WHEN n>0 THEN 'price_detail' WHEN id%10=5 THEN 'embedded_trend' ELSE '' END AS price_schedule_source,
 CASE WHEN n>0 THEN n+CASE WHEN id%10=5 AND NOT z THEN 1 ELSE 0 END WHEN id%10=5 THEN 2 ELSE 0 END AS periods, CASE WHEN id%2=0 THEN 'poi_id' ELSE 'search_card' END AS match_method FROM fx_stations s LEFT JOIN p ON p.station_id=s.id""")
def assemble(stations: DataFrame, periods: DataFrame) -> DataFrame:
    given = stations.select("id", F.col("station_name").alias("name"), "address", (F.col("id") % 2 == 0).alias("opened_by_poi"), F.lit(True).alias("expected_visible"))
    priced = pages.extract_price_detail(price_dumps(periods), ["station_id"]).withColumnRenamed("station_id", "id")
    out = pages.assemble_stations(merged(stations), priced, given, "id")
    return out.select("id", "station_name", "address", "address_source", "price_schedule_source", F.size("fast_prices").alias("periods"), "match_method")
