"""Deterministic inputs derived from the given tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REGIONS = """(VALUES (0,'郑州','中原区'),(1,'郑州','金水区'),(2,'郑州','新郑市'),(3,'洛阳','涧西区'),(4,'洛阳','新安县'),(5,'开封','祥符区'),(6,'许昌','长葛市'),(7,'新乡','红旗区'),(8,'安阳','林州市'),(9,'济源','济源'))"""

FIXTURES = {
    "fx_stations": """
SELECT id, concat(operator,'汽车充电站(',city,'S',CAST(k AS STRING),CASE WHEN m=2 THEN 'B' ELSE '' END,')') AS station_name,
 operator,
 CASE WHEN id%11=0 THEN '' WHEN id%7=0 THEN concat('河南省',city,'市航空港区炎黄大道',CAST(id AS STRING),'号') WHEN id%5=0 THEN concat('建设路',CAST(id AS STRING),'号') ELSE concat('河南省',city,'市',district,'测试路',CAST(id AS STRING),'号') END AS address,
 city, district,
 CASE WHEN id%13=0 THEN NULL ELSE CAST(110.5+((k*7919)%60000)/10000.0+m*0.0007 AS DECIMAL(10,6)) END AS longitude,
 CASE WHEN id%13=0 THEN NULL ELSE CAST(31.5+((k*10477)%45000)/10000.0 AS DECIMAL(10,6)) END AS latitude,
 CASE WHEN id%3=0 THEN '' ELSE '24小时营业' END AS business_hours,
 CASE WHEN id%4=0 THEN '' ELSE CAST(CAST(0.5+(id%100)/100.0 AS DECIMAL(4,2)) AS STRING) END AS current_price,
 CASE WHEN id%6=0 THEN '免费' ELSE '' END AS parking_fee,
 CASE WHEN id%2=0 THEN CAST(id%8 AS STRING) ELSE '' END AS fast_available,
 CASE WHEN id%2=0 THEN '8' ELSE '' END AS fast_total,
 (id%9<>0) AS detail_verified
FROM (SELECT c_custkey+1 AS id, CAST(floor(c_custkey/3) AS BIGINT) AS k, c_custkey%3 AS m,
  CASE CAST(floor(c_custkey/3) AS BIGINT)%4 WHEN 0 THEN '特来电' WHEN 1 THEN '星星充电' WHEN 2 THEN '云快充' ELSE '' END AS operator, CAST(floor(c_custkey/3) AS BIGINT)%10 AS rid0 FROM customer) b JOIN {REGIONS} AS r(rid,city,district) ON r.rid=b.rid0
""",
    "fx_source_rows": """
SELECT o_orderkey AS pos, CASE WHEN o_custkey%17=0 THEN '' ELSE concat('P',CAST(o_custkey AS STRING)) END AS id,
 concat('甲',CAST(o_custkey AS STRING),'充电站') AS name,
 CASE WHEN o_orderkey%4=0 THEN '' ELSE concat('郑州市中原区',CAST(o_custkey AS STRING),'号') END AS address,
 CAST(CAST(34.0+(o_custkey%100)/100.0 AS DECIMAL(6,2)) AS STRING) AS latitude,
 CAST(CAST(113.0+(o_custkey%100)/100.0 AS DECIMAL(6,2)) AS STRING) AS longitude,
 CASE WHEN o_orderkey%19=0 THEN 'x' WHEN o_orderkey%23=0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS sequence
FROM orders
""",
    "fx_tasks": """
SELECT c_custkey+1 AS task_id, concat('P',CAST(c_custkey AS STRING)) AS station_id, c_custkey%50 AS source_sequence,
 CASE WHEN c_custkey%20=0 THEN 1000 ELSE 100 END AS priority,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'pending' WHEN 'MACHINERY' THEN 'leased' WHEN 'FURNITURE' THEN 'failed' ELSE 'succeeded' END AS status,
 c_custkey%4 AS attempts, 3 AS max_attempts, 1704067200.0+(c_custkey%1000) AS available_at,
 CASE WHEN c_mktsegment='MACHINERY' THEN 1704067200.0+(c_custkey%360) ELSE NULL END AS lease_expires_at,
 CAST(c_custkey%101 AS DOUBLE) AS completeness_score, (c_custkey%101>=70) AS detailed
FROM customer
""",
    "fx_attempts": """
SELECT event_id AS attempt_id, user_id AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS BIGINT) AS attempt_no,
 concat('DEV',CAST(user_id%7 AS STRING)) AS device_serial,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'retry' WHEN 'signup' THEN 'interrupted' ELSE 'running' END AS outcome, ts AS started_at
FROM events
""",
    "fx_price_periods": """
SELECT l_orderkey AS station_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice) AS BIGINT) AS pos,
 CASE WHEN l_linestatus='O' THEN 'price_detail' ELSE 'embedded_trend' END AS source,
 CASE l_partkey%6 WHEN 0 THEN '00:00-07:00' WHEN 1 THEN '07:00~16:00' WHEN 2 THEN '16:00-20:00' WHEN 3 THEN '20:00-23:00' WHEN 4 THEN '当前时段' ELSE '' END AS time,
 CASE WHEN l_suppkey%5=0 THEN '' ELSE CAST(CAST(0.4+l_quantity/100 AS DECIMAL(4,2)) AS STRING) END AS total_price,
 CASE WHEN l_linestatus='O' AND l_suppkey%3<>0 THEN CAST(CAST(l_discount+0.2 AS DECIMAL(4,2)) AS STRING) ELSE '' END AS elec_fee,
 CASE WHEN l_linestatus='O' AND l_suppkey%4<>0 THEN CAST(CAST(l_tax+0.1 AS DECIMAL(4,2)) AS STRING) ELSE '' END AS service_fee,
 CASE WHEN l_returnflag='A' THEN '最低' ELSE '' END AS tag
FROM lineitem
""",
    "fx_grids": """
SELECT g+1 AS id, city, district, g AS grid_index,
 CASE WHEN g%10=0 THEN NULL ELSE lo+side/2 END AS center_lng, CASE WHEN g%10=0 THEN NULL WHEN g%37=0 THEN la+9.0 ELSE la+side/2 END AS center_lat,
 lo AS min_lng, CASE WHEN g%41=0 THEN lo-1.0 ELSE lo+side END AS max_lng, CASE WHEN g%43=0 THEN NULL ELSE la END AS min_lat, la+side AS max_lat,
 CASE g%4 WHEN 0 THEN 'pending' WHEN 1 THEN 'scanning' WHEN 2 THEN 'done' ELSE 'failed' END AS status
FROM (SELECT p_partkey AS g, p_partkey%10 AS rid0, CASE WHEN p_partkey<800 THEN 0.2 ELSE 0.01 END AS side,
  110.4+0.2*(p_partkey%32)+0.0001*(CAST(floor(p_partkey/800) AS BIGINT)*137%1900) AS lo, 31.4+0.2*(CAST(floor(p_partkey/32) AS BIGINT)%25)+0.0001*(CAST(floor(p_partkey/800) AS BIGINT)*211%1900) AS la FROM part) b JOIN {REGIONS} AS r(rid,city,district) ON r.rid=b.rid0
""",
    "fx_trail": """
SELECT user_id AS query_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS BIGINT) AS pos,
 CASE WHEN event_id%3=0 THEN 'outside' WHEN event_type IN ('error','signup') THEN 'outside' WHEN event_type='view' THEN 'unknown' ELSE 'target' END AS district_match
FROM events
""",
    "fx_logs": """
SELECT doc_id AS id, source AS layer, text AS raw_data, (doc_id%5<>0) AS success FROM documents
""",
    "fx_cards": """
SELECT query_id, CAST(floor((rn-1)/5) AS BIGINT) AS screen, ((rn-1)%5)*200+300 AS cy, 540 AS cx,
 concat('站 ',CAST(event_id%23 AS STRING),CASE WHEN event_id%2=0 THEN '汽车充电站' ELSE '（充电站）' END) AS name
FROM (SELECT user_id AS query_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS BIGINT) AS rn FROM events) e
""",
    "fx_poi": """
SELECT concat('P',CAST(s_suppkey AS STRING)) AS station_id, s_name AS name,
 CASE WHEN s_suppkey%4=0 THEN '' ELSE concat('测试路',CAST(s_suppkey AS STRING),'号') END AS address,
 CASE WHEN s_suppkey%3=0 THEN '' ELSE '郑州市' END AS city, CASE WHEN s_suppkey%3=0 THEN '' ELSE '中原区' END AS district,
 concat(CAST(CAST(113.0+s_suppkey/1000.0 AS DECIMAL(10,6)) AS STRING),',',CAST(CAST(34.0+s_suppkey/1000.0 AS DECIMAL(10,6)) AS STRING)) AS location
FROM supplier
""",
    "fx_bad_dumps": "SELECT page_id AS dump_id, html AS xml FROM pages",
}
TABLES = "customer orders lineitem events part supplier documents pages"


def sql_of(name: str) -> str:
    return FIXTURES[name].replace("{REGIONS}", REGIONS)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture over the tables of a folder."""
    tables = "|".join(TABLES.split())
    return spark.sql(re.sub(rf"\bFROM ({tables})\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet` AS {m[1]}", sql_of(name)))


def oracle(query: str) -> str:
    """A DuckDB statement that may name fixtures as tables."""
    used = [k for k in FIXTURES if re.search(rf"\b{k}\b", query)]
    head = ", ".join(f"{k} AS ({sql_of(k)})" for k in used)
    if not head:
        return query
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.lstrip().startswith(start):
            return query.replace(start, f"{start}{head}, ", 1)
    return f"WITH {head} {query}"
