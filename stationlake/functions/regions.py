"""Cities, their districts, and finding them in addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import as_column, text

#: 18 cities and their 157 districts.
REGIONS = {
    "郑州": "中原区 二七区 管城回族区 金水区 上街区 惠济区 中牟县 巩义市 荥阳市 新密市 新郑市 登封市",
    "洛阳": "老城区 西工区 瀍河区 涧西区 偃师区 孟津区 洛龙区 新安县 栾川县 嵩县 汝阳县 宜阳县 洛宁县 伊川县",
    "开封": "龙亭区 顺河回族区 鼓楼区 禹王台区 祥符区 杞县 通许县 尉氏县 兰考县",
    "南阳": "宛城区 卧龙区 南召县 方城县 西峡县 镇平县 内乡县 淅川县 社旗县 唐河县 新野县 桐柏县 邓州市",
    "许昌": "魏都区 建安区 鄢陵县 襄城县 禹州市 长葛市",
    "平顶山": "新华区 卫东区 石龙区 湛河区 宝丰县 叶县 鲁山县 郏县 舞钢市 汝州市",
    "新乡": "红旗区 卫滨区 凤泉区 牧野区 新乡县 获嘉县 原阳县 延津县 封丘县 卫辉市 辉县市 长垣市",
    "安阳": "文峰区 北关区 殷都区 龙安区 安阳县 汤阴县 滑县 内黄县 林州市",
    "焦作": "解放区 中站区 马村区 山阳区 修武县 博爱县 武陟县 温县 沁阳市 孟州市",
    "商丘": "梁园区 睢阳区 民权县 睢县 宁陵县 柘城县 虞城县 夏邑县 永城市",
    "周口": "川汇区 淮阳区 扶沟县 西华县 商水县 沈丘县 郸城县 太康县 鹿邑县 项城市",
    "驻马店": "驿城区 西平县 上蔡县 平舆县 正阳县 确山县 泌阳县 汝南县 遂平县 新蔡县",
    "信阳": "浉河区 平桥区 罗山县 光山县 新县 商城县 固始县 潢川县 淮滨县 息县",
    "漯河": "源汇区 郾城区 召陵区 舞阳县 临颍县",
    "三门峡": "湖滨区 陕州区 渑池县 卢氏县 义马市 灵宝市",
    "鹤壁": "鹤山区 山城区 淇滨区 浚县 淇县",
    "濮阳": "华龙区 清丰县 南乐县 范县 台前县 濮阳县",
    "济源": "济源",
}
#: Areas that belong to a city and to none of its districts.
FUNCTIONAL_AREAS = "航空港区 郑东新区 高新区 高新技术产业开发区 经开区 经济技术开发区 城乡一体化示范区".split()


def regions(spark: SparkSession) -> DataFrame:
    rows = [(city, d, i) for city, names in REGIONS.items() for i, d in enumerate(names.split())]
    return spark.createDataFrame(rows, "city string, district string, ord int")


def search_plan(regions: DataFrame, keyword: str = "重卡充电站") -> DataFrame:
    """A phrase for each district, and one for each city."""
    by_district = regions.select("city", "district", F.concat("city", "district", F.lit(keyword)).alias("phrase"))
    return by_district.unionByName(regions.select("city").distinct().select("city", F.lit("全市").alias("district"), F.concat("city", F.lit(keyword)).alias("phrase")))


def classify_district(city: Column | str, district: Column | str, addresses: list, hints: list = ()) -> Column:
    """target, outside or unknown: the first address that says something decides; hints can only confirm."""
    city, district = as_column(city), as_column(district)
    siblings = F.create_map(*[x for c, names in REGIONS.items() for x in (F.lit(c), F.array(*map(F.lit, names.split())))])
    others = F.filter(F.coalesce(F.try_element_at(siblings, city), F.array().cast("array<string>")), lambda d: d != district)
    cities = F.array(*map(F.lit, REGIONS))
    marker = F.concat(city, F.lit("市"))

    def verdict(address):
        a = text(address)
        behind = F.substr(a, F.instr(a, marker) + F.length(marker))
        area = F.exists(F.array(*map(F.lit, FUNCTIONAL_AREAS)), lambda f: F.startswith(behind, f))
        return (
            F.when(a == "", None)
            .when(F.contains(a, district), "target")
            .when(F.exists(others, lambda d: F.contains(a, d)), "outside")
            .when(F.exists(cities, lambda c: (c != city) & F.contains(a, F.concat(c, F.lit("市")))), "outside")
            .when(F.contains(a, marker) & area, "outside")
        )

    confirmed = [F.when(F.contains(F.coalesce(as_column(h), F.lit("")), district), "target") for h in hints]
    return F.coalesce(*map(verdict, addresses), *confirmed, F.lit("unknown"))


def district_aliases() -> tuple[dict[str, tuple[str, str]], dict[str, str]]:
    """What stands for a district: {name or short name: (district, city label)}, and {city: label}."""
    aliases, labels = {}, {c: f"{c}市" for c in REGIONS}
    for c, names in REGIONS.items():
        for d in names.split():
            if d != c:
                aliases[d] = (d, labels[c])
    for d, found in list(aliases.items()):
        short = d[:-1] if d[-1] in "区县市" else d
        if len(short) >= 2 and short not in labels:
            aliases.setdefault(short, found)
    return aliases, labels


def parse_region(*parts: Column | str) -> Column:
    """struct(city, district): the district named first in the joined texts decides, else the city named first."""
    joined = F.array_join(F.filter(F.array(*map(text, parts)), lambda t: t != ""), " ")
    aliases, labels = district_aliases()

    def found(whole):
        """The district with the smallest (place, -length, names), and else the city."""
        table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(-len(a)).alias("n"), F.lit(d).alias("x"), F.lit(c).alias("y")) for a, (d, c) in aliases.items()])
        near = F.filter(table, lambda r: F.contains(whole, r["a"]))
        district = F.array_min(F.transform(near, lambda r: F.struct(F.instr(whole, r["a"]).alias("at"), r["n"].alias("n"), r["x"].alias("x"), r["y"].alias("y"))))
        hit = lambda name, label: F.struct(F.instr(whole, F.lit(name)).alias("at"), F.lit(-len(name)).alias("n"), F.lit(label).alias("x"))
        cities = [F.when(F.contains(whole, F.lit(label)), hit(label, label)).when(F.contains(whole, F.lit(c)), hit(c, label)) for c, label in labels.items()]
        city = F.array_min(F.array_compact(F.array(*cities)))["x"]
        return F.struct(F.coalesce(district["y"], city, F.lit("")).alias("city"), F.coalesce(district["x"], F.lit("")).alias("district"))

    return F.get(F.transform(F.array(joined), found), F.lit(0))  # the joined text is made once
