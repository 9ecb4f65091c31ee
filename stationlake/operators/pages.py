"""Page dumps: XML to nodes, and what kind of page, which fields and prices, which cards and price entry they hold.

A parsed page is one row with an ordered array of nodes, so every rule below is a Column expression over that array:
no rule shuffles, and a page's size bounds what a row holds.
"""

from __future__ import annotations

import re
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_name
from ..functions.regions import REGIONS
from .prices import FIELDS, fold_price_periods

NODE = "struct<pos:int, end_pos:int, depth:int, tag:string, text:string, desc:string, clickable:boolean, x1:int, y1:int, x2:int, y2:int>"
BOUNDS = re.compile(r"\[(\d+),(\d+)\]\[(\d+),(\d+)\]")
# What pages show.
RANGE = r"\d{2}:\d{2}[-~]\d{2}:\d{2}"
PRICE_CHANGE = r"\d{2}:\d{2}起[涨降]至"
POPUP = "仅在使用中允许 使用应用时允许 始终允许 暂不更新 以后再说 我知道了".split()
STATION_WORDS = "充电站 充换电站 超充站 快充站 重卡站 充电场 充电中心".split()
TAGS = "优选电站 刚刚浏览 新站 热门".split()
FACILITIES = "地上 地面 地下 卫生间 休息室 便利店 重卡车位 桩多 免费停车 WIFI 无障碍".split()
OPERATORS = "特来电 新电途 星星充电 国家电网 南方电网 依威能源 云快充 万马爱充 小桔充电 快电 蔚来".split()
ADDRESS_WORDS = "省 市 县 区 镇 乡 村 路 街 道 号 高速".split()
NO_ADDRESS = "通知 K/s 正在充电 WLAN 已选中 未选中 信号".split()
TREND = "24小时价格趋势图"
LAYOUT_WORDS = {
    "has_equipment": ["空闲", "空"], "has_price_trend": [TREND], "has_price_click": ["电价详情", "价格详情"], "has_parking": ["停车费", "停车免费"],
    "has_occupancy": ["占位费"], "has_business_hours": ["营业时间"], "has_facilities": ["卫生间", "休息室", "便利店", "重卡车位"], "has_price_section": ["/度", "￥"],
}


SLICE = 500
ROOT = "hierarchy"  # of a page
# Where a node lies in its page, what it says, and where it lies on the screen.
PLACE, SAID, BOX = ("pos", "end_pos", "depth"), ("tag", "text", "desc"), ("x1", "y1", "x2", "y2")
PARTS_OF_NODE = {**dict.fromkeys(PLACE, pa.int32()), **dict.fromkeys(SAID, pa.string()), "clickable": pa.bool_(), **dict.fromkeys(BOX, pa.int32())}
# What assess_pages() and extract_detail() ask of a node.
JUDGED, WORDS = (*SAID, "clickable"), ("text", "desc")


@lru_cache(10_000)
def _box_of(bounds: str) -> tuple:
    found = BOUNDS.match(bounds)
    return tuple(map(int, found.groups())) if found and all(len(b) < 10 for b in found.groups()) else (None,) * 4


def _fault(xml: str) -> str | None:
    """Why xml is no page; entities that only a document type left unread would tell of are faults too."""
    try:
        ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return str(e)
    return None


def _stands_alone(xml: str | None) -> bool:
    """Whether xml, well-formed or not, can't be mistaken for another page's part: it begins and ends with the only tags of
    its root, and has no comments, sections, declarations, instructions and namespaces. So if many such pages together are
    well-formed, each one is."""
    return (
        xml is not None and xml.startswith((f"<{ROOT}>", f"<{ROOT} ")) and xml.endswith(f"</{ROOT}>") and xml.count(f"<{ROOT}") == 1 and xml.count(f"</{ROOT}") == 1
        and "<!" not in xml and "<?" not in xml and "xmlns" not in xml
    )


def _parsed(pages: pa.Array, fallback: bool, parts: tuple[str, ...]) -> pa.Array:
    """struct(nodes, error) of each page, nodes in page order; what a node is made of is held as one list for all pages.

    end_pos is the last position inside a node, so a.pos < n.pos <= a.end_pos finds ancestors.
    """
    tags, given, ends, depths, inside, errors, offsets = [], [], [], [], [], [], [0]
    placed = "end_pos" in parts or "depth" in parts

    def start(tag: str, attributes: dict[str, str]) -> None:
        tags.append(tag)
        given.append(attributes)

    def start_placed(tag: str, attributes: dict[str, str]) -> None:
        start(tag, attributes)
        depths.append(len(inside))
        inside.append(len(ends))
        ends.append(0)

    def end(tag: str) -> None:
        ends[inside.pop()] = len(ends) - 1

    def read(xml: str) -> None:
        parser = expat.ParserCreate(None, "}")
        parser.StartElementHandler = start_placed if placed else start
        if placed:
            parser.EndElementHandler = end
        parser.Parse(xml, True)

    def forget(n: int) -> None:
        for many in (tags, given, ends, depths):
            del many[n:]
        inside.clear()

    def read_together(pages: list[str | None]) -> bool:
        """Most of a small page's time goes to its parser, so pages that are surely apart are read by one."""
        if not all(map(_stands_alone, pages)):
            return False
        try:
            read(f"<all>{''.join(pages)}</all>")
        except expat.ExpatError:
            forget(0)
            return False
        del tags[0], given[0]
        if placed:
            del ends[0], depths[0]
            ends[:], depths[:] = [e - 1 for e in ends], [d - 1 for d in depths]
        offsets[:] = [i for i, tag in enumerate(tags) if tag == ROOT] + [len(tags)]
        errors.extend([None] * len(pages))
        return True

    def read_alone(xml: str) -> None:
        error = None
        try:
            error = _fault(xml) if "<!DOCTYPE" in xml else None
            if error is None:
                read(xml)
        except expat.ExpatError as e:
            error = str(e)
        if error is not None:
            forget(offsets[-1])
            for t in re.findall(r'text="([^"]*)"', xml) if fallback else ():
                start("node", {"text": t})
                depths.append(1)
                ends.append(len(ends))
        errors.append(error)
        offsets.append(len(tags))

    some = pages.to_pylist()
    if not read_together(some):
        for xml in some:
            read_alone(xml or "")
    first = np.repeat(offsets[:-1], np.diff(offsets))
    made = {
        "pos": lambda: np.arange(len(tags)) - first, "end_pos": lambda: np.array(ends, int) - first, "depth": lambda: depths, "tag": lambda: ["{" + t if "}" in t else t for t in tags],
        "text": lambda: [g.get("text", "").strip() for g in given], "desc": lambda: [g.get("content-desc", "").strip() for g in given], "clickable": lambda: [g.get("clickable") == "true" for g in given],
    }
    boxes = list(zip(*[_box_of(g.get("bounds", "")) for g in given], strict=True)) if set(BOX) & set(parts) else []
    made |= {c: lambda i=i: boxes[i] if boxes else () for i, c in enumerate(BOX)}
    nodes = pa.StructArray.from_arrays([pa.array(made[c](), PARTS_OF_NODE[c]) for c in parts], names=list(parts))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes), pa.array(errors, pa.string())], names=["nodes", "error"])


def parse_dumps(dumps: DataFrame, on_malformed: str = "none", parts: tuple[str, ...] = tuple(PARTS_OF_NODE)) -> DataFrame:
    """dumps with nodes and error in the place of nothing: xml stays.

    A page that is no XML (null and empty ones too) gets its error, and no nodes; with on_malformed="texts", a node for
    each text="..." in it. parts names what rules ask of a node; the rest isn't made. Python holds the nodes of SLICE pages
    at a time; what it returns is columns. The parser is declared non-deterministic, so that no filter on what it finds has
    pages parsed twice, once before they are dealt out.
    """
    fallback = on_malformed == "texts"
    parts = tuple(c for c in PARTS_OF_NODE if c in parts)

    def parse(xml: pa.Array) -> pa.Array:
        return pa.concat_arrays([_parsed(xml.slice(i, SLICE), fallback, parts) for i in range(0, max(1, len(xml)), SLICE)])

    node = ", ".join(f for f in NODE[len("struct<") : -1].split(", ") if f.split(":")[0] in parts)
    parser = F.arrow_udf(parse, f"struct<nodes:array<struct<{node}>>, error:string>").asNondeterministic()
    return dumps.withColumn("_p", parser("xml")).select("*", "_p.nodes", "_p.error").drop("_p")


def explode_nodes(dumps: DataFrame, on_malformed: str = "none", parts: tuple[str, ...] = tuple(PARTS_OF_NODE)) -> DataFrame:
    """One row for each node; a page without nodes keeps one row with its error."""
    rest = [c for c in dumps.columns if c != "xml"]
    return parse_dumps(dumps, on_malformed, parts).select(*rest, "error", F.explode_outer("nodes").alias("n")).select(*rest, "n.*", "error")


def once(value: Column, use) -> Column:
    """use(value) with value computed a single time.

    An expression that a lambda names is computed again for each element, and the optimizer puts a column's expression in
    the place of its name when it moves a filter; a lambda's own argument stays a value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def page_texts(nodes: Column) -> Column:
    return F.filter(F.transform(nodes, lambda n: n["text"]), lambda t: t != "")


def neighbours(texts: Column, ahead: int = 5) -> Column:
    """Each text with the one before it and the next ones: struct(i, prev, text, next1 ...)."""
    around = lambda s: F.transform(s, lambda t, i: F.struct(i.alias("i"), F.get(s, i - 1).alias("prev"), t.alias("text"), *[F.get(s, i + k).alias(f"next{k}") for k in range(1, ahead + 1)]))
    return once(texts, around)


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _first(items: Column, rule) -> Column:
    return F.get(F.filter(items, rule), F.lit(0))


def assess_pages(parsed: DataFrame, expected: str | None = None) -> DataFrame:
    """parsed with kind, confidence, reasons and expected_visible; expected names the column of the station looked for."""
    tagged = F.filter("nodes", lambda n: n["tag"] == "node")
    rows = parsed.withColumn("_texts", page_texts(tagged)).withColumn("_descs", F.filter(F.transform(tagged, lambda n: n["desc"]), lambda d: d != ""))
    rows = rows.withColumn("_values", F.concat("_texts", "_descs")).withColumn("_all", F.array_join("_values", "\n"))
    rows = rows.withColumn("_cards", F.size(F.filter(tagged, lambda n: n["clickable"] & F.contains(n["desc"], F.lit("充电")) & ~F.startswith(n["desc"], F.lit("搜索框")))))
    visible = F.lit(False)
    if expected:
        name = normalize_name(expected)
        rows = rows.withColumn("_name", name).withColumn("_names", F.filter(F.transform("_values", normalize_name), lambda v: F.length(v) >= 4))
        visible = (F.col("_name") != "") & F.exists("_names", lambda v: F.contains(v, F.col("_name")) | F.contains(F.col("_name"), v))
    rows = rows.withColumn("expected_visible", visible)
    has = lambda *words: _any(F.col("_all"), list(words))
    shown = lambda *texts: F.array_size(F.array_except(F.array(*map(F.lit, texts)), F.col("_texts"))) == 0
    around, seen, cards = has("在此区域搜索"), F.col("expected_visible"), F.col("_cards")
    periods = F.size(F.regexp_extract_all("_all", F.lit(RANGE), 0))
    title, fees = has("充电价格详情", "电价详情", "价格详情"), has("参考价") & has("电费", "服务费")
    # What speaks for a detail page, in the order of its reasons: (weight, reason or none, condition).
    signs = [
        (5, "station_info_section", has("电站信息")), (2, "business_hours", has("营业时间")), (2, "business_status", has("24小时营业", "营业中")), (2, "price_trend", has(TREND)),
        (1, "scan_action", has("扫码")), (2, "map_phone_actions", shown("地图", "电话")), (1, "map_action", shown("地图") & ~shown("电话")), (1, "navigation_actions", shown("导航", "路线")),
    ]
    late = [(2, "driving_summary", F.exists("_values", lambda v: F.contains(v, F.lit("驾车")) & F.contains(v, F.lit("公里")))), (1, "expected_station_visible", seen)]
    compact = seen & shown("详情", "地图", "导航", "路线")
    detail = sum((F.when(c, w).otherwise(0) for w, _, c in signs + late), F.lit(0))
    search = F.when(around, 5).otherwise(0) + F.when(cards >= 2, 5).when(cards == 1, 1).otherwise(0)
    summary = has("展开列表") & has("暂无更多内容") & ~around & (cards <= 1)
    summary = summary & (has("刚刚浏览", "停车费") | F.col("_all").rlike(r"\d+人浏览") | F.exists("_values", lambda v: F.contains(v, F.lit("充电")) & ~F.startswith(v, F.lit("搜索框"))))
    home = F.contains(F.coalesce("xml", F.lit("")), F.lit("maphome_searchbar_bg")) & F.col("error").isNull() | shown("首页", "打车", "我的")
    named = lambda pairs: [F.when(c, F.lit(r)) for _, r, c in pairs]
    early = named(signs)
    full = [*early, *named(late), F.when(around, F.lit("search_area_action")), F.when(cards >= 2, F.lit("multiple_search_cards")).when(cards == 1, F.lit("search_cards:1"))]
    texts = lambda *parts: F.array_compact(F.array(*parts))
    verdict = lambda kind, confidence, reasons: F.struct(F.lit(kind).alias("kind"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), reasons.alias("reasons"))
    found = (
        F.when(has(*POPUP), verdict("popup", 0.9, texts(F.lit("popup_keyword"))))
        .when(fees & ((periods >= 2) | title & (periods >= 1)), verdict("price_detail", 0.98, texts(F.lit("multiple_time_periods"), F.lit("fee_breakdown"))))
        .when(compact, verdict("detail", 0.93, texts(*early, F.lit("compact_detail_actions"))))
        .when(summary, verdict("detail", 0.92, texts(*full, F.lit("poi_summary_card"))))
        .when((detail >= 5) & ~around, verdict("detail", F.least(F.lit(0.99), 0.72 + 0.035 * detail), texts(*full)))
        .when(search >= 5, verdict("search_results", F.least(F.lit(0.99), 0.75 + 0.025 * search), texts(*full)))
        .when(home, verdict("home", 0.9, texts(*full, F.lit("home_navigation"))))
        .otherwise(verdict("unknown", 0.2, texts(*full)))
    )
    return rows.withColumn("_v", found).select(*parsed.columns, "_v.kind", "_v.confidence", "_v.reasons", "expected_visible")


def _box(n: Column) -> list[Column]:
    return [n[c].alias(c) for c in ("x1", "y1", "x2", "y2")]


def _area(n: Column) -> Column:
    return (n["x2"] - n["x1"]).cast("long") * (n["y2"] - n["y1"])


def _value(n: Column) -> Column:
    return F.when(n["text"] != "", n["text"]).otherwise(n["desc"])


def price_entry(nodes: Column) -> Column:
    """struct(marker, x1, y1, x2, y2, cx, cy) of the place that opens the price page, null without one."""
    pressable = lambda nodes: F.filter(nodes, lambda n: n["clickable"] & n["x1"].isNotNull())
    return once(F.filter(nodes, lambda n: n["tag"] == "node"), lambda nodes: once(pressable(nodes), lambda some: _entry(nodes, some)))


def _entry(nodes: Column, pressable: Column) -> Column:
    above = lambda n: F.filter(pressable, lambda a: (a["pos"] < n["pos"]) & (n["pos"] <= a["end_pos"]))
    ranked = lambda a: F.struct(_area(a).alias("area"), (-a["pos"]).alias("far"), *_box(a))
    smallest = lambda many: F.array_min(F.transform(many, ranked))
    block = lambda n: once(above(n), lambda many: F.coalesce(smallest(F.filter(many, lambda a: (a["x2"] - a["x1"] >= 400) & (a["y2"] - a["y1"] >= 120))), smallest(many)))
    own = lambda n: F.coalesce(smallest(above(n)), F.when(n["x1"].isNotNull(), ranked(n)))
    spot = lambda rule, place: F.get(F.filter(F.transform(F.filter(nodes, rule), place), lambda b: b.isNotNull()), F.lit(0))

    def is_card(c):
        values = F.filter(F.transform(F.filter(nodes, lambda n: (c["pos"] <= n["pos"]) & (n["pos"] <= c["end_pos"])), _value), lambda v: v != "")
        wide, high = c["x2"] - c["x1"], c["y2"] - c["y1"]
        opens = lambda v: F.array_contains(v, "查看") | F.array_join(v, "\n").rlike(PRICE_CHANGE)
        return once(values, lambda v: F.array_contains(v, "/度") & opens(v)) & (high <= F.greatest(F.lit(520), F.floor(wide * 0.7)))

    changes, titled = (lambda n: _value(n).rlike(PRICE_CHANGE)), (lambda n: _value(n).isin("电价详情", "价格详情", "充电价格详情"))
    card = F.array_min(F.transform(F.filter(pressable, is_card), lambda a: F.struct(_area(a).alias("area"), a["pos"].alias("far"), *_box(a))))
    hinted = F.exists(nodes, lambda n: changes(n) | titled(n))
    ways = [("price_trend", spot(lambda n: F.contains(_value(n), F.lit(TREND)), block)), ("price_card", card), ("price_change", spot(changes, own)), ("price_detail", spot(titled, own)), ("price_unit", F.when(hinted, spot(lambda n: _value(n) == "/度", own)))]
    marked = lambda m: lambda b: F.when(b.isNotNull(), F.struct(F.lit(m).alias("marker"), *_box(b), F.floor((b["x1"] + b["x2"]) / 2).cast("int").alias("cx"), F.floor((b["y1"] + b["y2"]) / 2).cast("int").alias("cy")))
    return F.coalesce(*[once(b, marked(m)) for m, b in ways])


def classify_layout(parsed: DataFrame) -> DataFrame:
    """parsed with layout, scrolls_needed and the features that decide; words count anywhere in the raw XML."""
    xml = F.coalesce("xml", F.lit(""))
    flags = {name: _any(xml, words) for name, words in LAYOUT_WORDS.items()}
    flags["has_price_click"] = flags["has_price_click"] | xml.rlike(PRICE_CHANGE)
    flags["has_price_detail_entry"] = price_entry(F.col("nodes")).isNotNull()
    out = parsed.withColumn("features", F.struct(*[c.alias(k) for k, c in flags.items()]))
    f = lambda *names: F.greatest(*[F.col(f"features.{n}") for n in names], F.lit(False))
    layout = F.when(f("has_price_trend"), "full_trend").when(f("has_price_click", "has_price_detail_entry"), "click_to_expand").when(f("has_equipment", "has_parking", "has_occupancy"), "standard").otherwise("basic")
    out = out.withColumn("layout", layout)
    return out.withColumn("scrolls_needed", F.when(F.col("layout") == "full_trend", 2).when(F.col("layout") == "basic", 0).otherwise(1))


def equipment(around: Column) -> Column:
    """struct of free, total and power of super, fast and slow guns; a page's last mention of a kind counts."""
    hits = F.filter(around, lambda a: a["text"].isin("空闲", "空") & (a["i"] > 0) & a["next2"].isNotNull())
    last = lambda many, label, earlier: F.try_element_at(F.filter(many, lambda a: F.contains(a["prev"], F.lit(label)) & ~_any(a["prev"], earlier)), F.lit(-1))
    power = lambda hit: F.coalesce(*[F.when(F.contains(hit[f"next{k}"], F.lit("kW")), hit[f"next{k}"]) for k in (3, 4, 5)], F.lit(""))
    facts = lambda kind, hit: (F.coalesce(hit["next1"], F.lit("")).alias(f"{kind}_available"), F.coalesce(F.replace(hit["next2"], F.lit("/")), F.lit("")).alias(f"{kind}_total"), power(hit).alias(f"{kind}_power"))
    kinds = {"super": ("超充", []), "fast": ("快充", ["超充"]), "slow": ("慢充", ["超充", "快充"])}
    ends = once(hits, lambda many: F.struct(*[last(many, *words).alias(kind) for kind, words in kinds.items()]))
    return once(ends, lambda e: F.struct(*[c for kind in kinds for c in facts(kind, e[kind])]))


def equipment_facts(around: Column) -> dict[str, Column]:
    """The fields of equipment() as columns of their own."""
    facts = equipment(around)
    return {f"{kind}_{c}": facts[f"{kind}_{c}"] for kind in ("super", "fast", "slow") for c in ("available", "total", "power")}


def trend_periods(texts: Column, around: Column) -> tuple[Column, Column]:
    """(fast, slow) periods of the price trend inside a detail page; halves, where the page has both headings."""
    timed = lambda t: F.when((F.contains(t, F.lit("-")) & F.contains(t, F.lit(":"))) | (t == "当前时段"), t)
    shown = F.when(F.array_contains(texts, TREND), around).otherwise(F.slice(around, 1, 0))
    prices = F.filter(shown, lambda a: F.startswith(a["text"], F.lit("￥")) & F.endswith(a["text"], F.lit("/度")))
    blank = F.lit("")

    def period(a):
        named = dict.fromkeys(FIELDS, blank) | {"source": F.lit("embedded_trend"), "total_price": F.replace(F.replace(a["text"], F.lit("￥")), F.lit("/度"))}
        named["time"] = F.replace(F.coalesce(*[timed(a[c]) for c in ("text", "next1", "next2", "next3")], blank), F.lit("~"), F.lit("-"))
        return F.struct(*[named[c].alias(c) for c in FIELDS])

    both = F.array_contains(texts, "快充价格") & F.array_contains(texts, "慢充价格")
    found = F.transform(prices, period)
    half = lambda f: F.floor(F.size(f) / 2).cast("int")
    fast = once(found, lambda f: F.when(both, F.slice(f, F.lit(1), half(f))).otherwise(f))
    return fast, once(found, lambda f: F.when(both, F.slice(f, half(f) + 1, F.size(f))).otherwise(F.slice(f, 1, 0)))


def extract_detail(parsed: DataFrame) -> DataFrame:
    """A detail page's fields beside the columns of parsed other than xml and nodes; what a page lacks is '' or []."""
    rest = [c for c in parsed.columns if c not in ("xml", "nodes")]
    rows = parsed.withColumn("_texts", page_texts(F.col("nodes"))).withColumn("_near", neighbours(F.col("_texts"))).withColumn("_guns", equipment(F.col("_near")))
    texts, near = F.col("_texts"), F.col("_near")
    known = lambda words: F.array(*map(F.lit, words))
    has = lambda t, *words: _any(t, list(words))
    name = _first(F.transform("nodes", lambda n: n["desc"]), lambda d: has(d, *STATION_WORDS))
    facilities = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.filter(known(FACILITIES), lambda w: F.contains(t, w)))))
    hours = _first(F.transform(near, lambda a: F.when((a["text"] == "营业时间") & a["next1"].isNotNull(), a["next1"])
        .when(has(a["text"], "暂无营业时间"), "暂无营业时间").when(has(a["text"], "24小时营业"), a["text"])
        .when(has(a["text"], "营业中") & F.coalesce(has(a["next1"], "小时营业"), F.lit(False)), a["next1"]).when(has(a["text"], "营业中"), a["text"])), lambda t: t.isNotNull())
    last = lambda rule: F.try_element_at(F.filter(texts, rule), F.lit(-1))
    minutes = last(lambda t: has(t, "分钟") & (F.length(t) <= 5) & F.trim(F.replace(t, F.lit("分钟"))).rlike(r"^[+-]?\d+$"))
    address = _first(texts, lambda t: (F.length(t) >= 6) & has(t, *ADDRESS_WORDS) & ~F.startswith(t, F.lit("停车费")) & ~F.startswith(t, F.lit("占位费")) & ~has(t, *NO_ADDRESS))
    # The first part that is no facility begins the address.
    begins = lambda parts: F.get(F.filter(F.transform(parts, lambda p, i: F.when(~F.array_contains(known(FACILITIES), p), i)), lambda i: i.isNotNull()), F.lit(0))
    cut = lambda address, parts: once(begins(parts), lambda b: F.when(b.isNotNull(), F.array_join(F.slice(parts, b + 1, F.size(parts)), " | ")).otherwise(address))
    clean = once(address, lambda a: once(F.filter(F.transform(F.split(a, r"[|｜]"), F.trim), lambda p: p != ""), lambda parts: cut(a, parts)))
    operator = F.coalesce(_first(texts, lambda t: F.array_contains(known(OPERATORS), t)), once(name, lambda n: _first(known(OPERATORS), lambda o: F.contains(n, o))))
    price = _first(near, lambda a: (a["text"] == "/度") & (a["i"] > 0) & F.replace(F.replace(a["prev"], F.lit(".")), F.lit("￥")).rlike(r"^\d+$"))["prev"]
    bare = lambda t: F.regexp_replace(t, "^[：:]+", "")
    behind = lambda t: F.substr(t, F.instr(t, "停车费") + 3)
    fee = lambda p: F.when(F.startswith(p, F.lit("停车费 ")), bare(F.substr(p, F.lit(5)))).when(F.startswith(p, F.lit("停车费")), bare(F.substr(p, F.lit(4)))).when(has(p, "停车免费"), "免费").otherwise(F.trim(bare(behind(p))))
    parking = once(_first(texts, lambda t: has(t, "停车费", "停车免费")), fee)
    before = lambda label: _first(near, lambda a: (a["text"] == label) & (a["i"] > 0) & a["prev"].rlike(r"^\d+$"))["prev"]
    fast, slow = trend_periods(texts, near)
    fields = {
        "station_name": name, "category": F.when(F.array_contains(texts, "充电站"), "充电站"), "business_hours": hours, "distance": last(lambda t: has(t, "驾车") & has(t, "公里")), "duration": minutes,
        "address": clean, "operator": operator, "current_price": price, "parking_fee": parking, "occupancy_fee": _first(texts, lambda t: has(t, "占位费")), "favorite_count": before("分享"), "view_count": before("浏览"),
        "price_trend_title": F.when(F.array_contains(texts, TREND), TREND),
    }
    filled = {k: F.coalesce(c, F.lit("")) for k, c in fields.items()}
    lists = {"tags": F.array_distinct(F.filter(texts, lambda t: t.isin(*TAGS))), "facilities": facilities, "fast_prices": fast, "slow_prices": slow}
    return rows.select(*rest, *[c.alias(k) for k, c in filled.items()], "_guns.*", *[c.alias(k) for k, c in lists.items()])


TOKEN = ("time", "tag", "total", "elec", "service", "label", "whole", "fraction", "decimal")


def _tokens(texts: Column) -> Column:
    """What each text of a price page says: a clock range, fees beside their labels, a label alone, or part of a number.

    Each part is found in all texts before the next one, and the parts, in TOKEN's order, are zipped: structs made text by
    text cost more than the patterns.
    """
    beside = lambda t, label: F.regexp_extract(t, rf"{label}\s*[:：]?\s*[￥¥]?\s*(\d+(?:\.\d+)?)", 1)
    spoken = lambda t: F.when(F.contains(t, F.lit("参考价")), "total").when(F.contains(t, F.lit("电费")), "elec").when(F.contains(t, F.lit("服务费")), "service").otherwise("")
    # Only a text that holds what a pattern begins with is searched by it.
    fee = lambda label: lambda t: F.when(F.contains(t, F.lit(label)), beside(t, label)).otherwise("")
    time = lambda t: F.when(F.contains(t, F.lit(":")), F.replace(F.regexp_extract(t, RANGE, 0), F.lit("~"), F.lit("-"))).otherwise("")
    tag = lambda t: F.when(F.contains(t, F.lit("当前计费时段")), "当前计费时段").when(F.contains(t, F.lit("最低")), "最低").otherwise("")
    # A text with a label is no bare number.
    number = lambda t: F.when(spoken(t) == "", F.trim(F.regexp_replace(t, "[￥¥元]|/度", ""))).otherwise("")
    like = lambda pattern: lambda n: F.when(n != "", F.regexp_extract(n, pattern, 0)).otherwise("")
    said = [F.transform(texts, part) for part in (time, tag, fee("参考价"), fee("电费"), fee("服务费"), spoken)]
    return once(F.transform(texts, number), lambda numbers: F.arrays_zip(*said, *[F.transform(numbers, like(pattern)) for pattern in (r"^\d{1,2}$", r"^\.\d+$", r"^\d+\.\d+$")]))


STATE = "struct<time:string, total:string, elec:string, service:string, tag:string, label:string, whole:string, done:array<struct<time:string, total:string, elec:string, service:string, tag:string>>>"
PARTS = ("time", "total", "elec", "service", "tag")


def price_page_periods(nodes: Column) -> Column:
    """The periods of a price page in its order; times may repeat.

    A clock range opens a period. Fees stand beside their labels, or in the next texts, whole and fraction apart. A
    period without any fee goes.
    """
    # A node's description counts beside its text, unless it is the same.
    texts = F.filter(F.flatten(F.transform(F.filter(nodes, lambda n: n["tag"] == "node"), lambda n: F.when(n["desc"].isin("", n["text"]), F.array(n["text"])).otherwise(F.array(n["text"], n["desc"])))), lambda t: t != "")
    empty = F.from_json(F.lit('{"time":"","total":"","elec":"","service":"","tag":"","label":"","whole":"","done":[]}'), STATE)

    def closed(s):
        worth = (s["time"] != "") & (F.concat(s["total"], s["elec"], s["service"]) != "")
        return F.when(worth, F.concat(s["done"], F.array(F.struct(*[s[p].alias(p) for p in PARTS])))).otherwise(s["done"])

    def step(s, token):
        t = {c: token[str(i)] for i, c in enumerate(TOKEN)}
        opens = (t["time"] != "") & (t["time"] != s["time"])
        fresh = lambda c: F.when(opens, F.lit("")).otherwise(s[c])
        label, whole = (F.when(t["time"] != "", F.lit("")).otherwise(s[c]) for c in ("label", "whole"))
        inside = (t["time"] != "") | (s["time"] != "")
        beside = (t["total"] != "") | (t["elec"] != "") | (t["service"] != "")
        names = (t["label"] != "") & ~beside & (t["whole"] == "")
        valued = (t["label"] == "") & ((t["fraction"] != "") | (t["decimal"] != "")) & ~beside & (t["whole"] == "")
        value = F.when(t["fraction"] != "", F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), t["fraction"])).otherwise(t["decimal"])
        fee = lambda c: F.when(t[c] != "", t[c]).when(valued & (label == c), value).otherwise(fresh(c))
        out = {
            "time": F.when(opens, t["time"]).otherwise(s["time"]), "total": fee("total"), "elec": fee("elec"), "service": fee("service"), "tag": F.when(t["tag"] != "", t["tag"]).otherwise(fresh("tag")),
            "label": F.when(beside | valued, F.lit("")).when(names, t["label"]).otherwise(label), "whole": F.when(beside | names | (valued & (t["fraction"] != "")), F.lit("")).when(t["whole"] != "", t["whole"]).otherwise(whole),
            "done": F.when(opens, closed(s)).otherwise(s["done"]),
        }
        return F.when(inside, F.struct(*[c.alias(k) for k, c in out.items()])).otherwise(s)

    named = dict(zip(("time", "total_price", "elec_fee", "service_fee", "tag"), PARTS, strict=True))
    folded = F.aggregate(once(texts, _tokens), empty, step, closed)
    return F.transform(folded, lambda p: F.struct(*[(p[named[c]] if c in named else F.lit("price_detail")).alias(c) for c in FIELDS]))


def extract_price_detail(dumps: DataFrame, keys: list[str]) -> DataFrame:
    """Period rows of price pages, one for each time; malformed pages are read by their text="..." attributes."""
    pages = parse_dumps(dumps, "texts", SAID).select(*keys, F.posexplode(price_page_periods(F.col("nodes"))).alias("pos", "p"))
    return fold_price_periods(pages.select(*keys, "pos", "p.*").na.drop(subset=keys), keys)


def search_cards(parsed: DataFrame) -> DataFrame:
    """The station cards of search pages in the order of the screen: name, address, centre and bounds."""
    rest = [c for c in parsed.columns if c not in ("xml", "nodes", "error")]
    places = "|".join([d for names in REGIONS.values() for d in names.split()] + [f"{c}市" for c in REGIONS])
    nodes = F.filter("nodes", lambda n: n["tag"] == "node")
    shown = lambda nodes: F.filter(nodes, lambda n: n["clickable"] & n["x1"].isNotNull() & F.contains(n["desc"], F.lit("充电")) & ~F.startswith(n["desc"], F.lit("搜索框")))

    def card(nodes, c):
        inner = F.transform(F.filter(nodes, lambda n: (c["pos"] <= n["pos"]) & (n["pos"] <= c["end_pos"]) & (n["text"] != "")), lambda n: n["text"])
        address = _first(inner, lambda t: ~t.rlike("[<>]") & ~F.contains(c["desc"], t) & t.rlike(places))
        middle = lambda a, b: F.floor((c[a] + c[b]) / 2).cast("int")
        return F.struct(middle("y1", "y2").alias("cy"), middle("x1", "x2").alias("cx"), c["pos"].alias("pos"), c["desc"].alias("name"), F.coalesce(address, F.lit("")).alias("address"), *_box(c))

    cards = once(nodes, lambda nodes: F.array_sort(F.transform(shown(nodes), lambda c: card(nodes, c))))
    return parsed.select(*rest, F.explode(cards).alias("c")).select(*rest, "c.*").drop("pos")


def merge_dumps(fields: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One record for each station from the pages of its scroll: a field's first filled value counts, name and address
    come from the first page alone, tags and facilities are united in order, periods fold by time."""
    lists, periods = ("tags", "facilities"), ("fast_prices", "slow_prices")
    texts = [f.name for f in fields.schema.fields if f.name not in (key, seq, "error", *lists, *periods)]
    first = {c: F.min_by(c, seq) for c in ("station_name", "address")}
    filled = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col(seq))), F.lit(""))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(seq, c))), lambda s: s[c])
    out = fields.groupBy(key).agg(*[first.get(c, filled(c)).alias(c) for c in texts], *[F.array_distinct(F.flatten(ordered(c))).alias(c) for c in lists], *[fold_periods(F.flatten(ordered(c))).alias(c) for c in periods])
    return out


def fold_periods(periods: Column) -> Column:
    """Periods of one source with those of one time folded into the first; rows without a time stay apart."""

    def pick(a, same, c):
        return F.coalesce(F.get(F.filter(F.transform(same, lambda p: p[c]), lambda v: v != ""), F.lit(0)), a["p"][c])

    def folded(placed, a):
        same = F.transform(F.filter(placed, lambda b: (b["p"]["time"] == a["p"]["time"]) & (a["p"]["time"] != "")), lambda b: b["p"])
        return once(same, lambda same: F.struct(*[(a["p"][c] if c in ("time", "source") else pick(a, same, c)).alias(c) for c in FIELDS]))

    def leads(placed):
        return F.filter(placed, lambda a: (a["p"]["time"] == "") | ~F.exists(placed, lambda b: (b["i"] < a["i"]) & (b["p"]["time"] == a["p"]["time"])))

    placed = F.transform(periods, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    return once(placed, lambda placed: F.transform(leads(placed), lambda a: folded(placed, a)))


def assemble_stations(merged: DataFrame, price_periods: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """merged records with the periods of their price pages, and where their name, address and schedule come from.

    given (key, name, address, opened_by_poi, expected_visible) says what was looked for. Price pages come first; trend
    periods fill in by time, those without a clock range only where there is no price page.
    """
    pages = price_periods.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *FIELDS))), lambda p: F.struct(*[p[c].alias(c) for c in FIELDS])).alias("_periods"))
    known = given.select(key, F.col("name").alias("_name"), F.trim("address").alias("_address"), F.coalesce("opened_by_poi", F.lit(False)).alias("_poi"), F.coalesce("expected_visible", F.lit(False)).alias("name_match"))
    rows = merged.join(known, key, "left").join(pages, key, "left")
    paged = F.coalesce(F.size("_periods") > 0, F.lit(False))
    trend = F.filter("fast_prices", lambda p: p["time"].rlike(r"^\d{2}:\d{2}-\d{2}:\d{2}$"))
    borrowed = (F.col("station_name") == "") & F.col("name_match") & (F.coalesce("_name", F.lit("")) != "")
    source = F.when(F.col("address") != "", "detail").when(F.coalesce("_address", F.lit("")) != "", "input").otherwise("")
    return rows.withColumns({
        "price_schedule_source": F.when(paged, "price_detail").when(F.size("fast_prices") + F.size("slow_prices") > 0, "embedded_trend").otherwise(""),
        "fast_prices": F.when(paged, fold_periods(F.concat("_periods", trend))).otherwise(F.col("fast_prices")),
        "station_name_source": F.when(borrowed, "input_verified").otherwise(""), "station_name": F.when(borrowed, F.col("_name")).otherwise(F.col("station_name")),
        "address_source": source, "address": F.when(source == "input", F.col("_address")).otherwise(F.col("address")),
        "match_method": F.when(F.col("_poi"), "poi_id").otherwise("search_card"), "name_match": F.coalesce("name_match", F.lit(False)), "detail_verified": F.lit(True),
    }).drop("_name", "_address", "_poi", "_periods")
