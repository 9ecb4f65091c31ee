"""Pages that are odd: no XML, nothing at all, prices in pieces."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from stationlake.operators import pages


def test_malformed_and_empty_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, '<a><node text=" x "/>'), (4, "<hierarchy/>")], "dump_id long, xml string")
    got = {r.dump_id: r for r in pages.parse_dumps(df, "texts").collect()}
    assert [got[i].error is not None for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert [n.text for n in got[3].nodes] == ["x"]
    kinds = {r.dump_id: r.kind for r in pages.assess_pages(pages.parse_dumps(df)).collect()}
    assert set(kinds.values()) == {"unknown"}
    fields = pages.extract_detail(pages.parse_dumps(df)).collect()
    assert {(r.station_name, r.current_price, len(r.fast_prices)) for r in fields} == {("", "", 0)}


def test_prices_in_pieces(spark):
    texts = ["00:00~08:00", "最低", "参考价", "￥1", ".45", "电费", "0.90元", "服务费：0.55", "08:00-20:00", "参考价", ".8"]
    xml = "<hierarchy>" + "".join(f'<node text="{t}"/>' for t in texts) + "</hierarchy>"
    row = spark.createDataFrame([(1, xml)], "dump_id long, xml string")
    got = pages.parse_dumps(row).select(pages.price_page_periods(F.col("nodes")).alias("p")).first().p
    assert [tuple(p)[:5] for p in got] == [("00:00-08:00", "1.45", "0.90", "0.55", "最低"), ("08:00-20:00", "0.8", "", "", "")]


def test_an_expression_of_texts_is_computed_once_a_page(spark):
    """Texts given as an expression, as a moved filter leaves them: each text took all of them to be found anew."""
    nodes = "".join(f'<node text="{t}"/>' for t in ["快充", "空闲", "3", "/8", "120kW"] + ["x"] * 2000)
    df = spark.createDataFrame([(1, f"<hierarchy>{nodes}</hierarchy>")], "dump_id long, xml string")
    near = pages.neighbours(pages.page_texts(F.col("nodes")))
    start = time.monotonic()
    row = pages.parse_dumps(df).withColumns(pages.equipment_facts(near)).select("fast_available", "fast_total", "fast_power", "slow_total").first()
    assert tuple(row) == ("3", "8", "120kW", "") and time.monotonic() - start < 60


def test_a_filter_on_what_pages_hold_parses_them_once(spark):
    df = spark.createDataFrame([(i, f'<a><node text="t{i}"/></a>') for i in range(9)], "dump_id long, xml string").repartition(3, "dump_id")
    some = pages.parse_dumps(df).select("dump_id", F.size("nodes").alias("n")).where("n > 1")
    assert some.count() == 9
    assert some._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_parsed_nodes_keep_their_places_over_slices(spark):
    xml = '<a><b text=" 1 " bounds="[1,2][3,4]"><c content-desc="d" clickable="true"/></b><b bounds="[9999999999,0][1,1]"/></a>'
    pages_of = [(i, "<a><b>" if i % 7 == 3 else xml) for i in range(3 * pages.SLICE + 1)]
    got = {r.dump_id: r for r in pages.parse_dumps(spark.createDataFrame(pages_of, "dump_id long, xml string").coalesce(1)).collect()}
    want = [(0, 3, 0, "a", "", "", False, *[None] * 4), (1, 2, 1, "b", "1", "", False, 1, 2, 3, 4), (2, 2, 2, "c", "", "d", True, *[None] * 4), (3, 3, 1, "b", "", "", False, *[None] * 4)]
    assert len(got) == len(pages_of)
    for i, r in got.items():
        assert ([tuple(n) for n in r.nodes], r.error is None) == (([], False) if i % 7 == 3 else (want, True))


def test_pages_of_one_key_fold_and_those_of_none_go(spark):
    page = lambda *fees: "<a>" + "".join(f'<node text="{t}"/>' for t in fees) + "</a>"
    rows = [(1, page("00:00-08:00 参考价1.2")), (1, page("08:00-09:00 参考价1.3")), (None, page("00:00-08:00 参考价9"))]
    found = pages.extract_price_detail(spark.createDataFrame(rows, "id long, xml string"), ["id"])
    assert sorted((r.id, r.time, r.total_price) for r in found.collect()) == [(1, "00:00-08:00", "1.2"), (1, "08:00-09:00", "1.3")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_parts_of_nodes_are_those_of_whole_nodes(spark):
    """Rules that ask for parts had all of a node made; what is made must not depend on what is asked for."""
    odd = [
        '<a><b text=" x " content-desc="d" bounds="[1,2][3,4]"><c clickable="true"/></b></a>', '<a xmlns="u"><b text="1"/></a>', "<p:a/>", "<a>&z;</a>", '<!DOCTYPE a SYSTEM "x"><a>&z;</a>',
        '<!DOCTYPE a [<!ENTITY q "z">]><a text="&q;"/>', '<a text="1"><b></a>', '<a text="1"/><b text="2"/>', "", None,
    ]
    df = spark.createDataFrame(list(enumerate(odd)), "dump_id long, xml string").coalesce(1)
    whole = {r.dump_id: r for r in pages.parse_dumps(df, "texts").collect()}
    assert [whole[i].error is None for i in range(len(odd))] == [True, True, False, False, False, True, False, False, False, False]
    assert [n.tag for n in whole[1].nodes] == ["{u}a", "{u}b"] and [n.text for n in whole[5].nodes] == ["z"] and [n.text for n in whole[7].nodes] == ["1", "2"]
    for parts in (pages.SAID, pages.JUDGED, pages.WORDS, ("pos", "depth"), ("x2",)):
        for r in pages.parse_dumps(df, "texts", parts).collect():
            assert r.error == whole[r.dump_id].error
            assert [n.asDict() for n in r.nodes] == [{c: n[c] for c in pages.PARTS_OF_NODE if c in parts} for n in whole[r.dump_id].nodes]


def test_parts_of_tokens_are_zipped_not_built_text_by_text(spark):
    """Of one period's odd texts; a struct was made, and copied twice, for each text."""
    texts = ["参考价1", "09:00-10:00 最低", "电费 服务费", "参考价 : ￥3", "参考价", "2", "¥ .5", "电费", "7.", "0.4元", "服务费", "12", "10:00-11:00", "  3 元"]
    row = spark.createDataFrame([(1, "<a>" + "".join(f'<node text="{t}"/>' for t in texts) + "</a>")], "dump_id long, xml string")
    found = pages.parse_dumps(row, "texts", pages.SAID).select(pages.price_page_periods(F.col("nodes")).alias("p"))
    assert [tuple(p)[:5] for p in found.first().p] == [("09:00-10:00", "2.5", "0.4", "", "最低")]
    tokens = spark.range(1).select(F.array(F.lit("参考价1")).alias("t")).select(pages._tokens(F.col("t")).alias("k"))
    assert "named_struct" not in tokens._jdf.queryExecution().analyzed().toString() and tuple(tokens.first().k[0]) == ("", "", "1", "", "", "total", "", "", "")


def test_small_pages_are_read_by_one_parser(monkeypatch):
    """Each page had a parser of its own, which took most of a small page's time."""
    made, create = [], pages.expat.ParserCreate
    monkeypatch.setattr(pages.expat, "ParserCreate", lambda *a: made.append(a) or create(*a))
    xml = '<hierarchy rotation="0"><node text="a"><node text="b&amp;c"/></node><b/></hierarchy>'
    for parts in (pages.WORDS, tuple(pages.PARTS_OF_NODE)):
        made.clear()
        got = pages._parsed(pa.array([xml] * pages.SLICE), False, parts).to_pylist()
        assert len(made) == 1 and got == pages._parsed(pa.array([xml]), False, parts).to_pylist() * pages.SLICE


def test_pages_read_together_are_what_each_is_alone():
    good = '<hierarchy><node text="a"><node text=" b " bounds="[1,2][3,4]"/></node></hierarchy>'
    odd = [
        None, "", "x", "<hierarchy/>", "<hierarchy></hierarchy>", '<?xml version="1.0"?>' + good, good + "\n", good + good, "<hierarchy>", "</hierarchy>", "<hierarchy><a></hierarchy>", "<hierarchy></a></hierarchy>",
        "<hierarchy></all><all></hierarchy>", "<hierarchy></hierarchy></all>", "<hierarchy><!-- </hierarchy>", "<hierarchy>--></hierarchy>", "<hierarchy><![CDATA[</hierarchy>", "<hierarchy>]]></hierarchy>", '<hierarchy a="></hierarchy>', '<hierarchy>"/></hierarchy>',
        '<hierarchy a="0"/></hierarchy>', '<hierarchy xmlns="u"><a/></hierarchy>', "<hierarchy><p:a/></hierarchy>", '<hierarchy><a text="&nbsp;"/></hierarchy>', "<hierarchy><hierarchy/></hierarchy>", '<hierarchy a="1" a="2"></hierarchy>', "<hierarchy><all/></hierarchy>", "<hierarchy>\x01</hierarchy>",
    ]
    for parts in (pages.JUDGED, tuple(pages.PARTS_OF_NODE)):
        for fallback in (False, True):
            alone = lambda xml: pages._parsed(pa.array([xml], pa.string()), fallback, parts).to_pylist()[0]  # noqa: B023, E731
            # A page alone can't be taken for a part of another one; only that it is well-formed counts here.
            for a in odd:
                for b in odd:
                    some = [good, a, b, good]
                    assert pages._parsed(pa.array(some, pa.string()), fallback, parts).to_pylist() == [alone(x) for x in some]
