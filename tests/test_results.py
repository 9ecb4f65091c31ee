import random

from pyspark.sql import functions as F

from stationlake.operators import results as R


def test_names_equal_all_pairs(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("ab充电") for _ in range(rng.choice([1, 2, 3, 4, 6, 9]))) for _ in range(150)] + ["", "a", "站", "a b"]
    left = [(i, n) for i, n in enumerate(names[:90] + names[-4:])]
    right = [(i, n) for i, n in enumerate(names[40:])]
    plain = lambda n: n.replace(" ", "")
    want = {}
    for t, a in ((t, plain(n)) for t, n in left):
        found = [(-(1000 if a == b else 800 + len(a) if a in b else 700 + len(b)), c) for c, b in ((c, plain(n)) for c, n in right) if a and b and (a in b or b in a)]
        if found:
            want[t] = (min(found)[1], -min(found)[0])
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, name string")
    got = {r.target_id: (r.candidate_id, r.score) for r in R.match_names(frame(left, "target_id"), frame(right, "candidate_id")).collect()}
    assert got == want and R.match_names(frame([], "target_id"), frame(right, "candidate_id")).count() == 0


def test_a_long_name_has_an_index_row_for_each_character(spark):
    names = spark.createDataFrame([("".join(chr(0x4E00 + i) for i in range(255)),)], "name string")
    assert names.select(F.size(R._parts(F.col("name"), R.PART))).first()[0] == 255 + 254 + 253


def test_a_callers_condition_decides(spark):
    kind = "city string, district string, card_match string, detail_match string, score int"
    rows = [("A", "D", "target", "unknown", 5), ("A", "D", "target", "unknown", 1), ("A", "D", "outside", "target", 5), ("A", "D", "unknown", "outside", 5), ("A", "A", "outside", "outside", 5), ("A", "D", "target", "target", None)]
    df = spark.createDataFrame(rows, kind)
    shown = lambda out: [(r.decision, r.reason) for r in out.collect()]
    assert shown(R.district_filter(df, accept=F.col("score") > 3)) == [("keep", ""), ("skip", "grid"), ("skip", "card"), ("skip", "detail"), ("keep", ""), ("skip", "grid")]
    assert shown(R.district_filter(df)) == [("skip", "unknown"), ("skip", "unknown"), ("skip", "card"), ("skip", "detail"), ("keep", ""), ("keep", "")]
