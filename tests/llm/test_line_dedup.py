import random

from stationlake.llm import line_dedup as L
from stationlake.llm.common import Scratch


def normal(line):
    return " ".join(line.encode().split()[i].decode() for i in range(len(line.encode().split()))).encode().lower().decode()


def shingles(line):
    return {line[i : i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def brute(rows):
    """The kept text of each (doc_id, text), by comparing all lines."""
    texts = {r for r in rows if r[0] is not None and r[1]}
    lines = sorted((doc, k, text, normal(line)) for doc, text in texts for k, line in enumerate(text.split("\n")) if normal(line))
    places, sets = [line[:3] for line in lines], [shingles(line[3]) for line in lines]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    gone = {p for i, p in enumerate(places) if find(i) != i}
    return {(d, t): None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k, t) not in gone) for d, t in rows}


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    pool = [" ".join(word() for _ in range(rng.choice([1, 3, 12, 40]))) for _ in range(40)]
    rows = []
    for d in range(90):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool).split(" ")
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = word()
            lines.append(rng.choice(["", "  "]) + rng.choice([" ", "\t "]).join(line).replace("a", rng.choice("aA")))
            if rng.random() < 0.2:
                lines.append("")
        rows.append((d, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "é"), (204, "é\nx"), (205, "long " * 30_000)]
    df = spark.createDataFrame([(d, t, 5, "r") for d, t in rows], "doc_id long, text string, n_lines int, removed string").repartition(6)
    got = {r.doc_id: r.text for r in L.dedup_lines(df, Scratch(spark, "t6")).collect()}
    assert got == {d: kept for (d, _), kept in brute(rows).items()}


def test_edges(spark):
    run = lambda rows: sorted(map(tuple, L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t6")).collect()), key=str)
    assert run([]) == []
    assert run([(None, "same line"), (2, "same line"), (3, "Same  line")]) == [(2, "same line", 1, 0), (3, "", 1, 1), (None, "same line", 1, 0)]
    assert run([(1, "a\nb\na"), (1, "a\nb\na")]) == [(1, "a\nb", 3, 1)] * 2


def test_texts_that_share_a_doc_id_are_judged_one_by_one(spark):
    rows = [(1, "first line of one\nsecond line of one"), (7, "first line of one\nown line of seven"), (7, "another line that is unlike\nlast own line, quite long"), (7, None), (7, ""), (8, "x\nlast own line, quite long")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = L.dedup_lines(df, Scratch(spark, "t6"), counts=False)
    expected = [(d, kept) for (d, _), kept in brute(rows).items()]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    assert (7, "own line of seven") in expected and (7, rows[2][1]) in expected and (8, "x") in expected
    kept = L.dedup_lines(df.union(df.where("doc_id = 8")), Scratch(spark, "t6"), counts=False, emptied=False)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([*expected, (8, "x")], key=str)


def test_similarity_is_of_five_character_shingles(spark):
    rng = random.Random(3)
    rows, gone = [], set()
    for d in range(0, 80, 2):
        line = "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(49, 79)))
        other = line[:24] + "z" + line[25:]
        a, b = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (line, other))
        rows += [(d, line), (d + 1, other)]
        gone |= {d + 1} if 100 * len(a & b) >= 80 * len(a | b) else set()
    assert len(gone) > 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in L.dedup_lines(df, Scratch(spark, "t6")).collect() if r.n_removed} == gone
