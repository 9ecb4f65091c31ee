import random

from stationlake.llm import decontamination as D


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as code", "2 as item_id")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, round(r.coverage, 4)) for r in D.leaks(docs, items).collect())


def tokens(text, names):
    """[kind, words] of each template word; runs of numbers and of names are one."""
    out = []
    for word in (text or "").encode().split():
        kind, small = D.template(word)
        kind = D.LITERAL if kind == D.NAME_SLOT and not names else kind
        if out and kind in (D.NUMBER_SLOT, D.NAME_SLOT) and out[-1][0] == kind:
            out[-1][1].append(small)
        else:
            out.append([kind, [small]])
    return out


def brute(docs, items, w=8, least=0.5):
    best = {}
    for names in (True, False):
        for d, text in docs:
            words = tokens(text, names)
            for i, item in items:
                q = tokens(item, names)
                n = min(w, len(q))
                if not n or d is None:
                    continue
                slots_only = lambda b: all(q[b + k][0] for k in range(n))
                places = [b for b in range(len(q) - n + 1) if not (names and slots_only(b))]
                lines = {}
                for a in range(len(words) - n + 1):
                    for b in places:
                        kinds = all(words[a + k][0] == q[b + k][0] and (q[b + k][0] or words[a + k] == q[b + k]) for k in range(n))
                        if kinds and (not slots_only(b) or words[a : a + n] == q[b : b + n]):
                            lines.setdefault(a - b, set()).add(b)
                good = set()
                for diagonal, found in lines.items():
                    slots = {b: {(q[b + k][0], *map(tuple, (q[b + k][1], words[diagonal + b + k][1]))) for k in range(n) if q[b + k][0]} for b in found}
                    pairs = set().union(*slots.values())
                    if len(pairs) == len({x[:2] for x in pairs}):
                        good |= found
                    good |= {b for b in found if all(x[1] == x[2] for x in slots[b])}
                if places and len(good) / len(places) >= least:
                    best[d, i] = max(best.get((d, i), 0), round(len(good) / len(places), 4))
    return sorted((d, i, c) for (d, i), c in best.items())


ITEM = "If Anna buys 12 apples for 3 dollars and Anna sells 12 of them at the market for 5 dollars how much does she earn"


def test_new_parameters(spark):
    swapped = ITEM.replace("Anna", "Boris").replace("12", "40").replace("3", "7").replace("apples", "apples")
    mixed = ITEM.replace("Anna sells 12", "Carla sells 99")
    docs = [(1, f"intro words {ITEM} and more"), (2, f"so {swapped}. Then"), (3, mixed), (4, " ".join(ITEM.split()[:10])), (5, None), (6, ""), (None, ITEM), (7, "clean text of no interest " * 5000), (8, ITEM), (8, ITEM)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "Two short words")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert (1, 1, 1.0) in got and (2, 1, 1.0) in got and all(d != 3 for d, *_ in got)


def test_case_and_runs(spark):
    """Copies in another case, values of other lengths, and edits of one of two equal values are found."""
    longer = ITEM.replace("Anna", "Mary Ann").replace("12", "twenty five").replace("for 3", "for one hundred")
    edited = ITEM.replace("Anna sells", "Carla sells") + " per day of work and rest and what does it cost to go home again"
    item = ITEM + " per day of work and rest and what does it cost to go home again"
    listed = " ".join(f"{i} km {i} kg" for i in range(9))
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, longer), (4, edited)]
    docs += [(5, "12 34 56 " * 40), (6, "Anna Carla Boris " * 40), (7, "Carla Anna"), (8, listed), (9, listed.replace("3", "55"))]
    items = [(1, ITEM), (2, item), (3, "Anna Boris"), (4, "1 2 3"), (5, listed)]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert {(d, i) for d, i, _ in got} >= {(1, 1), (2, 1), (3, 1), (4, 2), (8, 5)}
    assert not {d for d, *_ in got} & {5, 6, 7} and (9, 5, 1.0) not in got  # other numbers in windows of numbers alone


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "cat", "Tom", "Ann", "3", "14", "twenty-five", "-", "km", "runs", "to", "a", "house.", "Far", "away"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 15, 25])))) for i in range(25)]
    docs = []
    for d in range(120):
        own = [rng.choice(words) for _ in range(rng.randrange(40))]
        item = rng.choice(items)[1].split()
        own += [rng.choice(["Tom", "Ann"]) if w in ("Tom", "Ann") and rng.random() < 0.2 else w for w in item[: rng.randrange(1, len(item) + 1)]]
        docs.append((d, " ".join(own)))
    assert run(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]) == [] == run(spark, [(1, ITEM)], [])
    docs = spark.createDataFrame([(1, ITEM, "k"), (2, "other", "k")], "doc_id long, text string, keep string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in D.decontaminate(docs, items).collect()] == [(2, "other", "k")]
