import random
import re

import pytest
from pyspark.sql import functions as F

from stationlake.llm import license_scan as L
from stationlake.llm.common import Scratch

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words, spans = words_of(text), []
    for phrase, kinds in ((True, L.PHRASES), (False, L.NOTICES)):
        for label, template in kinds:
            t = template.split()
            hits = {}
            for i in range(len(words) - 2):
                for at in range(len(t) - 2):
                    if words[i : i + 3] == t[at : at + 3]:
                        hits.setdefault(i - at, set()).add(at)
            slack, enough, last = (0, 100, None) if phrase else (L.SLACK, L.SHARE, None)
            for d in sorted(hits):
                near = {x: hits[x] for x in hits if d <= x <= d + slack}
                voted = set().union(*near.values())
                if len(voted) * 100 < enough * (len(t) - 2):
                    continue
                first, end = min(x + min(v) for x, v in near.items()), max(x + max(v) + 3 for x, v in near.items())
                share = len(voted) / (len(t) - 2)
                if last is not None and d - last <= slack:
                    spans[-1][2:] = [min(spans[-1][2], first), max(spans[-1][3], end), max(spans[-1][4], share), spans[-1][5]]
                else:
                    spans.append([label, phrase, first, end, share, d])
                last = d
    base = [s for s in spans if s[1]]
    labels = lambda some: ",".join(sorted({s[0] for s in some}))
    shown = ",".join(f"{s[0]}:{s[2]}:{s[3]}" for s in sorted(spans, key=lambda s: (s[2], s[3], s[0])))
    starts = [s[5] for s in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(spans), max((s[4] for s in spans), default=0.0), shown)


def run(spark, rows, templates=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, row int").repartition(3)
    out = L.scan_licenses(df, templates or L.builtin_templates(spark), Scratch(spark, "t11")).collect()
    return sorted(map(tuple, out), key=str)


def texts():
    rng = random.Random(11)
    out = [None, "", " .,", "cc by", "CC BY-NC 4.0", "under the MIT License", "Under THE\tmit\nlicense! under the mit license", "cc by nc by nc cc by nc", "é MIT licensé", "Apache License, Version 2.0", "apache-license version 22"]
    notices = [t.split() for _, t in L.NOTICES + L.PHRASES]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += rng.choices(["the", "license", "of", "under", "x"], k=rng.randrange(12))
            notice = list(rng.choice(notices))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(notice) + 1)
                notice[at : at + rng.randrange(3)] = ["inserted"] * rng.randrange(3)
            words += [w.upper() if rng.random() < 0.2 else w for w in notice[rng.randrange(3) :]]
        out.append(rng.choice((" ", "\n", ", ")).join(words))
    return [*out, "under the mit license " * 400, "w " * 20_000 + "all rights reserved"]


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "under the mit license"), (None, None), (5, "cc by nc"), (5, "cc by nc")]
    assert run(spark, rows) == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_large_template_tables_meet_in_a_shuffle(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    broadcast = run(spark, rows)
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 0)
    assert run(spark, rows) == broadcast


def test_empty_tables_and_odd_templates(spark):
    assert run(spark, []) == []
    kind = "label string, text string, phrase boolean"
    none = spark.createDataFrame([], kind)
    assert run(spark, [(1, "under the mit license")], none) == [(1, 4, 0, None, None, "", "", 0.0, "")]
    odd = spark.createDataFrame([("a", "too short", True), ("b", None, True), ("c", "one two three", True), ("c", "one two three", True), ("d", "one two three", False)], kind)
    assert run(spark, [(1, "one two three")], odd) == [(1, 3, 1, 0, 0, "c", "c,d", 1.0, "c:0:3,d:0:3")]


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "cc by nc")], "doc_id long, text string")
    plan = L.scan_licenses(docs, L.builtin_templates(spark), Scratch(spark, "t11"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pytest.approx(1.0) == L.scan_licenses(docs, L.builtin_templates(spark), Scratch(spark, "t11")).agg(F.max("score")).first()[0]
