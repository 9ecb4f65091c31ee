import corpus_pipeline as P


def test_texts_that_share_a_doc_id_stay(spark):
    one, two = "a clean text about the first of two things", "quite another text with words of its own in it"
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, one), (None, one)], "doc_id long, text string")
    kept = sorted(map(tuple, P.dedup_near(spark, docs, "").collect()), key=str)
    assert kept == [(1, one), (1, two), (None, one)]


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    """All five stages over a small corpus, each against its slow counterpart on what the one before kept."""
    import random

    from tokenizers import Tokenizer

    from stationlake.llm import toxicity
    from stationlake.llm.bpe_transducer import vocabulary_path

    from . import test_bpe, test_decontamination, test_line_dedup, test_ngram_join

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8)))
    pool = [" ".join(word() for _ in range(rng.choice([4, 12, 25]))) for _ in range(60)]
    rows = [(d, "\n".join([*rng.sample(pool, 2), *(" ".join(word() for _ in range(20)) for _ in range(3))]) + (" idiot scum idiot" if d % 4 == 0 else "")) for d in range(60)]
    rows += [(100, rows[1][1]), (101, f"own words of one {test_decontamination.ITEM} text"), (102, None), (103, ""), (104, rows[2][1].replace("a", "e", 1)), (None, "no id here " * 3), (3, "other words under one id " + pool[0])]
    kind = "doc_id long, text string, lang string, n_chars long, score double, _doc string"
    spark.createDataFrame([(d, t, "en", len(t or ""), 0.5, "x") for d, t in rows], kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test_decontamination.ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    models = []
    fitted = toxicity.fitted_on
    monkeypatch.setattr(toxicity, "fitted_on", lambda *a: models.append(fitted(*a)) or models[-1])
    got = sorted(map(tuple, P.run(spark, str(tmp_path)).collect()), key=str)

    kept = [(d, t) for d, t in rows if models[0]((t or "").encode()) < 0.7]
    assert any(d == 0 for d, _ in rows) and not any(d is not None and d < 60 and d % 4 == 0 for d, _ in kept)
    judged = test_line_dedup.brute(kept)
    left = {d: t for (d, _), t in judged.items() if d != 3}
    lines = P.dedup_lines(spark, spark.createDataFrame(kept, "doc_id long, text string"), "")
    assert sorted(map(tuple, lines.collect()), key=str) == sorted(((d, t) for (d, given), t in judged.items() if t != "" or not given), key=str)
    assert left.keys() and all(r[0] is None or r[0] in {d for d, _ in kept} for r in got)
    clean = {d for d, _ in rows if d is not None and 0 < d < 60 and d % 4}
    assert clean - {r[0] for r in got} <= {d for d in clean if left.get(d) == ""}
    assert not {100, 101} & {r[0] for r in got}
    texts = {d: t for d, t in left.items() if isinstance(d, int) and d in clean - {3}}
    same = dict((d, c) for d, _, c in test_ngram_join.brute([(d, t) for d, t in texts.items()]))
    tok = Tokenizer.from_file(vocabulary_path())
    found = {r[0]: r[1:] for r in got}
    for d, t in texts.items():
        if t and same[d] == d:
            assert found[d] == test_bpe.expected(tok, t)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
