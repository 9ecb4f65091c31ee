"""License scan by diagonal voting, in DataFrame operations only.

All word 3-grams of every text meet the places of the templates that hold them, in a hash join. A hit at word w of a text
and word t of a template votes for the diagonal w - t, the word where the template would start. Votes of neighbouring
diagonals are merged, as inserted or missing words shift what follows them, and a place counts where enough different
places of the template voted. Grams meet by their hash and by their words, so every vote is an exact one.

Phrases are templates that must stand word for word, so all their grams must vote for one diagonal. Notices are
longer texts of which a share is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, in lower case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3  # words
SHARE = 60  # percent of a notice's grams that must be found
SLACK = 3  # words by which the parts of a notice may be shifted against each other
BROADCAST_GRAMS = 1_000_000  # larger template tables meet the texts in a shuffle

#: Phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Labels of the method's own and the notices that carry them.
NOTICES = [
    ("all-rights-reserved", "all rights reserved"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
              "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                 "you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
]


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAP, -1), "")


def grams_of(words: Column) -> Column:
    """The gram that starts at each word; the last ones are shorter and equal no gram of a template."""
    return F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, GRAM)]))


def builtin_templates(spark: SparkSession) -> DataFrame:
    rows = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text"), F.lit(c).alias("phrase")) for a, b, c in rows])))


def template_grams(templates: DataFrame) -> DataFrame:
    """(template, label, phrase, at, gram, grams): a row for each gram of each template; the shorter templates have none."""
    rows = templates.select("label", "phrase", words_in(F.col("text")).alias("words")).where(F.size("words") >= GRAM)
    named = rows.select(F.xxhash64("label", "phrase", F.array_join("words", " ")).alias("template"), "label", "phrase", "words").distinct()
    grams = F.slice(grams_of(F.col("words")), 1, F.size("words") - GRAM + 1)
    return named.select("template", "label", "phrase", F.size(grams).alias("grams"), F.posexplode(grams).alias("at", "gram"))


def license_votes(docs: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, n_words, start, template, label, phrase, grams, at): every hit of a gram of a template.

    Each row of docs has one row more, with a null template.
    """
    grams = scratch.save(template_grams(templates), "templates")
    bounded = grams.count() <= BROADCAST_GRAMS
    # A gram of no words stands for the text itself and is found in every text.
    itself = grams.sparkSession.range(1).select(*[F.lit("" if f.name == "gram" else None).cast(f.dataType).alias(f.name) for f in grams.schema])
    known = grams.union(itself).withColumn("hash", F.xxhash64("gram"))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_in(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    # Counted ahead of the generator, which would otherwise hand the array of words on with every gram.
    split = split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), grams_of(F.col("words"))).alias("all_grams"))
    found = split.select("row", "doc_id", "n_words", F.posexplode("all_grams").alias("place", "gram"))
    found = found.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(known) if bounded else known, ["hash", "gram"])
    start = (F.col("place") - 1 - F.col("at")).alias("start")
    return scratch.save(found.select("row", "doc_id", "n_words", start, "template", "label", "phrase", "grams", "at"), "votes")


def license_spans(votes: DataFrame, share: int = SHARE, slack: int = SLACK) -> DataFrame:
    """(row, label, phrase, start, first, end, share): the places of phrases and notices, in words, end exclusive.

    start is the template's own start; first and end tell which words of the text voted.
    """
    diagonals = votes.where("template is not null").groupBy("row", "template", "label", "phrase", "grams", "start").agg(F.collect_set("at").alias("ats"))
    near = Window.partitionBy("row", "template").orderBy("start").rangeBetween(0, slack)
    low, high = F.col("start") + F.array_min("ats"), F.col("start") + F.array_max("ats") + GRAM
    merged = lambda own, all_of: F.when(F.col("phrase"), own).otherwise(all_of.over(near))
    voted = diagonals.select(
        "row", "template", "label", "phrase", "start", "grams", merged(low, F.min(low)).alias("first"), merged(high, F.max(high)).alias("end"),
        F.size(F.array_distinct(F.flatten(merged(F.array("ats"), F.collect_list("ats"))))).alias("n"),
    )
    enough = voted.where(F.when(F.col("phrase"), F.col("n") == F.col("grams")).otherwise(F.col("n") * 100 >= F.col("grams") * share))
    own = Window.partitionBy("row", "template").orderBy("start")
    apart = F.col("start") - F.lag("start").over(own) > F.when(F.col("phrase"), 0).otherwise(slack)
    placed = enough.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(own))
    spans = placed.groupBy("row", "template", "island", "label", "phrase")
    return spans.agg(F.min("start").alias("start"), F.min("first").alias("first"), F.max("end").alias("end"), F.max(F.col("n") / F.col("grams")).alias("share"))


def scan_licenses(docs: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of docs.

    templates: label, text, phrase (must stand word for word, else a notice). score is the largest share of a template that
    a text holds, 0 without any. spans are label:first:end by (first, end, label). Null texts count as empty; rows are kept
    one to one, with null and repeated ids; an empty table gives an empty result; columns besides doc_id and text are
    ignored. Templates of fewer than 3 words are never found.
    """
    votes = license_votes(docs, templates, scratch)
    spans = license_spans(votes)
    base = lambda c: F.when(F.col("phrase"), F.col(c))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    shown = F.sort_array(F.collect_list(F.struct("first", "end", "label")))
    told = spans.groupBy("row").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"), labels(base("label")).alias("base_labels"),
        labels("label").alias("labels"), F.max("share").alias("score"), F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["label"], x["first"], x["end"])), ",").alias("spans"),
    )
    rows = votes.where("template is null").select("row", "doc_id", "n_words").join(told, "row", "left")
    given = lambda c, none: F.coalesce(F.col(c), F.lit(none)).alias(c)
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        given("base_labels", ""), given("labels", ""), given("score", 0.0), given("spans", ""),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), builtin_templates(spark), Scratch(spark, "op11"))


VALUES = ",\n    ".join(f"('{label}', '{text}', {phrase})" for kind, phrase in ((PHRASES, "true"), (NOTICES, "false")) for label, text in kind)

#: The same places from all grams of all texts, in DuckDB.
ORACLE_SQL = (
    r"""
WITH templates AS (
    SELECT row_number() OVER () AS template, label, phrase, string_split(text, ' ') AS w FROM (VALUES
    """
    + VALUES
    + r"""
    ) t(label, text, phrase)
), grams AS MATERIALIZED (
    SELECT template, label, phrase, len(w) - 2 AS grams, i - 1 AS spot, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
    FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM templates)
), texts AS MATERIALIZED (
    SELECT row_number() OVER () AS n, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), diagonals AS (
    SELECT n, template, label, phrase, grams, i - 1 - spot AS start, list(DISTINCT spot) AS ats
    FROM (SELECT n, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM texts)) JOIN grams USING (gram)
    GROUP BY ALL
), voted AS (
    SELECT n, template, label, phrase, grams, start, CASE WHEN phrase THEN [ats] ELSE list(ats) OVER near END AS voters,
        CASE WHEN phrase THEN start + list_min(ats) ELSE min(start + list_min(ats)) OVER near END AS first,
        CASE WHEN phrase THEN start + list_max(ats) + 3 ELSE max(start + list_max(ats) + 3) OVER near END AS stop
    FROM diagonals WINDOW near AS (PARTITION BY n, template ORDER BY start RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING)
), enough AS (
    SELECT *, len(list_distinct(flatten(voters))) AS votes FROM voted
    WHERE CASE WHEN phrase THEN len(list_distinct(flatten(voters))) = grams ELSE len(list_distinct(flatten(voters))) * 100 >= grams * 60 END
), placed AS (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > CASE WHEN phrase THEN 0 ELSE 3 END THEN 1 ELSE 0 END) OVER (PARTITION BY n, template ORDER BY start) AS island
    FROM (SELECT *, start - lag(start) OVER (PARTITION BY n, template ORDER BY start) AS gap FROM enough)
), spans AS (
    SELECT n, label, phrase, min(start) AS start, min(first) AS first, max(stop) AS stop, max(votes / grams) AS share FROM placed GROUP BY n, template, island, label, phrase
), told AS (
    SELECT n, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score,
        string_agg(label || ':' || first || ':' || stop, ',' ORDER BY first, stop, label) AS spans
    FROM spans GROUP BY n
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (n)
"""
)
