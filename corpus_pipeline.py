"""A corpus pipeline of five stages, each one of the operators in stationlake.llm, over the documents table.

All stages take any columns besides doc_id and text and hand them on under their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import bpe_transducer, decontamination, line_dedup, ngram_join, toxicity
from stationlake.llm.common import Scratch, free_names, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.7 or more go.

    Rows are judged one by one by their text: repeated rows and ids share a fate, null and empty texts get the score of no
    words, rows without a doc_id count like others. A score that ties with the limit is rejected.
    """
    scorer = toxicity.fitted_on(docs, table(spark, sf_dir, "labels"))
    score = free_names(docs, "score")[0]
    return toxicity.score_texts(docs, scorer, score).where(F.col(score) < 0.7).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that have an equal or near one further ahead go, and with them the documents that lose all their lines.

    Ahead means a smaller doc_id, or the same one and a smaller place. Null, empty and blank texts stay; rows without a
    doc_id neither lose lines nor take them from others; rows that share doc_id and text get equal results.
    """
    rest = line_dedup.dedup_lines(docs, Scratch(spark, "lines"), counts=False, emptied=False)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word 4-grams, the one with the smallest doc_id stays.

    Of rows that share a doc_id each different text stays, once. Null and empty texts link with nothing and stay; so do
    all rows without a doc_id.
    """
    groups = ngram_join.ngram_components(docs, Scratch(spark, "near"))
    doc = free_names(docs, "doc")[0]
    firsts = groups.where("doc_id = component_id").select(F.col("doc_id").alias(doc)).distinct()
    kept = docs.join(firsts, F.col("doc_id").cast("long") == F.col(doc), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and rows without a doc_id aren't judged: both stay. Rows that share a doc_id are one
    document and share a fate; repeated rows of clean documents stay. Without items nothing goes.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of ids and digests of ids and decoded texts of what is left, a row for each row, with null and repeated ids.

    Null and empty texts have no ids. Workers keep what earlier stages left in them, so they remember fewer words than op10's.
    """
    return bpe_transducer.encode_and_decode(docs, cache=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL can express none of the first four stages (a trained model, MinHash, similarity components, templates).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again by the next one."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
