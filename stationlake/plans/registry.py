"""Registered queries, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .fixtures import fixture, oracle

QUERIES, ORACLE_SQL = {}, {}


def shared_folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stationlake-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{uuid.uuid4().hex}"


def register(name: str, needs: str, sql: str | None = None):
    """A query over one or more fixtures (blank-separated), and its SQL, which may name fixtures as tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, n) for n in needs.split()])
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add
