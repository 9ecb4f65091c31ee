"""Shared folders, and tables of hash buckets behind a log of commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
KEEP = 3  # commits whose rows stay readable


def filesystem(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, where: str) -> None:
    path, fs = filesystem(spark, where)
    fs.delete(path, True)


def names_in(spark: SparkSession, where: str) -> list[str]:
    path, fs = filesystem(spark, where)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


class CommitConflict(Exception):
    """Another writer has made this version."""


class BucketTable:
    """A table whose rows lie in buckets by a hash of their keys; every change is one commit.

    A commit is a small file, <root>/_log/<version>.json, that names the folder of each bucket. Rows are written first,
    under a folder of their own, and count only once the commit has its final name, which a rename gives it that fails
    where the name is taken. So a crash at any step leaves the last commit whole, nothing is deleted before a newer one is
    there, and of two writers of one version the second one is told. A change reads and rewrites only the buckets that its
    batch touches; all others go on from where they are.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root, keys, buckets

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/_log") if n.endswith(".json") and not n.startswith("."))

    def commit(self, version: int | None = None) -> dict | None:
        """The commit of a version, by default the last one; None where there is none."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/_log/{version}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the last one; None where nothing was ever committed."""
        commit = self.commit(version)
        return None if commit is None else self._rows(commit, None)

    def _rows(self, commit: dict, buckets: set[int] | None) -> DataFrame:
        kind = T.StructType.fromJson(commit["schema"])
        paths = [f"{self.root}/data/{folder}/_bucket={b}" for b, folder in commit["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def apply(self, batch: DataFrame, number: int, change: Callable[[DataFrame | None, DataFrame, dict], DataFrame], tops: tuple[str, ...] = ()) -> bool:
        """Commits `change(rows of the buckets that the batch touches, batch, tops)`; False where the batch is committed already.

        number counts batches up, so that one that comes again after a crash is told from a new one. tops are columns whose
        largest value in the whole table the commits carry. change may rewrite, add and remove rows of those buckets only.
        """
        last = self.commit()
        if last and last["batch"] >= number:
            return False
        version = last["version"] + 1 if last else 0
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(last["of"] if last else self.buckets))
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # as many as there are buckets at most
        known = last["tops"] if last else dict.fromkeys(tops, None)
        rows = change(self._rows(last, touched) if last else None, batch, known)
        folder = f"v-{version}-{uuid.uuid4().hex[:12]}"
        self._write(rows.withColumn("_bucket", bucket.cast("int")), f"{self.root}/data/{folder}", tops, known)
        written = {int(n.removeprefix("_bucket=")) for n in names_in(self.spark, f"{self.root}/data/{folder}") if n.startswith("_bucket=")}
        if written - touched:
            raise ValueError(f"a change of the buckets {sorted(touched)} wrote to {sorted(written - touched)}")
        before = {b: f for b, f in last["buckets"].items() if int(b) not in touched} if last else {}
        self._publish({
            "version": version, "batch": number, "of": last["of"] if last else self.buckets, "schema": json.loads(rows.schema.json()),
            "buckets": before | {str(b): folder for b in sorted(written)}, "tops": known,
        })
        self.vacuum()
        return True

    def _write(self, rows: DataFrame, where: str, tops: tuple[str, ...], known: dict) -> None:
        seen = Observation()
        if tops:
            rows = rows.observe(seen, *[F.max(c).alias(c) for c in tops])
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(where)
        for c in tops:
            new = seen.get[c]
            known[c] = new if known.get(c) is None else known[c] if new is None else max(known[c], new)

    def _publish(self, commit: dict) -> None:
        """Writes the commit aside and gives it its name, which only one writer of a version can."""
        aside, fs = filesystem(self.spark, f"{self.root}/_log/.{commit['version']}-{uuid.uuid4().hex[:12]}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        self._name(aside, f"{self.root}/_log/{commit['version']}.json")

    def _name(self, aside, where: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        target = filesystem(self.spark, where)[0]
        context = hadoop.FileContext.getFileContext(aside.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(aside, target, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(where) from e
            raise

    def vacuum(self, keep: int = KEEP) -> None:
        """Deletes the commits before the last `keep` ones, and the folders that no kept commit names."""
        versions = self.versions()
        held = {f for v in versions[-keep:] for f in self.commit(v)["buckets"].values()}
        for v in versions[:-keep]:
            delete(self.spark, f"{self.root}/_log/{v}.json")
        for folder in names_in(self.spark, f"{self.root}/data"):
            if folder not in held and int(folder.split("-")[1]) <= versions[-1]:  # not what another writer has begun
                delete(self.spark, f"{self.root}/data/{folder}")
