"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact verification.

1. Equal texts are one class from the start, and so are equal shingle sets: copies never meet each other again.
2. Every class is entered under keys of its size band (and the one below, if smaller sets there can be similar enough):
   the universe falls into more parts than two sets above the threshold can differ in, so they agree in one of the
   parts that hold any of their shingles, whose hash is a key. This is exact at every size.
3. The classes of a key are a tile, large ones are cut into blocks. Counts of common bits in hashed bitmaps bound the
   overlap of a pair from above; what is left is counted in the sorted arrays (see candidates.py).
4. The links' components, widened to the copies, are the result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import candidate_links, shared_members
from .common import M1, M2, Scratch, WordHashes, as_bytes, mix, rolling, signed, slices, table
from .components import components


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence, where there are fewer words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes, min(n, len(hashes)), np.uint64(0x5851F42D4C957F2D)) + np.uint64(min(n, len(hashes)) == n))


def lower_ascii(word: bytes) -> bytes:
    return word.lower()  # bytes.lower() knows A-Z alone


def band_of(n: int) -> int:
    return int(math.floor(2 * math.log2(n) + 1e-9))


def band_low(band: int) -> int:
    return math.ceil(2 ** (band / 2) - 1e-9)


def bands_of(n: int, threshold: float) -> list[int]:
    """The set's own band, and the one below it if sets there can be similar enough."""
    own = band_of(n)
    below = own - 1
    while below >= 0 and band_low(below + 1) == band_low(below):
        below -= 1
    return [own] if below < 0 or (band_low(own) - 1) < threshold * n - 1e-9 else [own, below]


def part_keys(s: np.ndarray, band: int, threshold: float) -> np.ndarray:
    """Keys of a set in a band: one for each part of the universe that holds a shingle of it.

    Two sets above the threshold differ in at most `differ` shingles, and so in as many parts. Where either fills more
    parts than that, one of these is the same in both; sets that fill fewer have exact prefix keys, too.
    """
    differ = int((1 - threshold) / threshold * (band_low(band + 1) - 1) + 1e-9)
    m = differ + 1 + differ // 4
    salt = np.uint64(band * 0x9E3779B1 + 1)
    h = mix(s * M1)
    place = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, value = place[order], mix(s[order])
    start = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]
    keys = mix(np.add.reduceat(value, start) ^ mix((place[start].astype(np.uint64) + np.uint64(1)) * M1 + salt))
    if len(start) <= differ:
        # One order for all sets: similar ones share one of their first shingles.
        prefix = np.sort(h)[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]
        keys = np.concatenate([keys, mix(prefix ^ mix(salt + M2))])
    return keys


def marked_rows(batches, n: int, threshold: float):
    """Per text: the size of its set, a 128-bit hash of the set and its keys."""
    import pyarrow as pa

    hashes = WordHashes(key=lower_ascii)
    for whole in batches:
        for batch in slices(whole):
            sizes, a, b, keys = [], [], [], []
            for text in as_bytes(batch.column("text")):
                s = shingle_set(hashes((text or b"").split())[0], n)
                sizes.append(len(s))
                a.append(mix(s).sum(dtype=np.uint64))
                b.append(mix(s ^ M2).sum(dtype=np.uint64))
                found = [part_keys(s, x, threshold) for x in bands_of(len(s), threshold)] if len(s) else []
                keys.append(signed(np.concatenate(found)) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(signed(np.array(x, np.uint64)), pa.int64()) for x in (a, b)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "mark_a", "mark_b", "keys"],
            )


def bitmap(s: np.ndarray, each: int = 4) -> bytes:
    """Hashed bits of a set, some `each` for each shingle; the number of bytes is a power of two, 16 at least."""
    width = max(128, 1 << (each * band_low(band_of(len(s))) - 1).bit_length())
    at = (mix(s ^ M1) % np.uint64(width)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(bool), bitorder="little").tobytes()


def set_rows(batches, n: int):
    """Per text: the size of its set, its bitmap and its sorted elements as bytes."""
    import pyarrow as pa

    hashes = WordHashes(key=lower_ascii)
    for whole in batches:
        for batch in slices(whole):
            sets = [shingle_set(hashes((text or b"").split())[0], n) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array(map(len, sets), pa.int64()), pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["class", "n", "bits", "payload"],
            )


def bitmap_bound(percent: int):
    """Which pairs may reach the threshold: a shingle whose bit the other bitmap lacks is in one set only."""

    def passes(n1, x1, n2, x2):
        common = np.bitwise_count(x1 & x2).sum(axis=1, dtype=np.int64)
        bound = np.minimum(n1 - (np.bitwise_count(x1).sum(axis=1, dtype=np.int64) - common), n2 - (np.bitwise_count(x2).sum(axis=1, dtype=np.int64) - common))
        bound = np.minimum(bound, np.minimum(n1, n2))
        return (100 + percent) * bound >= percent * (n1 + n2), bound / np.maximum(n1, n2)

    return passes


def similar(percent: int):
    """100 * intersection >= percent * union, in the sorted arrays of two sets."""

    def exact(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return lambda: exact


def likely_rows(docs: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """docs without most rows whose doc_id is not in wanted (class), so that few texts are shuffled for an exact join.

    A bitmap of 2**bits hashed places, of 64 to a row, is broadcast: it doesn't grow with the input.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word, mask = (lambda c: F.shiftright(place(c), 6)), (lambda c: F.expr(f"shiftleft(1L, int(pmod(xxhash64({c}), 64)))"))
    words = wanted.groupBy(word("class").alias("_word")).agg(F.bit_or(mask("class")).alias("_mask"))
    held = docs.withColumn("_word", word("doc_id")).join(F.broadcast(words), "_word")
    return held.where(F.col("_mask").bitwiseAND(mask("doc_id")) != 0).drop("_word", "_mask")


def ngram_components(docs: DataFrame, scratch: Scratch, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are versions of one document:
    each gets its own row, and what either links with is in their one component. Rows without a doc_id link nothing
    and have no component_id. An empty table gives an empty result.
    """
    threshold = percent / 100
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    marked = docs.mapInArrow(lambda it: marked_rows(it, n, threshold), "doc_id long, n long, mark_a long, mark_b long, keys array<long>")
    marked = scratch.save(marked, "marked")

    # Copies: a class is a distinct set, named by its smallest doc_id.
    classes = marked.where("n > 0 and doc_id is not null").groupBy("n", "mark_a", "mark_b").agg(F.min("doc_id").alias("class"))
    classes = scratch.save(classes, "classes")

    own = classes.withColumn("doc_id", F.col("class"))
    keyed = marked.join(own, ["n", "mark_a", "mark_b", "doc_id"]).select("class", F.explode("keys").alias("key"))
    members = shared_members(keyed, scratch)
    wanted = members.select("class").distinct()
    texts = likely_rows(docs, wanted).join(wanted, F.col("doc_id") == F.col("class")).select("class", "text")
    sets = texts.mapInArrow(lambda it: set_rows(it, n), "class long, n long, bits binary, payload binary")
    sets = scratch.save(sets, "sets")
    links = candidate_links(members, sets, scratch, bitmap_bound(percent), similar(percent))
    scratch.drop("sets", "members")

    # The classes' components, for every row.
    found = components(links, scratch, "last").toDF("class", "component")
    found = classes.join(found, "class", "left").select("n", "mark_a", "mark_b", F.coalesce("component", "class").alias("component"))
    rows = marked.select("doc_id", "n", "mark_a", "mark_b").join(found, ["n", "mark_a", "mark_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


#: The same result from all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), linked AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)
), ways AS MATERIALIZED (
    SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(a, b) AS (
    SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), lowest AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN lowest ON lowest.a = d.doc_id
"""
