"""Fuzzy line dedup: MinHash bands, exact Jaccard checks, union-find; the first line of every component stays.

Lines are compared by their normal form: ASCII letters in lower case, white space as one blank, trimmed. Blank lines
are never compared and never removed. Equal lines are one class. A class's MinHash signature takes one pass over its
character shingles: each shingle falls into one of BANDS * ROWS bins, a bin keeps its smallest hash, and an empty bin
borrows from another one that a fixed list names. Classes that agree on all ROWS values of one of BANDS bands are
candidates; hashed bitmaps bound the overlap of their shingle sets, which sorts out chance agreements, and what is left is
compared exactly: a Jaccard similarity of 0.8 or more links two lines.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import candidate_links, shared_members
from .common import M1, Scratch, as_bytes, free_names, mix, rolling, signed, slices, table
from .components import components
from .ngram_join import bitmap, bitmap_bound

SHINGLE = 5  # characters
BANDS, ROWS = 18, 6  # a pair at 0.8 shares a band with probability 0.996, at 0.85 with 0.9998
BINS = BANDS * ROWS
CHUNK = 64_000  # bytes of lines that are hashed at a time, so that the arrays stay in the processor's cache
FACTOR = np.uint64(0x5851F42D4C957F2D)
UNEVEN = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")
BEST_FIRST = 2  # pairs for each class of a tile: lines share many bands, so that pairs would come out of many tiles
EMPTY = np.uint32(0xFFFFFFFF)
BORROW = np.random.default_rng(20240229).integers(0, BINS, (64, BINS))  # where empty bins look, one row after the other


def normal(line: bytes) -> bytes:
    return b" ".join(line.split()).lower()


def normal_lines(text: bytes) -> list[bytes]:
    """The normal forms of all lines of a text. Most texts hold single blanks only, which need no joining."""
    lines = text.lower().split(b"\n")
    return [line.strip() for line in lines] if not any(x in text for x in UNEVEN) else list(map(normal, lines))


def digests(lines) -> np.ndarray:
    """Two 64-bit halves of each line's hash."""
    return np.frombuffer(b"".join(hashlib.blake2b(line, digest_size=16).digest() for line in lines), "<i8").reshape(-1, 2)


def points(line: bytes) -> np.ndarray:
    if line.isascii():
        return np.frombuffer(line, np.uint8)
    return np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def line_set(line: bytes) -> np.ndarray:
    """Sorted distinct hashes of a normal line's character shingles; of the whole line, where it is shorter."""
    codes = points(line).astype(np.uint64)
    return np.unique(rolling(codes, min(SHINGLE, len(codes)), FACTOR))


def signatures(lines: list[bytes]) -> np.ndarray:
    """The MinHash signatures of lines, one row of BINS values for each."""
    codes = [points(line) for line in lines]
    sizes = np.array(list(map(len, codes)))
    flat = np.concatenate([*codes, np.zeros(SHINGLE, np.uint32)]).astype(np.uint64)
    hashes = rolling(flat, SHINGLE, FACTOR)
    start = np.cumsum(sizes) - sizes
    for i in np.nonzero(sizes < SHINGLE)[0]:  # one shingle, the whole line
        hashes[start[i]] = line_set(lines[i])[0]
    count = np.maximum(sizes - SHINGLE + 1, 1)
    owner = np.repeat(np.arange(len(lines)), count)
    h = hashes[np.arange(len(owner)) + np.repeat(start - np.cumsum(count) + count, count)]
    low = np.full(len(lines) * BINS, EMPTY)
    np.minimum.at(low, owner * BINS + ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64), h.astype(np.uint32))
    given = low.copy()
    bare = np.nonzero(low == EMPTY)[0]
    for where in BORROW:
        if not len(bare):
            break
        row, place = np.divmod(bare, BINS)
        found = given[row * BINS + where[place]]
        low[bare] = found
        bare = bare[found == EMPTY]
    low[bare] = given.reshape(-1, BINS).min(axis=1)[bare // BINS]
    return low.reshape(-1, BINS)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """The band keys of lines, one row of BANDS for each."""
    ends = np.cumsum(list(map(len, lines)))
    cuts = [0, *(np.nonzero(np.diff(ends // CHUNK))[0] + 1), len(lines)]
    low = np.concatenate([signatures(lines[at:to]) for at, to in zip(cuts, cuts[1:])])
    low = low.astype(np.uint64).reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), BANDS))
    for k in range(ROWS):
        key = mix(key * M1 + low[:, :, k])
    return key


def line_rows(batches):
    """Per line that isn't blank: its place, the 128-bit hash of its normal form and, once in a slice, its band keys (else none)."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, target=1_000_000):
            rows, places, texts = [], [], []
            for row, text in enumerate(as_bytes(batch.column("text"))):
                for place, shown in enumerate(normal_lines(text or b"")):
                    if shown:
                        rows.append(row)
                        places.append(place)
                        texts.append(shown)
            if not texts:
                continue
            first = {}
            which = np.array([first.setdefault(shown, len(first)) for shown in texts])
            both = digests(first)[which]
            ends = np.cumsum(np.append(True, which[1:] > np.maximum.accumulate(which)[:-1])) * BANDS  # new lines count up
            keys = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), signed(band_keys(list(first)).ravel()))
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "version")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(places, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), keys],
                names=["doc_id", "version", "place", "mark", "check", "keys"],
            )


def wanted_lines(batches):
    """The normal forms of the wanted lines of each text, with their numbers of shingles and their bitmaps."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, target=1_000_000):
            names, texts = [], []
            for text, wanted in zip(as_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
                lines = (text or b"").split(b"\n")
                for w in wanted:
                    names.append(w["class"])
                    texts.append(normal(lines[w["place"]]))
            if texts:
                sets = [line_set(x) for x in texts]
                bits = [bitmap(x, 8) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(bits, pa.binary()), pa.array(texts, pa.binary())],
                    names=["class", "n", "bits", "payload"],
                )


def similar_lines(percent: int):
    """A check of the Jaccard similarity of two lines, which remembers the sets of a few of them."""

    def make():
        set_of = functools.lru_cache(maxsize=256)(line_set)

        def exact(a: bytes, b: bytes) -> bool:
            x, y = set_of(a), set_of(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return exact

    return make


def version_of(text: Column) -> Column:
    """Tells the texts apart that share a doc_id."""
    return F.xxhash64(text.cast("string"))


def removed_lines(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """(doc_id, version, removed): for each text that loses lines, the zero-based places of these lines.

    Lines are ordered by (doc_id, place, version), version being a hash of the whole text: each different text under a
    doc_id has lines of its own, and rows that share doc_id and text are one text given more than once. Documents
    without a doc_id and null or empty texts neither lose lines nor make others lose any.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version_of(F.col("text")).alias("version"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = chosen.mapInArrow(line_rows, "doc_id long, version long, place int, mark long, check long, keys array<long>")
    rows = scratch.save(rows, "lines")
    place = F.struct("doc_id", "place", "version")
    keyed = rows.select(F.col("mark").alias("class"), F.explode("keys").alias("key"))
    members = shared_members(keyed, scratch)

    # The candidates' texts, each from its first place.
    named = rows.select("doc_id", "version", "place", "mark", "check")
    near = members.select(F.col("class").alias("mark")).distinct()
    firsts = scratch.save(named.join(near, "mark", "left_semi").groupBy("mark", "check").agg(F.min(place).alias("at")), "firsts")
    wanted = firsts.groupBy("at.doc_id", "at.version").agg(F.collect_list(F.struct(F.col("at.place").alias("place"), F.col("mark").alias("class"))).alias("wanted"))
    sets = chosen.join(wanted, ["doc_id", "version"]).mapInArrow(wanted_lines, "class long, n long, bits binary, payload binary")
    sets = scratch.save(sets.dropDuplicates(["class"]), "sets")
    links = candidate_links(members, sets, scratch, bitmap_bound(percent), similar_lines(percent), BEST_FIRST)
    scratch.drop("sets", "members")

    # What isn't the first line of its component goes. Lines are known by both halves of their hash.
    found = components(links, scratch, "last").toDF("mark", "component").join(firsts.select("mark", "check"), "mark")
    named = named.join(found, ["mark", "check"], "left")
    named = named.select("doc_id", "version", "place", F.coalesce("component", "mark").alias("group"), F.when(F.col("component").isNull(), F.col("check")).otherwise(0).alias("check"))
    named = scratch.save(named, "named")
    scratch.drop("lines")
    groups = named.groupBy("group", "check").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").select("group", "check", "at")
    lost = named.join(groups, ["group", "check"]).where(place > F.col("at"))
    removed = scratch.save(lost.groupBy("doc_id", "version").agg(F.collect_set("place").alias("removed")), "removed")
    scratch.drop("named", "firsts")
    return removed


def dedup_lines(docs: DataFrame, scratch: Scratch, percent: int = 80, counts: bool = True, emptied: bool = True) -> DataFrame:
    """All rows and columns of docs, text without the removed lines; with counts also n_lines, n_removed of each text.

    Texts are judged one by one, also those that share a doc_id. A null text stays null with no lines; an empty table gives an empty result; a text that loses all lines is empty, and
    its row goes, unless emptied is set. Texts that have no line to lose stay as they are.
    Columns of docs that are called n_lines or n_removed give way to the counts.
    """
    doc, version, gone = free_names(docs, "doc", "version", "gone")
    removed = removed_lines(docs, scratch, percent).withColumnsRenamed({"doc_id": doc, "version": version, "removed": gone})
    joined = docs.join(removed, (F.col("doc_id").cast("long") == F.col(doc)) & (version_of(F.col("text")) == F.col(version)), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    lost = F.coalesce(F.col(gone), F.expr("cast(array() as array<int>)"))
    kept = F.when(F.size(lost) == 0, F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(lost, i)), "\n"))
    names = ("n_lines", "n_removed") if counts else ()
    columns = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in names]
    numbers = [F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lost)).alias("n_removed")]
    joined = joined if emptied else joined.where((F.size(lost) == 0) | (F.trim(kept) != ""))
    return joined.select(*columns, *(numbers if counts else ()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines it had and lost, and a digest of the text that is left."""
    rest = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op6"))
    return rest.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The result of all pairs of lines at 0.8; pairs come from the rarest shingles of each line, of which similar lines share one.
ORACLE_SQL = r"""
WITH RECURSIVE places AS MATERIALIZED (
    SELECT doc_id, place, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS shown
    FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), classes AS MATERIALIZED (
    SELECT shown, row_number() OVER (ORDER BY min((doc_id, place))) AS class, min((doc_id, place)) AS first FROM places WHERE shown <> '' GROUP BY shown
), shingles AS MATERIALIZED (
    SELECT DISTINCT class, substring(shown, i, 5) AS s FROM (SELECT class, shown, unnest(range(1, greatest(length(shown) - 4, 1) + 1)) AS i FROM classes)
), sets AS MATERIALIZED (
    SELECT class, count(*) AS n, list(s) AS s FROM shingles GROUP BY class
), often AS (
    SELECT s, count(*) AS lines FROM shingles GROUP BY s
), rare AS MATERIALIZED (
    SELECT class, s FROM shingles JOIN often USING (s) JOIN (SELECT class, n FROM sets) USING (class)
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY lines, s) <= n - (4 * n + 4) // 5 + 1
), pairs AS MATERIALIZED (
    SELECT DISTINCT x.class AS a, y.class AS b FROM rare x JOIN rare y ON x.s = y.s AND x.class < y.class
), linked AS MATERIALIZED (
    SELECT a, b FROM (SELECT a, b, p.n + q.n AS n, len(list_intersect(p.s, q.s)) AS both_have FROM pairs JOIN sets p ON p.class = a JOIN sets q ON q.class = b
        WHERE 5 * p.n >= 4 * q.n AND 5 * q.n >= 4 * p.n)
    WHERE 100 * both_have >= 80 * (n - both_have)
), ways AS MATERIALIZED (
    SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(a, b) AS (
    SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), lowest AS (
    SELECT a AS class, min(b) AS b FROM reach GROUP BY a
), judged AS (
    SELECT p.doc_id, p.place, p.line, c.first < (p.doc_id, p.place) OR b < c.class AS lost
    FROM places p LEFT JOIN classes c ON p.shown = c.shown LEFT JOIN lowest ON lowest.class = c.class
), told AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (lost IS NOT TRUE) AS kept
    FROM judged GROUP BY doc_id
)
SELECT doc_id, cast(coalesce(n_lines, 0) AS INTEGER) AS n_lines, cast(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
    CASE WHEN text IS NOT NULL THEN cast(length(coalesce(kept, '')) AS INTEGER) END AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN told USING (doc_id)
"""
