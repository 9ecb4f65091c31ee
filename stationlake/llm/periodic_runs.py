"""Periodic runs of words: tiles per octave of periods, solved on their own, fragments stitched by document and period.

Periods fall into octaves [2^k, 2^(k+1)). For every octave a text is cut into tiles that overlap by three times the largest
period, so that what a tile sees of a run is long enough to be found there and meets what the next tile sees. In a tile,
boundaries stand 2^k words apart; every run covers one of them early enough to be told from it. The Z-functions of a
boundary, forwards and backwards, say how far the words q apart agree on either side of it, which is the fragment of period
q around it. Fragments of a document and period are stitched by Spark, whatever tiles they come from.

A boundary and period of which a few words differ is no run, so Z-functions are asked for the few others only. They compare
hashes of stretches, and what they say is then checked on the words, each of which is known by 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, free_names, slices, table, word_hashes

LEAST, TIMES = 6, 4  # a run has at least LEAST words and TIMES its period
PROBE = 16  # words that are compared before a Z-function is asked
TILE = 4096  # words of a tile at least, without its overlap
LONG_TEXT = 2_000_000  # bytes of texts that are cut into tiles of rows of their own
PRIMES = (np.uint64(2147483629), np.uint64(2147483587))
BASES = (np.uint64(1103515245), np.uint64(1812433253))
FRAGMENTS = "array<struct<q:int, start:int, stop:int>>"


def tile_words(octave: int, tile: int = TILE) -> tuple[int, int]:
    """(words from a tile to the next one, words that it overlaps the next one by)."""
    return max(tile, 32 << octave), 6 << octave


class Stretches:
    """Hashes of all stretches of a sequence, by prefix sums modulo two primes; equal stretches have equal hashes."""

    def __init__(self, values: np.ndarray):
        self.power, self.sums = [], []
        for prime, base in zip(PRIMES, BASES):
            power = np.ones(len(values) + 1, np.uint64)
            done, step = 1, base % prime
            while done < len(power):  # powers by doubling
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * step % prime
                done, step = done + more, step * step % prime
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values % prime * power[:-1] % prime, out=sums[1:])
            self.power.append(power)
            self.sums.append(sums % prime)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on have the hash of the n words from b on; a <= b."""
        same = np.ones(len(a), bool)
        for prime, power, sums in zip(PRIMES, self.power, self.sums):
            left = (sums[a + n] + prime - sums[a]) % prime * power[b - a] % prime
            same &= left == (sums[b + n] + prime - sums[b]) % prime
        return same


def z_values(stretches: Stretches, at: np.ndarray, q: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from `at` on (or before it) equal those q further on; at most `most`. Halving finds the place."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (open_ := np.nonzero(low < high)[0]).size:
        half = (low[open_] + high[open_] + 1) // 2
        a = at[open_] if forward else at[open_] - half
        same = stretches.equal(a, a + q[open_], half)
        low[open_[same]] = half[same]
        high[open_[~same]] = half[~same] - 1
    return low


def prime_factors(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + [q] * (q > 1)


def around(words, low: int, high: int, at: int, q: int) -> tuple[int, int]:
    """The stretch of period q around a boundary, word by word."""
    ahead = np.nonzero(words[at : high - q] != words[at + q : high])[0]
    behind = np.nonzero(words[low:at] != words[low + q : at + q])[0]
    return low + int(behind[-1]) + 1 if len(behind) else low, at + q + int(ahead[0]) if len(ahead) else high


def smallest(stretches: Stretches, words, q: int, start: int, stop: int) -> int:
    """The smallest period of a stretch of period q that is at least twice as long as q."""
    for r in prime_factors(q):
        while q % r == 0:
            p, n = q // r, np.array([stop - start - q // r])
            if not stretches.equal(np.array([start]), np.array([start + p]), n)[0] or not np.array_equal(words[start : stop - p], words[start + p : stop]):
                break
            q = p
    return q


def octave_fragments(words, stretches: Stretches, low: np.ndarray, high: np.ndarray, octave: int):
    """(q, start, stop) of the periodic stretches that the tiles [low, high) hold, for periods of one octave."""
    step = 1 << octave
    low, high = low[high - low >= 3 * step], high[high - low >= 3 * step]
    count = (high - low - 1) // step + 1
    tile = np.repeat(np.arange(len(low)), count)
    at = low[tile] + (np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count)) * step
    found = {}
    for begin in range(0, len(at), max(1, 1_000_000 // step)):  # so many boundaries at a time
        b, t = at[begin : begin + max(1, 1_000_000 // step)], tile[begin : begin + max(1, 1_000_000 // step)]
        span = np.arange(step, 2 * step)
        i, j = np.nonzero((b[:, None] + span < high[t][:, None]) & (words[b][:, None] == words[np.minimum(b[:, None] + span, len(words) - 1)]))
        b, t, q = b[i], t[i], span[j]
        for k in range(1, min(PROBE, step)):
            same = (b + q + k < high[t]) & (words[b + k] == words[np.minimum(b + q + k, len(words) - 1)])
            b, t, q = b[same], t[same], q[same]
        start = b - z_values(stretches, b, q, b - low[t], False)
        stop = b + q + z_values(stretches, b, q, high[t] - b - q, True)
        some = np.nonzero(stop - start >= 3 * q)[0]
        # Two periods of an octave over one stretch have the same smallest period: the smaller one will do.
        some = some[np.lexsort((q[some], stop[some], start[some]))]
        some = some[np.append(True, (np.diff(start[some]) != 0) | (np.diff(stop[some]) != 0))] if len(some) else some
        for s, e, p, boundary, which in zip(*(x[some].tolist() for x in (start, stop, q, b, t))):
            if (s, e) not in found or p < found[s, e][0]:
                found[s, e] = (p, boundary, which)
    out = set()
    for (s, e), (q, boundary, which) in found.items():
        if not np.array_equal(words[s : e - q], words[s + q : e]):  # hashes of unlike words met
            s, e = around(words, int(low[which]), int(high[which]), boundary, q)
        if e - s >= 3 * q:
            out.add((smallest(stretches, words, q, s, e), s, e))
    return out


def fragments_of(words, begin: np.ndarray, end: np.ndarray, octaves=None, tile: int = TILE) -> list[tuple[int, int, int]]:
    """(q, start, stop): all fragments of the texts [begin, end) of a sequence of words, cut into tiles per octave."""
    if not len(words):
        return []
    stretches, out = Stretches(words["first"] ^ words["second"] >> np.uint64(32)), set()
    most = int((end - begin).max())
    for octave in range(most.bit_length()) if octaves is None else octaves:
        if TIMES << octave > most:
            break
        stride, overlap = tile_words(octave, tile)
        long = np.nonzero(end - begin >= max(LEAST, TIMES << octave))[0]
        tiles = np.maximum(1, -(-(end[long] - begin[long] - overlap) // stride))
        which = np.repeat(long, tiles)
        low = begin[which] + (np.arange(len(which)) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * stride
        out |= octave_fragments(words, stretches, low, np.minimum(end[which], low + stride + overlap), octave)
    return sorted(out)


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place after the rewriting of a tenth of the documents; None for the others."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def plain(doc_id: int | None, n: int) -> None:
    return None


def joined_sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def sequences(batch, order):
    """(words, begin, end, texts): the hashed words of all texts of a batch, end to end, in the order that `order` gives."""
    text, first, second = word_hashes(batch.column("text"))
    words = np.empty(len(text), [("first", np.uint64), ("second", np.uint64)])
    words["first"], words["second"] = first, second
    begin = np.searchsorted(text, np.arange(batch.num_rows), "left")
    end = np.searchsorted(text, np.arange(batch.num_rows), "right")
    places = []
    for doc, b, e in zip(batch.column("doc_id").to_pylist(), begin.tolist(), end.tolist()):
        places.append(order(doc, e - b))
        if places[-1] is not None:
            words[b:e] = words[b + places[-1]]
    return words, begin, end, places


def solved_rows(order, tile: int):
    """Each text with its number of words, its digest without runs, and its fragments; the text only where there are some."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, target=1_000_000):
                words, begin, end, places = sequences(batch, order)
                own = [[] for _ in range(batch.num_rows)]
                found = fragments_of(words, begin, end, tile=tile)
                for q, s, e in found:
                    k = int(np.searchsorted(begin, s, "right")) - 1
                    own[k].append({"q": q, "start": s - int(begin[k]), "stop": e - int(begin[k])})
                texts = as_bytes(batch.column("text"))
                split = [(t or b"").split() for t in texts]
                split = [w if p is None else [w[i] for i in p] for w, p in zip(split, places)]
                text = pa.array([t if f else None for t, f in zip(texts, own)], pa.binary())
                fields = [batch.column("doc_id"), batch.column("key"), pa.array(map(len, split), pa.int64()), pa.array(map(joined_sha256, split), pa.string())]
                kind = pa.list_(pa.struct([("q", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*fields, pa.array(own, kind), text], names=["doc_id", "key", "n", "plain_sha256", "fragments", "text"])

    return run


def cut_rows(order, tile: int):
    """The tiles of long texts as rows of their own: octave, first word, and the hashed words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                words, _, _, _ = sequences(one, order)
                for octave in range(len(words).bit_length()):
                    if TIMES << octave > len(words):
                        break
                    stride, overlap = tile_words(octave, tile)
                    for low in range(0, max(1, len(words) - overlap), stride):
                        part = words[low : low + stride + overlap]
                        yield pa.RecordBatch.from_arrays(
                            [one.column("doc_id"), one.column("key"), pa.array([octave], pa.int32()), pa.array([low], pa.int32()), pa.array([part.tobytes()], pa.large_binary())],
                            names=["doc_id", "key", "octave", "low", "words"],
                        )

    return run


def solved_tiles(batches):
    """The fragments of the tiles of long texts."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for doc, key, octave, low, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "octave", "low", "words"))):
            words = np.frombuffer(words, [("first", np.uint64), ("second", np.uint64)])
            rows += [(doc, key, q, low + s, low + e) for q, s, e in fragments_of(words, np.array([0]), np.array([len(words)]), [octave], tile=len(words))]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "key", "q", "start", "stop"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(doc_id, key, q, start, stop): the runs that the fragments make up, by document and period."""
    own = Window.partitionBy("doc_id", "key", "q").orderBy("start", F.desc("stop"))
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    # What overlaps by a period or more continues the run; less than that is a run of its own.
    new = F.coalesce(F.col("start") > F.col("reach") - F.col("q"), F.lit(True)).cast("int")
    placed = fragments.distinct().withColumn("reach", reach).withColumn("island", F.sum(new).over(own))
    runs = placed.groupBy("doc_id", "key", "q", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    size = F.col("stop") - F.col("start")
    return runs.where((size >= LEAST) & (size >= TIMES * F.col("q"))).drop("island")


def told_rows(order):
    """The digests of texts with runs, from their runs (q, start, stop) by start and period."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, target=4_000_000):
                out = []
                for doc, text, runs in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("runs").to_pylist()):
                    words = (text or b"").split()
                    places = order(doc, len(words))
                    words = words if places is None else [words[i] for i in places]
                    kept = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        kept[r["start"] + r["q"]] += 1
                        kept[r["stop"]] -= 1
                    kept = np.nonzero(np.cumsum(kept[:-1]) == 0)[0]
                    best = min(runs, key=lambda r: (-Fraction(r["stop"] - r["start"], r["q"]), r["start"], r["q"]))
                    size = best["stop"] - best["start"]
                    shown = "".join(f"{r['start']},{r['stop'] - r['start']},{r['q']}\n" for r in runs)
                    out.append((len(runs), best["start"], size, best["q"], 1000 * size // best["q"], hashlib.sha256(shown.encode()).hexdigest(), joined_sha256([words[i] for i in kept])))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], names=["doc_id", "key", *FOUND])

    return run


FOUND = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def document_runs(docs: DataFrame, scratch: Scratch, order=plain, tile: int = TILE, long_text: int = LONG_TEXT) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): every row of docs (doc_id, key, n, plain_sha256, text), and (doc_id, key, q, start, stop) of all runs.

    key tells texts apart that share a doc_id. order(doc_id, n) may say which word stands at each place of a text.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_text
    solved = rows.where(~long).mapInArrow(solved_rows(order, tile), f"doc_id long, key long, n long, plain_sha256 string, fragments {FRAGMENTS}, text binary")
    rest = rows.where(long).mapInArrow(described(order), "doc_id long, key long, n long, plain_sha256 string, text binary")
    solved = scratch.save(solved.unionByName(rest.withColumn("fragments", F.expr(f"cast(null as {FRAGMENTS})"))), "solved")
    tiles = rows.where(long).mapInArrow(cut_rows(order, tile), "doc_id long, key long, octave int, low int, words binary").repartition(F.xxhash64("doc_id", "key", "octave", "low"))
    fragments = solved.select("doc_id", "key", F.inline("fragments")).union(tiles.mapInArrow(solved_tiles, "doc_id long, key long, q int, start int, stop int"))
    return solved.drop("fragments"), scratch.save(stitched(fragments), "runs")


def described(order):
    """Long texts with their numbers of words and digests."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                words = as_bytes(one.column("text"))[0].split()
                places = order(one.column("doc_id")[0].as_py(), len(words))
                shown = joined_sha256(words if places is None else [words[i] for i in places])
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("key"), pa.array([len(words)], pa.int64()), pa.array([shown]), one.column("text").cast(pa.binary())], names=["doc_id", "key", "n", "plain_sha256", "text"])

    return run


def run_digests(docs: DataFrame, scratch: Scratch, order=plain, tile: int = TILE, long_text: int = LONG_TEXT) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words) for every row of docs.

    Null, empty and blank texts have no words and no runs; rows are kept one to one, with null and repeated ids, and rows that
    share doc_id and text have equal results; an empty table gives an empty result; other columns are ignored.
    """
    texts, runs = document_runs(docs, scratch, order, tile, long_text)
    listed = runs.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "q", "stop"))).alias("runs"))
    # Rows without a doc_id join on a flag instead.
    flat = lambda df: df.withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "none": F.col("doc_id").isNull()}).drop("doc_id")
    on = ["id", "none", "key"]
    held = flat(texts.where("text is not null")).dropDuplicates(on).join(flat(listed), on)
    told = held.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "key", "text", "runs").mapInArrow(told_rows(order), "doc_id long, key long, " + ", ".join(f"{c} {'string' if 'sha' in c else 'long'}" for c in FOUND))
    done = flat(texts.drop("text")).join(flat(told), on, "left")
    none = hashlib.sha256(b"").hexdigest()
    return done.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), "start", "length", "period", "exponent_milli",
        F.coalesce("runs_sha256", F.lit(none)).alias("runs_sha256"), F.coalesce("collapsed_sha256", "plain_sha256").alias("collapsed_sha256"), F.col("n").alias("n_words"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), Scratch(spark, "op13"), rewritten)


#: The runs of equal words at every distance, in DuckDB; the checksum of a doc_id is computed bit by bit.
ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        xor(list_reduce([4294967295] || [ord(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
            lambda s, c: list_reduce([xor(s, CAST(c AS BIGINT))] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS h
    FROM documents
), places AS (
    SELECT r, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM texts
), words AS MATERIALIZED (
    SELECT r, doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE
        [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)] END) AS word FROM places
), pairs AS (
    SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
    GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
    SELECT r, start, length, min(q) AS q FROM stretches GROUP BY r, start, length
), dropped AS (
    SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM words WHERE (r, i) NOT IN (SELECT (r, i) FROM dropped) GROUP BY r
), told AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS shown,
        arg_min((start, length, q), (-length / q, start, q)) AS best FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[1] AS BIGINT) AS start, CAST(best[2] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
    CAST(1000 * best[2] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, len(w) AS n_words
FROM texts LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
