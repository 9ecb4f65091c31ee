"""Substring dedup by recompression.

Each text becomes a string of word names. Rounds shorten it: the first names runs of equal words, each further one
names pairs, where a hash bit of every name says whether it may open or close a pair. A name is a hash of what it
stands for, so all tasks give equal parts of texts the same interior symbols without a dictionary. A symbol's name
depends on a few words around it only (`lo`, `hi`); symbols that lie with these words inside a window occur wherever
the window occurs. So Spark counts the symbols of the top level, and a window can repeat only if all symbols inside
it do. The windows that are left, mostly true repeats, are grouped by a 96-bit hash of all their words; those behind
the first one of a group are repeats, and the words under them go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, M2, Scratch, as_bytes, mix, rolling, semi_join, signed, slices, table, word_hashes

FACTORS = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
ROUNDS = 5
FAR = 1 << 40  # of symbols that depend on where the text begins or ends


def recompress(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """Symbols of the last round over texts laid end to end: (name, text, lo, hi), [lo, hi) being the words it depends on."""
    n = len(names)
    lo = np.arange(n, dtype=np.int64)
    hi = lo + 1
    if not n:
        return names, text, lo, hi
    same_text = text[1:] == text[:-1]

    # Runs: a run's name holds its length, and depends on the words at either side being other ones.
    joined = np.concatenate([[False], same_text & (names[1:] == names[:-1])])
    start = np.nonzero(~joined)[0]
    end = np.append(start[1:], n)
    length = end - start
    lo = np.where((start > 0) & (text[np.maximum(start - 1, 0)] == text[start]), start - 1, -FAR)
    hi = np.where((end < n) & (text[np.minimum(end, n - 1)] == text[start]), end + 1, FAR)
    s = names[start]
    s = np.where(length > 1, mix(s * M1 + length.astype(np.uint64)), s)
    t = text[start]

    # Pairs: an opener and the closer that follows it become one symbol. What stays single depends on its neighbour.
    for r in range(1, rounds):
        closes = (mix(s ^ (np.uint64(r * int(M2) & 0xFFFFFFFFFFFFFFFF))) >> np.uint64(40)) & np.uint64(1) == 1
        next_same = np.append(t[1:] == t[:-1], False)
        pair = np.append(~closes[:-1] & closes[1:], False) & next_same
        tail = np.append(False, pair[:-1])
        new_s, new_lo, new_hi = s.copy(), lo.copy(), hi.copy()
        i = np.nonzero(pair)[0]
        new_s[i] = mix(mix(s[i] * M1 + np.uint64(r)) + s[i + 1] * M2)
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        i = np.nonzero(~pair & ~tail & ~closes)[0]
        j = np.minimum(i + 1, len(s) - 1)
        inside = next_same[i]
        new_lo[i], new_hi[i] = np.where(inside, np.minimum(lo[i], lo[j]), lo[i]), np.where(inside, np.maximum(hi[i], hi[j]), FAR)
        i = np.nonzero(~pair & ~tail & closes)[0]
        j = np.maximum(i - 1, 0)
        inside = (i > 0) & (t[j] == t[i])
        new_lo[i], new_hi[i] = np.where(inside, np.minimum(lo[i], lo[j]), -FAR), np.where(inside, np.maximum(hi[i], hi[j]), hi[i])
        keep = ~tail
        s, t, lo, hi = new_s[keep], t[keep], new_lo[keep], new_hi[keep]
    return s, t, lo, hi


class Texts:
    """The word hashes of a slice of texts, laid end to end, and the symbols inside windows of `window` words."""

    def __init__(self, batch, window: int):
        self.text, self.first, self.second = word_hashes(batch.column("text"))
        self.sizes = np.bincount(self.text, minlength=batch.num_rows)
        self.begin = np.cumsum(self.sizes) - self.sizes
        name, text, lo, hi = recompress(self.first ^ (self.second >> np.uint64(1)), self.text)
        good = hi - lo <= window
        self.name, self.owner, self.lo, self.hi = name[good], text[good], lo[good], hi[good]
        self.number = np.arange(len(self.owner)) - np.searchsorted(self.owner, self.owner)  # within its text
        n = max(0, len(self.text) - window + 1)
        self.whole = self.text[:n] == self.text[window - 1 :] if n else np.empty(0, bool)
        self.window = window

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """How many of the chosen symbols lie inside the window that starts at each word."""
        n = len(self.whole)
        out = np.zeros(len(self.text) + 2, np.int64)
        out += np.bincount(np.maximum(self.hi[chosen] - self.window, 0), minlength=len(out))
        out -= np.bincount(self.lo[chosen] + 1, minlength=len(out))
        return np.cumsum(out)[:n]


def symbol_rows(batches, window: int):
    """(rid, number, name) of every symbol; number -1 marks texts that have windows without a symbol inside."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole):
            x = Texts(batch, window)
            rid = batch.column("rid").to_numpy()
            bare = np.unique(x.text[: len(x.whole)][x.whole & (x.covered(np.ones(len(x.name), bool)) == 0)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rid[x.owner], rid[bare]])), pa.array(np.concatenate([x.number, np.full(len(bare), -1)]).astype(np.int32)), pa.array(signed(np.concatenate([x.name, np.zeros(len(bare), np.uint64)])))],
                names=["rid", "number", "name"],
            )


def window_rows(batches, window: int):
    """(a, b, doc_id, rid, start) of every window in which all symbols repeat."""
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole):
            x = Texts(batch, window)
            repeated = np.zeros(len(x.name), bool)
            lists = batch.column("numbers")
            ends = np.searchsorted(x.owner, np.arange(len(x.sizes)), side="left")
            numbers, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            real = numbers >= 0
            repeated[ends[owner[real]] + numbers[real]] = True
            at = np.nonzero(x.whole & (x.covered(~repeated) == 0))[0]
            a, b = rolling(x.first, window, FACTORS[0]), rolling(x.second, window, FACTORS[1])
            owner = x.text[at]
            for part in range(0, max(len(at), 1), 100_000):
                some, who = at[part : part + 100_000], owner[part : part + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(a[some])), pa.array((b[some] >> np.uint64(33)).astype(np.int32)), batch.column("doc_id").take(pa.array(who)), batch.column("rid").take(pa.array(who)), pa.array((some - x.begin[who]).astype(np.int32))],
                    names=["a", "b", "doc_id", "rid", "start"],
                )


def kept_words(words: list[bytes], starts, window: int) -> list[bytes]:
    """The words that no repeated window covers; start -1 stands for all windows."""
    if not starts or len(words) < window:
        return words
    if -1 in starts:
        return []
    at = np.array(starts)
    cover = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
    return [w for w, c in zip(words, np.cumsum(cover)[:-1].tolist()) if not c]


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = 20) -> DataFrame:
    """(rid, starts): the starts of the windows of each text that also start earlier; [-1] for copies of whole texts.

    docs: rid, doc_id, text, digest. Windows are ordered by (doc_id, start).
    """
    # A text that a smaller doc_id has, too, repeats all over: its windows needn't be looked at.
    copied = docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = docs.select("rid", "doc_id", "digest").join(copied.select("digest", "first"), "digest").where("doc_id > first")
    copies = scratch.save(copies.select("rid").distinct(), "copies")

    # Symbols that occur more than once, by text.
    plain = docs.select("rid", "text")
    symbols = scratch.save(plain.mapInArrow(lambda it: symbol_rows(it, window), "rid long, number int, name long"), "symbols")
    real = symbols.where("number >= 0")
    counted = scratch.save(real.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    repeated = semi_join(real, counted, ["name"], symbols.count()).select("rid", "number")
    repeated = repeated.union(symbols.where("number < 0").select("rid", "number"))
    numbers = repeated.join(copies, "rid", "left_anti").groupBy("rid").agg(F.collect_list("number").alias("numbers"))
    numbers = scratch.save(numbers, "numbers")
    scratch.drop("symbols", "counted")

    # Windows of repeated symbols only, and the first one of each kind.
    candidates = docs.select("rid", "doc_id", "text").join(numbers, "rid")
    windows = candidates.mapInArrow(lambda it: window_rows(it, window), "a long, b int, doc_id long, rid long, start int")
    windows = scratch.save(windows, "windows")
    scratch.drop("numbers")
    place = F.struct("doc_id", "start")
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    firsts = scratch.save(firsts.where("first < last").drop("last"), "firsts")
    later = semi_join(windows, firsts, ["a", "b"], windows.count()).where(place > F.col("first")).select("rid", "start")
    later = later.union(copies.select("rid", F.lit(-1)))
    later = scratch.save(later.groupBy("rid").agg(F.collect_set("start").alias("starts")), "starts")
    scratch.drop("windows", "firsts")
    return later


def dedup_substrings(docs: DataFrame, scratch: Scratch, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each text outside windows that start earlier elsewhere.

    Null and empty texts have no words; texts below `window` words lose nothing. Null doc_ids come before all others.
    Rows that share doc_id and text are one document given more than once, and get equal results; texts under one
    doc_id are ordered by start alone.
    """
    first = F.lit(-(2**63)).cast("long")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    docs = docs.select(F.coalesce("doc_id", first).alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("rid"), F.md5("text").alias("digest"))
    starts = repeated_windows(docs, scratch, window)
    joined = docs.select("doc_id", "text", "rid").join(starts, "rid", "left").select("doc_id", "text", "starts")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole):
                total, left = [], []
                for text, lost in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist()):
                    words = (text or b"").split()
                    total.append(len(words))
                    left.append(kept_words(words, lost, window))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array([a - len(b) for a, b in zip(total, left)], pa.int64()), pa.array([b" ".join(x) for x in left], pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    done = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return done.select(F.when(F.col("doc_id") != first, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same result from the word sequences of all windows.
ORACLE_SQL = r"""
WITH words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS shown
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), later AS (
    SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY shown ORDER BY doc_id, i) > 1
), lost AS (
    SELECT DISTINCT doc_id, i + k AS place FROM later, range(20) t(k)
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS shown
    FROM placed ANTI JOIN lost USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(shown, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
