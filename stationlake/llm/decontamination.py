"""Benchmark decontamination by templates.

Words become templates: numbers, names and units turn into typed placeholders, everything else into lower case without
punctuation. A run of numbers or of names is one placeholder, so that `12` can stand for `twenty five` and `Anna` for
`Mary Ann`. Each text is read in two views: in one, words that are capitalised are names; in the other, only numbers and
units are slots and letter case tells nothing, which finds copies in another case. Windows of template words of the
documents meet those of the benchmark in a hash join. Windows of one document and item on one diagonal must replace slots
consistently (one value of the item always by one value of the document), or hold the item's own values. Windows of
placeholders alone say nothing: they count by their words only. A document is contaminated by an item if such windows
cover COVERAGE of the item's in one of the views.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, M2, as_bytes, free_names, mix, rolling, signed, slices, table, word_hashes

WINDOW = 8
COVERAGE = 0.5
FACTOR = np.uint64(0x5851F42D4C957F2D)
FILTER_BITS = 1 << 24  # of the bitmap of benchmark windows: a fixed 2 MB whatever the tables hold

# Written numbers, and units of measure and money.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
UNIT_WORDS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres g kg mg lb lbs oz gram grams pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros mph kmh degree degrees"
NUMBERS, UNITS = (frozenset(x.encode() for x in words.split()) for words in (NUMBER_WORDS, UNIT_WORDS))
NUMBER = re.compile(rb"[-+]?[$]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
EDGES = b".,;:!?\"'()[]{}<>#$%&*|`~_=+\\/"
NUMBER_EDGES = EDGES.replace(b"$", b"")


LITERAL, NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = range(4)
RUNS = np.array([False, True, False, True])  # of which kinds a run is one slot
VIEWS = (0, 1)  # with names as slots, and without


def template(word: bytes) -> tuple[int, bytes]:
    """The word's kind and its literal; depends on the word alone, so that a passage is the same everywhere."""
    core = word.strip(EDGES)
    shown = core if core.isascii() else core.decode("utf-8", "replace")
    small = core.lower() if core.isascii() else shown.lower().encode()
    letters = core.isalpha()  # ASCII letters alone
    if small in NUMBERS or (not letters and NUMBER.fullmatch(word.strip(NUMBER_EDGES))):
        return NUMBER_SLOT, small
    if b"-" in small and all(x in NUMBERS for x in small.split(b"-")):
        return NUMBER_SLOT, small
    if small in UNITS:
        return UNIT_SLOT, small
    if len(shown) > 1 and shown[:1].isupper() and shown[1:].islower():
        return NAME_SLOT, small
    return LITERAL, small


class Templates:
    """Kinds of words and hashes of their literals, with a bounded cache from word to row."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.rows = limit, {}
        self.kind, self.code = np.empty(0, np.int8), np.empty(0, np.uint64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        if len(self.rows) > self.limit:
            self.rows = {}
        rows = self.rows
        new = list(set(words).difference(rows))
        if new:
            known = len(rows)
            kinds, smalls = zip(*map(template, new))
            codes = word_hashes(pa.array([b"." + x for x in smalls], pa.large_binary()))[1]  # one word each, empty ones too
            self.kind = np.concatenate([self.kind[:known], np.array(kinds, np.int8)])
            self.code = np.concatenate([self.code[:known], codes])
            rows.update(zip(new, range(known, known + len(new))))
        at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        return self.kind[at], self.code[at]


class View:
    """The template words of texts laid end to end: their kinds, hashes, first words and texts."""

    def __init__(self, view: int, kind: np.ndarray, code: np.ndarray, owner: np.ndarray):
        self.view = view
        kind = kind if view == 0 else np.where(kind == NAME_SLOT, LITERAL, kind)
        goes_on = RUNS[kind[1:]] & (kind[1:] == kind[:-1]) & (owner[1:] == owner[:-1])
        self.first = np.nonzero(np.append(True, ~goes_on))[0] if len(kind) else np.empty(0, np.int64)
        self.end = np.append(self.first[1:], len(kind))
        self.kind, self.owner = kind[self.first], owner[self.first]
        inside = np.arange(len(kind)) - np.repeat(self.first, self.end - self.first)
        self.plain = np.add.reduceat(mix(code + inside.astype(np.uint64) * M1), self.first) if len(kind) else code
        self.shown = np.where(self.kind == LITERAL, self.plain, mix(self.kind.astype(np.uint64) + M2))
        self.literals = np.append(0, np.cumsum(self.kind == LITERAL))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first template word and the hash of every window that says something."""
        count = max(0, len(self.owner) - n + 1)
        at = np.nonzero(self.owner[:count] == self.owner[n - 1 :])[0] if count else np.empty(0, np.int64)
        bare = self.literals[at + n] == self.literals[at]
        if self.view == 0:  # the other view has their words
            at, bare = at[~bare], bare[~bare]
        if not len(at):
            return at, np.empty(0, np.uint64)
        code = rolling(self.shown, n, FACTOR)[at]
        if bare.any():
            code[bare] = mix(rolling(self.plain, n, FACTOR)[at[bare]] + M1)
        return at, mix(code ^ np.uint64(16 * n + self.view))


def window_rows(batches, window: int, sizes=None, passed=None):
    """(id, view, size, place, code, slots) of the windows of each view.

    Without `sizes`, of `window` template words, or of all where a text has fewer; with it, of all the (view, size) there,
    as far as the bitmap lets them through.
    """
    import pyarrow as pa

    templates = Templates()
    for whole in batches:
        for batch in slices(whole, target=1_000_000):
            words, counts = [], []
            for text in as_bytes(batch.column("text")):
                some = (text or b"").split()
                words += some
                counts.append(len(some))
            kind, code = templates(words)
            owner = np.repeat(np.arange(len(counts)), counts)
            for view in VIEWS:
                x = View(view, kind, code, owner)
                tokens = np.bincount(x.owner, minlength=len(counts))
                begin = np.cumsum(tokens) - tokens
                for n in np.unique(np.minimum(tokens[tokens > 0], window)).tolist() if sizes is None else [n for v, n in sizes if v == view]:
                    at, hashed = x.windows(n)
                    if sizes is None:
                        ok = np.minimum(tokens[x.owner[at]], window) == n
                    else:
                        bit = hashed & np.uint64(FILTER_BITS - 1)
                        ok = (passed[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, hashed = at[ok], hashed[ok]
                    who = x.owner[at]
                    slots = [[slot(words[x.first[k] : x.end[k]], x.kind[k]) for k in range(i, i + n)] for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(who)),
                            pa.array(np.full(len(at), view, np.int32)),
                            pa.array(np.full(len(at), n, np.int32)),
                            pa.array((at - begin[who]).astype(np.int32)),
                            pa.array(signed(hashed)),
                            pa.array(slots, pa.list_(pa.string())),
                        ],
                        names=["id", "view", "size", "place", "code", "slots"],
                    )


def slot(words: list[bytes], kind: int) -> str:
    """What fills a slot, with its kind in front; empty for literals."""
    return "" if kind == LITERAL else f"{kind} " + " ".join(template(w)[1].decode("utf-8", "replace") for w in words)


def windows_of(texts: DataFrame, window: int, sizes=None, passed=None) -> DataFrame:
    """texts: id, text."""
    bits = None if passed is None else texts.sparkSession.sparkContext.broadcast(passed)
    schema = "id long, view int, size int, place int, code long, slots array<string>"
    return texts.mapInArrow(lambda it: window_rows(it, window, sizes, None if bits is None else bits.value), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage): the items that each document holds, by the view that shows more.

    Items of fewer than `window` template words are compared as one window of their length. Null and empty texts hold
    nothing and aren't held; rows without an id are left out; rows that share an id count as one document or item. An
    empty table on either side gives an empty result; other columns are ignored.
    """
    docs = docs.selectExpr("cast(doc_id as long) id", "cast(text as string) text").where("id is not null and text is not null")
    items = benchmark.selectExpr("cast(item_id as long) id", "cast(text as string) text").where("id is not null and text is not null").distinct()
    wanted = windows_of(items, window).withColumnsRenamed({"id": "item_id", "place": "item_place", "slots": "item_slots"})
    sizes = [tuple(r) for r in wanted.select("view", "size").distinct().collect()]  # `window` of each view at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    places = wanted.select((F.col("code").bitwiseAND(FILTER_BITS - 1)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    hits = windows_of(docs, window, sizes, bits).join(wanted.drop("size"), ["view", "code"])
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: x["a"] != "")
    hits = hits.select("id", "item_id", "view", "item_place", (F.col("place") - F.col("item_place")).alias("diagonal"), pairs.alias("pairs"))
    own = F.forall("pairs", lambda x: x["a"] == x["b"])
    diagonal = hits.groupBy("id", "item_id", "view", "diagonal").agg(
        F.collect_set("item_place").alias("places"),
        F.collect_set(F.when(own, F.col("item_place"))).alias("own_places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    matched = diagonal.select("id", "item_id", "view", F.when(consistent, F.col("places")).otherwise(F.col("own_places")).alias("places"))
    matched = matched.groupBy("id", "item_id", "view").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"))
    total = wanted.groupBy("item_id", "view").agg(F.count_distinct("item_place").alias("n_windows"))
    done = matched.join(total, ["item_id", "view"]).withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    best = done.groupBy("id", "item_id").agg(F.max(F.struct("coverage", "n_matched", "n_windows")).alias("best"))
    return best.select(F.col("id").alias("doc_id"), "item_id", "best.n_matched", "best.n_windows", "best.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; rows without a doc_id stay, and so do repeated rows of clean documents."""
    doc = free_names(docs, "doc")[0]
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col(doc), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
