"""Token ids in Simple-8b files: 64-bit words that each hold a selector and as many ids as fit.

The top four bits of a word are its selector, which gives the number of ids in the other 60 bits. Selector 0 escapes:
the low bits count the raw 64-bit values that follow, for values of over 60 bits. Ids are packed in blocks of
BLOCK_IDS, and a row of a file lists where each block starts, so that readers can decode blocks on their own and with
array operations. The files are Parquet: Spark's committer makes them whole even when executors are lost.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_transducer import vocabulary_path
from .common import Scratch, as_bytes, slices, table

#: Ids per word by selector (fixed values); selector 0 escapes.
COUNTS = [0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0] + [60 // c for c in COUNTS[1:]]
BLOCK_IDS = 4096
PUNCTUATION = ".,;:!?%&$#*|"


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    out = np.ones(len(values), np.uint8)
    for b in range(1, 64):
        over = values >> np.uint64(b) > 0
        if not over.any():
            break
        out += over
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of uint64 values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    need = widths(values)
    padded = np.concatenate([need, np.ones(64, np.uint8)])  # what lies behind the end fits anywhere
    best = np.zeros(n, np.uint8)
    most = {0: padded}  # of 2**k values from each position on
    for k in range(1, 6):
        m = most[k - 1]
        most[k] = np.maximum(m[: -(1 << (k - 1))], m[1 << (k - 1) :])
    for s in range(len(COUNTS) - 1, 0, -1):
        c = COUNTS[s]
        m = most[c.bit_length() - 1]
        fits = np.maximum(m[:n], m[c - (1 << (c.bit_length() - 1)) :][:n]) <= BITS[s]
        best[fits] = s
    step = np.array([1, *COUNTS[1:]])[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts)
    chosen = best[start]
    room = np.concatenate([values, np.zeros(60, np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        at = np.nonzero(chosen == s)[0]
        for j in range(COUNTS[s]):
            words[at] |= room[start[at] + j] << np.uint64(j * BITS[s])
    if not (chosen == 0).any():
        return words
    big = np.nonzero(chosen == 0)[0]
    words[big] = 1
    return np.insert(words, big + 1, values[start[big]])


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of Simple-8b words."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if not selector.all():  # raw values may look like anything: find the escapes one after the other
        at = 0
        while True:
            zero = np.nonzero(selector[at:] == 0)[0]
            if not len(zero):
                break
            at += int(zero[0])
            count = int(words[at])
            raw[at : at + 1 + count] = True
            selector[at] = 0
            selector[at + 1 : at + 1 + count] = len(COUNTS)
            at += 1 + count
    sizes = np.array([*COUNTS, 1])[selector]
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in np.unique(selector[~raw]):
        at = np.nonzero((selector == s) & ~raw)[0]
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
        mask = np.uint64((1 << BITS[s]) - 1)
        out[start[at][:, None] + np.arange(COUNTS[s])] = (words[at][:, None] >> shifts) & mask
    escaped = np.nonzero(selector == len(COUNTS))[0]
    out[start[escaped]] = words[escaped]
    return out[:n]


def pack_blocks(values: np.ndarray) -> tuple[bytes, list[int]]:
    """Words of all blocks, and the first word of each block."""
    packed = [pack(values[at : at + BLOCK_IDS]) for at in range(0, len(values), BLOCK_IDS)]
    starts = np.cumsum([0, *map(len, packed)])[:-1].tolist() if packed else []
    return b"".join(w.astype("<u8").tobytes() for w in packed), starts


def unpack_blocks(data: bytes, starts, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8")
    ends = [*starts[1:], len(words)]
    parts = [unpack(words[a:b], min(BLOCK_IDS, n - k * BLOCK_IDS)) for k, (a, b) in enumerate(zip(starts, ends))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class CachedTokenizer:
    """The tokenizers library, asked once for each word in reach of a bounded cache.

    Only for vocabularies that drop white space and never look across it, as word_bpe_49k.json: there the ids of a text
    are those of its words between ASCII blanks.
    """

    def __init__(self, path: str, limit: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _ask(self, cores: list[str]) -> None:
        for at in range(0, len(cores), 4096):
            some = cores[at : at + 4096]
            for w, c in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.cores[w] = array("I", c.ids).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """In ASCII words letters and the punctuation behind them are tokens apart, and letters count in lower case: many
        words share these parts, and only new parts go to the library. Other words go whole, as composing characters or
        lower case may tie their letters to the punctuation."""
        parts = []
        for w in words:
            shown = w.decode("utf-8", "replace")
            head = shown.rstrip(PUNCTUATION)
            plain = shown.isascii() and head.isalpha()
            parts.append((w, head.lower() if plain else shown, shown[len(head) :] if plain else ""))
        self._ask(list({p for _, head, tail in parts for p in (head, tail) if p and p not in self.cores}))
        for w, head, tail in parts:
            self.known[w] = self.cores[head] + self.cores[tail] if tail else self.cores[head]

    def __call__(self, text: bytes | None) -> bytes:
        """Ids of a text as little-endian uint32."""
        words = (text or b"").split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.limit:
                self.known.clear()
                self.cores.clear()
                found = [None] * len(words)
            self._learn({w for w, x in zip(words, found) if x is None})
            found = list(map(self.known.get, words))
        return b"".join(found)


TOKENIZERS: dict[str, CachedTokenizer] = {}  # of this Python worker
FILE_SCHEMA = "part int, first long, n_ids int, doc_ids array<long>, doc_tokens array<int>, block_words array<int>, words binary"


def write_token_files(docs: DataFrame, where: str, path: str | None = None, end_id: int = 1, row_ids: int = 1 << 16) -> DataFrame:
    """Encodes all texts and writes their ids in ascending doc_id order; returns the written rows.

    Documents are dealt by ranges of doc_id, so one shuffle of the texts orders the corpus; `part` numbers the ranges
    and `first` is the place of a row's first id within its part. Null doc_ids come first, rows with the same doc_id
    follow each other ordered by text; null and empty texts hold the end id alone.
    """
    path = path or vocabulary_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if path not in TOKENIZERS:
            TOKENIZERS[path] = CachedTokenizer(path)
        encode, end, part, first = TOKENIZERS[path], np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("block_words", pa.list_(pa.int32())), ("words", pa.binary())])
        ids, names, sizes = [], [], []

        def row():
            nonlocal first
            values = np.frombuffer(b"".join(ids), "<u4")
            words, starts = pack_blocks(values.astype(np.uint64))
            out = {"part": part, "first": first, "n_ids": len(values), "doc_ids": names.copy(), "doc_tokens": sizes.copy(), "block_words": starts, "words": words}
            first += len(values)
            for x in (ids, names, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([out], schema)

        held = 0
        for whole in batches:
            for batch in slices(whole):
                for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                    ids.append(encode(text) + end)
                    names.append(doc)
                    sizes.append(len(ids[-1]) // 4)
                    held += sizes[-1]
                    if held >= row_ids:
                        yield row()
                        held = 0
        if names:
            yield row()

    chosen = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ordered = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(where)
    return docs.sparkSession.read.parquet(where)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files."""
    return _decoded(files, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: ids.astype(np.int32).tolist())


def digest_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return _decoded(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _decoded(files: DataFrame, schema: str, shown) -> DataFrame:
    # One row for each written part, whatever the number of documents: small enough for one window and a broadcast.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    last = schema.split(", ")[3].split(" ")[0]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: batch.column(k)[r].as_py() for k in ("base", "first", "n_ids", "doc_ids", "doc_tokens", "block_words", "words")}
                values = unpack_blocks(row["words"], row["block_words"], row["n_ids"])
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts + row["base"] + row["first"], pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()),
                    last: pa.array([shown(values[a:b]) for a, b in zip(starts, ends)], pa.list_(pa.int32()) if last == "ids" else pa.int64()),
                })

    return files.join(F.broadcast(bases), "part").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = Scratch(spark, "op5").root + "/tokens"
    return digest_token_files(write_token_files(table(spark, sf_dir, "documents"), where))
