"""What the operators of this subpackage share: reading tables, shared scratch tables, word splitting and hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stationlake-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


class Scratch:
    """Intermediate tables of one run, written as Parquet into the shared folder.

    A written table cuts the lineage: executors that are lost later cost a reread, not a recomputation. Tables go with
    drop() once nothing needs them, and the whole folder goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        conf, where = self.spark.conf, f"{self.root}/{name}"
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")  # the shuffle files of a finished write are of no more use
        try:
            df.write.mode("overwrite").parquet(where)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many _ in front as it takes to clash with no column of df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return ["_" * next(k for k in range(1, len(taken) + 2) if "_" * k + n not in taken) + n for n in names]


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8 (bytes.split() knows exactly these six blanks)."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


class WordHashes:
    """128-bit hashes of words as two uint64 arrays, with a bounded cache from word to row."""

    def __init__(self, limit: int = 100_000, key=None):
        self.limit, self.key = limit, key
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.first = np.empty(1024, np.uint64)
        self.second = np.empty(1024, np.uint64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > self.limit:
            self._clear()
        rows = self.rows
        for word in set(words).difference(rows):
            at = len(rows)
            if at == len(self.first):
                self.first, self.second = np.resize(self.first, 2 * at), np.resize(self.second, 2 * at)
            shown = word if self.key is None else self.key(word)
            digest = hashlib.blake2b(shown, digest_size=16).digest()
            self.first[at] = int.from_bytes(digest[:8], "little")
            self.second[at] = int.from_bytes(digest[8:], "little")
            rows[word] = at
        at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        return self.first[at], self.second[at]


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = np.asarray(x, np.uint64)
    if not x.ndim:
        return mix(x.reshape(1))[0]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, bool)
BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes of eight
LONG_WORD = 256  # bytes; longer words are hashed one by one


def word_spans(column, lower: bool = False):
    """Where the words of an Arrow text column lie: (bytes of all texts end to end, start, length and text of each word).

    Null texts have no words. With `lower`, A-Z become a-z in the bytes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.empty(0, np.uint8) if values is None else np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    gap = BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= gap[:-1]
    closes[:-1] |= gap[1:]
    start = np.nonzero(opens & ~gap)[0]
    length = np.nonzero(closes & ~gap)[0] + 1 - start
    return data, start, length, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(column, lower: bool = False):
    """(text, first, second): the text and the 128-bit hash of every word of an Arrow text column.

    Words are taken eight bytes at a time in arrays over all words, so that new words cost no more than known ones.
    """
    data, start, length, text = word_spans(column, lower)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    first, second = length.astype(np.uint64) * M1, length.astype(np.uint64) * M2
    at = np.arange(len(start))
    for begin in range(0, LONG_WORD, 8):
        if begin:
            at = at[length[at] > begin]
        if not len(at):
            break
        piece = eight[start[at] + begin] & LEFT[np.minimum(length[at] - begin, 8)]
        first[at] = mix(first[at] * M2 + piece)
        second[at] = mix(second[at] * M1 ^ ~piece)
    for i in np.nonzero(length > LONG_WORD)[0]:
        digest = hashlib.blake2b(data[start[i] : start[i] + length[i]].tobytes(), digest_size=16).digest()
        first[i], second[i] = np.frombuffer(digest, "<u8")
    return text, first, second


def rolling(h: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hashes of all windows of `width` consecutive values, by doubling: log2(width) passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, have, span, power = None, 0, h, 1, factor
    rest = width
    while rest:
        if rest & 1:  # append a piece of `span` values after the `done` values so far
            piece = have[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += span
        rest >>= 1
        if rest:
            have = have[: len(have) - span] * power + have[span:]
            span, power = 2 * span, np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def slices(batch, column: str = "text", target: int = 4_000_000):
    """Cuts an Arrow batch into slices of about `target` bytes of text, one row at least, so that memory stays bounded."""
    import pyarrow as pa
    import pyarrow.compute as pc

    pa.set_memory_pool(pa.system_memory_pool())  # gives memory back that batches no longer need
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes, dtype=np.int64) // target
    cuts = [0, *(np.nonzero(np.diff(parts))[0] + 1), batch.num_rows]
    for at, to in zip(cuts, cuts[1:]):
        if to > at:
            yield batch.slice(at, to - at)


def as_bytes(column) -> list:
    """The texts of an Arrow column as UTF-8 bytes, None for null."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


HOT_KEYS = 20_000  # at most so many keys can hold more than one row in HOT_KEYS


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, count: str = "n") -> DataFrame:
    """The rows that have a partner in keys, with the other columns of keys; `count` says how many rows a key has.

    Keys with more than one row in HOT_KEYS of all, HOT_KEYS at most, are broadcast, so their rows stay where they are;
    all other rows meet their key in a shuffle.
    """
    bound = max(total // HOT_KEYS, 10_000)
    hot = F.broadcast(keys.where(F.col(count) > bound).drop(count))
    rest = keys.where(F.col(count) <= bound).drop(count)
    cold = rows.join(hot.select(*on), on, "left_anti").join(rest, on)
    return rows.join(hot, on).select(*cold.columns).union(cold)


def row_key(*cols: str) -> Column:
    """Tells rows apart that share an id: a 64-bit hash of the given columns."""
    return F.xxhash64(*[F.col(c) for c in cols])
