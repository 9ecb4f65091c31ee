"""BPE encoding and decoding as streaming transducers with bounded lookahead.

The encoder reads symbols from left to right and keeps only those whose tokens may still change. How far the future
can reach back is computed from the merge list (`sufficient_lookahead`): a token boundary changes only if a merge to
its right is pre-empted by one of lower rank further right, and so on along a chain of falling ranks. A boundary with
that many symbols behind it is final, its tokens are emitted and forgotten, so memory stays constant however long a
text or a word is. The decoder is a state machine from token ids over bytes to text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, slices, table

NONE = 1 << 62


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class MergeTable:
    """The merge list of a tokenizer file: symbol ids, ranked merges and the lookahead that they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in (self.ids | self.specials).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = [self.ids[c] for c in symbols]
        self.last = [self.ids[c + self.suffix] for c in symbols]
        self.merges: dict[int, int] = {}
        self.ordered: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges.setdefault(a << 20 | b, rank << 20 | made)
            self.ordered.append((a, b, made))
        self.lookahead = sufficient_lookahead(self.ordered)
        self._shown: dict[int, bytes] = {}
        self._raw: dict[int, bytes] = {}

    def shown_bytes(self) -> dict[int, bytes]:
        """The strings of all tokens."""
        if not self._shown:
            self._shown = {i: t.encode() for i, t in self.strings.items()}
        return self._shown

    def raw_bytes(self) -> dict[int, bytes]:
        """The bytes that tokens stand for; the end of a word is a blank."""
        if not self._raw:
            of = {c: b for b, c in enumerate(byte_symbols())}
            for i, t in self.strings.items():
                core = t.removesuffix(self.suffix) if self.suffix else t
                self._raw[i] = bytes(of[c] for c in core) + (b" " if core != t else b"")
        return self._raw

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the merges in place: always the lowest rank, the leftmost on ties."""
        get, none = self.merges.get, NONE
        ranked = [get(a << 20 | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranked and (best := min(ranked)) != none:
            at, made = ranked.index(best), best & 0xFFFFF
            del symbols[at], ranked[at]
            symbols[at] = made
            if at:
                ranked[at - 1] = get(symbols[at - 1] << 20 | made, none)
            if at < len(ranked):
                ranked[at] = get(made << 20 | symbols[at + 1], none)
        return symbols


def sufficient_lookahead(merges: list[tuple[int, int, int]]) -> int:
    """Symbols that must follow a token boundary until nothing to come can move it.

    In rank order, reach[a] is how far to its right a symbol a must see before all merges (a, b) so far are settled: the
    length of b and what b itself, or a symbol at its right end that it is made from, must see for merges of lower rank.
    """
    parts, size, reach = {}, {}, {}

    def sees(symbol: int) -> int:
        most = 0
        while symbol is not None:
            most = max(most, reach.get(symbol, 0))
            symbol = parts.get(symbol)
        return most

    for a, b, made in merges:
        reach[a] = max(reach.get(a, 0), size.get(b, 1) + sees(b))
        if made not in size:
            size[made], parts[made] = size.get(a, 1) + size.get(b, 1), b
    return max(reach.values(), default=0)


class Encoder:
    """Streams the symbols of one word; push() and finish() return the ids that have become final."""

    def __init__(self, table: MergeTable, block: int = 256):
        self.table, self.block, self.kept, self.sizes = table, max(block, 1), [], None

    def push(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(symbols), self.block):
            self.kept += symbols[at : at + self.block]
            if len(self.kept) >= self.block + self.table.lookahead:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Emits the tokens that end at least `lookahead` symbols before the end of what is known."""
        final, covered, limit = [], 0, len(self.kept) - self.table.lookahead
        for token in self.table.merge(list(self.kept)):
            end = covered + self._size(token)
            if end > limit:
                break
            final.append(token)
            covered = end
        self.kept = self.kept[covered:]
        return final

    def _size(self, token: int) -> int:
        return len(self.table.strings[token].removesuffix(self.table.suffix))

    def finish(self) -> list[int]:
        out, self.kept = self.table.merge(self.kept), []
        return out


class Decoder:
    """Ids to text, piece by piece. A file without a decoder joins its tokens' strings with blanks; with
    byte_level=True the tokens' bytes are put together, and a character is given out once all its bytes are there."""

    def __init__(self, table: MergeTable, byte_level: bool = False):
        self.begun, self.state = False, codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.pieces, self.gap = (table.raw_bytes(), b"") if byte_level else (table.shown_bytes(), b" ")

    def feed(self, ids: list[int]) -> str:
        pieces = self.pieces
        data = self.gap.join([pieces[i] for i in ids if i in pieces])
        if data and self.begun:
            data = self.gap + data
        self.begun = self.begun or bool(data)
        return self.state.decode(data)

    def finish(self) -> str:
        """The rest of an unfinished character; the decoder is as new afterwards."""
        rest, self.begun = self.state.decode(b"", True), False
        self.state.reset()
        return rest


class TextEncoder:
    """Encodes whole texts word by word (white space always separates tokens); short words come from a bounded cache.

    A word is (ids as little-endian uint32, decoded bytes). Its pieces are kept so, too: the strings of tokens are whole
    characters, so that what is decoded of a word is that of its pieces, joined with blanks.
    """

    def __init__(self, table: MergeTable, cache: int = 500_000, longest: int = 64):
        self.table, self.limit, self.longest = table, cache, longest
        self.special = re.compile("|".join(map(re.escape, table.specials))) if table.specials else None
        self.strings = table.shown_bytes()
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def word(self, data: bytes) -> tuple[bytes, bytes]:
        known = self.pieces.get
        if data.isalpha():  # of ASCII letters alone, as most words are
            piece = data.decode().lower()
            return known(piece) or self._piece(piece)
        word, found, at = data.decode("utf-8", "replace"), [], 0
        for m in self.special.finditer(word) if self.special and "<" in word else ():
            found += self._split(word[at : m.start()])
            found.append(self._shown([self.table.specials[m[0]]]))
            at = m.end()
        found += self._split(word[at:] if at else word)
        return found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), b" ".join([x[1] for x in found]))

    def _split(self, word: str) -> list[tuple[bytes, bytes]]:
        if word.isascii():
            word = word.lower()
        else:
            word = unicodedata.normalize("NFC", word)
            word = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)
        known = self.pieces.get
        return [known(piece) or self._piece(piece) for piece in self.table.pieces.findall(word)]

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        table, data = self.table, piece.encode()
        inner = table.inner
        symbols = [inner[b] for b in data[:-1]]
        symbols.append(table.last[data[-1]])
        if len(symbols) <= self.longest:
            table.merge(symbols)
        else:
            encoder = Encoder(table)
            symbols = encoder.push(symbols) + encoder.finish()
        found = self.pieces[piece] = self._shown(symbols)
        return found

    def _shown(self, ids: list[int]) -> tuple[bytes, bytes]:
        shown = self.strings
        return array("I", ids).tobytes(), b" ".join([shown[i] for i in ids])

    def _known(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """What each word is."""
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.limit:
                self.known.clear()
                self.pieces.clear()
                found = [None] * len(words)
            for w in {w for w, x in zip(words, found) if x is None}:
                self.known[w] = self.word(w)
            found = list(map(self.known.get, words))
        return found

    def text(self, text: bytes | None, block: int = 1 << 16):
        """Streams (ids as little-endian uint32 bytes, decoded bytes) of a text, a block of words at a time."""
        words = (text or b"").split()
        begun = False
        for at in range(0, len(words), block):
            some = self._known(words[at : at + block])
            shown = b" ".join([x[1] for x in some if x[1]])
            yield b"".join([x[0] for x in some]), b" " + shown if begun and shown else shown
            begun = begun or bool(shown)


ENCODERS: dict[tuple[str, int], TextEncoder] = {}  # of this Python worker


def text_encoder(path: str, cache: int) -> TextEncoder:
    if (path, cache) not in ENCODERS:
        ENCODERS[path, cache] = TextEncoder(MergeTable(path), cache)
    return ENCODERS[path, cache]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = 500_000) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text decoded from them.

    A map without shuffle. Null and empty texts have no ids; rows are kept one to one, repeated ids and null ids too;
    other columns are ignored. `path` is the vocabulary file, `cache` the number of words that a Python worker remembers.
    """
    path = path or vocabulary_path()

    def run(batches):
        import pyarrow as pa

        encoder = text_encoder(path, cache)
        for whole in batches:
            for batch in slices(whole):
                counts, ids_sha, text_sha = [], [], []
                for text in as_bytes(batch.column("text")):
                    n, ids, shown = 0, hashlib.sha256(), hashlib.sha256()
                    for some, piece in encoder.text(text):
                        n += len(some) // 4
                        ids.update(some)
                        shown.update(piece)
                    counts.append(n)
                    ids_sha.append(ids.hexdigest())
                    text_sha.append(shown.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    chosen = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return chosen.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))
