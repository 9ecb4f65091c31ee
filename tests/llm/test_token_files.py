import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stationlake.llm import token_files as T
from stationlake.llm.bpe_transducer import vocabulary_path


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**60 - 1), st.integers(2**60, 2**64 - 1)), max_size=300))
def test_round_trip(values):
    array = np.array(values, np.uint64)
    words = T.pack(array)
    assert T.unpack(words, len(values)).tolist() == values
    data, starts = T.pack_blocks(array)
    assert T.unpack_blocks(data, starts, len(values)).tolist() == values


def test_dense_and_long():
    rng = np.random.default_rng(0)
    for top in (2, 5, 50, 49408, 1 << 40):
        values = rng.integers(0, top, 20_000).astype(np.uint64)
        data, starts = T.pack_blocks(values)
        assert (T.unpack_blocks(data, starts, len(values)) == values).all() and len(starts) == 5
        assert len(data) <= 8 * len(values)
    assert len(T.pack(np.zeros(600, np.uint64))) == 10


def brute(rows):
    tok, at, out = Tokenizer.from_file(vocabulary_path()), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(80), " ".join(rng.choice(["the", "Haus,", "naïve", "x<|endoftext|>y", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [(None, "a b"), (3, None), (4, ""), (5, "long " * 40_000), (-7, "first")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int").repartition(5)
    files = T.write_token_files(df, f"{tmp_path}/t", row_ids=200)
    got = sorted(map(tuple, T.digest_token_files(files).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    whole = {(r.doc_id, r.start): r.ids for r in T.read_token_files(files).collect()}
    assert all(zlib.crc32(np.array(whole[d, s], "<u4").tobytes()) == c and len(whole[d, s]) == n for d, s, n, c in got)


def test_empty(spark, tmp_path):
    files = T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert T.digest_token_files(files).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, T.query(spark, sf).collect()), key=lambda r: r[1]) == brute([tuple(r) for r in docs])


def test_ids_of_every_character():
    """All assigned characters before, behind and between punctuation and letters, whole texts against the library."""
    import unicodedata

    tok, own = Tokenizer.from_file(vocabulary_path()), T.CachedTokenizer(vocabulary_path())
    shown = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    shown = [c for c in shown if not "\u3400" <= c <= "\u9fff" and not "\uac00" <= c <= "\ud7a3" and c < "\U00017000"]
    texts = [" ".join(x for c in shown[i : i + 200] for x in (f"{c}.", f".{c}", f"a{c},", f"{c}b!?", f"A{c}b.{c}")) for i in range(0, len(shown), 200)]
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        got = np.frombuffer(own(text.encode()), "<u4").tolist()
        assert got == want.ids, text[:50]


def test_words_in_reach_of_the_cache_are_asked_for_once():
    """210,000 words fit; a cache of 200,000 forgot all of them when one more came."""
    letters = "abcdefghij"
    words = " ".join("".join(letters[int(d)] for d in str(i)) for i in range(210_000)).encode()
    encode, asked = T.CachedTokenizer(T.vocabulary_path()), []
    ask = encode._ask
    encode._ask = lambda cores: asked.extend(cores) or ask(cores)
    first, _, again = (encode(t) for t in (words, b"zz", words))
    assert first == again and len(asked) == len(set(asked)) == 210_001
