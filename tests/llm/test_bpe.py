import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from stationlake.llm import bpe_transducer as B


@pytest.fixture(scope="module")
def both():
    path = B.vocabulary_path()
    return Tokenizer.from_file(path), B.MergeTable(path)


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    shown = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_equals_the_library(spark, both):
    tok, _ = both
    texts = [
        None, "", " \t\n", "Hello, world!", "don't we'll I'VE 'Sail", "naïve Ελλάς ΣΑΣ Σ İstanbul ǅ",
        "a<|endoftext|>b <|startoftext|> <|endoftext", "é ́x a b c\x85d\x1ce", "٣4½ x²", "日本語テキスト 🙂🙃👍🏽",
        "x" * 5000, "abc" * 3000 + " tail", "\x00\x01 ok", "Ünïcödé​zero", "a b",
    ]
    rng = random.Random(5)
    texts += ["".join(rng.choice("aehinorst'É ß.,<|>9\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in B.encode_and_decode(df).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == expected(tok, t), repr(t)[:80]


def test_streaming_equals_whole(both):
    """Words of any length, pushed in pieces, get the tokens of the whole word."""
    tok, table = both
    rng = random.Random(1)
    assert 0 < table.lookahead < 2000
    for n in (1, 2, 63, 500, 6000):
        for letters in ("aeinorst", "ab", "a", "thaner"):
            word = "".join(rng.choice(letters) for _ in range(n))
            symbols = [table.inner[b] for b in word.encode()[:-1]] + [table.last[word.encode()[-1]]]
            encoder, out, at = B.Encoder(table, block=16), [], 0
            while at < len(symbols):
                step = rng.randrange(1, 50)
                out += encoder.push(symbols[at : at + step])
                at += step
                assert len(encoder.kept) <= table.lookahead + 2 * 16 + 64
            out += encoder.finish()
            assert out == tok.encode(word, add_special_tokens=False).ids


def test_lookahead_by_brute_force():
    """On small merge lists no continuation moves a boundary that has the lookahead behind it."""
    rng = random.Random(3)
    for _ in range(30):
        strings, merges = {0: "a", 1: "b", 2: "c"}, []
        while len(merges) < 8:
            a, b = rng.choice(list(strings)), rng.choice(list(strings))
            made = next((i for i, s in strings.items() if s == strings[a] + strings[b]), len(strings))
            if (a, b) not in [m[:2] for m in merges] and len(strings[a] + strings[b]) < 7:
                strings[made] = strings[a] + strings[b]
                merges.append((a, b, made))
        table = B.MergeTable.__new__(B.MergeTable)
        table.merges = {a << 20 | b: r << 20 | m for r, (a, b, m) in enumerate(merges)}
        ahead = B.sufficient_lookahead(merges)

        def ends(word):
            out, at = [], 0
            for t in table.merge([ord(c) - 97 for c in word]):
                at += len(strings[t])
                out.append(at)
            return out

        for _ in range(60):
            head = "".join(rng.choice("abc") for _ in range(ahead + 8))
            kept = [e for e in ends(head) if e <= len(head) - ahead]
            for _ in range(4):
                more = head + "".join(rng.choice("abc") for _ in range(12))
                assert ends(more)[: len(kept)] == kept


def test_decoder_states(both):
    tok, table = both
    ids = tok.encode("naïve café 🙂 x", add_special_tokens=False).ids
    one, many = B.Decoder(table, True), B.Decoder(table, True)
    whole = one.feed(ids) + one.finish()
    assert whole == "naïve café 🙂 x " == "".join(many.feed([i]) for i in ids) + many.finish()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode_and_decode(empty).collect() == []
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in B.encode_and_decode(twice).collect()) == [0, 2, 2]


def test_words_in_reach_of_the_cache_are_encoded_once(both, monkeypatch):
    """160,000 words fit; a cache of 150,000 forgot all of them when one more came."""
    _, table = both
    letters = "abcdefghij"
    words = " ".join("".join(letters[int(d)] for d in str(i)) for i in range(160_000)).encode()
    calls, merge = [], table.merge
    monkeypatch.setattr(table, "merge", lambda symbols: calls.append(1) or merge(symbols))
    encoder = B.TextEncoder(table)
    first, _, again = (list(encoder.text(t)) for t in (words, b"zz", words))
    assert first == again and len(calls) <= 160_001
