"""Encoding, decoding and counting against the tokenizers library."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from parcelgrid.llm.merge_automaton import Codec, MergeAutomaton, decode, encode_decode  # noqa: E402
from parcelgrid.llm.merge_counts import MergeCounter, count_tokens  # noqa: E402
from parcelgrid.llm.queries import tokenizer_path  # noqa: E402
from parcelgrid.llm.wordsplit import WordCache  # noqa: E402


@pytest.fixture(scope="module")
def spec():
    with open(tokenizer_path()) as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    found = tokenizers.Tokenizer.from_str(spec)
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    rng = random.Random(5)
    parts = ["a", "aa", "b", "the", "'s", "'", "'LL", " ", "\n", "1", "²", "ª", "İ", "Σ", "ς", "<|endoftext|>",
             "<|startoftext|>", "<|endoftext", "|>", "é", "é", "\x85", "\x1c", "​", "!!", "Ɔ", "ǘ", "ß", "漢字"]
    made = ["", " ", "\n\t", "aaaaaaa", "word " * 5000, "x" * 3000]
    for _ in range(800):
        made.append("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
        made.append("".join(rng.choice("aabeethhiinngr") for _ in range(rng.randint(0, 30))))
        made.append("".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)]))
                            for _ in range(rng.randint(0, 20))))
    return made


def test_codec_equals_library(spec, library):
    codec, counter = Codec(spec), MergeCounter(spec)
    made = texts()
    for text, want in zip(made, library.encode_batch(made, add_special_tokens=False)):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
        assert counter.count_text(text) == len(want.ids)


def test_gadgets_on_a_small_merge_table():
    """Every string over {a, b} up to 7 symbols: the automaton's path is what merging in rank order gives."""
    from itertools import product

    from parcelgrid.llm.wordsplit import byte_symbols

    symbols = byte_symbols()
    vocab = {s + e: k for k, (e, s) in enumerate((e, s) for e in ("", "</w>") for s in symbols)}
    merges = [["a", "a"], ["a", "b"], ["aa", "b"], ["b", "a"], ["aa", "aa"], ["ab", "a</w>"], ["ba", "b</w>"], ["a", "a</w>"]]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    names = {k: s for s, k in vocab.items()}
    automaton = MergeAutomaton(vocab, merges, "</w>")
    for n in range(1, 8):
        for word in map("".join, product("ab", repeat=n)):
            held = [*word[:-1], word[-1] + "</w>"]
            for pair in merges:
                at = 0
                while at + 1 < len(held):
                    if held[at:at + 2] == pair:
                        held[at:at + 2] = ["".join(pair)]
                    at += 1
            assert [names[t] for t in automaton.encode(word.encode())] == held


def test_bad_merge_table_is_refused():
    from parcelgrid.llm.wordsplit import byte_symbols

    vocab = {s: k for k, s in enumerate(byte_symbols())} | {s + "</w>": 300 + k for k, s in enumerate(byte_symbols())} | {"abc": 256, "ab": 257}
    with pytest.raises(ValueError):
        MergeAutomaton(vocab, [["ab", "c"]], "</w>")


def test_word_cache_keeps_few():
    made = []
    cache = WordCache(lambda w: made.append(w) or len(w), size=2, longest=3)
    assert [cache[w] for w in ("a", "bb", "ccc", "a", "dddd", "dddd")] == [1, 2, 3, 1, 4, 4]
    assert len(cache) <= 2 and made.count("dddd") == 2 and made.count("a") == 1


def test_frames_and_odd_rows(spark, docs_of, library):
    rows = [(1, "Hello <|endoftext|> World"), (2, None), (3, ""), (1, "Hello <|endoftext|> World"), (None, "x"),
            (4, "très long " * 20000)]
    docs = docs_of(rows)
    coded = encode_decode(docs, tokenizer_path())
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in coded.collect())
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id is None, doc_id or 0, len(ids), np.array(ids, "<u4").tobytes(),
                     library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    back = {(r.doc_id, r.decoded) for r in decode(coded, tokenizer_path()).collect()}
    assert back == {(r.doc_id, r.decoded) for r in coded.collect()}
    counted = count_tokens(docs, tokenizer_path(), limit=3).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == sorted(
        (i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids),
         len(library.encode(t or "", add_special_tokens=False).ids) > 3) for i, t in rows)
    assert encode_decode(docs.limit(0), tokenizer_path()).count() == 0
    assert count_tokens(docs.limit(0), tokenizer_path()).count() == 0


def test_a_very_long_word_costs_its_own_length(spec, library):
    import time

    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    codec = Codec(spec)
    began = time.monotonic()
    ids = codec.encode(word)
    assert time.monotonic() - began < 15  # a quadratic walk takes many minutes
    part = word[:100_000]
    assert codec.encode(part) == np.array(library.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
    assert codec.decode(ids).replace(" ", "").replace("</w>", "") == word
