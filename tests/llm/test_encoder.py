"""The encoder's ids against the tokenizer's own, text by text."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from itembank.llm import packing


def encoded(encoder, texts):
    out = []
    for _, ids, to in encoder.encoded(pa.array(texts, pa.string()), 1):
        out += [ids[a:b].tolist() for a, b in zip(to, to[1:])]
    return out


def wanted(encoder, texts):
    return [[*e.ids, 1] for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


def test_every_code_point_in_several_settings(encoder):
    assert encoder.by_chunks and encoder.by_letters and encoder.cuts_tails
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for setting in ("{}", "a{}b", "Word{}. x", "{}.{} é{},"):
        texts = [setting.format(*[c] * setting.count("{}")) for c in letters]
        assert encoded(encoder, texts) == wanted(encoder, texts)


def test_random_texts(encoder, monkeypatch):
    rng = random.Random(3)
    parts = [*"abzABZ019'.,;:!?%&$*#()[]\"<|> \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 　́éÉßñ×÷ΣяИ中🎈_-", "<|endoftext|>", "'s", "Don't", "été", "!!!"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(20_000)] + [None, "", "x" * 3000 + "!" * 3000, "word " * 5000]
    want = wanted(encoder, texts)
    assert encoded(encoder, texts) == want
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    assert encoded(encoder, texts) == want


def test_long_words_are_kept_nowhere(encoder, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000)) + " short words." for _ in range(2000)]
    encoder._forget()
    for lo in range(0, len(texts), 200):
        for _, ids, to in encoder.encoded(pa.array(texts[lo : lo + 200], pa.string()), 1):
            assert len(ids) == to[-1]
    assert encoder.pool.n < 100 and encoder.sizes.n < 10 and encoder.pool.room.nbytes < 10_000
    assert encoded(encoder, texts[:3]) == wanted(encoder, texts[:3])
    monkeypatch.setattr(packing, "CACHE_IDS", 500)
    many = [" ".join("".join(rng.choices("qxzj", k=200)) for _ in range(30)) for _ in range(40)]
    assert encoded(encoder, many) == wanted(encoder, many)


@pytest.mark.parametrize("lower", [False, True])
def test_other_tokenizers(tmp_path, lower):
    words = {w: i for i, w in enumerate(["?", "Hello", "hello", "world", "World", "hello.", "x", ".", ",", "été", "don't", "word", "Word", "x."])}
    t = Tokenizer(models.WordLevel(words, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    if lower:
        t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "t.json"))
    own = packing.Encoder(str(tmp_path / "t.json"))
    texts = ["Hello hello World world.", "hello. x , x. Word WORD", "", "?\x1cx x"]
    assert encoded(own, texts) == wanted(own, texts)


def test_a_tokenizer_that_keeps_white_space():
    import public_tokenizers

    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  world\n\n x", " a b", "", "été!! <|endoftext|>"]
    assert not own.by_chunks and encoded(own, texts) == wanted(own, texts)
