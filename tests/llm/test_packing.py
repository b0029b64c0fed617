"""Ids of texts put together from words and their parts."""

import random

import pyarrow as pa
import pytest

from tidewell.llm.packing import VOCABULARY, WordTokens

SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "don't", "WE'RE", "''s", "İ", "J̌", "ΑΣ", "ﬁ", "日本", "\xa0", "\x85", "\x1c"]


@pytest.fixture
def words():
    import public_tokenizers

    return WordTokens(public_tokenizers.path(VOCABULARY))


def assert_same_ids(words, texts, tokenizer=None):
    tokenizer = tokenizer or words.tokenizer
    want = tokenizer.encode_batch([text or "" for text in texts], add_special_tokens=False)
    for text, got, encoding in zip(texts, words.encode(pa.array(texts, pa.string())), want, strict=True):
        assert got.tolist() == encoding.ids, text


def test_pairs_of_latin_characters_and_special_words(words):
    latin = [chr(i) for i in range(256)]
    assert_same_ids(words, [f"{a}{b} a{a}'{b}Y" for a in latin for b in latin])
    rng = random.Random(3)

    def text():
        parts = [rng.choice(rng.choice([SPECIAL, latin])) + rng.choice(["", " ", "\r\n", "\v"]) for _ in range(rng.randrange(25))]
        return "".join(parts)

    assert_same_ids(words, [None, "", " \n", *[text() for _ in range(5000)]])


def test_blocks_of_nothing(words):
    assert [ids.tolist() for ids in words.encode(pa.array([None], pa.string()))] == [[]]
    assert [ids.tolist() for ids in words.encode(pa.array(["", None, " \n "]))] == [[], [], []]


def test_words_of_known_parts_need_no_tokenizer(words):
    tokenizer = words.tokenizer
    words.encode(pa.array(["zqxvé ñandu $$$ ( )! ' 1 2 's"]))

    class Untouched:
        def __getattr__(self, name):
            raise AssertionError(name)

    words.tokenizer = words.parts = Untouched()
    texts = ["(zqxvé)! ÑANDU's $$$12", "zqxvé$$$\n'ñandu'", None]
    assert_same_ids(words, texts, tokenizer)
