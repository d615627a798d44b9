"""Encoding held against the tokenizer library: every code point, special strings, and random texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ripplespark.llm.bpe import WordBPE

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def differing(library, texts):
    ids, count = WordBPE(PATH).encode(texts)
    at, out = 0, []
    for text, n, real in zip(texts, count.tolist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        if ids[at : at + n].tolist() != real.ids:
            out.append(text)
        at += n
    return out


@pytest.mark.parametrize("around", ["a%s1", "á̕%ṣ", "%ś.%s's"])
def test_every_code_point(library, around):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Forty to a text, each between blanks, so that all take part in one pass.
    texts = [" ".join(around.replace("%s", c) for c in points[k : k + 40]) for k in range(0, len(points), 40)]
    assert [t.encode("unicode_escape")[:80] for t in differing(library, texts)] == []


def test_special_strings_and_their_look_alikes(library):
    texts = ["\x00<|ENDOFTEXT|>", "\x00<|StartOfText|>", "\x00<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "('<|endoftext|>',)"]
    assert differing(library, texts + texts[::-1]) == []


def test_random_texts(library):
    rng = random.Random(11)
    pools = ["abcXYZ 019'.,", "áÉßΣσς İıǅ", "̣́࢘̕᫏ͅ", "日本語中文한국", "\U0001f600‍\U0001f3fd️", "ᲉꟋꟜ\U00010d50\U00016ea0\U000323b0\U0003d000", "\t\n\x0b\x1c\x85\xa0 ", "\x00<|>endoftext"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 30))) for _ in range(60_000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x3FFFF)])) for _ in range(rng.randint(1, 20))) for _ in range(40_000)]
    assert [t.encode("unicode_escape") for t in differing(library, texts)][:5] == []
