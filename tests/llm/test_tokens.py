"""The ids of whole texts beside the library's, and what of them is asked of it."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowgauge.llm import tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_letters_go_straight_to_the_model(monkeypatch, path):
    made, sent = tokens.Encoder(path), []
    monkeypatch.setattr(made, "batch", lambda texts, f=made.batch: sent.extend(texts) or f(texts))
    text = "Straße the, of.\nThe,*** naïve x-y"
    got = [i.tolist() for i in made.ids(pa.array([*[text] * 300, None]))]
    assert got == [ids_of(path, text)] * 300 + [[]]
    assert {t for t in sent if any(c.isalpha() for c in t)} == {"Straße", " x-y"}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_each_piece_is_looked_up_once_a_batch(monkeypatch, path):
    rng, asked = random.Random(5), []
    parts = ["the", "Ünd,", "of.\nThe", "don't", "4.0", "日本", "<|endoftext|>", "İı", "é́", "a ", "　", "\x1c", "\t", "", "x" * 60]
    texts = [rng.choice(["", " "]) + " ".join(rng.choices(parts, k=40)) for _ in range(150)]
    texts += [" ".join(rng.choices(parts[:6], k=40)) for _ in range(150)]
    made, keep = tokens.Encoder(path), tokens.Memory.values
    monkeypatch.setattr(tokens.Memory, "values", lambda self, words, *more: asked.append(words) or keep(self, words, *more))
    library = Tokenizer.from_file(path)
    for some in (texts, texts[150:]):
        got = [i.tolist() for i in made.ids(pa.array(some))]
        assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert len(asked) == 2 and all(len(words) == len(set(words)) for words in asked) and sorted(asked[1]) == sorted(parts[:6])
