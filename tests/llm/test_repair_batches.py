import random

import pytest

from quillon.llm import bpe, repair
from tests.llm.test_bpe import POOL

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture
def own():
    return repair.Encoder(bpe.default_vocabulary())


def expected(library, texts):
    return [bpe.pack(library.encode(t, add_special_tokens=False).ids, "H") for t in texts]


@pytest.mark.parametrize("factor", [None, 1])
def test_same_as_library(library, own, monkeypatch, factor):
    """With factor 1 pieces of the same letters collide, and texts are encoded one by one."""
    if factor:
        own.hash_by(factor)
    monkeypatch.setattr(own, "most", 500)
    rnd = random.Random(11)
    pool = [*POOL, *[" "] * 12, "\n", "don't", " we'll've", "_", "Ⅷ", "½", "ǅ"]
    texts = ["", *("".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(4000)), "th" * 3000, "", " "]
    assert own.encode_all(texts) == expected(library, texts)
    assert own.encode_all(texts) == expected(library, texts)  # from memory
    assert own.encode_all([]) == []


def test_every_settled_character(library, own):
    texts = [f"{c}a{c}b {c}1 {c}{c}\n{c}x {c}" for c in map(chr, range(0xD800)) if own.settled(c)]
    assert own.encode_all(texts) == expected(library, texts)


def test_small_memory(library, own, monkeypatch):
    monkeypatch.setattr(own.piece, "size", 5)
    texts = [f"word{k % 7} other, {chr(97 + k % 26)}and\nso" for k in range(200)]
    for k in range(0, 200, 20):
        assert own.encode_all(texts[k : k + 20]) == expected(library, texts[k : k + 20])


def test_new_words_share_calls(own):
    """A new word cost a call of the library each."""
    calls, model = [], own.model

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    own.model = Counted()
    words = ["".join(random.Random(k).choices("aeioukst", k=8)) for k in range(3200)]
    own.encode_all([" ".join(words[k : k + 40]) for k in range(0, 3200, 40)])
    assert len(calls) <= 3200 / 16 + 10 + 80  # first words of texts have no blank
