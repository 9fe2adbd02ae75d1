import hashlib
import random

import pytest

from quillon.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = bpe.default_vocabulary()
POOL = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "Z", "é", "1", "'s", "'re", "!", "<|endoftext|>", "中", "😀", "\0", "th", "the", "ing", "'", "՘", "́", "²"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def test_same_as_library(library):
    rnd, codec = random.Random(7), bpe.codec(VOCABULARY)
    for _ in range(4000):
        text = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == bpe.pack(ids), repr(text)
        assert codec.decode(bpe.pack(ids)) == library.decode(ids, skip_special_tokens=False)


def test_pretokens_of_settled_characters(library):
    codec = bpe.codec(VOCABULARY)
    for c in map(chr, range(0xE000)):
        if not 0xD800 <= ord(c) < 0xE000 and codec.settled(c):
            text = f"a{c}b{c}1"
            assert codec.pretokens(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_long_word_and_small_memory(library):
    text = "th" * 20000 + " " + "ab " * 500
    assert bpe.codec(VOCABULARY).encode(text) == bpe.pack(library.encode(text, add_special_tokens=False).ids)
    small = bpe.Memory(lambda key: key.encode(), size=3)
    assert [small(c) for c in "abcabcdefgabc"] == [c.encode() for c in "abcabcdefgabc"]
    assert len(small.young) <= 3 and len(small.old) <= 3


def test_invalid_utf8_is_replaced(library):
    ids = [bpe.codec(VOCABULARY).first[b] for b in b"\xe4\xb8a\xff"]
    assert bpe.codec(VOCABULARY).decode(bpe.pack(ids)) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op1_bpe_roundtrip(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(bpe.pack(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "", "z"), (1, "a b", None), (1, "a b", None)], "doc_id long, text string, ids string")
    rows = bpe.encode_decode(docs, VOCABULARY).collect()
    assert sorted((len(r.ids), r.decoded) for r in rows) == [(0, ""), (0, ""), (8, "a b"), (8, "a b"), (8, "a b")]
    assert bpe.digests(docs.limit(0), VOCABULARY).collect() == []
