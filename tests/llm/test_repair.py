import zlib

import numpy as np
import pytest

from quillon.llm import bpe, repair
from quillon.llm.common import table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def expected(library, docs):
    start, out = 0, []
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir, library, monkeypatch):
    monkeypatch.setattr(repair, "RANGE", 7)
    monkeypatch.setattr(repair, "BLOCK", 1_000)
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in repair.op4_repair(spark, sf_dir).collect()) == expected(library, docs)


def test_odd_rows_and_small_shards(spark, library):
    docs = [(None, "first"), (1, None), (2, ""), (3, "a  b   c \n d<|endoftext|>\0 "), (5, "the " * 30000), (9, "x")]
    frame = spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, shard string")
    for size in (1, 50, 10**6):
        shards = repair.with_starts(repair.write_shards(frame, bpe.default_vocabulary(), shard_ids=size))
        got = sorted([tuple(r) for r in repair.read_documents(shards, digest=True).collect()], key=lambda r: r[1])
        assert got == expected(library, docs)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in repair.read_documents(shards).collect()}
    assert library.decode(ids[9][:-1].tolist(), skip_special_tokens=False) == "x" and ids[9][-1] == 0
    again = spark.createDataFrame([(4, "same")] * 5, "doc_id long, text string")
    assert sorted(r.start for r in repair.read_documents(repair.with_starts(repair.write_shards(again, bpe.default_vocabulary()))).collect()) == [0, 2, 4, 6, 8]
    assert repair.read_documents(repair.with_starts(repair.write_shards(frame.limit(0), bpe.default_vocabulary()))).collect() == []


def test_grammar_round_trip_and_random_access():
    rnd = np.random.default_rng(4)
    for ids in (rnd.integers(0, 9, 30_000), np.zeros(5_000, int), np.tile([1, 2, 3], 4_000), np.arange(300), np.array([7])):
        ids = ids.astype(np.uint16)
        shard = opened(repair.pack([1], [len(ids)], ids, 300))
        assert (shard.ids(0, len(ids)) == ids).all()
        for _ in range(50):
            a, b = sorted(rnd.integers(0, len(ids) + 1, 2))
            assert (shard.ids(a, b) == ids[a:b]).all()
    assert len(opened(repair.pack([1], [12_000], np.tile([1, 2, 3], 4_000).astype(np.uint16), 300)).symbols(0)) < 200


def opened(data):
    return repair.Shard(lambda at, n: data[at : at + n], len(data))


def test_a_document_costs_its_blocks_only(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 1_000)
    rnd = np.random.default_rng(6)
    ids = rnd.integers(0, 20_000, 200_000).astype(np.uint16)
    ends = list(range(500, len(ids) + 1, 500))
    data = repair.pack(list(range(len(ends))), ends, ids, 20_000)
    read = []
    shard = repair.Shard(lambda at, n: read.append(n) or data[at : at + n], len(data))
    head = sum(read)
    assert head < len(data) / 10
    for k in (0, 7, 399):
        read.clear()
        assert (shard.document(k) == ids[500 * k : 500 * k + 500]).all()
        assert sum(read) <= 2 * 2_000  # at most two blocks of a thousand 16-bit symbols


def test_find_documents(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(None, "x"), (3, "again")], "doc_id long, text string"))
    shards = repair.write_shards(docs, bpe.default_vocabulary(), shard_ids=3_000)
    wanted = spark.createDataFrame([(3,), (3,), (150,), (10**9,), (None,), (-1,)], "doc_id long")
    got = sorted((r.doc_id, bytes(r.ids)) for r in repair.find_documents(shards, wanted).collect())
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in (3, 150)]
    assert got == sorted((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in texts) and len(got) == 3
