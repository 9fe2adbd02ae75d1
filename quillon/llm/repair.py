"""Token ids in binary shards under Re-Pair grammars.

Documents are sorted by id across the cluster, encoded, each followed by an end
id, and cut into shards of about ``SHARD_IDS`` ids. In each shard the most
frequent pairs of ids are replaced by nonterminals, round after round, until no
pair occurs ``LEAST`` times or the 16-bit symbols are used up. A round replaces
at most ``PAIRS`` of the most frequent pairs together.

A shard's bytes, integers little-endian:

    symbols of 16 bits, in blocks of ``BLOCK``
    the head, packed by zlib:
        unsigned 64-bit: documents, ids, rules, blocks, base
        documents x (8-byte id, 1-byte null mark, 8-byte end position)
        rules x (two 16-bit symbols), rules x 32-bit expansion length
        blocks x 8-byte first position
    the head's packed length in 8 bytes, and "RPR2"

A symbol of at least ``base`` is rule symbol - base. The lengths tell how many
ids a block expands to, so a range of ids is read from the head and from those
blocks alone that hold it; ``find_documents`` fetches single documents so.
Symbols are not packed any further: zlib would save a sixth of them, at more
than a tenth of the time that the grammar takes.

Files get names of their own in every attempt, and only shards listed in a
table that Spark has committed are read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import BytePairCodec, byte_symbols
from quillon.llm.common import materialise, open_fs, parts, shared_dir, table

SHARD_IDS = 2_000_000
#: Pairs replaced in one round, and the fewest occurrences worth a rule.
PAIRS, LEAST = 2_000, 32
TOP, CELLS = 1 << 16, 1 << 20
#: Symbols packed together, and documents read together.
BLOCK, RANGE = 1 << 15, 512
MAGIC = b"RPR2"


def cells(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint32(2654435761)) >> np.uint32(12)).astype(np.int32)


def selected(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """At most ``most`` of the most frequent keys, the number of each cell's key (-1: none), and whether these are all frequent ones.

    Of frequent keys in one cell the most frequent is taken; the others' turn comes in a later round.
    """
    found, times = np.unique(keys, return_counts=True)
    found, times = found[times >= LEAST], times[times >= LEAST]
    frequent = len(found)
    found = found[np.lexsort((found, -times))[:most]]
    _, first = np.unique(cells(found), return_index=True)
    found = found[np.sort(first)]
    slot = np.full(CELLS, -1, np.int16)
    slot[cells(found)] = np.arange(len(found), dtype=np.int16)
    return found, slot, len(found) == frequent


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, expansion lengths) of ids below ``base``."""
    seq = ids.astype(np.uint16)
    rules = np.zeros((0, 2), np.uint32)
    new = 0  # pairs without a symbol from here on are known to be rare
    while len(seq) > 1 and (room := min(PAIRS, TOP - base - len(rules))) > 0:
        if new:
            at = np.flatnonzero((seq[:-1] >= new) | (seq[1:] >= new))
            keys = seq[at].astype(np.uint32) << np.uint32(16) | seq[at + 1]
        else:
            at, keys = None, seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        pairs, slot, every = selected(keys, room)
        if not len(pairs):
            break
        number = slot[cells(keys)]
        hit = np.flatnonzero(number >= 0)
        hit = hit[pairs[number[hit]] == keys[hit]]
        places, number = hit if at is None else at[hit], number[hit]
        # Of overlapping occurrences in a row, every other one is replaced, which ends those between.
        begins = np.concatenate([[True], np.diff(places) > 1])
        run = np.maximum.accumulate(np.where(begins, places, 0))
        odd = (places - run) % 2 == 0
        places, number = places[odd], number[odd]
        used, number = np.unique(number, return_inverse=True)
        # With all frequent pairs replaced, only pairs with a new symbol can be frequent.
        new = base + len(rules) if every else 0
        seq[places] = base + len(rules) + number
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq = seq[keep]
        pairs = pairs[used]
        rules = np.concatenate([rules, np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], axis=1)])
    lengths = [1] * base
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return seq, rules, np.array(lengths[base:], np.uint32)


class Shard:
    """One shard's grammar and documents; ``read(offset, length)`` fetches its bytes, blocks only when they are asked for."""

    def __init__(self, read, size: int):
        self.read = read
        tail = read(size - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard")
        packed = int.from_bytes(tail[:8], "little")
        data = zlib.decompress(read(size - 12 - packed, packed))
        docs, self.n_ids, n_rules, blocks, self.base = (int(x) for x in np.frombuffer(data, "<u8", 5))
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, nulls, self.ends = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls)]
        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), take("<u4", n_rules).astype(np.int64)])
        self.first, self.end = take("<i8", blocks), size - 12 - packed
        # All expansions end to end: the ids themselves, then each rule's, made of earlier ones.
        self.begins = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths[self.base :]) - self.lengths[self.base :]])
        self.flat = np.zeros(self.base + int(self.lengths[self.base :].sum()), np.uint32)
        self.flat[: self.base] = np.arange(self.base)
        for k, pair in enumerate(self.rules):
            to = self.begins[self.base + k]
            for x in pair:
                n = self.lengths[x]
                self.flat[to : to + n] = self.flat[self.begins[x] : self.begins[x] + n]
                to += n
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def symbols(self, k: int) -> np.ndarray:
        return np.frombuffer(self.read(2 * BLOCK * k, min(2 * BLOCK, self.end - 2 * BLOCK * k)), "<u2")

    def block(self, k: int) -> np.ndarray:
        """The ids of one block; the last one asked for is kept."""
        if self.held[0] != k:
            own = self.symbols(k)
            n = self.lengths[own]
            self.held = k, self.flat[np.repeat(self.begins[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return self.held[1]

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids at positions first to end, from only the blocks that hold them."""
        if first >= end:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.first, [first, end - 1], side="right") - 1
        return np.concatenate([self.block(k)[max(first - int(self.first[k]), 0) : end - int(self.first[k])] for k in range(i, j + 1)])

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def pack(doc_ids: list, ends: list[int], ids: np.ndarray, base: int) -> bytes:
    seq, rules, lengths = compress(ids, base)
    before = np.concatenate([[0], np.cumsum(np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])[seq])])
    head = zlib.compress(
        b"".join(
            [
                np.array([len(doc_ids), len(ids), len(rules), -(-len(seq) // BLOCK), base], "<u8").tobytes(),
                np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
                np.array([i is None for i in doc_ids], "u1").tobytes(),
                np.array(ends, "<i8").tobytes(),
                rules.astype("<u2").tobytes(),
                lengths.astype("<u4").tobytes(),
                before[:-1:BLOCK].astype("<i8").tobytes(),
            ]
        ),
        1,
    )
    return b"".join([seq.astype("<u2").tobytes(), head, len(head).to_bytes(8, "little"), MAGIC])


class Encoder(BytePairCodec):
    """The tokenizers library's model behind bounded memories of pieces and pre-tokens; 16-bit ids.

    Texts are encoded many at a time. They are cut where pre-tokens begin in any
    context, at blanks and behind letters; equal pieces are looked up once, and
    new words go to the library in strings of several.
    """

    width = "H"
    remembered = 400_000
    #: Words given to the library in one string (in longer ones its queue gets slower), and characters of texts that are cut together.
    together, most = 16, 1 << 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.symbols = byte_symbols()
        self.size = len(self.strings)
        self.token.make = self.ids_of
        #: Byte 0 stands between words, if no merge takes it; they have none.
        self.printed = np.array([ord(self.symbols[b]) for b in range(256)], "<u2")
        self.between, self.between_id = self.symbols[0], self.first[0]
        self.apart = all(self.between_id not in pair[:2] for pair in self.pairs)
        #: Of each settled character, whether it is a letter.
        self.letter = np.array([chr(c).isalpha() for c in range(0xD800)])
        self.hash_by(0x9E3779B97F4A7C15)

    def hash_by(self, factor: int) -> None:
        """Tables for the hashes of pieces: the powers of an odd number and of its inverse, and all places."""
        power = lambda x: np.cumprod(np.full(self.most, x, np.uint64))
        self.powers, self.inverses, self.places = power(factor), power(pow(factor, -1, 1 << 64)), np.arange(self.most)

    def ids_of(self, token: str) -> bytes:
        """Ids of one pre-token by the library's model, which takes a printable character for each byte."""
        return array(self.width, [t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens without byte 0."""
        if not words or not self.apart:
            return list(map(self.ids_of, words))
        printed = self.printed[np.frombuffer("\0".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le").split(self.between)
        ids = array(self.width)
        for k in range(0, len(printed), self.together):
            ids.extend([t.id for t in self.model.tokenize(self.between.join(printed[k : k + self.together]) + self.between)])
        data, ends = ids.tobytes(), 2 * np.flatnonzero(np.frombuffer(ids, np.uint16) == self.between_id)
        return [data[a:b] for a, b in zip([0, *(ends + 2).tolist()], ends.tolist())]

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces of settled text."""
        found = list(map(self.piece.young.get, pieces))
        absent = [k for k, x in enumerate(found) if x is None]
        made, words = {}, []
        for k in absent:
            piece = pieces[k]
            if (ids := self.piece.old.get(piece)) is not None:
                made[piece] = ids
            elif piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
                words.append(piece)
            else:
                made[piece] = b"".join(map(self.token, self.pretokens(piece)))
        made.update(zip(words, self.ids_of_words(words)))
        for k in absent:
            found[k] = made[pieces[k]]
        self.piece.keep(made)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as ``encode`` gives them. Texts that can't be cut so are encoded by themselves."""
        plain = [0 < len(t) <= self.most and "\0" not in t and self.odd_blank(t) is None and self.settled(t) is not None and not any(s in t for s in self.special) for t in texts]
        made, held, size = [], [], 0
        for text in (t for t, p in zip(texts, plain) if p):
            if held and size + len(text) > self.most:
                made += self.encode_settled(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        made = iter(made + (self.encode_settled(held) if held else []))
        return [next(made) if p else self.encode(t) for t, p in zip(texts, plain)]

    def encode_settled(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of settled characters, none of them empty, by their different pieces."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-16-le"), "<u2")  # settled characters are one unit each
        ends = np.cumsum([len(t) for t in texts])
        letter = (codes | np.uint16(32)) - np.uint16(97) < 26
        wide = np.flatnonzero(codes > 127)
        letter[wide] = self.letter[codes[wide]]
        begins = codes == 32
        begins[1:] |= letter[:-1] & ~letter[1:]
        begins[0] = True
        begins[ends[:-1]] = True
        first = np.flatnonzero(begins)
        n = np.diff(first, append=len(codes))
        # Pieces of one polynomial hash are taken for equal, then compared.
        with np.errstate(over="ignore"):
            key = np.add.reduceat(codes * self.powers[: len(codes)], first) * self.inverses[first]
        _, sample, number = np.unique(key, return_index=True, return_inverse=True)
        same = sample[number]
        other = np.repeat(first[same] - first, n)
        other += self.places[: len(codes)]
        if not ((n == n[same]).all() and (codes == codes[other]).all()):
            return [self.encode(t) for t in texts]
        ids = self.ids_of_pieces([whole[a:b] for a, b in zip(first[sample].tolist(), (first + n)[sample].tolist())])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat, size = np.frombuffer(b"".join(ids), np.uint16), sizes[number]
        after = np.cumsum(size)
        data = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - (after - size), size) + np.arange(int(after[-1]))].tobytes()
        bounds = [0, *(2 * after[np.searchsorted(first, ends) - 1]).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def together(batches: Iterator, most: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of documents in order, about ``most`` characters at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            few = batch.slice(k, 64).to_pydict()
            more = sum(map(len, few["text"]))
            if texts and size + more > most:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys += few["doc_id"]
            texts += few["text"]
            size += more
    if texts:
        yield keys, texts


SHARDS = "part int, shard int, file string, offset long, length long, n_ids long, first_doc long, last_doc long"


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents in ascending order of doc_id; return the committed shards, ordered by (part, shard).

    A null text is empty: the end id alone. Null ids come first; rows with equal
    ids are ordered by a hash of their text. Vocabularies of 16-bit ids only.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        fs, path = open_fs(folder)
        name, out, offset, made = f"{uuid.uuid4().hex}.rpr", None, 0, []
        doc_ids, ends, held, n = [], [], [], 0
        end = array("H", [end_id]).tobytes()

        def flush():
            nonlocal out, offset, n
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            data = pack(doc_ids, ends, np.frombuffer(b"".join(held), np.uint16), own.size)
            out.write(data)
            named = [i for i in doc_ids if i is not None]
            made.append((part, len(made), f"{folder}/{name}", offset, len(data), n, min(named, default=None), max(named, default=None)))
            offset += len(data)
            n = 0
            for x in (doc_ids, ends, held):
                x.clear()

        for keys, texts in together(batches, own.most):
            for doc_id, ids in zip(keys, own.encode_all(texts)):
                held.append(ids + end)
                n += len(ids) // 2 + 1
                doc_ids.append(doc_id)
                ends.append(n)
                if n >= shard_ids:
                    flush()
        if n:
            flush()
        if out is not None:
            out.close()
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        names, types = zip(*(x.split() for x in SHARDS.split(", ")))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kinds[t]) for k, t in enumerate(types)], names=list(names))

    return materialise(ordered.mapInArrow(write, SHARDS), "shard-table")


def with_starts(shards: DataFrame) -> DataFrame:
    """Shards with ``start``, the number of ids before each: within its part, and over the (few) parts.

    The input is a table of ``write_shards``; it has no nulls but the document
    ids of shards with null ids alone. No shards give no rows.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(totals, "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def read_documents(shards: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ids as binary, 32-bit, or with ``digest`` their crc32 instead.

    A document of a null or empty text has its end id alone. Repeated rows and
    null ids give one row each, in the order that they were written in; no
    shards give no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, offset, length, start in zip(batch["file"], batch["offset"], batch["length"], batch["start"]):
                fs, path = open_fs(file)
                with fs.open_input_file(path) as f:
                    whole = f.read_at(length, offset)
                shard, rows = Shard(lambda at, n, whole=whole: whole[at : at + n], length), []
                # Ranges of documents, so that a shard is expanded in bounded steps.
                for k in range(0, len(shard.doc_ids), RANGE):
                    ends = shard.ends[max(k - 1, 0) : k + RANGE]
                    first = 0 if k == 0 else int(ends[0])
                    bounds = [first, *map(int, ends if k == 0 else ends[1:])]
                    ids = shard.ids(first, bounds[-1]).astype("<u4")
                    for doc_id, a, b in zip(shard.doc_ids[k : k + RANGE], bounds, bounds[1:]):
                        data = ids[a - first : b - first].tobytes()
                        rows.append((doc_id, start + a, b - a, zlib.crc32(data) if digest else data))
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
                    rows = []

    spread = shards.select("part", "shard", "file", "offset", "length", "start").repartitionByRange(parts(shards.sparkSession), "part", "shard")
    return spread.mapInPandas(read, f"doc_id long, start long, n_tokens long, ids {'long' if digest else 'binary'}")


def find_documents(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents whose ids are in column ``doc_id`` of ``wanted``, each id once.

    Reads the heads of the shards that may hold them, and of these shards only
    the blocks that do. Rows that share an id are all found; null and unknown
    ids give no row. Other columns of ``wanted`` are ignored.
    """
    spark = wanted.sparkSession
    bounds = shards.where("first_doc is not null").groupBy("part").agg(F.min("first_doc").alias("low"), F.max("last_doc").alias("high")).orderBy("low", "part").collect()  # a row for each partition of the sort
    held = spark.sparkContext.broadcast(([r.part for r in bounds], np.array([r.low for r in bounds], np.int64), np.array([r.high for r in bounds], np.int64)))

    @F.pandas_udf("array<int>")
    def parts_of(ids: pd.Series) -> pd.Series:
        own, low, high = held.value
        ends = np.searchsorted(low, ids.to_numpy(), side="right")
        begins = np.searchsorted(high, ids.to_numpy(), side="left")
        return pd.Series([own[a:b] for a, b in zip(begins, ends)], dtype=object)

    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    near = ids.select("doc_id", F.explode(parts_of("doc_id")).alias("part")).join(shards, "part").where(F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))
    jobs = near.select("file", "offset", "length", "doc_id").repartitionByRange(parts(spark), "file", "offset", "doc_id").sortWithinPartitions("file", "offset", "doc_id")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, shard, f, own = None, None, None, {}
        for batch in batches:
            rows = []
            for file, offset, length, doc_id in zip(*(batch[c] for c in ("file", "offset", "length", "doc_id"))):
                if known != (file, offset):
                    if f is not None:
                        f.close()
                    fs, path = open_fs(file)
                    f, known = fs.open_input_file(path), (file, offset)
                    shard = Shard(lambda at, n, f=f, offset=offset: f.read_at(n, offset + at), length)
                    own = {}
                    for k, i in enumerate(shard.doc_ids):
                        own.setdefault(i, []).append(k)
                for k in own.get(doc_id, ()):
                    ids = shard.document(k).astype("<u4")
                    rows.append((doc_id, len(ids), ids.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids"])
        if f is not None:
            f.close()

    return jobs.mapInPandas(find, "doc_id long, n_tokens long, ids binary")


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(with_starts(shards), digest=True).withColumnRenamed("ids", "ids_crc32")
