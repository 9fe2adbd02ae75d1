"""Byte-level BPE encoding and decoding.

Encoding a pre-token keeps its symbols in a doubly linked list and the merge
candidates in a priority queue of (rank, position). A popped candidate whose
symbols have changed since it was pushed is stale and is skipped. Decoding
concatenates the vocabulary strings of the ids.

The work is a narrow map over documents: no shuffle, one pass over the text.
Each Python worker remembers what it has encoded in two dictionaries of bounded
size; what isn't remembered is encoded again, so the bound only costs time.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

#: Entries of each generation of a worker's two memories; about 200 bytes each.
REMEMBERED = 200_000
#: Longer pieces are encoded but not remembered.
LONGEST_REMEMBERED = 64

#: The pre-token pattern of this public vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory:
    """A bounded dictionary: when the young generation is full it becomes the old one, which is dropped."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, key: str, make=None) -> bytes:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = (make or self.make)(key)
                if len(key) > LONGEST_REMEMBERED:
                    return found
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def keep(self, made: dict[str, bytes]) -> None:
        """Remember many at once."""
        longer = [k for k in made if len(k) > LONGEST_REMEMBERED]
        self.young.update(made if not longer else {k: v for k, v in made.items() if len(k) <= LONGEST_REMEMBERED})
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}


class BytePairCodec:
    """Encoder and decoder for one vocabulary file in the tokenizers JSON format."""

    width = "I"  # of encoded ids: 32 bits
    remembered = REMEMBERED

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_of = {c: b for b, c in byte_symbols().items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.strings[i] = bytes(bytes_of[c] for c in word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.strings[i] = word.encode()
        self.first = [vocab[c] for _, c in sorted(byte_symbols().items())]
        #: Per rank the pair and what it becomes; per pair, as one number, its rank.
        self.pairs: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 24 | vocab[b]] = len(self.pairs)
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.pretokens = regex.compile(PRETOKEN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        #: White space around a blank: there, cutting at blanks isn't cutting between pre-tokens.
        self.odd_blank = re.compile(r"\s (?:\s|\Z)").search
        #: The tokenizers library knows an older Unicode, so characters outside these blocks are left to it.
        self.settled = re.compile("[\0-\u0556\u2010-\u205e\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch
        self.path, self.library = path, None
        self.token = Memory(lambda token: pack(self.merge(token.encode()), self.width), self.remembered)
        self.piece = Memory(lambda piece: b"".join(map(self.token, self.split(piece))), self.remembered)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.settled(text):
            return self.pretokens(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def settled_piece(self, piece: str) -> bytes:
        """Ids of a piece of settled text; a blank and letters are one pre-token."""
        if piece[:1] == " " and piece[1:].isalpha():
            return self.token(piece)
        return b"".join(map(self.token, self.pretokens(piece)))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token. A candidate in the queue is rank and position in one number."""
        ids = list(map(self.first.__getitem__, data))
        n = len(ids)
        rank, pairs = self.rank.get, self.pairs
        bits = n.bit_length()
        queue, last = [], -1 << 60
        for i in range(n):
            if (r := rank(last << 24 | ids[i])) is not None:
                queue.append(r << bits | i - 1)
            last = ids[i]
        if not queue:
            return ids
        heapify(queue)
        left, right, mask = list(range(-1, n - 1)), list(range(1, n + 1)), (1 << bits) - 1
        while queue:
            x = heappop(queue)
            i = x & mask
            a, b, new = pairs[x >> bits]
            if ids[i] != a or (j := right[i]) >= n or ids[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(new << 24 | ids[k])) is not None:
                    heappush(queue, r << bits | i)
            if (h := left[i]) >= 0 and (r := rank(ids[h] << 24 | new)) is not None:
                heappush(queue, r << bits | h)
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens.

        A blank with something else on both sides starts a pre-token, so text
        is cut at its blanks, and most of the pieces have been seen before.
        """
        if "\0" in text or self.odd_blank(text):
            return self.piece(text)
        pieces = text.replace(" ", "\0 ").split("\0")
        found = list(map(self.piece.young.get, pieces))
        if None in found:
            make = self.settled_piece if self.settled(text) else None
            for k in [k for k, x in enumerate(found) if x is None]:
                found[k] = self.piece(pieces[k], make)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers; special tokens in the text count as such."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(pack([self.special[x]], self.width) if x in self.special else self._plain(x) for x in self.special_split(text) if x)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def pack(ids: list[int], width: str = "I") -> bytes:
    return array(width, ids).tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One per worker process."""
    return BytePairCodec(path)


def encode_decode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Per document ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    Columns in ``keep`` (default: ``doc_id``) are carried along, but for own ones
    called ``ids`` or ``decoded``; all others are dropped. A null text counts as empty: no ids and an
    empty decoded text. Repeated rows and null ids give one row each; an empty
    table gives an empty one.
    """
    keep = ["doc_id"] if keep is None else [c for c in keep if c.lower() not in ("ids", "decoded")]
    both = _coded(vocabulary)(F.col("text"))
    return docs.select(*keep, both.alias("_c")).select(*keep, "_c.ids", "_c.decoded")


def _coded(vocabulary: str):
    @F.pandas_udf("ids binary, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for texts in batches:
            ids = [c.encode(t) if t else b"" for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [c.decode(x) for x in ids]})

    return coded


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, without sending ids or text back to the JVM.

    A null text counts as empty: no ids and an empty decoded text. Repeated rows
    and null ids give one row each; other columns are dropped, whatever their
    names; an empty table gives an empty one.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for texts in batches:
            rows = []
            for t in texts:
                ids = c.encode(t) if t else b""
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")


def decode_column(ids: Column, vocabulary: str) -> Column:
    """Text of a binary id column; null ids give null."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary)
        for part in batches:
            yield pd.Series([None if x is None else c.decode(x) for x in part], dtype="object")

    return decoded(ids)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())
