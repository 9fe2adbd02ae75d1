"""WARC archives with a two-level capture index.

Writing: each task appends one gzip member a record to archives of its own and
returns where each record lies. Of pages with equal payloads one is a response,
the others are revisits without payload, found by a grouping of digests alone.

Indexing: capture keys (the URL with its host reversed, then the page id) are
sorted across the cluster, and each task writes its range as compressed blocks
with a sparse directory of the blocks' first keys at the file's end. The top
level is one row for each index file, whatever the number of captures.

Lookup: sorted keys are searched by bisection in the top level, in one file's
directory and in one block, then a range read fetches the record.

Files get names of their own in every attempt, and only those listed in a
table that Spark has committed are read, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, open_fs, parts, shared_dir, table

#: Bytes after which a task begins another archive; lines of one index block.
ARCHIVE_BYTES = 512 << 20
BLOCK_LINES = 1_000
#: Parts into which the pages of one payload are dealt.
SALTS = 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "capture string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL; the whole text where it has no ``://``; null: empty."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "+")
    host = F.lower(F.regexp_extract(text, r"^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_extract(text, r"^[^:/?#]*://[^/?#]*(.*)$", 1)
    return F.when(text.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(text)


def capture_key(url: Column, page_id: Column) -> Column:
    """Sorts by URL key and then by page id, nulls first."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(url_key(url), F.lit(" "), F.coalesce(number, F.lit("")))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""

    def headers(lines: bytes) -> dict[str, str]:
        return {k.lower(): v for line in lines.decode().split("\r\n")[1:] for k, _, v in [line.partition(": ")]}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, headers(http), payload


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record for each page (page_id, url, html); return the committed captures.

    A null html is an empty payload and a null url an empty one. Of pages with
    equal payloads the largest page_id is the response; null ids refer to it if
    there is one. Repeated rows with that id are all responses.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    ids = materialise(pages.select("page_id", digest.alias("digest")), "payloads")
    first = ids.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # One payload may be that of many pages: these are dealt out by salts, each of which gets the payload's row.
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    again = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("again"), F.col("digest").alias("as"), "first").distinct()
    rows = pages.withColumn("digest", digest)
    rows = rows.join(again, rows.page_id.eqNullSafe(again.again) & (rows.digest == again["as"]), "left")
    rows = rows.select("page_id", "url", "html", "first", F.col("as").isNotNull().alias("revisit"), capture_key(F.col("url"), F.col("page_id")).alias("capture"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            lines = []
            for page_id, url, html, first, revisit, capture in zip(*(batch[c] for c in ("page_id", "url", "html", "first", "revisit", "capture"))):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = gzip_member(record(whole(page_id), url, html.encode(), whole(first), revisit))
                out.write(data)
                lines.append((capture, name, offset, len(data)))
                offset += len(data)
            if out is not None and lines:
                out.flush()
            yield pd.DataFrame(lines, columns=["capture", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = rows.mapInPandas(write, CAPTURE)
    return materialise(captures.withColumn("file", F.concat(F.lit(f"{folder}/"), "file")), "captures")


def whole(value):
    """An integer that pandas may hold as a float (ids are read as nullable integers below)."""
    return None if value is None or value != value else int(value)


def write_index(captures: DataFrame) -> DataFrame:
    """Sort captures into index files; return the top level: one row (first, file, at, size) for each file.

    The input is a table of ``write_archives``, without nulls; captures that
    share a key all get a line. No captures give no files.
    """
    spark = captures.sparkSession
    folder = shared_dir(spark, "index")
    ordered = captures.repartitionByRange(parts(spark), "capture").sortWithinPartitions("capture", "file", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(folder)
        lines: list[bytes] = []
        directory, first, out, offset = [], None, None, 0
        name = f"{uuid.uuid4().hex}.idx"

        def flush():
            nonlocal out, offset
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            block = zlib.compress(b"\n".join(lines), 1)
            out.write(block)
            directory.append(b"\t".join([lines[0].split(b"\t", 1)[0], b"%d" % offset, b"%d" % len(block)]))
            offset += len(block)
            lines.clear()

        for batch in batches:
            for capture, file, at, length in zip(batch["capture"], batch["file"], batch["offset"], batch["length"]):
                first = capture if first is None else first
                lines.append(f"{capture}\t{file}\t{at}\t{length}".encode())
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            footer = zlib.compress(b"\n".join(directory), 1)
            out.write(footer)
            out.close()
            yield pd.DataFrame([(first, f"{folder}/{name}", offset, len(footer))], columns=["first", "file", "at", "size"])

    return materialise(ordered.mapInPandas(write, "first string, file string, at long, size long"), "index-files")


class Reader:
    """Bisects a two-level index and reads records by range; keeps a few files, directories and blocks at hand."""

    def __init__(self, top: list[tuple[bytes, str, int, int]], held: int = 16):
        self.top, self.held = sorted(top), held
        self.firsts = [x[0] for x in self.top]
        self.files: OrderedDict = OrderedDict()
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    def remembered(self, where: OrderedDict, key, make):
        if key not in where:
            if len(where) >= self.held:
                old = where.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
            where[key] = make()
        where.move_to_end(key)
        return where[key]

    def read(self, uri: str, offset: int, length: int) -> bytes:
        def opened():
            fs, path = open_fs(uri)
            return fs.open_input_file(path)

        return self.remembered(self.files, uri, opened).read_at(length, offset)

    def lines(self, data: bytes) -> list[list[bytes]]:
        return [line.split(b"\t") for line in zlib.decompress(data).split(b"\n")]

    def captures(self, key: bytes) -> Iterator[list[bytes]]:
        """Index lines with this capture key."""
        i = bisect_right(self.firsts, key) - 1
        if i < 0:
            return
        _, uri, at, size = self.top[i]
        firsts, places = self.remembered(self.directories, uri, lambda: list(zip(*[(x[0], (int(x[1]), int(x[2]))) for x in self.lines(self.read(uri, at, size))])))
        for j in range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key)):
            keys, lines = self.remembered(self.blocks, (uri, j), lambda: (lambda found: ([x[0] for x in found], found))(self.lines(self.read(uri, *places[j]))))
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]


RECORD = "capture string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def lookup(keys: DataFrame, top: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of capture keys (a column ``capture``; each key counts once). Keys without a record give no row."""
    spark = keys.sparkSession
    held = spark.sparkContext.broadcast([(r["first"].encode(), r.file, r["at"], r["size"]) for r in top.collect()])  # one row for each index file
    ordered = keys.select("capture").distinct().repartitionByRange(parts(spark), "capture").sortWithinPartitions("capture")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(held.value)
        for batch in batches:
            rows = []
            for capture in batch["capture"]:
                for _, file, offset, length in reader.captures(capture.encode()):
                    warc, http, payload = parse(zlib.decompress(reader.read(file.decode(), int(offset), int(length)), 31))
                    digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    revisit = warc["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{file.decode()}: record at {offset.decode()} is damaged")
                    rows.append((capture, page_of(warc["warc-record-id"]), warc["warc-target-uri"], payload if payloads and not revisit else None, size, digest, warc["warc-type"], page_of(warc.get("warc-refers-to"))))
                    if len(rows) == 1000:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return ordered.mapInPandas(find, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    top = write_index(write_archives(pages))
    keys = pages.select(capture_key(F.col("url"), F.col("page_id").cast("long")).alias("capture"))
    return lookup(keys, top, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
