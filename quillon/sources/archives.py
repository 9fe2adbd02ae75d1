"""Package archives (tar.gz) as rows of files, within limits, and their rejected entries."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.functions.core import in_order
from quillon.functions.folders import materialise

#: Bytes in all, entries, bytes of a file, and depth of a path.
TOTAL, ENTRIES, FILE, DEPTH = 50 << 20, 10_000, 10 << 20, 20
#: Bytes looked at for the kind of a file, and the share of unprintable ones that makes it binary.
SNIFFED, UNPRINTABLE = 8_192, 0.3
#: Bytes of archives that one task reads, about.
PACKED = 64 << 20

FILES = "archive string, path string, size long, sha256 string, is_binary boolean, content binary, rejected string"


def problem(path: str) -> str | None:
    """Why a path may not be unpacked, if so."""
    if not path or "\0" in path:
        return "bad name"
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path):
        return "absolute path"
    parts = re.split(r"[/\\]", path)
    if ".." in parts:
        return "path leaves the archive"
    return "too deep" if len(parts) > DEPTH else None


def looks_binary(data: bytes) -> bool:
    head = data[:SNIFFED]
    odd = sum(b < 9 or 13 < b < 32 or b == 127 for b in head)
    return b"\0" in head or bool(head) and odd / len(head) > UNPRINTABLE


def entries(name: str, source, largest: int = FILE) -> Iterator[tuple]:
    """Files of one archive, the first folder of their paths left out; damage ends it with a rejected row.

    ``source`` is a file object that is read once from start to end, so a task
    holds one file of an archive at a time.
    """
    total = n = 0
    try:
        with tarfile.open(fileobj=source, mode="r|gz") as tar:
            for member in tar:
                if member.isdir():
                    continue
                n += 1
                why = "not a file" if not member.isfile() else problem(member.name) or ("file too large" if member.size > largest else None)
                if why is None and (n > ENTRIES or total + member.size > TOTAL):
                    why = "archive too large"
                if why:
                    yield name, member.name, member.size, None, None, None, why
                    if why == "archive too large":
                        return
                    continue
                total += member.size
                content = tar.extractfile(member).read()
                path = member.name.partition("/")[2] or member.name
                yield name, path, len(content), hashlib.sha256(content).hexdigest(), looks_binary(content), content, None
    except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
        yield name, None, None, None, None, None, f"damaged: {type(e).__name__}"


class Some(InputPartition):
    """Archives (name, URI) that one task reads."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class PackageArchives(DataSource):
    """``spark.read.format("package_archives")``: the files of all ``*.tgz`` in a folder, and entries that were rejected.

    Options: ``path`` (a URI that executors reach), ``largest`` (bytes of a file), and
    ``packed`` (bytes of archives that a task gets, about).
    """

    @classmethod
    def name(cls) -> str:
        return "package_archives"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("largest", FILE)), int(self.options.get("packed", PACKED)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, largest: int, packed: int):
        self.path, self.largest, self.packed = path if "://" in path or path.startswith("file:") else f"file://{path}", largest, packed

    def partitions(self) -> list[InputPartition]:
        """Archives by name, as many to a task as make up ``packed`` bytes."""
        fs, root = FileSystem.from_uri(self.path)
        out, size = [[]], 0
        for f in sorted(fs.get_file_info(FileSelector(root, allow_not_found=True)), key=lambda f: f.base_name):
            if f.type == FileType.File and f.base_name.endswith(".tgz"):
                if out[-1] and size + f.size > self.packed:
                    out.append([])
                    size = 0
                out[-1].append((f.base_name, f.path))
                size += f.size
        return [Some(files) for files in out]

    def read(self, partition: Some) -> Iterator[tuple]:
        fs, _ = FileSystem.from_uri(self.path)
        for name, path in partition.files:
            with fs.open_input_stream(path, compression=None) as source:
                yield from entries(name, source, self.largest)


def read(spark: SparkSession, folder: str, largest: int = FILE) -> DataFrame:
    """One row for each file or rejected entry of all archives of a folder."""
    spark.dataSource.register(PackageArchives)
    return spark.read.format("package_archives").option("path", folder).option("largest", largest).load()


def pack(files: DataFrame, folder: str) -> DataFrame:
    """Write an archive for each ``archive`` of (archive, path, content) and return (archive, files); content is binary.

    Files are streamed by archive and path. An archive gets its name only when it is
    complete, so that a task may be run again; null contents are empty files, and
    repeated paths repeated entries.
    """

    def written(archive, rows) -> Iterator[tuple]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, n = f"{root}/{uuid.uuid4().hex}.part", 0
        with fs.open_output_stream(part, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
            for _, path, content in rows:
                info = tarfile.TarInfo(path)
                info.size = len(content or b"")
                tar.addfile(info, io.BytesIO(content or b""))
                n += 1
        fs.move(part, f"{root}/{archive}.tgz")
        yield archive, n

    rows = files.select(F.col("archive").cast("string"), "path", "content").where("archive IS NOT NULL")
    return materialise(in_order(rows, "archive", ["path"], written, "archive string, files long"), "packed")
