"""Tar archives: one row per member, and image/metadata pairs.

Archives on a file system are read by ranges of members: one task walks an archive's headers and cuts it where a
range is full, and the ranges are dealt to tasks that hold one member at a time. So an archive may
have any size, and one that is much larger than the others is read by many tasks.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.functions.captions import file_extension, file_stem
from captionforge.session import small_batches

MEMBER_SCHEMA = "archive string, member string, content binary, error string"
MEMBERS_PER_BLOCK = 64
BLOCK_BYTES = 16 << 20  # of members passed on together, if a single one is not larger
RANGE_BYTES = 64 << 20  # of an archive that one task reads, if a single member is not larger
RANGE_SCHEMA = "archive string, start bigint, stop bigint, error string"

_BROKEN = (tarfile.TarError, EOFError, OSError, ValueError)


def _members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The files of an archive; headers that were passed are forgotten."""
    while (member := tar.next()) is not None:
        tar.members = []
        if member.isfile():
            yield member


def _rows(path: str, file) -> Iterator[pd.DataFrame]:
    """Members in blocks; a broken archive ends with a row that names the error, not with a failed job."""
    block, held = [], 0
    frame = lambda: pd.DataFrame(block, columns=["archive", "member", "content", "error"])
    try:
        with tarfile.open(fileobj=file) as tar:
            for member in _members(tar):
                block.append((path, member.name, tar.extractfile(member).read(), None))
                held += member.size
                if len(block) == MEMBERS_PER_BLOCK or held >= BLOCK_BYTES:
                    yield frame()
                    block, held = [], 0
    except _BROKEN as e:
        block.append((path, None, None, type(e).__name__))
    if block:
        yield frame()


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            yield from _rows(path, io.BytesIO(content))


def _named(members: DataFrame) -> DataFrame:
    return members.select("archive", "member", file_stem(F.col("member")).alias("stem"),
                          file_extension(F.col("member")).alias("ext"), "content", "error")


def tar_members(archives: DataFrame) -> DataFrame:
    """(archive, member, stem, ext, content, error) from (path, content) rows; a task holds few archives at a time."""
    small_batches(archives.sparkSession)
    return _named(archives.select("path", "content").mapInPandas(_unpack, MEMBER_SCHEMA))


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return system.open_input_file(place)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of whole members. Only headers are read, and a compressed archive is one range."""
    for batch in batches:
        for path in batch["path"]:
            ranges, error, start, end = [], None, 0, 0
            try:
                with _open(path) as file:
                    size = file.size()
                    try:
                        with tarfile.open(fileobj=file, mode="r:") as tar:
                            for member in _members(tar):
                                if member.offset - start >= RANGE_BYTES:
                                    ranges.append((path, start, member.offset, None))
                                    start = member.offset
                                end = member.offset_data + -(-member.size // 512) * 512
                                if end > size:
                                    raise EOFError(path)
                    except tarfile.ReadError:
                        if start == end == 0:  # compressed, or no archive: its reader will see
                            end = size
                        else:
                            raise
            except _BROKEN as e:
                error, end = type(e).__name__, start
            if end > start:
                ranges.append((path, start, end, None))
            if error:
                ranges.append((path, None, None, error))
            if ranges:
                yield pd.DataFrame(ranges, columns=["archive", "start", "stop", "error"])


class _Part(io.RawIOBase):
    """The bytes of a file from ``start`` to ``stop``, as a file of its own."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.start, self.size, self.at = file, start, stop - start, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, into) -> int:
        n = max(0, min(len(into), self.size - self.at))
        self.file.seek(self.start + self.at)
        into[:n] = self.file.read(n)
        self.at += n
        return n


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, start, stop, error in zip(batch["archive"], batch["start"], batch["stop"], batch["error"]):
            if error is not None:
                yield pd.DataFrame([(path, None, None, error)], columns=["archive", "member", "content", "error"])
                continue
            with _open(path) as file:
                yield from _rows(path, io.BufferedReader(_Part(file, int(start), int(stop)), 1 << 20))


def archive_ranges(paths: DataFrame) -> DataFrame:
    """(archive, start, stop, error) for rows with a ``path``: parts of at least one member and about ``RANGE_BYTES``."""
    return paths.select("path").mapInPandas(_walk, RANGE_SCHEMA)


def read_archives(spark: SparkSession, path: str, glob: str = "*.tar") -> DataFrame:
    """(archive, member, stem, ext, content, error) of the archives below a folder, which ``pyarrow.fs`` must be able to open.

    A member that an archive breaks off in is left out; those before it are read, and a row names the error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    # names only: the contents are not loaded
    ranges = archive_ranges(files.select("path")).withColumn("__deal", F.xxhash64("archive", "start"))
    dealt = ranges.repartition("__deal").drop("__deal")
    return _named(dealt.mapInPandas(_read_ranges, MEMBER_SCHEMA))


def join_sidecar(members: DataFrame, metadata_schema: str, image_ext: str = "png", data_ext: str = "json") -> DataFrame:
    """Images with their metadata by (archive, stem); either one missing, or unreadable metadata, drops it.

    For members that may be anywhere. ``archive_pairs`` pairs those of an archive without a join.
    """
    images = members.where(F.col("ext") == image_ext).select("archive", "stem", F.col("content").alias("image"))
    meta = F.from_json(F.decode("content", "UTF-8"), metadata_schema)
    sidecars = members.where(F.col("ext") == data_ext).select("archive", "stem", meta.alias("__meta"))
    return images.join(sidecars, ["archive", "stem"]).where(F.col("__meta").isNotNull()).select(
        "archive", "stem", "image", "__meta.*")


def _stem(name: str) -> tuple[str, str]:
    """What ``file_stem`` and ``file_extension`` give."""
    base = name.rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    return (stem, ext.lower()) if dot else (base, "")


def archive_pairs(archives: DataFrame, metadata_schema: str, image_ext: str = "png", data_ext: str = "json") -> DataFrame:
    """The rows of ``join_sidecar`` from (path, content) rows of archives: members are paired where an archive is unpacked.

    Its metadata is read first, then its images one by one; no image is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                meta: dict[str, list[str]] = {}
                for wanted in (data_ext, image_ext):
                    try:
                        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                            for member in _members(tar):
                                stem, ext = _stem(member.name)
                                if ext != wanted or wanted == image_ext and stem not in meta:
                                    continue
                                body = tar.extractfile(member).read()
                                if wanted == data_ext:
                                    meta.setdefault(stem, []).append(body.decode("utf-8", "replace"))
                                else:
                                    yield pd.DataFrame([(path, stem, body, m) for m in meta[stem]], columns=["archive", "stem", "image", "meta"])
                    except _BROKEN:
                        pass  # what stands before the break counts

    small_batches(archives.sparkSession)
    rows = archives.select("path", "content").mapInPandas(run, "archive string, stem string, image binary, meta string")
    return rows.withColumn("__meta", F.from_json("meta", metadata_schema)).where(F.col("__meta").isNotNull()).select(
        "archive", "stem", "image", "__meta.*")
