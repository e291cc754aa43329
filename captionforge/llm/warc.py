"""Deterministic sharded WARC writer and reader.

1. Payload digests are compared as narrow rows: the smallest id of each digest, by pre-aggregated minimum, and one
   decision row for every other id that has it. Payloads take no part in that join.
2. Pages and decisions are range-partitioned by id. The borders are byte-weighted quantiles of the ids chosen by
   their hash, so they depend on the data alone; an id that outweighs a shard is dealt on by its
   payloads' digests. A task sorts its shards and writes their records one after the other.
3. Each record is a gzip member of its own with headers and digests computed from what is written. A file
   is closed when its compressed size reaches ``FILE_BYTES``, and the next one begins.
4. Files are written under temporary names. What the successful tasks report is written as a manifest; only the
   files it names are moved to their final names, which may be repeated after a failure, and readers
   follow the manifest alone. Two runs over the same rows give the same bytes.

The folder is a URI that ``pyarrow.fs`` and Spark both open (file, hdfs, s3, gs).

Defined cases: a null payload is empty; a null url has no target header; a null id sorts last, never is
the smallest and is written without an id header; payloads under ``LEAST_REVISIT`` bytes are always responses; of
repeated rows with the smallest id the first is the response and the others revisit it; an empty table
gives an empty manifest; further columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.session import materialize, small_batches

SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
LEAST_REVISIT = 100
BORDER_SAMPLE = 100_000
DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 20

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace for names of the URL kind
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(file system, path) of a folder URI; a bare path is a local one."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def record_id(page_id: int | None, digest: str, number: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{number}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, number: int = 0, refers_to: int | None = None,
           date: str = DATE) -> bytes:
    """One WARC record; a revisit names its payload by length and digest and has none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, number)}", f"WARC-Date: {date}"]
    if url is not None:
        # header lines cannot hold control characters
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
              f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # no time in the header, so equal bytes for equal records
    return packer.compress(data) + packer.flush()


_MANIFEST = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                       ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_MANIFEST_DDL = "shard bigint, name string, temporary string, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"


class _Roller:
    """Files of one shard."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        self.system, self.root = file_system(folder)
        self.shard, self.limit, self.number, self.out = shard, file_bytes, 0, None
        self.done: list[tuple] = []
        self.system.create_dir(f"{self.root}/_temporary", recursive=True)

    def write(self, data: bytes, page_id: int | None) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard >> 16:06d}-{self.shard & 0xFFFF:04d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.system.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.hash, self.size, self.count, self.first = hashlib.sha256(), 0, 0, page_id
            info = f"software: captionforge\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, self.name)}>\r\nWARC-Date: {DATE}\r\n"
                    f"WARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n")
            self._put(head.encode() + info + b"\r\n\r\n")
        self._put(data)
        self.count, self.last = self.count + 1, page_id
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        packed = _member(data)
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.count, self.size, self.hash.hexdigest(), self.first, self.last))
            self.out, self.number = None, self.number + 1


def _write(folder: str, file_bytes: int, least: int):
    """Rows sorted by (shard, id, kind, digest): decisions (kind 0) before the pages (kind 1) they are about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, current, first_of, seen = None, None, {}, {}

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MANIFEST)], schema=_MANIFEST)

        for batch in batches:
            shards, ids, kinds, digests, firsts = (batch.column(i).to_pylist() for i in range(5))
            urls, bodies = batch.column(5), batch.column(6)
            for i, (shard, page, kind, digest, first) in enumerate(zip(shards, ids, kinds, digests, firsts)):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield packed(roller.done)
                    roller, current = _Roller(folder, shard, file_bytes), None
                if current != (shard, page):
                    current, first_of, seen = (shard, page), {}, {}
                if kind == 0:
                    first_of[digest] = first
                    continue
                payload = (bodies[i].as_py() or "").encode()
                number = seen.get(digest, 0)
                seen[digest] = number + 1
                to = first_of.get(digest, page if number and page is not None and len(payload) >= least else None)
                roller.write(record("response" if to is None else "revisit", page, urls[i].as_py(), payload, digest, number, to), page)
        if roller is not None:
            roller.close()
            yield packed(roller.done)

    return run


def _commit(folder: str):
    """Moves the manifest's files to their final names; a file that is there already stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            system, root = file_system(folder)
            for name, temporary, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
                except OSError:
                    there = system.get_file_info(f"{root}/{name}")
                    if there.type != fs.FileType.File or there.size != size:
                        raise
            yield batch.select(["name"])

    return run


def _borders(sized: DataFrame, shard_bytes: int) -> tuple[list[int], dict]:
    """Ids at which shards begin, and the parts that an id heavier than a shard is dealt to."""
    total, rows = sized.agg(F.sum("size"), F.count(F.lit(1))).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    every = max(1, rows // BORDER_SAMPLE)
    picked = sized.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).groupBy("page_id").agg(F.sum("size").alias("w"))
    heavy = sized.groupBy("page_id").agg(F.sum("size").alias("w")).where(F.col("w") > 2 * shard_bytes).collect()  # at most half the shards
    parts = {r["page_id"]: min(0xFFFF, -(-r["w"] // shard_bytes)) for r in heavy}
    light = sorted((r["page_id"], r["w"]) for r in picked.where("page_id is not null").collect() if r["page_id"] not in parts)
    if not light:
        return [], parts
    weight = np.cumsum([w for _, w in light])
    at = np.searchsorted(weight, np.arange(1, shards) * (weight[-1] / shards), "left")
    return sorted({int(light[min(i, len(light) - 1)][0]) for i in at}), parts


def _shard(borders: list[int], parts: dict) -> Column:
    edges = np.array(borders, np.int64)

    def place(ids: pa.Array, digests: pa.Array) -> pa.Array:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.searchsorted(edges, values, "right").astype(np.int64) << 16
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        out[missing] = (len(edges) + 1) << 16
        for i in np.flatnonzero(missing | np.isin(values, [k for k in parts if k is not None])) if parts else []:
            key = None if missing[i] else int(values[i])
            if key in parts:
                out[i] += int(digests[i].as_py()[:8], 16) % parts[key]
        return pa.array(out)

    return F.arrow_udf(place, "bigint")("page_id", "digest")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes one record per row below ``folder`` and returns the committed manifest (also kept in ``folder/_manifest``)."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).alias("html"))
    body = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.sha2(body.cast("binary"), 256))
    sized = materialize(rows.select("page_id", "digest", F.octet_length(body).cast("long").alias("size")), "digests")
    equal = sized.where(F.col("size") >= least)
    shared = equal.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    decisions = equal.join(shared.select("digest", "first"), "digest").where("page_id is null or page_id <> first")
    decisions = decisions.select("page_id", F.lit(0).alias("kind"), "digest", "first").distinct()
    borders, parts = _borders(sized.select("page_id", "size"), shard_bytes)
    both = rows.select("page_id", F.lit(1).alias("kind"), "digest", F.lit(None).cast("long").alias("first"), "url", "html").union(
        decisions.select("*", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")))
    placed = both.withColumn("shard", _shard(borders, parts)).select("shard", "page_id", "kind", "digest", "first", "url", "html")
    n = len(borders) + 2 + sum(parts.values())
    # more partitions than shards, so that few of these meet in one
    dealt = placed.repartition(3 * n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "digest", "url")
    manifest = dealt.mapInArrow(_write(folder, file_bytes, least), _MANIFEST_DDL)
    manifest.write.mode("errorifexists").parquet(f"{folder}/_manifest")
    return commit(spark, folder)


def commit(spark: SparkSession, folder: str) -> DataFrame:
    """Moves what the manifest names to final names; may be called again after a failure."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    manifest.select("name", "temporary", "bytes").mapInArrow(_commit(folder), "name string").write.format("noop").mode("overwrite").save()
    return manifest


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], stream.read(_READ)
    while data:
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
        data = data or stream.read(_READ)
    if parts and any(parts):
        raise ValueError("the file ends inside a record")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a member."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_RECORD_DDL = "page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        number = lambda headers, name: int(headers[name]) if name in headers else None
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_RECORD)], schema=_RECORD)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, held, found = [], 0, 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in (record for data in members(stream) for record in parse(data)):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        found += 1
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["warc-block-digest"]:
                            raise ValueError(f"{name}: damaged record {headers['warc-record-id']}")
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                        if kind == "response":
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            if own != digest:
                                raise ValueError(f"{name}: wrong payload digest in {headers['warc-record-id']}")
                        out.append((number(headers, "x-page-id"), kind, headers.get("warc-target-uri"), size, digest,
                                    number(headers, "x-refers-to-page-id"), payload if payloads and kind == "response" else None))
                        held += len(payload) if payloads else 100
                        if held > 8 << 20:
                            yield packed(out)
                            out, held = [], 0
                if found != expected:
                    raise ValueError(f"{name}: {found} records of {expected}")
                yield packed(out)

    return run


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files of the manifest, their number and digests checked; a revisit has no payload."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    files = manifest.count()
    return manifest.select("name", "records").repartition(max(1, files), "name").mapInArrow(_read(folder, payloads), _RECORD_DDL)
