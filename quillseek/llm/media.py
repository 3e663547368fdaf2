"""Media columns: payloads as images in archives, read back by a Spark data source of our own.

`store_media` writes payloads as 8-bit grey PNG images, 64 samples a row, into ZIP archives in
a shared folder; PNG compresses losslessly, so equal payloads have equal files. An archive
has at most ARCHIVE_BYTES or ARCHIVE_MEMBERS. Archives count once the task that wrote them has
reported them in the manifest, so a lost or repeated task leaves none twice.

The manifest is dealt into PARTS parts by the archives' names. The data source `media_archive`
plans byte ranges over the parts, or over a folder of archives: a partition is one range of the bytes that a part's
archives have one after the other, and holds the members that begin in it. So the driver sees a
sum for each part, and a range finds its archives itself. It reads their directories, then
each member by its offset; a member whose bytes can't be read or don't match
their checksum is read again, up to `retries` times, without its neighbours. Members stream to Spark as Arrow batches of
at most BATCH_BYTES. With `on_error` = `null` a member that stays bad gives a row with a null
payload and the error; else it fails the task.

Defined cases: null ids and ids of any sign; a null text is empty, and a payload is at least
one row of 64 zero bytes; repeated rows are members of their own; payloads over the limit
of an archive get one alone; an empty table gives an empty result. Only id and text are stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import discard, scratch_path, small_batches, stored

WIDTH = 64
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 32 << 20, 20_000
#: Bytes of a range, and how many ranges there are at most: ranges get longer beyond.
RANGE_BYTES, MOST_RANGES = 8 << 20, 50_000
#: Parts of a manifest.
PARTS = 256
BATCH_BYTES, BATCH_MEMBERS = 4 << 20, 1000
RETRIES = 3
#: Fixed values of the PNG and ZIP formats.
PNG_MAGIC, ZIP_LOCAL = b"\x89PNG\r\n\x1a\n", b"PK\x03\x04"
SCHEMA = "doc_id bigint, n_bytes bigint, member string, payload binary, media_bytes bigint, media_sha256 string, error string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 filled up with bytes 0 to a positive multiple of WIDTH, length before)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, WIDTH a row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def unpng(image: bytes) -> bytes:
    """The samples of what `png` made; ValueError if anything is wrong with it."""
    if image[:8] != PNG_MAGIC:
        raise ValueError("no PNG")
    at, data, size = 8, [], None
    while at + 12 <= len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != image[at + 8 + n : at + 12 + n]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if not size or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all payloads to archives under path; the manifest (archive, bytes, members, part), stored by parts. A row for each archive."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        fs.create_dir(base, recursive=True)
        done, members, size, sink, archive, name = [], 0, 0, None, None, None

        def close() -> None:
            archive.close()
            sink.close()
            done.append((name, fs.get_file_info(f"{base}/{name}").size, members))

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload, n = payload_of(text)
                image = png(payload)
                if archive and (members >= ARCHIVE_MEMBERS or size + len(image) > ARCHIVE_BYTES):
                    close()
                    archive = None
                if not archive:
                    members, size, name = 0, 0, f"{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                archive.writestr(f"{members}_{'null' if key is None else key}_{n}.png", image)
                members, size = members + 1, size + len(image)
        if archive:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "bytes", "members"])

    found = stored(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "archive string, bytes bigint, members bigint"), "media-archives")
    # a file for each part, dealt out from what is written: a repeated task would report other archives
    where = scratch_path(docs.sparkSession, "media-manifest")
    found.withColumn("part", F.pmod(F.xxhash64("archive"), F.lit(PARTS)).cast("int")).repartition(PARTS, "part").write.partitionBy("part").parquet(where)
    discard(docs.sparkSession, found)
    out = docs.sparkSession.read.schema("archive string, bytes bigint, members bigint, part int").parquet(where)
    out.scratch = where
    return out


class ByteRange(InputPartition):
    """Bytes from begin to end of the archives of a part (-1: of a folder), one after the other."""

    def __init__(self, part: int, begin: int, end: int):
        self.part, self.begin, self.end = part, begin, end


def plan_ranges(parts: list[tuple[int, int]], size: int) -> list[ByteRange]:
    size = max(size, -(-sum(n for _, n in parts) // MOST_RANGES))
    return [ByteRange(p, at, min(at + size, n)) for p, n in parts for at in range(0, n, size)]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.manifest = options.get("manifest")
        self.parts = json.loads(options.get("parts", "null"))
        self.range = int(options.get("range_bytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.null = options.get("on_error", "fail") == "null"

    def archives(self, part: int) -> list[tuple[str, int]]:
        """(archive, bytes) of a part of the manifest, or of the folder, in order."""
        if part < 0:
            fs, base = opened(self.path)
            return sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".zip"))
        fs, base = opened(f"{self.manifest}/part={part}")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".parquet")]
        tables = [pq.read_table(f, columns=["archive", "bytes"], filesystem=fs, partitioning=None) for f in files]
        return sorted((r["archive"], r["bytes"]) for t in tables for r in t.to_pylist())

    def partitions(self) -> list[ByteRange]:
        parts = self.parts
        if parts is None:
            parts = [(-1, sum(n for _, n in self.archives(-1)))]
        return plan_ranges(parts, self.range) or [ByteRange(-1, 0, 0)]

    def member(self, f: pa.NativeFile, info: zipfile.ZipInfo) -> tuple[bytes, bytes]:
        """(image, payload) of one member, by its offset."""
        head = f.read_at(30, info.header_offset)
        if head[:4] != ZIP_LOCAL:
            raise OSError("no member at this offset")
        skip = 30 + sum(struct.unpack("<HH", head[26:30]))
        image = f.read_at(info.compress_size, info.header_offset + skip)
        if len(image) != info.file_size or zlib.crc32(image) != info.CRC:
            raise OSError("wrong bytes")
        return image, unpng(image)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows, size, first = [], 0, 0
        for archive, n in self.archives(partition.part) if partition.end > partition.begin else ():
            begin, end, first = partition.begin - first, partition.end - first, first + n
            if end <= 0 or begin >= n:
                continue
            for row in self.members(archive, begin, end):
                rows.append(row)
                size += len(row[3] or b"")
                if size >= BATCH_BYTES or len(rows) >= BATCH_MEMBERS:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def members(self, archive: str, begin: int, end: int) -> Iterator[tuple]:
        """A row for each member of an archive that begins there."""
        fs, base = opened(self.path)
        where = f"{base}/{archive}"
        with fs.open_input_file(where) as f:
            infos = [i for i in zipfile.ZipFile(f).infolist() if begin <= i.header_offset < end]
        f = fs.open_input_file(where)
        try:
            for info in infos:
                image = payload = error = None
                for attempt in range(self.retries + 1):
                    try:
                        image, payload = self.member(f, info)
                        error = None
                        break
                    except (OSError, ValueError, zlib.error) as e:
                        error = f"{archive} at {info.header_offset}: {e}"
                        time.sleep(0.05 * attempt)
                        f.close()
                        f = fs.open_input_file(where)
                if error and not self.null:
                    raise OSError(error)
                _, key, n = info.filename.removesuffix(".png").split("_")
                yield None if key == "null" else int(key), int(n), info.filename, payload, len(image) if image else None, hashlib.sha256(image).hexdigest() if image else None, error
        finally:
            f.close()

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("member", pa.string()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])


class MediaArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder); options range_bytes, retries, on_error, and manifest and parts as `read_media` sets them."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_media(spark: SparkSession, path: str, manifest: DataFrame | None = None, **options) -> DataFrame:
    """All members under path; with a manifest only those of its archives (the driver gets a sum for each part)."""
    small_batches(spark)
    spark.dataSource.register(MediaArchiveSource)
    reader = spark.read.format("media_archive").options(**options)
    if manifest is not None:
        parts = manifest.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect()
        reader = reader.option("manifest", manifest.scratch).option("parts", json.dumps([[r["part"], r["bytes"]] for r in parts]))
    return reader.load(path)


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and how many rows of the image are blank."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    some = p[p > 0]
    blank = int((~x.reshape(-1, WIDTH).any(axis=1)).sum())
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};rows={len(x) // WIDTH};blank={blank}"


def media_columns(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts, read the stored bytes back: SCHEMA's columns and `feature` for every row of docs."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "media")
    rows = read_media(spark, path, store_media(docs, path, id_col, text_col))
    at = rows.columns.index("payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(p.as_py()) if p.is_valid else None for p in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "feature"])

    return rows.mapInArrow(run, SCHEMA + ", feature string")


__all__ = ["MediaArchiveSource", "features", "media_columns", "payload_of", "png", "read_media", "store_media", "unpng"]
