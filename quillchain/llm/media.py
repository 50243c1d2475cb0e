"""Media columns: a Spark data source over archives of media members.

The source lists archive files, plans byte ranges over them, and each task reads the
archive's own directory (a ZIP central directory) to find the members that begin in its
range; payloads leave it as Arrow batches of bounded size, and a member that fails to be
read is tried again by its offset, without touching the others.  Members are greyscale
PNG images, one 8-bit sample per payload byte.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zipfile
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import files
from .common import shared_path
from .flat import flat

FORMAT, SUFFIX = "quill_media", ".zip"
UNIT = 576  # samples in a row
FILL = 255
LEVEL = 2
MOST_MEMBERS, MOST_BYTES = 1 << 14, 128 << 20  # an archive is closed at either
RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
SCHEMA = "archive string, offset long, member string, media binary, tries int, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """``text`` and fill bytes up to a positive multiple of ``UNIT``."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale image of 8 bits a sample, ``UNIT`` wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; ValueError for anything damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit greyscale image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("the image is cut short")
    lines = lines.reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered image is not one of ours")
    return lines[:, 1:].tobytes()


class ByteRange(InputPartition):
    """The members of one archive whose headers begin in [low, high)."""

    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


class Archives(WriterCommitMessage):
    def __init__(self, staged: list[str]):
        self.staged = staged


class Entry(NamedTuple):
    offset: int
    member: str  # the id as text; empty for a null id
    info: zipfile.ZipInfo


class Archive:
    """One open archive; ``again`` reopens it after a failed read."""

    def __init__(self, uri: str, opener=files.reader):
        self.uri, self.opener = uri, opener
        self.again()

    def again(self) -> None:
        self.zip = zipfile.ZipFile(self.opener(self.uri))

    def entries(self, low: int, high: int) -> list[Entry]:
        found = [Entry(i.header_offset, i.comment.decode(), i) for i in self.zip.infolist() if low <= i.header_offset < high]
        return sorted(found, key=lambda e: e.offset)

    def read(self, entry: Entry, tries: int = TRIES) -> tuple[bytes | None, int, str | None]:
        """(media, tries, error): a member's bytes, whose CRC is checked.  Each member has
        tries of its own; the last failure is reported instead of raised."""
        error = None
        for n in range(1, tries + 1):
            try:
                if n > 1:
                    self.again()
                return self.zip.open(entry.info).read(), n, None
            except (OSError, EOFError, zipfile.BadZipFile, zlib.error) as bad:
                error = f"{type(bad).__name__}: {bad}"
        return None, tries, error


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self):
        """Byte ranges from names and sizes alone: no archive is opened for planning."""
        return [ByteRange(uri, low, low + self.range_bytes) for uri, size in files.listed(self.folder, SUFFIX) for low in range(0, max(1, size), self.range_bytes)]

    def read(self, part: ByteRange):
        if part is None or not part.archive:
            return
        archive = Archive(part.archive)
        rows, size = [], 0
        for entry in archive.entries(part.low, part.high):
            media, tries, error = archive.read(entry)
            rows.append((part.archive, entry.offset, entry.member, media, tries, error))
            size += len(media or b"")
            if size >= BATCH_BYTES or len(rows) >= 2048:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string())
_NAMES = ("archive", "offset", "member", "media", "tries", "error")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES, strict=True)], names=list(_NAMES))


class MediaWriter(DataSourceArrowWriter):
    """Rows (member string, payload binary) into archives.  Tasks write staged files under
    names of their own; only those of successful tasks are moved in by ``commit``."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches) -> Archives:
        staged, out, zipped = [], None, None
        for batch in batches:
            members = batch.column(0)
            raw, at = flat(batch.column(1))
            for k in range(len(batch)):
                if zipped is None:
                    staged.append(files.unique(f"{self.folder}/_staged", SUFFIX))
                    out, count, size = files.create(staged[-1]), 0, 0
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                media = to_png(padded(raw[at[k] : at[k + 1]].tobytes()))
                info = zipfile.ZipInfo(f"{count:06d}.png")
                info.comment = (members[k].as_py() or "").encode()
                zipped.writestr(info, media)
                count, size = count + 1, size + len(media)
                if count >= MOST_MEMBERS or size >= MOST_BYTES:
                    zipped.close()
                    out.close()
                    zipped = None
        if zipped is not None:
            zipped.close()
            out.close()
        return Archives(staged)

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.staged if m else ():
                files.move(name, f"{self.folder}/{name.rsplit('/', 1)[1]}")
        files.delete_folder(f"{self.folder}/_staged")

    def abort(self, messages) -> None:
        files.delete_folder(f"{self.folder}/_staged")


class MediaSource(DataSource):
    """``spark.read.format("quill_media").load(folder)``; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"])


def write_media(rows: DataFrame, folder: str) -> None:
    """Stores rows (member, payload) as archives in ``folder``, which all executors share."""
    rows.sparkSession.dataSource.register(MediaSource)
    rows.select(F.col("member").cast("string").alias("member"), F.col("payload").cast("binary").alias("payload")).write.format(FORMAT).mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, offset, member, media, tries, error): ``error`` says why a member could
    not be read in ``TRIES`` tries, and its media is null then."""
    spark.dataSource.register(MediaSource)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).load(folder)


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which of 64 equal
    parts are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count / len(x)
    level = np.arange(256)
    mean = float((p * level).sum())
    spread = math.sqrt(max(0.0, float((p * level * level).sum()) - mean * mean))
    some = p[p > 0]
    entropy = abs(float((some * np.log2(some)).sum()))
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    parts = np.add.reduceat(x, edges[:-1], dtype=np.int64) / np.diff(edges)
    bits = int(np.packbits(parts > mean).view(">u8")[0])
    return f"mean={mean:.3f} sd={spread:.3f} entropy={entropy:.3f} hash={bits:016x}"


def _digests(batches):
    """(member, media, error) to op5's columns; a member that could not be read fails the
    task, so nothing is silently left out."""
    for batch in batches:
        rows = []
        for media, error in zip(batch.column(1), batch.column(2), strict=True):
            if error.as_py() is not None:
                raise OSError(error.as_py())
            stored = media.as_buffer().to_pybytes()
            payload = from_png(stored)
            text = len(payload.rstrip(bytes([FILL])))  # UTF-8 has no such byte
            rows.append((text, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
        cols = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["member", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per document from its stored media: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null texts count as empty; an empty text is one row of fill bytes; repeated rows are
    members of their own with equal values; null ids come back null; an empty table gives
    an empty result; further columns are ignored.  Nothing is shuffled.  ``folder``
    (default: a new one in the shared folder) keeps the archives.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "media")
    rows = docs.select(F.col(doc_id).cast("string").alias("member"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
    write_media(rows, folder)
    stored = read_media(spark, folder).select("member", "media", "error")
    out = stored.mapInArrow(_digests, "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    kind = docs.schema[doc_id].dataType.simpleString()
    return out.select(F.when(F.col("member") != "", F.col("member")).cast(kind).alias("doc_id"), *out.columns[1:])


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
