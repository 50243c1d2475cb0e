"""WARC from legacy archives: an ARC to WARC converter and a WARC reader.

ARC files of either version are parsed record by record: the version block names the
header fields, each header line declares its record's length, and nothing but that length
says where a record ends.  Each record gets what WARC asks for and ARC lacks: an
identifier derived from its content and place (so a repeated task makes the same one), an
ISO timestamp, a record type, and SHA-1 digests.  Payloads that occur more than once
become revisits of one response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import shared_path, written
from .flat import flat

V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
LEAST_REVISIT = 1000  # payload bytes
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "X-Page-Id"  # the extension field that carries a row's id
CAPTURED = "20200101000000"
READ_BYTES = 1 << 18
LEVEL = 2


class ArcRecord(NamedTuple):
    offset: int  # of its gzip member, or of its header in a plain file
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes


# --- gzip members and plain streams


def members(stream, at: int = 0, one: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member from ``at`` on; memory holds one member."""
    stream.seek(at)
    data = stream.read(READ_BYTES)
    while data:
        start, inflate, out = at, zlib.decompressobj(31), []
        while True:
            out.append(inflate.decompress(data))
            if inflate.eof:
                at += len(data) - len(inflate.unused_data)
                data = inflate.unused_data or stream.read(READ_BYTES)
                break
            at += len(data)
            data = stream.read(READ_BYTES)
            if not data:
                raise ValueError(f"a gzip member at {start} is cut short")
        yield start, b"".join(out)
        if one:
            return


def gzipped(record: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


# --- ARC


def arc_fields(version_block: bytes) -> tuple[str, ...]:
    """The header fields that a version block (the content of a filedesc record) declares."""
    first, _, rest = version_block.partition(b"\n")
    version = first.split(b" ", 1)[0].decode("ascii", "replace").strip()
    told = tuple(rest.partition(b"\n")[0].decode("ascii", "replace").split())
    if version not in ("1", "2"):
        raise ValueError(f"no known ARC version: {version!r}")
    fields = V1 if version == "1" else V2
    if told and told != fields:
        raise ValueError(f"version {version} with fields {told}")
    return fields


def arc_header(line: bytes, fields: tuple[str, ...]) -> dict[str, str]:
    """The header line by field.  URLs of old crawlers may hold spaces, so the line is
    split from its right end."""
    parts = line.decode("utf-8", "surrogateescape").rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header: {line[:200]!r}")
    return dict(zip(fields, parts, strict=True))


def _own_fields(line: bytes) -> tuple[str, ...]:
    """Fields of a file's first line, told from their number."""
    return V2 if line.count(b" ") >= len(V2) - 1 else V1


def arc_records(stream, at: int = 0, one: bool = False, fields: tuple[str, ...] | None = None) -> Iterator[ArcRecord]:
    """The records of an ARC file, its filedesc record first; plain or gzipped by member.
    ``at`` with ``fields`` starts in the middle."""
    stream.seek(0)
    zipped = stream.read(2) == b"\x1f\x8b"
    for offset, data in members(stream, at, one) if zipped else _plain(stream, at):
        where = 0
        while where < len(data):
            end = data.index(b"\n", where)
            line = data[where:end].rstrip(b"\r")
            if not line:
                where = end + 1
                continue
            head = arc_header(line, fields or _own_fields(line))
            size = int(head["Archive-length"])
            content = data[end + 1 : end + 1 + size]
            if len(content) != size:
                raise ValueError(f"the record at {offset + where} declares {size} bytes and has {len(content)}")
            if head["URL"].startswith("filedesc://"):
                fields = arc_fields(content)
            yield ArcRecord(offset if zipped else offset + where, head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], content)
            if one:
                return
            where = end + 1 + size


def _plain(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """A plain ARC file as (offset, one record) pieces, cut by the declared lengths."""
    stream.seek(at)
    data = b""
    while True:
        while b"\n" not in data:
            more = stream.read(READ_BYTES)
            if not more:
                if data.strip():
                    raise ValueError(f"a header at {at} is cut short")
                return
            data += more
        line, _, rest = data.partition(b"\n")
        if not line.strip():
            at, data = at + len(line) + 1, rest
            continue
        size = int(line.rsplit(b" ", 1)[-1])
        while len(rest) < size:
            more = stream.read(max(READ_BYTES, size - len(rest)))
            if not more:
                raise ValueError(f"the record at {at} declares {size} bytes and has {len(rest)}")
            rest += more
        yield at, line + b"\n" + rest[:size]
        at, data = at + len(line) + 1 + size, rest[size:]


def arc_bytes(fields: tuple[str, ...], url: str, date: str, content_type: str, content: bytes, name: str, offset: int = 0, code: str = "-") -> bytes:
    """One record with its header line, closed by a newline."""
    told = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": content_type, "Result-code": code, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content))}
    return " ".join(told[f] for f in fields).encode("utf-8", "surrogateescape") + b"\n" + content + b"\n"


def version_block(fields: tuple[str, ...]) -> bytes:
    return f"{1 if fields == V1 else 2} 0 quillchain\n{' '.join(fields)}\n".encode()


# --- what WARC needs and ARC lacks


def iso_date(date: str) -> str:
    """YYYYMMDDhhmmss, or a beginning of it from the year on, as an ISO timestamp; the
    start of 1970 for anything else."""
    if not re.fullmatch(r"\d{4,14}", date) or len(date) % 2:
        return "1970-01-01T00:00:00Z"
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, r: ArcRecord) -> str:
    """A name-based UUID of the record's place and content."""
    key = "\n".join((archive, str(r.offset), r.url, r.date, hashlib.sha1(r.content).hexdigest()))
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def warc_type(r: ArcRecord) -> tuple[str, str]:
    """(WARC-Type, Content-Type) of an ARC record."""
    if r.url.startswith("filedesc://"):
        return "warcinfo", "application/warc-fields"
    if r.content.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", r.content_type if "/" in r.content_type else "application/octet-stream"


def http_split(content: bytes) -> tuple[bytes, bytes]:
    """(headers with their closing blank line, payload) of an HTTP response; other content
    is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    found = re.search(rb"\r?\n\r?\n", content)
    return (content[: found.end()], content[found.end() :]) if found else (content, b"")


def http_field(headers: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", headers)
    return found[1].decode("utf-8", "surrogateescape").strip() if found else None


def sha1_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", sha1_of(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def converted(archive: str, r: ArcRecord, revisit: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; ``revisit``: id, URL and date of the response
    whose payload it repeats."""
    kind, content_type = warc_type(r)
    headers, payload = http_split(r.content)
    fields = [("WARC-Type", "revisit" if revisit else kind), ("WARC-Record-ID", record_id(archive, r)), ("WARC-Date", iso_date(r.date)), ("Content-Type", content_type)]
    if kind == "warcinfo":
        block = f"software: quillchain\r\nformat: WARC File Format 1.0\r\ndescription: converted from {archive}\r\n".encode()
        return warc_bytes(fields, block)
    fields += [("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", sha1_of(payload))]
    page = http_field(headers, PAGE)
    if page is not None:
        fields.append((PAGE, page))
    if not revisit:
        return warc_bytes(fields, r.content)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", revisit[0]), ("WARC-Refers-To-Target-URI", revisit[1]), ("WARC-Refers-To-Date", revisit[2])]
    return warc_bytes(fields, headers)


class WarcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]  # by lower-case name
    block: bytes


def warc_records(stream) -> Iterator[WarcRecord]:
    """The records of a WARC file gzipped by member; declared lengths and block digests
    are checked."""
    for offset, data in members(stream):
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"the record at {offset} has not the {size} bytes it declares")
        if fields.get("warc-block-digest", sha1_of(block)) != sha1_of(block):
            raise ValueError(f"the block digest at {offset} differs")
        yield WarcRecord(offset, fields, block)


# --- Spark jobs


def _arc_writer(folder: str):
    def write(batches):
        out, name, fields, size = None, None, V1, 0
        for batch in batches:
            ids, urls = batch.column(0), batch.column(1)
            raw, at = flat(batch.column(2))
            for k in range(len(batch)):
                if out is None:
                    name = files.unique(folder, ".arc.gz")
                    base = name.rsplit("/", 1)[1]
                    fields = V2 if int(base[-9], 16) % 2 else V1  # both versions are written
                    out = files.create(name)
                    size = out.write(gzipped(arc_bytes(fields, f"filedesc://{base}", CAPTURED, "text/plain", version_block(fields), base)))
                page, payload = ids[k].as_py(), raw[at[k] : at[k + 1]].tobytes()
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", urls[k].as_py() or "") or "urn:x-none:"
                told = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                told += "" if page is None else f"{PAGE}: {page}\r\n"
                size += out.write(gzipped(arc_bytes(fields, url, CAPTURED, "text/html", told.encode() + b"\r\n" + payload, base, size, "200")))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    return write


def write_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Stores each row as a record of an ARC file, one file a task; (archive) of the files
    that successful tasks have written."""
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return written(rows.mapInArrow(_arc_writer(folder), "archive string"), "warc-arcs")


INDEX = "archive string, at long, version int, id string, uri string, date string, kind string, page string, bytes long, digest string"


def _index(batches):
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows, version = [], 1
            base = name.rsplit("/", 1)[1]
            with files.reader(name) as stream:
                for r in arc_records(stream):
                    if r.url.startswith("filedesc://"):
                        version = 2 if arc_fields(r.content) == V2 else 1
                    headers, payload = http_split(r.content)
                    rows.append((name, r.offset, version, record_id(base, r), r.url, iso_date(r.date), warc_type(r)[0], http_field(headers, PAGE), len(payload), hashlib.sha1(payload).hexdigest()))
                    if len(rows) == 4096:
                        yield _rows(rows, _INDEX_TYPES)
                        rows = []
            if rows:
                yield _rows(rows, _INDEX_TYPES)


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values(), strict=True)], names=list(types))


_INDEX_TYPES = dict(zip("archive at version id uri date kind page bytes digest".split(), (pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int64(), pa.string()), strict=True))


def _dealt(archives: DataFrame) -> DataFrame:
    """File names over tasks, so many to a task that the number of tasks is moderate."""
    n = archives.count()
    slots = archives.sparkSession.sparkContext.defaultParallelism
    return archives.repartition(max(1, min(n, max(4 * slots, n // 8))))


def _converter(folder: str):
    def convert(batches):
        out, name, stream, source = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = files.unique(folder, ".warc.gz")
                    out = files.create(name)
                if row["archive"] != source:
                    if stream is not None:
                        stream.close()
                    source, stream = row["archive"], files.reader(row["archive"])
                fields = V2 if row["version"] == 2 else V1
                record = next(arc_records(stream, row["at"], True, fields))
                revisit = (row["to_id"], row["to_uri"], row["to_date"]) if row["to_id"] else None
                out.write(gzipped(converted(source.rsplit("/", 1)[1], record, revisit)))
        if out is not None:
            stream.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    return convert


def arc_to_warc(archives: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Converts ARC files (archive: URI) to WARC files in ``folder``; (archive) of those
    written.

    Of records with equal payloads of at least ``least`` bytes the one with the largest
    page id (a number; by record id if there is none) stays a response.  Copies are counted
    by digest with partial sums; what is joined back to the records is one row a digest.
    Payloads are never shuffled: each task reads its records where they lie.
    """
    index = written(_dealt(archives).mapInArrow(_index, INDEX), "warc-index")
    big = (F.col("kind") == "response") & (F.col("bytes") >= least)
    first = F.max(F.struct(F.col("page").cast("decimal(38,0)").alias("n"), "id", "uri", "date"))
    kept = index.where(big).groupBy("digest").agg(first.alias("to"), F.count("*").alias("n")).where("n > 1")
    kept = kept.select("digest", F.col("to.id").alias("to_id"), F.col("to.uri").alias("to_uri"), F.col("to.date").alias("to_date"))
    copies = index.where(big).join(kept, "digest").where("id <> to_id").select("archive", "at", "to_id", "to_uri", "to_date")
    copies = written(copies, "warc-copies")
    plan = index.select("archive", "at", "version").join(copies, ["archive", "at"], "left")
    n = max(1, archives.count())
    slots = archives.sparkSession.sparkContext.defaultParallelism
    plan = plan.repartition(max(1, min(n, max(4 * slots, n // 8))), "archive").sortWithinPartitions("archive", "at")
    return written(plan.mapInArrow(_converter(folder), "archive string"), "warc-files")


WARC = "id string, type string, uri string, date string, page string, payload_bytes long, payload_digest string, refers_to_id string"
_WARC_TYPES = dict(zip("id type uri date page payload_bytes payload_digest refers_to_id".split(), (*[pa.string()] * 5, pa.int64(), pa.string(), pa.string()), strict=True))


def _read(batches):
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows = []
            with files.reader(name) as stream:
                for r in warc_records(stream):
                    f = r.fields
                    if f["warc-type"] == "warcinfo":
                        continue
                    headers, payload = http_split(r.block)
                    told = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex()
                    size = len(payload)
                    if f["warc-type"] == "revisit":
                        size = int(http_field(headers, "Content-Length") or 0)
                    elif hashlib.sha1(payload).hexdigest() != told:
                        raise ValueError(f"{name}: the payload digest at {r.offset} differs")
                    rows.append((f["warc-record-id"], f["warc-type"], f["warc-target-uri"], f["warc-date"], f.get(PAGE.lower()), size, told, f.get("warc-refers-to")))
                    if len(rows) == 4096:
                        yield _rows(rows, _WARC_TYPES)
                        rows = []
            if rows:
                yield _rows(rows, _WARC_TYPES)


def read_warc(archives: DataFrame) -> DataFrame:
    """(id, type, uri, date, page, payload_bytes, payload_digest, refers_to_id): every
    record of the WARC files (archive: URI) but warcinfo; digest and size are those of the
    full payload, for revisits as their headers tell."""
    return _dealt(archives).mapInArrow(_read, WARC)


def archived_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """One row per page as read back from WARC: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, warc_date, record_id.

    Rows go through ARC files of both versions and the converter.  A null html is an empty
    payload, always a response; null ids come back null; repeated rows are records of
    their own (of which one is the response); a null or empty url is stored as
    ``urn:x-none:``, spaces and controls in others percent-encoded; an empty table gives an
    empty result; further columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    arcs = write_arc(pages, f"{folder}/arc", page_id, url, html)
    warcs = arc_to_warc(arcs, f"{folder}/warc")
    files.delete_folder(f"{folder}/arc")
    records = written(read_warc(warcs), "warc-records")
    kind = pages.schema[page_id].dataType.simpleString()
    known = records.where("type = 'response'").select(F.col("id").alias("refers_to_id"), F.col("page").alias("to"))
    first = records.where("refers_to_id is null").withColumn("to", F.lit(None).cast("string"))  # most records: no key to shuffle by
    out = first.unionByName(records.where("refers_to_id is not null").join(known, "refers_to_id", "left"))
    return out.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("to").cast(kind).alias("refers_to"), F.col("uri").alias("url"), F.col("date").alias("warc_date"), F.col("id").alias("record_id"))


def op1_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
