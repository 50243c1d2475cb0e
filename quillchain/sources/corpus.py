"""Text files as a corpus table, split between tasks at paragraphs.

A file of any size is read as lines, in Spark's own splits.  Each task puts the lines of a
split together again and cuts them after blank lines, so that what comes out are runs of
whole paragraphs; the paragraph that crosses a split's border is put together from the end
of one split and the beginning of the next.
"""

from __future__ import annotations

import codecs

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError, CorpusError

POLICIES = ("strict", "replace", "ignore")
PIECE_BYTES = 1 << 18  # a row holds about so many bytes of whole paragraphs
MOST_BYTES = 16 << 20  # a longer paragraph is cut, at the end of a line
WHOLE, HEAD, TAIL = 0, 1, 2  # a piece may begin or end at the border of a split


@F.pandas_udf(T.StringType())
def _ignoring(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise CorpusError(f"no such corpus: {path}")
    return fs.getFileStatus(hadoop).isDirectory()


def _without(files: DataFrame, exclude: str | None) -> DataFrame:
    """Rows whose ``path`` is neither ``exclude`` nor below it."""
    if not exclude:
        return files
    hadoop = files.sparkSession._jvm.org.apache.hadoop.fs.Path(exclude)
    full = hadoop.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).makeQualified(hadoop)
    for name in {full.toString(), full.toUri().toString()}:  # lines know their file's percent-encoded URI
        files = files.where((F.col("path") != name) & ~F.col("path").startswith(name + "/"))
    return files


def _reader(spark: SparkSession, path: str, kind: str):
    read = spark.read.format(kind).option("recursiveFileLookup", True)
    return read.option("pathGlobFilter", "*.txt") if _is_folder(spark, path) else read


def fingerprints(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(path, size_bytes, modified_ns), listed without reading contents."""
    files = _without(_reader(spark, path, "binaryFile").load(path), exclude)
    return files.select("path", F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns")).orderBy("path")


_PIECE = pa.schema([("path", pa.string()), ("block", pa.int64()), ("no", pa.int32()), ("edge", pa.int32()), ("raw", pa.binary())])
PIECE = "path string, block long, no int, edge int, raw binary"


class _Split:
    """Pieces of one split; what follows its last blank line is held until the split ends."""

    def __init__(self, path: str, block: int, most: int):
        self.path, self.block, self.most, self.no, self.held = path, block, most, 0, b""

    def _row(self, raw: bytes, edge: int) -> tuple:
        self.no += 1
        return self.path, self.block, self.no - 1, edge, raw

    def _cut(self, lines: memoryview, ends: np.ndarray, at: int, upto: int, edge: int) -> tuple[list[tuple], int]:
        """Rows of what is held and ``lines`` from ``at`` on, as long as that is too much for
        one paragraph up to ``upto``; and where the rest begins."""
        out = []
        while len(self.held) + upto - at > self.most:
            k = int(np.searchsorted(ends, at + max(0, self.most - len(self.held)), "right")) - 1
            cut = int(ends[max(k, int(np.searchsorted(ends, at, "right")))])
            if cut >= upto:
                break
            out.append(self._row(self.held + bytes(lines[at:cut]), WHOLE if out else edge))
            self.held, at = b"", cut
        return out, at

    def add(self, lines: memoryview, ends: np.ndarray, blank: np.ndarray) -> list[tuple]:
        """``lines`` are bytes of whole lines, ``ends`` where each ends, ``blank`` which are."""
        out, at, cuts = [], 0, ends[blank]
        while len(cuts):
            first = self.no == 0 and self.block > 0  # the rest of a paragraph that began in the split before
            k = 0 if first else min(len(cuts) - 1, max(int(np.searchsorted(cuts, at + PIECE_BYTES)), int(np.searchsorted(cuts, at, "right"))))
            if cuts[k] <= at:
                break
            some, at = self._cut(lines, ends, at, int(cuts[k]), HEAD if first else WHOLE)
            out += some
            out.append(self._row(self.held + bytes(lines[at : cuts[k]]), HEAD if first and not some else WHOLE))
            self.held, at = b"", int(cuts[k])
        some, at = self._cut(lines, ends, at, len(lines), HEAD if self.no == 0 and self.block else WHOLE)
        self.held += bytes(lines[at:])
        return out + some

    def end(self) -> list[tuple]:
        if not self.held:
            return []
        # a split without a blank line only ends the paragraph before it, and is cut there
        return [self._row(self.held, HEAD if self.no == 0 and self.block else TAIL)]


def _assembled(most: int):
    def assemble(batches):
        split = None
        for batch in batches:
            if not len(batch):
                continue
            path, block, line, blank = (batch.column(k) for k in range(4))
            size = np.concatenate([[0], np.cumsum(np.diff(np.frombuffer(line.buffers()[1], np.int32)[line.offset : line.offset + len(line) + 1].astype(np.int64)))])
            first = int(np.frombuffer(line.buffers()[1], np.int32)[line.offset])
            data = memoryview(line.buffers()[2])[first : first + int(size[-1])] if size[-1] else memoryview(b"")
            blocks, names, empty = block.to_numpy(), path.dictionary_encode().indices.to_numpy(), blank.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])]))
            rows = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)]):
                own = path[i].as_py(), int(blocks[i])
                if split is None or (split.path, split.block) != own:
                    rows += split.end() if split else []
                    split = _Split(*own, most)
                rows += split.add(data[size[i] : size[j]], size[i + 1 : j + 1] - size[i], empty[i:j])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)
        if split and (rows := split.end()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    return assemble


def pieces(spark: SparkSession, path: str, exclude: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, block, no, raw): runs of whole paragraphs as bytes, in Spark's splits.

    ``block`` is where the split begins in the file, ``no`` counts inside it.  Only the
    pieces at borders of splits are shuffled.
    """
    lines = _reader(spark, path, "text").option("lineSep", "\n").load(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"), F.col("value").rlike(r"^[\s\x1c-\x1f]*$").alias("blank"))
    found = _without(lines, exclude).mapInArrow(_assembled(most_bytes), PIECE)
    edges = found.where(f"edge > {WHOLE}")
    heads = edges.where(f"edge = {HEAD}").select("path", F.col("block").alias("next"), F.col("raw").alias("rest"))
    order = Window.partitionBy("path").orderBy("block")  # a row per split
    after = edges.select("path", "block").distinct().withColumn("next", F.lead("block").over(order))
    tails = edges.where(f"edge = {TAIL}").join(after, ["path", "block"]).withColumn("tail", F.lit(True))
    joined = tails.join(heads, ["path", "next"], "full_outer")
    whole = joined.select("path", F.coalesce("block", "next").alias("block"), F.coalesce("no", F.lit(0)).alias("no"), F.concat(F.coalesce("raw", F.lit(b"")), F.coalesce("rest", F.lit(b""))).alias("raw"))
    return found.where(f"edge = {WHOLE}").select("path", "block", "no", "raw").unionByName(whole)


def decoded(content: Column, path: Column, errors: str) -> Column:
    if errors == "ignore":
        return _ignoring(content)
    text = content.cast("string")
    if errors == "replace":
        return F.make_valid_utf8(text)
    bad = F.raise_error(F.concat(F.lit("malformed UTF-8 in "), path)).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(bad)


def read_corpus(spark: SparkSession, path: str, errors: str = "strict", exclude: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, path, text, replacements): the paragraphs of every .txt file below ``path``,
    or of that file; a row holds a run of whole paragraphs.

    ``strict`` fails at the first file with malformed bytes, naming it; ``replace`` puts
    U+FFFD and ``ignore`` nothing in their place.  ``replacements`` counts U+FFFD in the
    text under every policy, so genuine ones count too.
    """
    if errors not in POLICIES:
        raise ConfigurationError(f"errors is one of {', '.join(POLICIES)}")
    if fingerprints(spark, path, exclude).isEmpty():
        raise CorpusError(f"no .txt file below {path}")
    rows = pieces(spark, path, exclude, most_bytes)
    raw = F.substring("raw", F.lit(1), F.length("raw") - 1)  # the last line's end was put there by ``pieces``
    rows = rows.withColumn("text", decoded(raw, F.col("path"), errors))
    count = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    return rows.select(F.xxhash64("path", "block", "no").alias("doc_id"), "path", "text", count.alias("replacements"))


def malformed_at(path: str) -> int | None:
    """The position of the first byte of a file that is not UTF-8, read as a stream."""
    path = "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path
    where, name = arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    decoder, at = codecs.getincrementaldecoder("utf-8")(), 0
    with where.open_input_stream(name, compression=None) as stream:
        while True:
            block = stream.read(1 << 20)
            waiting = len(decoder.getstate()[0])
            try:
                decoder.decode(block, not block)
            except UnicodeDecodeError as bad:
                return at - waiting + bad.start
            if not block:
                return None
            at += len(block)
