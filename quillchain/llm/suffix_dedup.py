"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

The arrays are sparse: of all suffixes those are kept that start at an anchor, the least
16-gram hash of some window of 272 starts.  Where two strings of 400 bytes are equal,
their anchors lie at the same offset, and the suffixes from there agree in 128 bytes at
least.  A level of the family is a table of suffixes in lexicographic order of these bytes,
in which an interval of suffixes with the same 128 bytes is one row with its length; it is
stored in sorted buckets, so two levels are scanned against each other, and merged, by one
pass over both, without a shuffle or a sort.  New batches get arrays of their own, are
scanned against every level, and levels of equal size merge, so a suffix is rewritten a
logarithmic number of times.

Suffixes that the scans find again are candidates; whether and how far the bytes around
them agree is settled by their whole surroundings, one representative of each kind.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import NODE, node_of
from .common import CLEANUP, discard, settings, shared_path, slim_batches, written
from .flat import U64, Rolling, chunks, flat, grams, mix

LENGTH, GRAM, WINDOW = 400, 16, 272
PREFIX = LENGTH - WINDOW  # bytes that equal strings share from their anchor on
BATCHES = 4
SUFFIXES_A_BUCKET = 100_000
STEP = 24  # starts are first compared in groups of so many
PLACE_BITS = 31  # of a place in a chunk; the other bits of a hash rank grams, in every chunk alike
SUFFIX = f"s binary, c long, node {NODE}, lo int, n int, back int"


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """(row, lo, n, anchor, rolling): each anchor with the run of starts it stands for.

    Starts are positions with ``LENGTH`` bytes of the same text from there on; the anchor
    of a start is the leftmost least 16-gram of the ``WINDOW`` starts from it on, which
    lies within its 400 bytes, so equal strings have equal anchors.
    """
    size = np.diff(offsets)
    roll = Rolling(raw)
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (roll,)
    low = U64((1 << PLACE_BITS) - 1)
    value = (grams(raw, GRAM) & ~low) | np.arange(len(raw) - GRAM + 1, dtype=U64)
    pad = (-len(value)) % WINDOW
    grid = np.concatenate([value, np.full(pad, ~U64(0))]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    starts = len(raw) - LENGTH + 1
    least = np.minimum(back[:starts], ahead[WINDOW - 1 : WINDOW - 1 + starts])
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:starts]
    ok = np.arange(starts) + LENGTH <= offsets[1:][row]
    s = np.flatnonzero(ok)
    if not len(s):
        return (np.zeros(0, np.int64),) * 4 + (roll,)
    new = np.ones(len(s), bool)
    new[1:] = (anchor[s[1:]] != anchor[s[:-1]]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    lo, n = s[at], np.diff(np.append(at, len(s)))
    return row[lo], lo, n, anchor[lo], roll


def _suffixes(batches):
    """(node, text) to SUFFIX rows: s the first bytes of the suffix, c the fingerprint of all
    bytes that the run's strings cover, lo and n the run, back how far the anchor lies
    behind lo."""
    for batch in batches:
        raw, at = flat(batch.column(1))
        node = batch.column(0)
        for i, j in chunks(at):
            text, own = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            row, lo, n, anchor, roll = anchors(text, own)
            c = mix(roll.of(lo, lo + n - 1 + LENGTH) + (anchor - lo).astype(U64) * U64(1 << 32) + n.astype(U64))
            first = np.lib.stride_tricks.sliding_window_view(text, PREFIX)[anchor] if len(anchor) else np.zeros((0, PREFIX), np.uint8)
            s = pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer((np.arange(len(anchor) + 1) * PREFIX).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(first))])
            yield pa.RecordBatch.from_arrays([s, pa.array(c.view(np.int64)), node.slice(i, j - i).take(pa.array(row)), pa.array((lo - own[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((anchor - lo).astype(np.int32))], names=["s", "c", "node", "lo", "n", "back"])


class SuffixFamily:
    """Levels of suffix arrays; level i holds 2**i batches or nothing.

    A level is a table (s, times), bucketed and sorted by s: joins of two levels by s are
    merge joins of buckets as they are stored.
    """

    def __init__(self, spark, batches: int = BATCHES):
        self.spark, self.batches, self.levels, self.names, self.suffixes, self.repeated = spark, batches, {}, {}, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sized_for(self, suffixes: int) -> None:
        """Fewer buckets, if so many suffixes fill fewer."""
        self.buckets = min(self.buckets, 1 + suffixes // SUFFIXES_A_BUCKET)

    @contextmanager
    def _sorted(self):
        """Shuffles deal out one task a bucket; a bucket's one file, written in order, needs no
        sort when it is read."""
        told = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true", "spark__sql__shuffle__partitions": str(self.buckets), CLEANUP: "true"}
        with settings(self.spark, **told):
            self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            yield

    def _store(self, rows: DataFrame) -> DataFrame:
        name = f"quill_suffixes_{uuid.uuid4().hex}"
        writer = rows.write.option("path", shared_path(self.spark, "suffix-level")).option("compression", "zstd")
        writer.bucketBy(self.buckets, "s").sortBy("s").saveAsTable(name)
        level = self.spark.table(name)
        self.names[id(level)] = name
        return level

    def _drop(self, *levels: DataFrame) -> None:
        for level in levels:
            files = level.inputFiles()
            self.spark.sql(f"DROP TABLE {self.names.pop(id(level))}")
            for folder in {f.rsplit("/", 1)[0] for f in files}:  # external, so its files stay
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, texts: DataFrame) -> None:
        """Adds (node, text) rows: builds their array, scans it against every level for
        suffixes that are there already, and merges levels of equal size."""
        made = written(texts.mapInArrow(_suffixes, SUFFIX), "suffixes")
        if not self.suffixes:
            self.sized_for(made.count() * self.batches)
        self.suffixes.append(made)
        with self._sorted():
            run = self._store(made.groupBy("s").agg(F.count("*").alias("times")))
            again = run.where("times > 1").select("s")
            for level in self.levels.values():
                again = again.union(self.scanned(run, level))
            self.repeated.append(written(again.select(F.xxhash64("s").alias("k")), "suffix-again"))
            size = 0
            while size in self.levels:
                old = self.levels.pop(size)
                new = self._store(self.merged(run, old))
                self._drop(run, old)
                run, size = new, size + 1
            self.levels[size] = run

    @staticmethod
    def scanned(run: DataFrame, level: DataFrame) -> DataFrame:
        """(s): suffixes of ``run`` that agree with one of ``level`` in all bytes compared."""
        return run.select("s").join(level.select("s").hint("merge"), "s")

    @staticmethod
    def merged(run: DataFrame, level: DataFrame) -> DataFrame:
        """(s, times) of both."""
        other = level.select("s", F.col("times").alias("more")).hint("merge")
        both = F.coalesce("times", F.lit(0)) + F.coalesce("more", F.lit(0))
        return run.select("s", "times").join(other, "s", "full_outer").select("s", both.alias("times"))

    def matches(self) -> DataFrame:
        """(k, c, node, lo, n, back) of all suffixes that occur more than once, k for s."""
        keys, rows = self.repeated[0], self.suffixes[0]
        for more, others in zip(self.repeated[1:], self.suffixes[1:]):
            keys, rows = keys.union(more), rows.union(others)
        keys = written(keys.distinct(), "suffix-keys")
        out = written(rows.select(F.xxhash64("s").alias("k"), "c", "node", "lo", "n", "back").join(keys, "k", "left_semi"), "suffix-matches")
        self._drop(*self.levels.values())
        discard(self.spark, keys, *self.suffixes, *self.repeated)
        self.levels, self.suffixes, self.repeated = {}, [], []
        return out


def _pieces(batches):
    """(node, text, runs) to (k, c, n, back, piece): the bytes that each run's strings cover.
    Rows come sorted by node, so copies of a text follow one another and one is used."""
    last = None
    for batch in batches:
        nodes = np.stack([x.to_numpy() for x in batch.column(0).flatten()], 1)
        new = np.ones(len(nodes), bool)
        new[1:] = (nodes[1:] != nodes[:-1]).any(1)
        if last is not None and len(nodes):
            new[0] = (nodes[0] != last).any()
        last = nodes[-1] if len(nodes) else last
        batch = batch.take(pa.array(np.flatnonzero(new)))
        raw, at = flat(batch.column(1))
        runs = batch.column(2)
        owner = np.repeat(np.arange(len(batch)), runs.value_lengths().to_numpy())
        k, c, lo, n, back = runs.flatten().flatten()
        start = at[owner] + lo.to_numpy()
        size = n.to_numpy() - 1 + LENGTH
        for i in range(0, len(owner), 2048):
            sl = slice(i, i + 2048)
            ends = np.concatenate([[0], np.cumsum(size[sl])])
            where = np.arange(ends[-1]) + np.repeat(start[sl] - ends[:-1], size[sl])
            piece = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[where])])
            yield pa.RecordBatch.from_arrays([k[sl], c[sl], n[sl], back[sl], piece], names=["k", "c", "n", "back", "piece"])


def _groups(batches):
    """(k, c, n, back, piece) to (k, c, j, core, whole): the run's starts in groups of
    ``STEP`` by their distance from the anchor.  core is what all strings of a group
    cover, whole what those of this run's part of the group cover."""
    for batch in batches:
        raw, at = flat(batch.column(4))
        n, back = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        roll = Rolling(raw)
        first, last = (back - n + 1) // STEP, back // STEP  # of the group numbers
        per = last - first + 1
        row = np.repeat(np.arange(len(n)), per)
        j = first[row] + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        anchor = at[:-1][row] + back[row]
        low = np.maximum(anchor - STEP * j - STEP + 1, at[:-1][row])
        high = np.minimum(anchor - STEP * j, at[:-1][row] + n[row] - 1)
        core = roll.of(anchor - STEP * j, anchor - STEP * j - STEP + 1 + LENGTH)
        whole = mix(roll.of(low, high + LENGTH) + (anchor - low).astype(U64) * U64(1 << 32) + (high - low).astype(U64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(j.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], names=["k", "c", "j", "core", "whole"])


def _singles(batches):
    """(k, c, n, back, piece, groups) to (k, c, off, string): each start of those groups,
    by its distance from the anchor, with the fingerprint of its 400 bytes."""
    for batch in batches:
        raw, at = flat(batch.column(4))
        n, back = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        groups = batch.column(5)
        owner = np.repeat(np.arange(len(n)), np.diff(groups.offsets.to_numpy()))
        off = (groups.flatten().to_numpy().astype(np.int64)[:, None] * STEP + np.arange(STEP)[None, :]).ravel()
        owner = np.repeat(owner, STEP)
        ok = (off <= back[owner]) & (off > back[owner] - n[owner])
        owner, off = owner[ok], off[ok]
        start = at[:-1][owner] + back[owner] - off
        string = Rolling(raw).of(start, start + LENGTH)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(off.astype(np.int32)), pa.array(string.view(np.int64))], names=["k", "c", "off", "string"])


def repeated_starts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, spans array<struct<start, len>>): every start of a 400-byte string that also
    starts elsewhere, from the family's ``matches`` and the (node, text) rows.

    Runs with equal prefix and equal bytes repeat as a whole.  Where a prefix has several
    different surroundings, one representative of each is compared with the others: first
    groups of starts by what their strings have in common, then single starts.
    """
    spark = found.sparkSession
    stat = found.groupBy("k", "c").agg(F.count("*").alias("times"), F.min(F.struct("node", "lo", "n", "back")).alias("rep"))
    stat = written(stat, "suffix-stat")
    mixed = written(stat.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1").select("k"), "suffix-mixed")
    reps = stat.join(mixed, "k", "left_semi").select("rep.node", F.struct("k", "c", "rep.lo", "rep.n", "rep.back").alias("run"))
    reps = written(reps.groupBy("node").agg(F.collect_list("run").alias("runs")), "suffix-reps")
    held = texts.join(reps.hint("merge"), "node").select("node", "text", "runs")
    pieces = written(held.mapInArrow(_pieces, "k long, c long, n int, back int, piece binary"), "suffix-pieces")
    groups = written(pieces.mapInArrow(_groups, "k long, c long, j int, core long, whole long"), "suffix-groups")
    key = ["k", "j", "core"]
    shared = groups.groupBy(*key).agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min("whole").alias("wa"), F.max("whole").alias("wb"))
    shared = written(shared.where("a <> b").select(*key, (F.col("wa") == F.col("wb")).alias("same")), "suffix-shared")
    marked = written(groups.join(shared, key).select("k", "c", "j", "same"), "suffix-marked")
    as_groups = marked.where("same").select("k", "c", (F.col("j") * STEP).alias("off"), F.lit(STEP).alias("many"))

    finer = marked.where("not same").groupBy("k", "c").agg(F.collect_list("j").alias("groups"))
    strings = written(pieces.join(finer, ["k", "c"]).select("k", "c", "n", "back", "piece", "groups").mapInArrow(_singles, "k long, c long, off int, string long"), "suffix-strings")
    key = ["k", "off", "string"]
    again = written(strings.groupBy(*key).agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select(*key), "suffix-again")
    as_singles = strings.join(again, key).select("k", "c", "off", F.lit(1).alias("many"))

    single = stat.where("times = 1").select("k", "c")
    offs = as_groups.unionByName(as_singles).groupBy("k", "c").agg(F.collect_list(F.struct("off", "many")).alias("offs"))
    part = offs.join(single, ["k", "c"], "left_semi")
    whole = stat.where("times > 1").select("k", "c", F.lit(None).cast("array<struct<off:int,many:int>>").alias("offs"))
    verdict = written(part.select("k", "c", "offs").unionByName(whole), "suffix-verdict")
    discard(spark, mixed, reps, pieces, groups, shared, marked, strings, again)

    rows = written(found.select("k", "c", "node", "lo", "n", "back").distinct(), "suffix-rows").join(verdict, ["k", "c"])
    # off counts back from the anchor: group starts run from anchor - off - many + 1 to anchor - off
    first = F.greatest(F.col("o.off"), F.col("back") - F.col("n") + 1)
    last = F.least(F.col("o.off") + F.col("o.many") - 1, F.col("back"))
    some = rows.where("offs is not null").select("node", "lo", "n", "back", F.explode("offs").alias("o"))
    some = some.select("node", (F.col("lo") + F.col("back") - last).alias("start"), (last - first + 1).alias("len"))
    spans = rows.where("offs is null").select("node", F.col("lo").alias("start"), F.col("n").alias("len")).unionByName(some)
    return spans.groupBy("node").agg(F.collect_list(F.struct("start", "len")).alias("spans"))


def _removed(batches):
    """(doc_id, text, spans) to the digest columns of op2 and the text that is left."""
    for batch in batches:
        raw, at = flat(batch.column(1))
        spans = batch.column(2)
        rows = []
        for x in range(len(batch)):
            text = raw[at[x] : at[x + 1]]
            left, gone_n, runs = text.tobytes(), 0, 0
            if spans[x].is_valid:
                start, n = (v.to_numpy() for v in spans[x].values.flatten())
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n - 1 + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                left, gone_n = text[~gone].tobytes(), int(gone.sum())
            rows.append((len(text), gone_n, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(v, kind) for v, kind in zip(zip(*rows) if rows else [()] * 5, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    Every byte covered by a 400-byte string that also starts anywhere else, in the same
    document or another, goes; strings are judged on the whole input.  ``text`` is what is
    left, with U+FFFD where a cut went through a character; the digest is of the bytes.
    Null texts count as empty; texts under 400 bytes lose nothing; equal texts (and repeated
    rows) of 400 bytes or more lose all; texts of any length are taken whole; null ids are
    passed on; an empty table gives an empty result; extra columns are ignored, whatever
    their names.  Texts are told apart by 128 bits of hash, suffixes by 128 bytes, and what
    stands around those by fingerprints modulo the prime 2**61 - 1.
    """
    spark = docs.sparkSession
    slim_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), node_of(text).alias("node"), F.col(text).alias("text"))
    texts = rows.where(F.octet_length("text") >= LENGTH).select("node", "text")
    family = SuffixFamily(spark, batches)
    for k in range(batches):
        family.add(texts.where(F.pmod("node.a", F.lit(batches)) == k))
    spans = written(repeated_starts(family.matches(), texts), "suffix-spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans.hint("merge"), "node", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
