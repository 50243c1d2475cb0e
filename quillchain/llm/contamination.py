"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles; for each size class every
document is cut into windows of at most twice the class's largest size, overlapping by
half, so a test item lies whole inside one window of like size however long the document
is, and the chance that a MinHash register agrees is bounded from below.  Windows whose
registers meet an item's are candidates; each candidate is verified by the exact share of
the item's shingles that the whole document holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import NODE, node_of
from .common import slim_batches
from .flat import U64, chunks, flat, mix
from .shingles import shingles

CONTAINMENT = 0.8
REGISTERS = 64  # an item at 0.8 has Jaccard of 0.19 at least with its window: missed with (1 - 0.19)**64 < 2e-6
BLOCK_BYTES = 32 << 20  # of a block of items as it is broadcast, about
_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _class(sizes: np.ndarray) -> np.ndarray:
    """Size class c holds 2**c to 2**(c+1) - 1 shingles."""
    return np.floor(np.log2(np.maximum(1, sizes))).astype(np.int64)


class Items:
    """A block of distinct test items: exact shingle sets, and registers by size class."""

    #: bytes of an item in a block: a hash and a place in each register, and its shingles
    @staticmethod
    def weight(size: Column) -> Column:
        return REGISTERS * 16 + 8 * (size / 2 + 1) + 200

    def __init__(self, ids: list[tuple[int, int]], texts: list[str]):
        raw = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        h, first = shingles(np.frombuffer(b"".join(raw), np.uint8), at)
        self.sets = [np.unique(h[first[k] : first[k + 1]]) for k in range(len(ids))]
        self.ids = ids
        sizes = np.array([len(x) for x in self.sets], np.int64)
        self.registers = {}  # class: sorted register values with the item of each, by register
        for c in np.unique(_class(sizes[sizes > 0])) if len(sizes) else []:
            own = np.flatnonzero((_class(sizes) == c) & (sizes > 0))
            per = []
            for f in _FACTORS:
                value = np.array([(self.sets[k] * f).min() for k in own], U64)
                order = np.argsort(value, kind="stable")
                per.append((value[order], own[order]))
            self.registers[int(c)] = per

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sorted distinct (row, item) pairs with a common register, as rows of two."""
        found = []
        if not len(h):
            return np.zeros((0, 2), np.int64)
        plans = []
        for c, per in self.registers.items():
            # half-windows of 2**(c+1) shingles, never across texts; a window is two of them
            half = 1 << (c + 1)
            n = np.maximum(1, -(-np.diff(first) // half)) * (np.diff(first) > 0)
            row = np.repeat(np.arange(len(n)), n)
            start = first[:-1][row] + half * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            plans.append((per, row, start, np.append(row[1:] == row[:-1], False)))
        for r, f in enumerate(_FACTORS):
            mixed = h * f
            for per, row, start, again in plans:
                low = np.minimum.reduceat(mixed, start)
                low[:-1][again[:-1]] = np.minimum(low[:-1], low[1:])[again[:-1]]
                values, owner = per[r]
                a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, low, "right")
                hit = np.flatnonzero(b > a)
                if len(hit):
                    times = (b - a)[hit]
                    item = owner[np.repeat(a[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    found.append(np.stack([np.repeat(row[hit], times), item], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def held(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(row, item, shingles held, containment) at ``CONTAINMENT`` or more."""
        h, first = shingles(raw, offsets)
        out, last, own = [], -1, None
        for row, k in self.candidates(h, first).tolist():
            if row != last:
                last, own = row, np.sort(h[first[row] : first[row + 1]])
            want = self.sets[k]
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            n = int((own[at] == want).sum())
            if n >= CONTAINMENT * len(want):
                out.append((row, k, n, n / len(want)))
        return out


def distinct_items(benchmark: DataFrame, text: str) -> DataFrame:
    """(node, text): the texts of ``benchmark`` that have a word, each once."""
    some = benchmark.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(node_of(text).alias("node"), F.col(text).alias("text"))
    return some.groupBy("node").agg(F.first("text").alias("text"))


def blocks_of(benchmark: DataFrame, text: str) -> Iterator[Items]:
    """The distinct items in blocks of about ``BLOCK_BYTES`` as broadcast; one block is on
    the driver at a time."""
    items = distinct_items(benchmark, text)
    size = items.agg(F.sum(Items.weight(F.octet_length("text")))).first()[0] or 0
    n = math.ceil(size / BLOCK_BYTES)
    for k in range(n):
        rows = items.where(F.pmod("node.a", F.lit(n)) == k).collect()
        yield Items([tuple(r.node) for r in rows], [r.text for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item held): doc_id, item_id, shingles, containment.

    An item is held if the document contains at least 0.8 of its distinct 5-word shingles
    (an item of fewer words is one shingle, held only by a text that is just that item).
    Documents are scanned once per block of items and never shuffled; what is found joins
    the items' ids by a hash of their text, so equal items are searched once.  Null and
    wordless texts hold nothing and are held by nothing; very long texts are cut into
    windows, none of them left out; repeated rows give repeated results, as do repeated
    items; null ids are passed on; further columns are ignored, whatever their names; empty
    tables give an empty result.  A held item is missed with a probability below 2e-6;
    what is returned is verified by 64-bit hashes of all shingles.
    """
    spark = docs.sparkSession
    slim_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, node {NODE}, shingles long, containment double"
    out = None
    for items in blocks_of(benchmark, item_text):
        found = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(items)), schema)
        out = found if out is None else out.union(found)
    out = spark.createDataFrame([], schema) if out is None else out
    ids = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), node_of(item_text).alias("node"))
    return out.join(ids, "node").select("doc_id", "item_id", "shingles", "containment")


def _searcher(sent):
    def search(batches):
        items = sent.value
        nodes = pa.StructArray.from_arrays([pa.array([i[k] for i in items.ids], pa.int64()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            raw, at = flat(batch.column(1))
            for i, j in chunks(at):
                got = items.held(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                row, item, n, share = zip(*got) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row, np.int64) + i)), nodes.take(pa.array(item, pa.int64())), pa.array(n, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "node", "shingles", "containment"])

    return search


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item: a narrow filter, rows stay in the JVM."""
    slim_batches(docs.sparkSession)
    for items in blocks_of(benchmark, item_text):
        docs = docs.where(~_holder(docs.sparkSession.sparkContext.broadcast(items))(F.col(text)))
    return docs


def _holder(sent):
    @F.arrow_udf("boolean")
    def holds(col: pa.Array) -> pa.Array:
        raw, at = flat(col)
        hit = np.zeros(len(col), bool)
        for i, j in chunks(at):
            for row, *_ in sent.value.held(raw[at[i] : at[j]], at[i : j + 1] - at[i]):
                hit[i + row] = True
        return pa.array(hit)

    return holds


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Exact containment of every item in every document, without any candidate search.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM d WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS shingles FROM ds JOIN si USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shingles, shingles / n AS containment FROM j JOIN n USING (item_id) WHERE shingles >= 0.8 * n
"""
