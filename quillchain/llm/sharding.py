"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups of the same size are interchangeable, so what is packed is a histogram: how many
groups there are of each size, the largest first.  Best fit puts a group into the bin with
the least remaining capacity that suffices, and goes on with that bin, now tighter still,
until it is too small; so all groups of a size are placed by a few steps through a balanced
tree of remaining capacities, and the outcome is that of packing them one by one.  A
histogram of sizes that sum to B has at most sqrt(2 B) rows, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, ROW_COST = 40, 16
SLOT_CHUNK = 1 << 10  # written rows that are numbered together
RANK_CHUNK = 1 << 8  # groups of a size that are ranked together, about
Classes = Sequence[tuple[int, int]]  # (size, groups of it), sizes falling


class CapacityTree:
    """Bins by remaining capacity: a two-level B-tree whose leaves hold at most ``LEAF``
    entries, so the tightest bin for a size is found, taken out and put back by binary
    searches."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = [(-1, -1)]  # the least entry of each leaf, but the first

    def _leaf(self, entry: tuple[int, int]) -> int:
        at = bisect_left(self.tops, entry)
        return at if at < len(self.tops) and self.tops[at] == entry else max(0, at - 1)

    def put(self, left: int, bin_no: int) -> None:
        i = self._leaf((left, bin_no))
        insort(self.leaves[i], (left, bin_no))
        if len(self.leaves[i]) > self.LEAF:
            half = self.leaves[i][self.LEAF // 2 :]
            del self.leaves[i][self.LEAF // 2 :]
            self.leaves.insert(i + 1, half)
            self.tops.insert(i + 1, half[0])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity of at least ``size``."""
        want, i = (size, -1), self._leaf((size, -1))
        at = bisect_left(self.leaves[i], want)
        while at == len(self.leaves[i]):
            i, at = i + 1, 0
            if i == len(self.leaves):
                return None
        entry = self.leaves[i].pop(at)
        if not self.leaves[i] and i:
            del self.leaves[i], self.tops[i]
        return entry


def pack(classes: Classes, capacity: int, most_bins: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Best fit over ``classes``: for each the bins and how many of its groups each gets, in
    order; None if it needs more than ``most_bins`` bins or a size exceeds ``capacity``."""
    tree, bins, out = CapacityTree(), 0, []
    for size, groups in classes:
        if size > capacity:
            return None
        parts = []
        while groups:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            left, bin_no = found
            fit = min(groups, left // size)
            groups -= fit
            tree.put(left - fit * size, bin_no)
            parts.append((bin_no, fit))
        out.append(parts)
    return out


def equal_shards(classes: Classes, shards: int) -> list[list[tuple[int, int]]]:
    """Bins 0 to ``shards - 1`` for ``classes``, as ``pack`` gives them, by the least capacity
    at which best fit needs no more bins than that.

    A group larger than the mean of what is left gets a bin to itself first: it would
    else raise the capacity of every bin.
    """
    total, first = sum(size * n for size, n in classes), 0
    own: list[list[tuple[int, int]]] = [[] for _ in classes]
    rest: list[tuple[int, int]] = []
    for k, (size, n) in enumerate(classes):
        while n and not rest and first < shards - 1 and size * (shards - first) >= total:
            own[k].append((first, 1))
            first, n, total = first + 1, n - 1, total - size
        rest.append((size, n))
        if n == 0:
            rest.pop()
    if not rest:
        return own
    skipped, bins = len(classes) - len(rest), shards - first
    low = max(-(-total // bins), rest[0][0])
    step, best = 0, pack(rest, low, bins)
    while best is None:
        step = max(1, low >> 16) if not step else step * 2
        best = pack(rest, low + step, bins)
    bad, good = low + step // 2, low + step
    while good - bad > max(1, low >> 16):
        mid = (good + bad) // 2
        tried = pack(rest, mid, bins)
        if tried is None:
            bad = mid
        else:
            good, best = mid, tried
    for k, parts in enumerate(best):
        own[skipped + k] += [(first + b, n) for b, n in parts]
    return own


def group_shards(sized: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(h, shard) for every group of (h, size) rows.

    What reaches the driver is the histogram of group sizes.  Groups of a size that several
    shards share are ranked by hash, in chunks, and dealt by rank.
    """
    spark = sized.sparkSession
    groups = written(sized.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    classes = sorted((tuple(r) for r in groups.groupBy("bytes").count().collect()), reverse=True)
    rows = []
    for (size, n), parts in zip(classes, equal_shards(classes, shards), strict=True):
        lows, at = [], 0
        for _, fit in parts:
            lows.append(at)
            at += fit
        rows.append((size, n, lows, [b for b, _ in parts]))
    table = spark.createDataFrame(rows, "bytes long, n long, lows array<long>, shards array<int>")
    dealt = written(groups.join(table, "bytes"), "shard-classes")
    one = dealt.where(F.size("shards") == 1).select("h", F.col("shards")[0].alias("shard"))
    several = dealt.where(F.size("shards") > 1).withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(11)), F.ceil(F.col("n") / RANK_CHUNK)))
    counts = several.groupBy("bytes", "chunk").agg(F.count("*").alias("m"))
    before = counts.select("bytes", "chunk", (F.sum("m").over(Window.partitionBy("bytes").orderBy("chunk")) - F.col("m")).alias("before"))
    inside = several.withColumn("inside", F.row_number().over(Window.partitionBy("bytes", "chunk").orderBy("h")) - 1)
    rank = F.col("before") + F.col("inside")
    ranked = inside.join(before, ["bytes", "chunk"]).select("h", F.element_at("shards", F.size(F.filter("lows", lambda low: low <= rank))).alias("shard"))
    return written(one.union(ranked), "shard-of")


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def text_cost(text: str):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_COST).cast("long")


def shard_rows(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: equal texts share a shard (null counts as the empty text), and shard
    sizes are as equal as that allows.  Slots number each shard's rows from 0 without
    gaps: rows are counted by (shard, chunk of 1,024 written rows), chunks are shifted by
    the counts before them, so a hot shard is never gathered in one task.  Null ids and
    repeated rows are rows like others; texts of any length are one item; an empty table
    gives an empty result; further columns are ignored.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), text_cost(text).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), text_hash(text).alias("h"), F.monotonically_increasing_id().alias("rid"))
    sized = written(sized, "shard-sized")
    placed = sized.join(group_shards(sized, shards), "h").withColumn("chunk", F.floor(F.col("rid") / SLOT_CHUNK))
    placed = written(placed.select("doc_id", "size", "text_crc32", "rid", "shard", "chunk"), "shard-placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("start"))
    inside = placed.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("rid")) - 1)
    return inside.join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", to: str = "shard") -> DataFrame:
    """``docs`` with its rows' shards in column ``to``, or the first of ``to_1``, ``to_2`` ...
    that is not a column of ``docs``, all of which stay.  One shuffle of the rows, by their
    text's hash; nothing is dropped."""
    taken, name, k = {c.lower() for c in docs.columns}, to, 0
    while name.lower() in taken:
        k += 1
        name = f"{to}_{k}"
    where = group_shards(docs.select(text_hash(text).alias("h"), text_cost(text).alias("size")), shards)
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_hash(text).alias("h"))
    return rows.join(where, "h").select("row.*", F.col("shard").alias(name))


def op7_shard_best_fit(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
