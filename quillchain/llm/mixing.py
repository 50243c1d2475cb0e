"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by (source, hash bucket); the bucket in which a source's budget ends
is the only one that is refined, level by level, until the budget's end lies at a single
hash value.  Documents are then taken by comparing their hash with that threshold, so
nothing is sorted.  DataFrame expressions only: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
MOST = 3  # no source and no document is taken more often
LEVEL_BITS, LEVELS = 10, 6  # a source has 1,024 sums a level at most
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """A 60-bit number from row content alone: reruns agree, other engines can restate it."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, 0-based by code point with null last, without one global sort task:
    rows are dealt into ranges, ranked inside each, and shifted by the ranges' counts."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "mix-ranges")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(before, "part").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    What exceeds ``most`` times a source is reshared by weight until no target is above.
    The uncapped targets are always level * weight, so only that level is iterated; each
    round is one aggregate over the sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = ranked_sources(sources).withColumn("w", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    s = written(s.withColumn("cap", F.col("source_size") * float(most)).select("source", "source_size", "w", "cap"), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        row = s.agg(F.sum(F.when(F.col("cap") <= F.col("w") * level, F.col("cap"))), F.sum(F.when(F.col("cap") > F.col("w") * level, F.col("w")))).first()
        if not row[1]:
            break
        risen = (total - (row[0] or 0.0)) / row[1]
        if risen <= level:
            break
        level = risen
    return s.select("source", "source_size", F.least(F.col("w") * F.lit(level), "cap").alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame, bits: int = LEVEL_BITS, levels: int = LEVELS) -> DataFrame:
    """(source, source_size, target, times, below): each document is taken ``times`` times
    and once more if its hash is less than ``below``.

    ``sized`` has (source, h, size).  Window frames run over at most 2**bits summed
    buckets of a source.
    """
    state = wanted.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long"))
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        state = written(state, "mix-state")
        inside = sized.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where(F.shiftright("h", shift + bits) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(by_bucket)).withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0)))
        # the boundary: the first bucket whose sum passes the rest of the budget
        found = sums.join(state.select(F.col("source").alias("s"), "rest", "base"), F.col("source").eqNullSafe(F.col("s")))
        found = found.where((F.col("base") + F.col("upto") > F.col("rest")) & (F.col("base") + F.col("before") <= F.col("rest")))
        found = found.groupBy("s").agg(F.min(F.struct("bucket", "before", "n")).alias("b"))
        state = state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "times", "rest", F.coalesce("b.bucket", F.lit(-1)).alias("prefix"),
            (F.col("base") + F.coalesce("b.before", F.lit(0))).alias("base"), F.coalesce("b.n", F.lit(0)).alias("n"),
        )
        if level < levels - 1:
            state = state.drop("n")
    # at the last level a bucket is one hash value: it goes in whole if that ends nearer
    nearer = (F.col("base") + F.col("n") - F.col("rest")) < (F.col("rest") - F.col("base"))
    below = F.when(F.col("times") >= MOST, 0).otherwise(F.when(F.col("prefix") < 0, 0).otherwise(F.col("prefix") + F.when(nearer, 1).otherwise(0)))
    return written(state.select("source", "source_size", "target", "times", below.cast("long").alias("below")), "mix-thresholds")


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(sized rows: doc_id, source, size, h; thresholds by source)."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), hash60(F.col(doc_id), F.col(text)).alias("h"))
    sized = written(sized, "mix-sized")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    return sized, thresholds(sized, targets(totals, weights))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Whole documents are taken, so a source ends within half the size of the document at
    its budget's end.  Null sources form one source, ranked last; null and wordless texts
    have size 0 and taken 0; rows equal in id and text share a hash and are taken or left
    together; texts of any length are counted whole; an empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    sized, marks = plan_mix(docs, doc_id, text, source, weights)
    joined = sized.join(marks.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + (F.col("h") < F.col("below")).cast("long"))).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, marks = plan_mix(docs, doc_id, text, source, weights)
    marks = marks.select(F.col("source").alias("_s"), F.col("times").alias("_times"), F.col("below").alias("_below"))
    once = F.when(words_in(F.col(text)) > 0, hash60(F.col(doc_id), F.col(text)))  # null for wordless texts
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source).alias("_source"), once.alias("_h"))
    often = F.coalesce(F.col("_times") + (F.col("_h") < F.col("_below")).cast("long"), F.lit(0)).cast("int")
    rows = rows.join(marks, F.col("_source").eqNullSafe(F.col("_s"))).select("_row", often.alias("_often")).where("_often > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_often"))).alias("_copy")).select("_row.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, source NULLS LAST) - cap AS capped, sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, source NULLS LAST) - w) AS left_w FROM w),
lv AS (SELECT arg_min(level, ratio) AS level FROM (SELECT ((SELECT sum(source_size) FROM s)::DOUBLE - capped) / left_w AS level, cap / w AS ratio FROM o) WHERE level < ratio),
t AS (SELECT source, source_size, coalesce(least(w * level, cap), cap) AS target FROM o, lv),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
r AS (SELECT *, target - times * source_size AS rest FROM k),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (SELECT r.*, (SELECT min(c.h) FROM c WHERE c.source IS NOT DISTINCT FROM r.source AND c.upto > r.rest) AS edge FROM r),
m AS (SELECT b.*, CASE WHEN times >= 3 OR edge IS NULL THEN 0 WHEN c.upto - rest < rest - (c.upto - c.n) THEN edge + 1 ELSE edge END AS below
  FROM b LEFT JOIN c ON c.source IS NOT DISTINCT FROM b.source AND c.h = b.edge)
SELECT d.doc_id, d.size, m.source_size, m.target, d.size * (m.times + CASE WHEN d.h < m.below THEN 1 ELSE 0 END) AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""
