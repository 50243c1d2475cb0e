"""A corpus through five stages: language, near-duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and hands the table to the next one.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillchain.llm import bagminhash, contamination, langid, mixing, sharding
from quillchain.llm.common import written

LEAST_SCORE = 0.1  # texts of which less is known in any learned language are rejected


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; null texts and those without a letter go.

    Equal texts are judged alike and repeated rows stay repeated; where languages fit
    equally well the first by code point is meant; texts of any length are judged whole.
    All columns pass through, whatever their names; an empty table stays empty, as does one
    without a labelled row, in which no language can be learned.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    judged = langid.predicted(rows, langid.fit(docs), "row.text")
    kept = judged.where((F.col("_lang.lang_pred") != "und") & (F.col("_lang.score") >= LEAST_SCORE))
    return kept.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate class.

    Rows with a null text are no one's copies and stay; a null doc_id is kept only where
    its class has no other; of rows equal in id and text one stays, that whose columns'
    hash is least; texts without a word equal only themselves.  All columns pass through;
    an empty table stays empty.
    """
    return bagminhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: 0.8 or more of its distinct 5-word shingles.

    Null texts and texts without a word hold nothing and stay; repeated rows are judged
    alike; long texts are searched whole.  All columns pass through; an empty table stays
    empty, and an empty benchmark drops nothing.
    """
    return contamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times.

    Null sources are one source, ranked last; texts that are null or without a word count
    nothing and are not taken; rows equal in id and text are taken alike.  All columns pass
    through; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` (0 to 39); equal texts, nulls as empty ones, share one.

    A column ``shard`` of the documents stays, and the new one is then ``shard_1``.  Rows
    and repeated rows are all kept; a text of any length is one item; of groups of equal
    size it is their hash that decides; an empty table stays empty.
    """
    return sharding.sharded(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Signatures, packing and learned filters have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
