"""Structured Streaming: every micro-batch is counted and kept as one delta of the model.

Deltas are named by batch id, so a batch that is replayed after a failure overwrites its
own delta and counts once.  Reading a model adds its deltas up; ``compact`` folds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import merge_add, transitions


def stream_transitions(texts: DataFrame, path: str, order: int = 2, mode: str = "word", checkpoint: str | None = None) -> StreamingQuery:
    """Starts counting a stream of (doc_id, text) into deltas below ``path``."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        transitions(batch, order, mode).write.mode("overwrite").parquet(f"{path}/delta={batch_id}")

    return texts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True).start()


def stream_model(spark: SparkSession, path: str) -> DataFrame:
    return merge_add(spark.read.parquet(f"{path}/delta=*"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    stream_model(spark, path).write.parquet(to)
