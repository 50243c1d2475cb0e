"""Paragraphs, sentences, words and order-N windows as narrow transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BOS, EOS, char_words_of, cleaned, paragraphs_of, sentences_of, tokens_of


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan of fewer splits than there are task slots to all of them, as a file of
    one row group cannot be split; larger inputs have their splits and are left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(slots) if splits < slots else df


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, para_no, clean): the cleaned, non-empty paragraphs."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("raw")))
    rows = rows.select("doc_id", F.posexplode(paragraphs_of(F.col("raw"))).alias("para_no", "raw"))
    return cleaned(rows, "raw", "clean").where("clean <> ''").select("doc_id", "para_no", "clean")


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, para_no, tokens)."""
    return paragraphs(docs).select("doc_id", "para_no", tokens_of(F.col("clean")).alias("tokens"))


def word_sequences(tokens: DataFrame) -> DataFrame:
    """(seq): one array of tokens a sentence."""
    return tokens.select(F.explode(sentences_of(F.col("tokens"))).alias("s")).select(F.split("s", " ").alias("seq"))


def char_sequences(tokens: DataFrame, **options) -> DataFrame:
    """(seq): one array of characters a word."""
    return tokens.select(F.explode(char_words_of(F.col("tokens"), **options)).alias("w")).select(F.split("w", "").alias("seq"))


def window_columns(seq: Column, order: int) -> Column:
    """array of structs (c0 ... cN): each element after its ``order`` predecessors, padded
    with BOS in front and closed by EOS.  Plain slices zipped: no lambda per element."""
    padded = F.concat(F.array_repeat(F.lit(BOS), order), seq, F.array(F.lit(EOS)))
    n = F.size(seq) + 1
    return F.arrays_zip(*[F.slice(padded, F.lit(k + 1), n).alias(f"c{k}") for k in range(order + 1)])


def windows(sequences: DataFrame, order: int) -> DataFrame:
    """One row (c0 ... cN) per observation; empty sequences have none."""
    zipped = sequences.where(F.size("seq") > 0).select(F.explode(window_columns(F.col("seq"), order)).alias("z"))
    fields = zipped.schema["z"].dataType.names
    return zipped.select(*[F.col("z")[f].alias(f"c{k}") for k, f in enumerate(fields)])
