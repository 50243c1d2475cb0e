"""Transition tables and what is derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions.text import EOS, SEP, decode_state, is_lexical
from .counting import counted
from .sequences import char_sequences, spread, token_rows, windows, word_sequences

KEYS = ("mode", "state", "next_token")
MODES = ("word", "char")


def count_windows(observed: DataFrame, order: int, mode: str) -> DataFrame:
    """(mode, state, next_token, frequency): counted on the bare token columns, with the
    state string built once per distinct transition."""
    cols = [f"c{k}" for k in range(order + 1)]
    counted = observed.groupBy(*cols).agg(F.count("*").alias("frequency"))
    return counted.select(F.lit(mode).alias("mode"), F.concat_ws(SEP, *cols[:-1]).alias("state"), F.col(cols[-1]).alias("next_token"), "frequency")


def modes_of(mode: str) -> tuple[str, ...]:
    if mode not in (*MODES, "both"):
        raise ConfigurationError("mode is word, char or both")
    return MODES if mode == "both" else (mode,)


def transitions_of_tokens(tokens: DataFrame, order: int = 2, mode: str = "word", asked: DataFrame | None = None) -> DataFrame:
    if order < 1:
        raise ConfigurationError("order must be at least 1")
    made = {"word": word_sequences, "char": char_sequences}
    seen = {m: windows(made[m](tokens), order) for m in modes_of(mode)}
    if asked is not None:
        last = asked.select(F.col("last_token").alias(f"c{order - 1}")).distinct()
        seen = {m: rows.join(last, f"c{order - 1}", "left_semi") for m, rows in seen.items()}
    return reduce(DataFrame.unionByName, [count_windows(rows, order, m) for m, rows in seen.items()])


def transitions(docs: DataFrame, order: int = 2, mode: str = "word", asked: DataFrame | None = None) -> DataFrame:
    """Frequencies of (state, next token) over all sentences (or words) of ``docs``.

    ``asked`` (last_token) restricts the model, before anything is counted, to states that
    end in one of these: all that lookups of such states and their backoff need.
    """
    if asked is not None:
        return transitions_of_tokens(token_rows(docs), order, mode, asked)
    if order < 1:
        raise ConfigurationError("order must be at least 1")
    return counted(spread(docs.select("doc_id", "text")), order, modes_of(mode))


def backoff(model: DataFrame) -> DataFrame:
    """The same counts by the last token of the state alone."""
    last = F.element_at(decode_state(F.col("state")), -1)
    return model.groupBy("mode", last.alias("last_token"), "next_token").agg(F.sum("frequency").alias("frequency")).where("frequency > 0")


def backoff_transitions(docs: DataFrame, order: int = 2, mode: str = "word") -> DataFrame:
    """``backoff`` of the model of ``docs``, without that model: a state's last token and what
    follows are the last two columns of a window, so one shuffle counts them."""
    if order < 1:
        raise ConfigurationError("order must be at least 1")
    return counted(spread(docs.select("doc_id", "text")), order, modes_of(mode), 2).withColumnRenamed("state", "last_token")


def merge_add(*models: DataFrame) -> DataFrame:
    """One model of several: frequencies of equal keys are added."""
    return reduce(DataFrame.unionByName, models).groupBy(*KEYS).agg(F.sum("frequency").alias("frequency"))


def row_counts(model: DataFrame) -> DataFrame:
    return model.groupBy("mode").agg(F.count("*").alias("transition_rows"))


def build_stats(tokens: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of additive counters over a corpus; sums, so retried tasks don't count twice."""
    from ..functions.text import char_words_of, sentences_of

    lexical = F.size(F.filter("tokens", is_lexical))
    sentences = sentences_of(F.col("tokens"))
    words = char_words_of(F.col("tokens"))
    word_obs = F.aggregate(sentences, F.lit(0), lambda acc, s: acc + F.size(F.split(s, " ")) + 1)
    char_obs = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w) + 1)
    per = tokens.select(lexical.alias("w"), F.size(words).alias("c"), word_obs.alias("wo"), char_obs.alias("co"))
    one = per.agg(F.count("*").alias("paragraphs"), F.coalesce(F.sum("w"), F.lit(0)).alias("word_tokens"), F.coalesce(F.sum("c"), F.lit(0)).alias("character_words"), (F.coalesce(F.sum("wo"), F.lit(0)) + F.coalesce(F.sum("co"), F.lit(0))).alias("observations"))
    size = docs.agg(F.count("*").alias("source_files"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("source_bytes"))
    return one.crossJoin(size)  # one row by one row


def ends_only(model: DataFrame) -> DataFrame:
    return model.where(F.col("next_token") == EOS)
