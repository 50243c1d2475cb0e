"""Language identification with bit-sliced Bloom filters.

One filter holds all languages: each slot is a word whose bits are languages, so two
lookups and one AND return every language that has an n-gram.  A text's language is the
one whose bit count, corrected for the filter's false positives, is greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slim_batches
from .flat import U64, chunks, flat, grams, mix

GRAMS = (3, 5)  # byte lengths
SLOTS = 1 << 20
SLICE = 1 << 18  # bytes of text that are hashed at a time
SAMPLE_ROWS = 1000  # about so many labelled texts a language are learned from
LEAST_SHARE = 0.01  # an n-gram counts for a language if this share of its texts has it
LEAST_RATIO = 0.5  # ... and if its share is at least this part of the greatest language's
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: tuple[str, ...]
    slots: np.ndarray  # uint64 masks, one row for every 64 languages, one column a slot
    false_rate: np.ndarray  # by language: chance that an n-gram it lacks is found


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    return chunks(flat(col)[1], limit)


def gram_hashes(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (hashes, row of each): the byte n-grams of lower-cased texts in which
    everything but letters is a space; each text stands between two spaces.

    ``limit`` bytes are hashed at a time, so a text of any length, which then comes in
    several parts, needs scratch arrays of that size only.
    """
    raw, at = flat(pc.utf8_lower(col))
    n = len(col)
    ends = at + 2 * np.arange(n + 1)
    text = np.full(ends[-1], 32, np.uint8)
    keep = np.ones(ends[-1], bool)
    keep[ends[:-1]] = keep[ends[1:] - 1] = False
    text[keep] = _FOLD[raw]
    del keep
    for low in range(0, len(text), limit):
        high = min(len(text), low + limit)
        part = text[low : high + max(GRAMS) - 1]
        row = np.searchsorted(ends, np.arange(low, low + len(part)), "right") - 1
        for k in GRAMS:
            m = min(high - low, len(part) - k + 1)
            if m > 0:
                inside = (row[:m] == row[k - 1 : k - 1 + m]) & ~((part[:m] == 32) & (part[1 : m + 1] == 32))
                yield grams(part, k)[:m][inside], row[:m][inside]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U64(SLOTS - 1)).astype(np.int64), (mix(h) & U64(SLOTS - 1)).astype(np.int64)


def _once(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once a row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def _count_texts(batches):
    """(lang, text) batches to (lang, gram, n): how many texts of a slice have the n-gram."""
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for i, j in slices(batch.column(1)):
            seen = [_once(h, row) for h, row in gram_hashes(batch.column(1).slice(i, j - i))]
            if not seen:
                continue
            h, row = _once(*map(np.concatenate, zip(*seen)))
            named = lang[i:j][row]
            for name in dict.fromkeys(lang[i:j].tolist()):
                grams, count = np.unique(h[named == name], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])


def id_remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod 3 is not 1.

    Of each language about ``sample_rows`` texts are used, chosen by a hash of their
    content, whole.  What reaches the driver is one row per n-gram that at least
    ``LEAST_SHARE`` of a language's sampled texts have: at most their mean length divided
    by that share, whatever the corpus size.
    """
    seen = docs.where((id_remainder(F.col(doc_id)) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    rate = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))]), F.col("lang")) if counts else F.lit(0.0)
    sample = seen.where(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1 << 20)) < rate * (1 << 20))
    sizes = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()} if counts else {}
    found = []
    if sizes:
        share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(1.0 / n))]), F.col("lang"))
        grams = sample.mapInArrow(_count_texts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        common = grams.where((F.col("n") * share >= LEAST_SHARE) & (F.col("n") >= 2))
        found = common.select("lang", "gram", (F.col("n") * share).alias("share")).collect()
    slots, best = np.zeros((-(-len(languages) // 64), SLOTS), U64), {}
    for r in found:
        best[r.gram] = max(best.get(r.gram, 0.0), r.share)
    for k, name in enumerate(languages):
        grams = np.array([r.gram for r in found if r.lang == name and r.share >= LEAST_RATIO * best[r.gram]], np.int64).view(U64)
        for at in _slots(grams):
            slots[k // 64, at] |= U64(1 << k % 64)
    filled = np.array([((slots[k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(languages))])
    return Model(languages, slots, filled**2)


def judge(col: pa.Array, model: Model) -> tuple[pa.Array, np.ndarray]:
    """(language, score) of each text: the score is the corrected share of the text's
    n-grams that its language has.  ``und`` with 0 for nulls and texts without a letter."""
    k, best, scores = len(model.languages), np.zeros(len(col), np.int64), np.zeros(len(col))
    lettered = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    for i, j in slices(col) if k else ():
        n = j - i
        total, hits = np.zeros(n), np.zeros((k, n))
        for h, row in gram_hashes(col.slice(i, n)):
            one, two = _slots(h)
            total += np.bincount(row, minlength=n)
            for b in range(k):
                if b % 64 == 0:
                    masks = model.slots[b // 64][one] & model.slots[b // 64][two]
                hits[b] += np.bincount(row[(masks >> U64(b % 64)) & U64(1) > 0], minlength=n)
        true = np.maximum(0, (hits - total * model.false_rate[:, None]) / (1 - model.false_rate[:, None]))
        best[i:j] = true.argmax(0)
        scores[i:j] = np.minimum(1, true[best[i:j], np.arange(n)] / np.maximum(1, total))
    best[~lettered], scores[~lettered] = k, 0
    if not k:
        best[:] = 0
    return pa.array([*model.languages, "und"], pa.string()).take(pa.array(best)), scores


def predicted(docs: DataFrame, model: Model, text: str = "text", to: str = "_lang") -> DataFrame:
    """``docs`` with a struct column ``to`` of lang_pred and score.  A narrow step: texts go
    to Python once and rows stay in the JVM; the filter (8 MB) travels as a broadcast of
    fixed size."""
    slim_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def guess(col: pa.Array) -> pa.Array:
        langs, scores = judge(col, kept.value)
        return pa.StructArray.from_arrays([langs, pa.array(scores)], ["lang_pred", "score"])

    return docs.withColumn(to, guess(F.col(text)))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null id counts as the empty text for ``held_out``; without labelled rows every text
    is ``und``; a text in an unknown language gets the nearest learned one with a low
    score; of languages that fit equally well the first by code point is taken.  Very long
    texts are judged whole, a slice at a time.  Repeated rows and other columns change
    nothing; an empty table gives an empty result.
    """
    model = fit(docs, doc_id, text, lang)
    rows = predicted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", (id_remainder(F.col("doc_id")) == 1).alias("held_out"), F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
