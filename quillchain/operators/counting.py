"""Windows counted in columns of numbers, from texts to tables, with one small shuffle.

A task numbers the tokens of its texts, sorts whole windows as integers and packs what it
has counted into buckets of states; the other side of the shuffle adds the buckets up and
only then makes strings.  Texts that NFKC leaves alone are tokenized here; all others come
with the tokens that the JVM made of them, so both follow one definition.

A bucket holds all windows of its states, in order of state and next token; only the state
of a sentence's start, which has as many successors as there are openers, is spread over
all buckets by its next token.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from . import query
from .sequences import spread

FLUSH = 1 << 22  # tokens that a task counts at once
MERGED = 1 << 20  # counted windows that are added up at once, unless one bucket holds more
MOST_BUCKETS = 8192
BYTES_A_PARTITION, BYTES_A_BUCKET = 1 << 20, 8 << 20  # of input, as Spark estimates it
FIRST = (fx.BOS, fx.EOS)  # tokens 0 and 1 of every numbering
CODES = {"word": 0, "char": 1}
BACKOFF, START = 2, 4  # added to the code of a mode: for its first-order table, for the state of BOS alone
PACKED = "bucket int, packed binary"
MODEL = pa.schema([("mode", pa.string()), ("state", pa.string()), ("next_token", pa.string()), ("frequency", pa.int64())])
MODEL_DDL = "mode string, state string, next_token string, frequency long"

# Of what the guard ``fx.UNSTABLE`` lets pass, these are the letters; digits are the ASCII ones.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž"
_TOKEN = re.compile(rf"[{_LETTERS}][{_LETTERS}0-9]*(?:['-][{_LETTERS}0-9]+)*|[0-9]+(?:[.,][0-9]+)*|{fx.DOTS}|{fx.one_of(fx.PUNCTUATION)}")
_PARAGRAPHS = re.compile(r"\n[\s\x1c-\x1f]*\n")
_REPLACED = [*zip(fx.PUNCT_FROM, fx.PUNCT_TO), *((c, "") for c in fx.DROPPED), ("I", "ı"), ("İ", "i")]
_CHAR_WORD = re.compile(f"[{fx.ALPHABET}]{{1,64}}")


def plain_tokens(paragraph: str) -> list[str]:
    """Tokens of a paragraph without a character that ``fx.UNSTABLE`` finds."""
    for old, new in _REPLACED:
        paragraph = paragraph.replace(old, new)
    return _TOKEN.findall(paragraph.lower())


def plain_paragraphs(text: str) -> list[str]:
    return _PARAGRAPHS.split(text) if "\n" in text else [text]


def char_words(token: str) -> list[str]:
    """What ``fx.char_words_of`` makes of one token."""
    if token in fx.PUNCTUATION:
        return []
    return [w for p in token.split("-") if _CHAR_WORD.fullmatch(w := p.replace("'", ""))]


class Numbering(dict):
    """Numbers for tokens, in order of appearance after BOS and EOS."""

    def __init__(self):
        super().__init__((t, k) for k, t in enumerate(FIRST))

    def __missing__(self, token: str) -> int:
        number = self["…"] if token.startswith("...") else len(self)
        self[token] = number
        return number

    def tokens(self) -> list[str]:
        """By number; runs of dots that share the ellipsis' number leave no gap behind."""
        out = [""] * (max(self.values()) + 1)
        for token, number in self.items():
            if not token.startswith("..."):
                out[number] = token
        return out


def sentence_starts(ids: np.ndarray, paragraphs: np.ndarray, tokens: list[str]) -> np.ndarray:
    """Where sentences begin: at paragraphs, and at tokens after a sentence's end and its
    trailers, unless that end is the dot of an abbreviation."""
    known = {t: k for k, t in enumerate(tokens)}
    flags = np.zeros(len(tokens), np.uint8)
    for bit, members in ((1, fx.SENTENCE_ENDS), (2, fx.SENTENCE_ENDS + fx.SENTENCE_TRAILERS), (4, fx.ABBREVIATIONS), (8, ".")):
        for t in members:
            if t in known:
                flags[known[t]] |= bit
    of = flags[ids]
    begins = np.zeros(len(ids), bool)
    begins[paragraphs] = True
    short = np.zeros(len(ids), bool)
    short[1:] = (of[:-1] & 4 > 0) & ~begins[1:]
    ends = (of & 1 > 0) & ~((of & 8 > 0) & short)
    groups = np.flatnonzero((of & 2 == 0) | begins)
    ended = np.concatenate([[False], np.add.reduceat(ends, groups, dtype=np.int64)[:-1] > 0]) if len(groups) else np.zeros(0, bool)
    return groups[ended | begins[groups]]


def windows(ids: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Columns c0 ... cN of every window over the sequences that begin at ``starts``."""
    count = len(starts)
    sequence = np.zeros(len(ids), np.int64)
    sequence[starts[1:]] = 1
    at = np.arange(len(ids)) + np.cumsum(sequence) * (order + 1) + order
    padded = np.zeros(len(ids) + count * (order + 1), np.int32)
    padded[at] = ids
    last = np.concatenate([starts[1:], [len(ids)]]) + np.arange(count) * (order + 1) + order
    padded[last] = 1
    where = np.ones(len(padded), bool)
    for k in range(order):
        where[starts + np.arange(count) * (order + 1) + k] = False
    where = np.flatnonzero(where)
    return np.stack([padded[where - order + k] for k in range(order + 1)])


def added(columns: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``columns``, in their order, and how often (or with what weight) each is there."""
    n = columns.shape[1]
    if not n:
        return columns, np.zeros(0, np.int64)
    bits = max(1, int(columns.max()).bit_length())
    key, used, decode = columns[0].astype(np.int64), bits, []
    for c in columns[1:]:
        if used + bits > 63:
            distinct, key = np.unique(key, return_inverse=True)
            used = max(1, int(len(distinct) - 1).bit_length())
            decode.append(distinct)
        decode.append(None)
        key = (key << bits) | c
        used += bits
    if weights is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, weights = key[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.concatenate([first, [n]])) if weights is None else np.add.reduceat(weights, first)
    key, out = key[first], []
    for step in reversed(decode):
        if step is None:
            out.append((key & ((1 << bits) - 1)).astype(np.int32))
            key = key >> bits
        else:
            key = step[key]
    return np.stack([key.astype(np.int32), *reversed(out)]), counts.astype(np.int64)


_NARROW = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return width, values.astype(_NARROW[width]).tobytes()


def pack(columns: np.ndarray, counts: np.ndarray, tokens: pa.Array, code: int) -> bytes:
    """Counted windows with the tokens they use; ``unpack`` reads them."""
    used, local = np.unique(columns, return_inverse=True)
    words = tokens.take(pa.array(used))
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8))
    data = words.buffers()[2].to_pybytes()[: int(lengths.sum())] if len(words) else b""
    parts = [_narrow(lengths), _narrow(counts), *(_narrow(c) for c in local.reshape(columns.shape))]
    body = b"".join([*(p[1] for p in parts), data])
    head = np.array([code, len(columns), columns.shape[1], len(words), len(body), *(p[0] for p in parts)], np.int64)
    return len(head).to_bytes(1, "little") + head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _code(packed: bytes) -> int:
    return int.from_bytes(packed[1:9], "little")


def unpack(packed: bytes) -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
    """(code, columns, counts, tokens)"""
    size = packed[0]
    head = np.frombuffer(packed, np.int64, size, 1).tolist()
    code, width, n, words, length = head[:5]
    body = pa.decompress(packed[1 + size * 8 :], decompressed_size=length, codec="zstd", asbytes=True)
    at, parts = 0, []
    for m, w in zip([words, n, *[n] * width], head[5:]):
        parts.append(np.frombuffer(body, _NARROW[w], m, at))
        at += m * w
    offsets = np.concatenate([[0], np.cumsum(parts[0], dtype=np.int64)])
    tokens = pa.LargeStringArray.from_buffers(words, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[at:]))
    return code, np.stack(parts[2:]).astype(np.int32), parts[1].astype(np.int64), tokens


def _mixed(columns: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(columns.shape[1], np.uint64)
    for c in columns:
        out = (out ^ hashes[c]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def packed_buckets(columns: np.ndarray, counts: np.ndarray, tokens: pa.Array, hashes: np.ndarray, code: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    start = ~columns[:-1].any(axis=0)
    if start.any() and not code & START:
        yield from packed_buckets(columns[:, start], counts[start], tokens, hashes, code | START, buckets)
        columns, counts = columns[:, ~start], counts[~start]
    of = _mixed(columns[-1:] if code & START else columns[:-1], hashes)
    of = ((of >> np.uint64(11)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(of, kind="stable")
    of, columns, counts = of[order], columns[:, order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(of)]):
        yield int(of[i]), pack(columns[:, i:j], counts[i:j], tokens, code)


def _hash(token: str) -> int:
    raw = token.encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)


class Counting:
    """What one task has read since it last packed."""

    def __init__(self, order: int, modes: tuple[str, ...], buckets: int, last: int | None, backoff: bool = False):
        self.order, self.modes, self.buckets, self.last, self.backoff = order, modes, buckets, last, backoff
        self.clear()

    def clear(self) -> None:
        self.known = Numbering()
        self.known["…"]  # before any run of dots
        self.ids, self.paragraphs = [], []

    def add(self, paragraphs) -> None:
        for tokens in paragraphs:
            if tokens:
                self.paragraphs.append(len(self.ids))
                self.ids.extend(map(self.known.__getitem__, tokens))

    def _counted(self, mode: str, ids: np.ndarray, tokens: list[str]):
        """(columns, counts, tokens): of characters, each distinct token's are cut once."""
        if mode == "word":
            columns = windows(ids, sentence_starts(ids, np.array(self.paragraphs), tokens), self.order)
            return *added(columns if self.last is None else columns[-self.last :]), tokens
        times = np.bincount(ids, minlength=len(tokens))
        found = [(w, n) for t, n in zip(tokens[len(FIRST) :], times[len(FIRST) :].tolist()) if n for w in char_words(t)]
        sizes = np.array([len(w) for w, _ in found], np.int64)
        letters = np.frombuffer("".join(w for w, _ in found).encode("utf-32-le"), np.uint32)
        alphabet, numbers = np.unique(letters, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if found else np.zeros(0, np.int64)
        columns = windows(numbers.astype(np.int32) + len(FIRST), starts, self.order)
        weights = np.repeat(np.array([n for _, n in found], np.int64), sizes + 1)
        columns = columns if self.last is None else columns[-self.last :]
        return *added(columns, weights), [*FIRST, *map(chr, alphabet)]

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.ids:
            return
        ids, tokens = np.array(self.ids, np.int32), self.known.tokens()
        for mode in self.modes:
            columns, counts, used = self._counted(mode, ids, tokens)
            hashes = np.fromiter(map(_hash, used), np.uint64, len(used))
            words = pa.array(used, pa.large_string())
            yield from packed_buckets(columns, counts, words, hashes, CODES[mode], self.buckets)
            if self.backoff:
                yield from packed_buckets(*added(columns[-2:], counts), words, hashes, CODES[mode] + BACKOFF, self.buckets)
        self.clear()


def _batches(rows: Iterator[tuple[int, bytes]], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
            size += len(row[1])
        if held and (row is None or size > most):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int32()), pa.array([r[1] for r in held], pa.binary())], ["bucket", "packed"])
            held, size = [], 0


def _packer(order: int, modes: tuple[str, ...], buckets: int, last: int | None, backoff: bool = False):
    def rows(batches):
        counting = Counting(order, modes, buckets, last, backoff)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for text, made in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if made is not None:
                        counting.add(made)
                    elif text is not None:
                        counting.add(map(plain_tokens, plain_paragraphs(text)))
                    if len(counting.ids) >= FLUSH:
                        yield from counting.flush()
        yield from counting.flush()

    return lambda batches: _batches(rows(batches))


class Merged:
    """Windows of some buckets, added up: ``columns`` number ``tokens``, which are in order."""

    def __init__(self, code: int, packs: list):
        tokens = pa.chunked_array([p[3] for p in packs]).combine_chunks().dictionary_encode()
        rank = np.empty(len(tokens.dictionary), np.int32)
        order = pc.array_sort_indices(tokens.dictionary)
        rank[order.to_numpy()] = np.arange(len(rank), dtype=np.int32)
        local, base, columns = rank[tokens.indices.to_numpy()], 0, []
        for _, c, _, t in packs:
            columns.append(local[base : base + len(t)][c])
            base += len(t)
        self.code, self.tokens = code, tokens.dictionary.take(order)
        self.columns, self.counts = added(np.concatenate(columns, axis=1), np.concatenate([p[2] for p in packs]))

    def text(self, column: np.ndarray) -> pa.Array:
        return self.tokens.take(pa.array(column))

    def states(self, which: np.ndarray | slice = slice(None)) -> pa.Array:
        return pc.binary_join_element_wise(*(self.text(c[which]) for c in self.columns[:-1]), pa.scalar(fx.SEP, pa.large_string())).cast(pa.string())


def model_rows(m: Merged, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    mode = _mode(m)
    for at in range(0, len(m.counts), rows):
        which = slice(at, at + rows)
        n = len(m.counts[which])
        yield pa.RecordBatch.from_arrays([pa.array([mode] * n, pa.string()), m.states(which), m.text(m.columns[-1][which]).cast(pa.string()), pa.array(m.counts[which])], schema=MODEL)


def _merger(made: Callable[[Merged], Iterator[pa.RecordBatch]], start: bool | None = None):
    """Buckets arrive one after the other; neighbours are added up together while they are small.
    ``start`` keeps only the state of BOS alone, or all others."""

    def merged(held: list) -> Iterator[pa.RecordBatch]:
        for code in sorted({p[0] & ~START for p in held}):
            yield from made(Merged(code, [p for p in held if p[0] & ~START == code]))

    def rows(batches):
        held, size, now = [], 0, None
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and size >= MERGED:
                    yield from merged(held)
                    held, size = [], 0
                now = bucket
                raw = packed.as_buffer().to_pybytes()
                if start is None or bool(_code(raw) & START) == start:
                    held.append(unpack(raw))
                    size += len(held[-1][2])
        yield from merged(held)

    return rows


def packed(docs: DataFrame | list[DataFrame], order: int, modes: tuple[str, ...], last: int | None = None, backoff: bool = False) -> DataFrame:
    """(bucket, packed) of (doc_id, text), a bucket's rows together in one partition and in order;
    with ``backoff``, first-order tables of the same windows, too.  Each table of several is
    counted on its own."""
    tables = docs if isinstance(docs, list) else [docs]
    spark = tables[0].sparkSession
    size = sum(int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for d in tables)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // BYTES_A_PARTITION))
    buckets = parts * max(1, min(MOST_BUCKETS // parts, -(-size // (BYTES_A_BUCKET * parts))))
    counted = reduce(DataFrame.unionByName, [_with_tokens(d).mapInArrow(_packer(order, modes, buckets, last, backoff), PACKED) for d in tables])
    return counted.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")


def tokens_by_paragraph(text: Column) -> Column:
    """Of the paragraphs that are not empty when they are clean."""
    return F.transform(F.filter(F.transform(fx.paragraphs_of(text), lambda p: fx.clean(p)), lambda c: c != ""), lambda c: fx.tokens_of(c))


def _with_tokens(docs: DataFrame) -> DataFrame:
    """(text, made): the tokens of texts that the JVM has to clean."""
    return docs.select("text", F.when(fx.needs_nfkc(F.col("text")), tokens_by_paragraph(F.col("text"))).alias("made"))


def counted(docs: DataFrame | list[DataFrame], order: int, modes: tuple[str, ...], last: int | None = None) -> DataFrame:
    """(mode, state, next_token, frequency) of (doc_id, text); ``last`` keeps so many columns of a window."""
    return packed(docs, order, modes, last).mapInArrow(_merger(model_rows), MODEL_DDL)


# Stored models: the same buckets again, dealt out by ranges of (state, next token) in packed form

SAMPLED = 1 << 12  # of so many rows of a bucket, one may become a border
ROWS_A_RANGE = 1 << 21
MERGED_DDL = "code int, n long, packed binary, keys array<string>"


class Windows:
    """What is to be counted: order-N windows of (doc_id, text) and their first-order tables."""

    def __init__(self, docs: DataFrame, order: int, modes: tuple[str, ...]):
        self.docs, self.order, self.modes, self.sparkSession = docs, order, modes, docs.sparkSession

    def merged(self) -> DataFrame:
        """(code, n, packed, keys): every bucket added up, and rows of it as possible borders."""
        return packed(self.docs, self.order, self.modes, backoff=True).mapInArrow(_merger(_merged_rows), MERGED_DDL)


def _key(m: Merged, row: int) -> str:
    return fx.SEP.join(m.tokens[int(c[row])].as_py() for c in m.columns)


def _merged_rows(m: Merged) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(m.counts), MERGED):
        n = len(m.counts[at : at + MERGED])
        keys = [_key(m, k) for k in range(at, at + n, SAMPLED)]
        raw = pack(m.columns[:, at : at + n], m.counts[at : at + n], m.tokens, m.code)
        yield pa.RecordBatch.from_arrays([pa.array([m.code], pa.int32()), pa.array([n], pa.int64()), pa.array([raw], pa.binary()), pa.array([keys], pa.list_(pa.string()))], ["code", "n", "packed", "keys"])


def borders(keys: list[str], ranges: int) -> list[str]:
    """Where all but the first of so many ranges of about equal size begin."""
    keys = sorted(keys, key=_in_order)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}, key=_in_order) if keys else []


def _in_order(key: str) -> list[bytes]:
    return [t.encode() for t in key.split(fx.SEP)]


def _dealt(found: list[str]):
    """Packed tables, whose rows are in order, cut at the borders."""
    asked = [_in_order(b) for b in found]

    def rows(batches):
        for batch in batches:
            for packed in batch.column(0):
                code, columns, counts, tokens = unpack(packed.as_buffer().to_pybytes())
                at = [0]
                for border in asked:
                    low, high = at[-1], len(counts)
                    while low < high:
                        mid = (low + high) // 2
                        if [tokens[int(c[mid])].as_py().encode() for c in columns] < border:
                            low = mid + 1
                        else:
                            high = mid
                    at.append(low)
                for k, (i, j) in enumerate(zip(at, [*at[1:], len(counts)])):
                    if i < j:
                        yield k, pack(columns[:, i:j], counts[i:j], tokens, code)

    return lambda batches: _batches(rows(batches))


def in_order(merged: DataFrame, code: int) -> DataFrame:
    """(state, next_token, frequency) of one table of ``Windows.merged``: ranges of states, each in order."""
    table = merged.where(F.col("code") == code)  # the starts were added to the others
    n = table.agg(F.sum("n")).first()[0] or 0
    keys = [r[0] for r in table.select(F.explode("keys")).collect()]
    slots = merged.sparkSession.sparkContext.defaultParallelism
    found = borders(keys, max(1, min(slots, n >> 16), -(-n // ROWS_A_RANGE)))
    dealt = table.select("packed").mapInArrow(_dealt(found), PACKED).repartitionById(len(found) + 1, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_merger(_plain_rows), "state string, next_token string, frequency long")


def _plain_rows(m: Merged) -> Iterator[pa.RecordBatch]:
    for batch in model_rows(m):
        yield batch.select(["state", "next_token", "frequency"])


# What is asked of each state, while its successors are together

def row_counts(docs: DataFrame, order: int, modes: tuple[str, ...]) -> DataFrame:
    """(mode, transition_rows) of modes with rows."""

    def size(m: Merged) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_mode(m)]), pa.array([len(m.counts)], pa.int64())], ["mode", "n"])

    return packed(docs, order, modes).mapInArrow(_merger(size), "mode string, n long").groupBy("mode").agg(F.sum("n").alias("transition_rows"))


def _mode(m: Merged) -> str:
    return next(k for k, v in CODES.items() if v == m.code % BACKOFF)


class States:
    """Where each state's successors begin, and of what length they are."""

    def __init__(self, m: Merged):
        changed = (m.columns[:-1, 1:] != m.columns[:-1, :-1]).any(axis=0)
        self.first = np.flatnonzero(np.concatenate([[True], changed])) if len(m.counts) else np.zeros(0, int)
        self.size = np.diff(np.concatenate([self.first, [len(m.counts)]]))
        self.m = m

    def spread(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.size)

    def best(self) -> np.ndarray:
        """The row of the most frequent successor; ties go to the greatest token, which is the last."""
        counts = self.m.counts
        top = self.spread(np.maximum.reduceat(counts, self.first))
        return np.maximum.reduceat(np.where(counts == top, np.arange(len(counts)), -1), self.first)

    def weights(self, temperature: float) -> np.ndarray:
        """Counts to the power of 1 / temperature, a state's largest as 1."""
        if temperature == 0:
            out = np.zeros(len(self.m.counts))
            out[self.best()] = 1.0
            return out
        logs = np.log(self.m.counts)
        return np.exp((logs - self.spread(np.maximum.reduceat(logs, self.first))) / temperature)

    def running(self, weights: np.ndarray) -> np.ndarray:
        """Sums from a state's first successor on, added one by one."""
        out = weights.copy()
        short = self.size <= 64
        for k in range(1, 64):
            at = self.first[short & (self.size > k)] + k
            if not len(at):
                break
            out[at] += out[at - 1]
        for i, n in zip(self.first[~short].tolist(), self.size[~short].tolist()):
            out[i : i + n] = np.cumsum(weights[i : i + n])
        return out

    def draws(self, states: pa.Array) -> np.ndarray:
        """``query.uniform_of`` of each state."""
        return np.array([int(md5(s.encode()).hexdigest()[:12], 16) for s in states.to_pylist()], np.float64) / float(1 << 48)


def _in_pieces(n: int, rows: int = 1 << 16) -> Iterator[slice]:
    for at in range(0, n, rows):
        yield slice(at, min(n, at + rows))


def _greedy_rows(m: Merged) -> Iterator[pa.RecordBatch]:
    best = States(m).best()
    for piece in _in_pieces(len(best)):
        rows = best[piece]
        yield pa.RecordBatch.from_arrays([m.states(rows), m.text(m.columns[-1][rows]).cast(pa.string()), pa.array(m.counts[rows])], ["state", "next_token", "frequency"])


def _sampled_rows(temperature: float):
    def made(m: Merged) -> Iterator[pa.RecordBatch]:
        s = States(m)
        running = s.running(s.weights(temperature))
        last = s.first + s.size - 1
        for piece in _in_pieces(len(last)):
            first, end = s.first[piece], last[piece]
            states = m.states(first)
            low, high = int(first[0]), int(end[-1]) + 1
            hit = running[low:high] > np.repeat(s.draws(states) * running[end], s.size[piece])
            found = np.minimum(np.minimum.reduceat(np.where(hit, np.arange(low, high), high), first - low), end)
            yield pa.RecordBatch.from_arrays([states, m.text(m.columns[-1][found]).cast(pa.string())], ["state", "next_token"])

    return made


def _shared_rows(temperature: float):
    def made(m: Merged) -> Iterator[pa.RecordBatch]:
        s = States(m)
        weights = s.weights(temperature)
        shares = weights / s.spread(np.add.reduceat(weights, s.first))
        for rows in _in_pieces(len(weights)):
            yield pa.RecordBatch.from_arrays([m.states(rows), m.text(m.columns[-1][rows]).cast(pa.string()), pa.array(m.counts[rows]), pa.array(shares[rows])], ["state", "next_token", "frequency", "probability"])

    return made


def _asked(docs: DataFrame, order: int, mode: str, made, ddl: str, starts: Callable[[DataFrame], DataFrame], last: int | None = None) -> DataFrame:
    """``made`` of all states but that of BOS alone, whose rows are in all buckets: ``starts`` of those."""
    table = packed(docs, order, (mode,), last)
    alone = table.mapInArrow(_merger(_plain_rows, True), "state string, next_token string, frequency long")
    return table.mapInArrow(_merger(made, False), ddl).unionByName(starts(alone))


def greedy(docs: DataFrame, order: int, mode: str, last: int | None = None) -> DataFrame:
    """``query.greedy`` of the model of ``docs`` by state; ``last=2`` asks its first-order table."""
    return _asked(docs, order, mode, _greedy_rows, "state string, next_token string, frequency long", lambda rows: query.greedy(rows, "state"), last)


def distribution(docs: DataFrame, order: int, mode: str, temperature: float) -> DataFrame:
    """``query.distribution`` of the model of ``docs`` by state."""
    query.check_temperature(temperature)
    return _asked(docs, order, mode, _shared_rows(temperature), "state string, next_token string, frequency long, probability double", lambda rows: query.distribution(rows, ["state"], temperature))


def sample(docs: DataFrame, order: int, mode: str, temperature: float = 1.0) -> DataFrame:
    """``query.sample`` of the model of ``docs`` by state."""
    query.check_temperature(temperature)
    if temperature == 0:
        return greedy(docs, order, mode).select("state", "next_token")
    return _asked(docs, order, mode, _sampled_rows(temperature), "state string, next_token string", lambda rows: query.sample(rows, ["state"], temperature))


# Counters of a corpus

STATS = ("paragraphs", "word_tokens", "character_words", "observations")
_SHOWN = re.compile(r"[^\x00-\x20\x7f\xad]")  # a character that cleaning of plain text leaves


class Stats(Counting):
    """Additive counters instead of windows."""

    def __init__(self):
        super().__init__(1, (), 1, None)

    def flush(self) -> Iterator[tuple[int, ...]]:
        if not self.ids:
            return
        ids, tokens = np.array(self.ids, np.int32), self.known.tokens()
        times = np.bincount(ids, minlength=len(tokens)).tolist()
        sentences = len(sentence_starts(ids, np.array(self.paragraphs), tokens))
        words, letters = 0, 0
        for token, n in zip(tokens[len(FIRST) :], times[len(FIRST) :]):
            if n:
                found = char_words(token)
                words += n * len(found)
                letters += n * sum(len(w) + 1 for w in found)
        lexical = sum(n for token, n in zip(tokens, times) if token not in fx.PUNCTUATION)
        yield 0, lexical, words, len(ids) + sentences + letters
        self.clear()


def _stats(batches):
    stats, sums = Stats(), np.zeros(len(STATS), np.int64)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            for text, made in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if made is not None:
                    sums[0] += len(made)
                    stats.add(made)
                elif text is not None:
                    shown = [p for p in plain_paragraphs(text) if _SHOWN.search(p)]
                    sums[0] += len(shown)
                    stats.add(map(plain_tokens, shown))
                if len(stats.ids) >= FLUSH:
                    sums += sum(map(np.array, stats.flush()))
    for row in stats.flush():
        sums += row
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sums.tolist()], STATS)


def build_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of additive counters over a corpus; sums, so retried tasks don't count twice."""
    rows = _with_tokens(spread(docs.select(F.col(text).alias("text"))))
    per = rows.mapInArrow(_stats, ", ".join(f"{c} long" for c in STATS))
    one = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS])
    size = docs.agg(F.count("*").alias("source_files"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("source_bytes"))
    return one.crossJoin(size)  # one row by one row
