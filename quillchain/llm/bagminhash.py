"""Near-duplicates by BagMinHash signatures of 5-word shingle multisets.

A signature has one register per hash function; two texts agree in a register with the
probability of their weighted Jaccard similarity.  Registers come from hierarchical
Poisson processes over discretised weights: each shingle owns one process per dyadic
block of weights, [0, 1), [1, 2), [2, 4) ..., which is split into halves, each with a
process that follows from its parent's, as far as a text's weight and the registers ask.

Texts that share a band of registers share a bucket.  Buckets are settled in two ways,
whatever their size: by stars, pairs of one pivot with the other members, as long as that
halves what is open; then by blocks, in which all members of different components are
compared.  Either way links are verified by exact multiset overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, slim_batches, written
from .flat import U64, chunks, flat, mix
from .shingles import counted, shingles

BANDS, ROWS = 20, 4  # a pair at 0.8 shares no band with probability (1 - 0.8**4)**20 < 3e-5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
PAIRS_A_TASK, UNITS_A_TASK = 4000, 1000
BLOCK = 256  # members a block; two blocks are compared at a time
LEAST_AGREE = 44  # of 80 registers: a pair at 0.8 has fewer with probability below 1e-7
_STEP, _WAIT, _REGISTER, _LEFT, _RIGHT = (U64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))


def _wait(seed: np.ndarray, rate) -> np.ndarray:
    """Exponential waiting times."""
    return -np.log(((seed >> U64(11)).astype(float) + 1) * 2.0**-53) / rate


def _register(seed: np.ndarray, m: int) -> np.ndarray:
    return (mix(seed + _REGISTER) & U64(0xFFFFFFFF)).astype(np.int64) * m >> 32


def registers(row: np.ndarray, sh: np.ndarray, times: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """The earliest time in each of ``m`` registers, for ``rows`` multisets given as (row,
    shingle, weight).

    A process is known by its first point, a time and a register.  When it is split, the
    half that the point falls into, either with equal chance, inherits it; the other half's
    first point is later by a waiting time of its own.  All of it follows from the shingle
    alone, so two multisets see the same points wherever both weights reach.  A filled
    process gives its point away and is then split for the later ones, down to single units
    of weight, whose points follow one another; a process ends, and with it all that would
    come of it, when it is later than all registers.
    """
    best = np.full(rows * m, np.inf)
    roots, level = [], 0
    while len(row):
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        take = times > low
        row, sh, times = row[take], sh[take], times[take]
        seed = mix(sh + U64(level))
        roots.append((row, seed, np.full(len(row), width), np.minimum(times - low, width), _wait(mix(seed + _WAIT), width * m), _register(seed, m), np.zeros(len(row), bool)))
        level += 1
    if not level:
        return best.reshape(rows, m)
    state = [np.concatenate(x) for x in zip(*roots)]
    while len(state[0]):
        row, _, width, left, time, register, sent = state
        new = (left >= width) & ~sent
        np.minimum.at(best, row[new] * m + register[new], time[new])
        sent |= new
        on = time < best.reshape(rows, m).max(1)[row]
        row, seed, width, left, time, register, sent = (x[on] for x in state)
        unit = width == 1
        after = mix(seed[unit] + _STEP)
        parts = [(row[unit], after, width[unit], left[unit], time[unit] + _wait(mix(after + _WAIT), m), _register(after, m), np.zeros(len(after), bool))]
        row, seed, width, left, time, register, sent = (x[~unit] for x in (row, seed, width, left, time, register, sent))
        if len(row):
            half, to_left = width >> 1, (mix(seed) & U64(1)).astype(bool)
            for salt, heir, rest in ((_LEFT, to_left, left), (_RIGHT, ~to_left, left - half)):
                own = mix(seed + salt)
                some = rest > 0
                side = (row, own, half, np.minimum(rest, half), np.where(heir, time, time + _wait(mix(own + _WAIT), half * m)), np.where(heir, register, _register(own, m)), sent & heir)
                parts.append(tuple(x[some] for x in side))
        state = [np.concatenate(x) for x in zip(*parts)]
    return best.reshape(rows, m)


def signatures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Times, one row of registers per text; all infinite for wordless texts."""
    return registers(*counted(*shingles(raw, offsets)), len(offsets) - 1)


def band_keys(best: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band; equal keys mean equal registers and band."""
    bits = best.view(U64).reshape(len(best), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (len(best), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * _STEP + bits[:, :, k])
    return key


def node_of(text: str) -> Column:
    """What tells distinct texts apart: 128 bits, two 64-bit hashes with their own seeds."""
    return F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


NODE = "struct<a:long,b:long>"


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _sign(batches):
    """(doc_id, node, text) to (doc_id, node, bands); no bands for wordless texts."""
    for batch in batches:
        raw, at = flat(batch.column(2))
        for i, j in chunks(at):
            best = signatures(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            some = np.isfinite(best[:, 0])
            bands = _lists(np.concatenate([[0], np.cumsum(some * BANDS)]), band_keys(best)[some].view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], bands], names=["doc_id", "node", "bands"])


def _unit_rows(batches):
    """(node, text) to (node, units, sketch), repeats within a batch left out.

    A unit is one occurrence of a shingle, so that the overlap of unit sets is multiset
    overlap; units are sorted.  The sketch has one byte of each register.
    """
    for batch in batches:
        a, b = (x.to_numpy() for x in batch.column(0).flatten())
        one = np.sort(np.unique(np.stack([a, b], 1), axis=0, return_index=True)[1])
        batch = batch.take(pa.array(one))
        raw, at = flat(batch.column(1))
        for i, j in chunks(at):
            part, own = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            row, h, times = counted(*shingles(part, own))
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            unit, row = mix(np.repeat(h, times) + nth.astype(U64)), np.repeat(row, times)
            unit = unit[np.lexsort((unit, row))]
            sketch = (mix(signatures(part, own).view(U64)) & U64(255)).astype(np.uint8)
            sketch = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((np.arange(j - i + 1) * REGISTERS).astype(np.int32)), pa.py_buffer(sketch)])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], _lists(ends, unit.view(np.int64)), sketch], names=["node", "units", "sketch"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
    return both / max(1, len(a) + len(b) - both)


def _verify(batches):
    """(p, q, units of p, units of q) to (a, b, similarity), exact, at ``SIMILARITY`` or more."""
    for batch in batches:
        ua, ub = batch.column(2), batch.column(3)
        va, vb = ua.flatten().to_numpy(), ub.flatten().to_numpy()
        ea, eb = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in (ua, ub))
        sims = np.array([overlap(va[ea[k] : ea[k + 1]].view(U64), vb[eb[k] : eb[k + 1]].view(U64)) for k in range(len(batch))])
        took = pa.array(np.flatnonzero(sims >= SIMILARITY))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(sims[sims >= SIMILARITY], pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (p, q) of nodes that really are that similar, as (a, b, similarity)."""
    a = units.select(F.col("node").alias("p"), F.col("units").alias("units_p"))
    b = units.select(F.col("node").alias("q"), F.col("units").alias("units_q"))
    # a text of less than 0.8 of the other's size cannot be 0.8 similar
    alike = F.least(F.size("units_p"), F.size("units_q")) >= SIMILARITY * F.greatest(F.size("units_p"), F.size("units_q"))
    joined = pairs.join(b, "q").join(a, "p").where(alike).select("p", "q", "units_p", "units_q")
    return joined.mapInArrow(_verify, f"a {NODE}, b {NODE}, similarity double")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the members of two blocks, (i, j) with i < j, or inside one, (i, i).
    Pairs whose sketches agree enough are compared exactly, the likeliest first; of the
    links that join components a spanning forest is returned."""
    empty = pa.table({"a": pa.array([], table.schema.field("node").type), "b": pa.array([], table.schema.field("node").type), "similarity": pa.array([], pa.float64())})
    n = table.num_rows
    if n < 2:
        return empty
    table = table.combine_chunks()
    node = np.stack([x.to_numpy() for x in table.column("node").chunk(0).flatten()], 1)
    comp = np.unique(np.stack([x.to_numpy() for x in table.column("comp").chunk(0).flatten()], 1), axis=0, return_inverse=True)[1].ravel()
    own, units = table.column("own").to_numpy(), table.column("units").chunk(0)
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    ends = np.concatenate([[0], np.cumsum(units.value_lengths().to_numpy())])
    values, size = units.flatten().to_numpy().view(U64), np.diff(ends)
    sketch = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in table.column("sketch")])
    left, right, agree = [], [], []
    for x in range(n - 1):
        ok = comp[x + 1 :] != comp[x]
        if across:
            ok &= own[x + 1 :] != own[x]
        y = np.flatnonzero(ok) + x + 1
        y = y[np.minimum(size[y], size[x]) >= SIMILARITY * np.maximum(size[y], size[x])]
        same = (sketch[y] == sketch[x]).sum(1)
        y, same = y[same >= LEAST_AGREE], same[same >= LEAST_AGREE]
        left.append(np.full(len(y), x))
        right.append(y)
        agree.append(same)
    left, right, agree = map(np.concatenate, (left, right, agree))
    parent = list(range(int(comp.max()) + 1))

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = int(left[k]), int(right[k])
        p, q = root(int(comp[x])), root(int(comp[y]))
        if p != q and (s := overlap(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]])) >= SIMILARITY:
            parent[p] = q
            out.append((x, y, s) if tuple(node[x]) < tuple(node[y]) else (y, x, s))
    if not out:
        return empty
    x, y, s = zip(*out)
    names = table.column("node").chunk(0)
    return pa.table({"a": names.take(pa.array(x)), "b": names.take(pa.array(y)), "similarity": pa.array(s, pa.float64())})


def block_links(open_: DataFrame, units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Exact links inside the buckets (key, node, comp), none as rows of pairs: members are
    dealt into blocks of about ``block``, and each pair of blocks is one bounded group."""
    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")
    return dealt.join(units, "node").groupBy("key", "i", "j").applyInArrow(_block_links, f"a {NODE}, b {NODE}, similarity double")


def buckets_of(signed: DataFrame) -> DataFrame:
    """(key, node): the members of every bucket that holds two distinct texts or more; of
    buckets with the same members, one."""
    entries = signed.where("node is not null").select("node", F.explode("bands").alias("key"))
    multi = entries.groupBy("key").agg(F.min("node.a").alias("lo"), F.max("node.a").alias("hi")).where("lo <> hi").select("key")
    members = written(entries.join(multi, "key").select("key", "node").distinct(), "bag-members")
    n = members.count()
    sums = members.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("f"), F.sum(F.xxhash64("node", F.lit(3)).cast("decimal(20,0)")).alias("g"), F.count("*").alias("n"))
    one = sums.groupBy("f", "g", "n").agg(F.min("key").alias("key")).select("key")
    buckets = written(members.join(one, "key"), "bag-buckets", rows=n)
    discard(signed.sparkSession, members)
    return buckets


def units_of(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, units, sketch) of the distinct texts in ``buckets``; ``asked`` has (node, text).

    This is the one shuffle of texts, by a sort-merge join at every size; copies of one
    text go before the aggregation that makes nodes distinct, batch by batch.
    """
    wanted = written(buckets.select("node").distinct(), "bag-wanted", rows=buckets.count())  # plain on both sides, so that a hot key can be split
    some = asked.select("node", "text").where("node is not null").join(wanted.hint("merge"), "node", "left_semi")
    rows = written(some.mapInArrow(_unit_rows, f"node {NODE}, units array<long>, sketch binary"), "bag-unit-rows")
    n = rows.count()
    units = written(rows.groupBy("node").agg(F.first(F.struct("units", "sketch")).alias("u")).select("node", "u.units", "u.sketch"), "bag-units", rows=n, per_file=UNITS_A_TASK)
    discard(asked.sparkSession, wanted, rows)
    return units


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, node; links: a, b, similarity; stars: node, root) of near-duplicates.

    A node is a distinct text.  Buckets of equal band keys are never expanded into pairs:
    a round pairs each bucket's pivot, another one in every bucket and round, with the
    members in other components, verifies the pairs exactly and merges components; pivots
    leave, and a bucket is done when its members share a component.  Groups of copies
    collapse that way, at a few pairs a member.  When a round leaves more than half of
    what was open, buckets hold texts that share passages rather than most of their words;
    these are settled by blocks.  No bucket, however large, loses a link that would join
    components.
    """
    spark = docs.sparkSession
    slim_batches(spark)
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(text).isNotNull(), node_of(text)).alias("node"), F.col(text).alias("text"))
    id_type = asked.schema["doc_id"].dataType.simpleString()
    signed = written(asked.mapInArrow(_sign, f"doc_id {id_type}, node {NODE}, bands array<long>"), "bag-signed")
    buckets = buckets_of(signed)
    units = units_of(asked, buckets)
    open_, before, rounds = buckets.withColumn("comp", F.col("node")), buckets.count(), 0
    links = spark.createDataFrame([], f"a {NODE}, b {NODE}, similarity double")
    stars = spark.createDataFrame([], f"node {NODE}, root {NODE}")
    while before:
        first = F.min(F.struct(F.xxhash64("key", "node", F.lit(rounds)).alias("h"), "node", "comp")).alias("p")
        pivots = open_.groupBy("key").agg(first).select("key", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp"))
        state = written(open_.join(pivots, "key"), "bag-round", rows=before)
        pairs = state.where("comp <> pivot_comp").select(F.least("node", "pivot").alias("p"), F.greatest("node", "pivot").alias("q")).distinct()
        links = links.union(written(verified(pairs, units), "bag-links", rows=before, per_file=PAIRS_A_TASK))
        old_stars, stars = stars, written(connected_components(links.select("a", "b")), "bag-stars")
        left = state.where("node <> pivot").select("key", "node").join(stars, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        left = written(left, "bag-left", rows=before)
        several = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        old_open, open_ = open_, written(left.join(several, "key"), "bag-open", rows=before)
        discard(spark, state, left, *([old_open, old_stars] if rounds else []))
        rounds, last, before = rounds + 1, before, open_.count()
        if 2 * before > last:
            links = links.union(written(block_links(open_, units, block), "bag-links"))
            old_stars, stars = stars, written(connected_components(links.select("a", "b"), rows=last), "bag-stars", rows=last)
            discard(spark, old_stars)
            break
    if rounds:
        discard(spark, open_)
    discard(spark, buckets, units)
    return signed.select("doc_id", "node"), links, stars


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, copies, links.

    Equal texts share a class, as do texts linked by chains of pairs of weighted Jaccard
    similarity 0.8 or more over 5-word shingles.  ``class_id`` is the least doc_id of the
    class, ``copies`` the rows of the same text, ``links`` the verified links of that text
    (those that were needed to join its class).  Null texts are classes of their own with
    their own id; wordless texts equal only themselves; null ids are rows like others
    (their class has a null id if it has no other).  Texts of any length are taken whole.
    Extra columns are ignored, whatever their names; an empty table gives an empty result.

    Distinct texts are told apart by 128 bits of hash, shingles by 64: candidates come from
    the signatures, so a pair of texts at 0.8 is missed with a probability below 3e-5.
    """
    rows, links, stars = near_links(docs, doc_id, text, block)
    per_text = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    per_text = written(per_text, "bag-texts")
    linked = written(stars.join(per_text.select("node", "least"), "node"), "bag-linked")
    names = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    linked = linked.join(names, "root").join(ends, "node", "left").select("node", F.lit(True).alias("near"), "class_id", "links")
    known = per_text.join(linked, "node", "left").select("node", F.when(F.col("near"), F.col("class_id")).otherwise(F.col("least")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    known = written(known, "bag-known")  # plain on both sides, so that a hot text can be split
    out = rows.join(known, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least
    id.  Rows with a null text are no one's copies and stay; of rows that are equal in id
    and text one stays, the one whose columns' hash is least."""
    spark = docs.sparkSession
    rows, links, stars = near_links(docs, doc_id, text)
    per_text = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = per_text.join(stars, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("k"))
    chosen = written(rooted.select(F.col("k.least").alias("_least"), F.col("k.node").alias("_node")), "bag-chosen")
    discard(spark, rows, links, stars)
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.where(F.col(text).isNotNull()).select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), node_of(text).alias("_n"), F.xxhash64(*plain).alias("_h"))
    # one shuffle of the rows: what follows the join is grouped by the same key
    kept = keyed.join(chosen, F.col("_n") == F.col("_node")).where(F.col("_id").eqNullSafe(F.col("_least")))
    one = kept.groupBy("_n").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
    return one.unionByName(docs.where(F.col(text).isNull()))


def op9_bagminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
