"""The pipeline on one small corpus: each stage's decisions hold on its own input."""

import importlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillchain.llm import langid
from tests.llm.test_ops_small import bag, brute_classes, prose, table

SF = "/root/testdata/sf0.001"


def test_stages_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"] and corpus_pipeline.ORACLE_SQL is None


def test_run_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        rows = at.collect()
        at = spark.createDataFrame(rows, at.schema)
        seen.append(rows)
    language, near, clean, mixed, shards = seen
    assert {r.doc_id for r in near} <= {r.doc_id for r in language} and len({r.text for r in near}) == len(near)
    items = [set(bag(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in near for s in items if s and len(s & set(bag(r.text))) >= 0.8 * len(s)}
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == held
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3 and {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    where = {}
    assert len(shards) == len(mixed) and all(where.setdefault(r.text, r.shard) == r.shard and 0 <= r.shard < 40 for r in shards)
    assert at.columns == [*docs.columns, "shard"]


def test_run_writes_what_the_stages_decide(spark):
    """run() against a version by brute force: classes by comparing all pairs, leaks by all
    items, copies by each source's target, shards by equal texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs if said[r.doc_id][0] != "und" and said[r.doc_id][1] >= corpus_pipeline.LEAST_SCORE]
    assert all(any(map(str.isalpha, r[1])) for r in rows) and all(r.text is None or not any(map(str.isalpha, r.text)) or said[r.doc_id][0] != "und" for r in docs)
    rows = [r for r, c in zip(rows, brute_classes(rows)) if r[0] == c]
    items = [set(bag(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(s and len(s & set(bag(r[1]))) >= 0.8 * len(s) for s in items)]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    out = corpus_pipeline.run(spark, SF).collect()
    taken = Counter()
    for r in out:
        taken[r.source] += words(r.text)
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and {r.text for r in out} <= {r[1] for r in rows}
    longest = max(words(r[1]) for r in rows)
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= longest
    where = {}
    assert all(where.setdefault(r.text, r.shard) == r.shard and 0 <= r.shard < 40 for r in out)


def words(text):
    return len("".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")) - "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ").count("")


def targets(sizes):
    """Shares by weight 5, 2, 1, what exceeds three times a source's size going to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        got = {s: 3 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and got[s] > 3 * sizes[s]}
        if not over:
            return got
        full |= over


def test_hostile_rows_pass_through(spark):
    long = prose(30_000, 7)
    rows = [(k, prose(40, k), "en", "a") for k in range(30)] + [(90, None, "en", None), (91, "", None, "a"), (None, prose(40, 99), "en", "a"), (5, prose(40, 5), "en", "a"), (92, long, None, "a"), (93, long + " end", None, None)]
    docs = table(spark, rows).withColumn("_lang", F.lit("x")).withColumn("shard", F.lit("x")).withColumn("row", F.lit("x")).withColumn("_often", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns + (["shard_1"] if name == "shard" else [])
        got = Counter(r.doc_id for r in out.collect())
        assert out.where("_lang <> 'x' or shard <> 'x' or row <> 'x' or _often <> 'x' or h <> 'x'").isEmpty()
        want = Counter(r[0] for r in rows)
        if name == "language_id":
            assert got == want - Counter([90, 91])
        elif name == "near_dedup":
            assert got == want - Counter([5, 93])
        elif name == "mix":
            assert max(got.values()) <= 6 and set(got) <= set(want) - {90, 91}
        else:
            assert got == want
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_registry_lists_all():
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
