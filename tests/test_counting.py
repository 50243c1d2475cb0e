"""Windows counted outside the JVM: the same tokens, the same counts, little to shuffle."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillchain.functions import text as fx
from quillchain.operators import counting, model, sequences

SF = "/root/testdata/sf0.1"


def counted_by_jvm(docs, order, mode):
    return model.transitions_of_tokens(sequences.token_rows(docs), order, mode)


def plain(spark):
    """Every character that the guard before NFKC lets pass."""
    all_of_them = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(c,) for c in all_of_them], "c string")
    return [r.c for r in rows.where(~fx.needs_nfkc(F.col("c"))).collect()]


def test_plain_tokens_are_those_of_the_jvm(spark):
    rng, letters = random.Random(11), plain(spark)
    assert len(letters) > 300
    usual = "aIİı09.,'-…"[:-1] + "!?;:()[]\"% \n" + "–’“" + chr(0xAD)
    texts = ["a" + c + "b" + c + c + "1" for c in letters]
    texts += ["".join(rng.choice(usual if rng.random() < 0.8 else letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["dr. x", "a.\n \x1c\n.b", "a\n\xad\nb", "1...2.3,4", "..\xad. x", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert df.where(fx.needs_nfkc(F.col("text"))).isEmpty()
    for r in df.select("id", counting.tokens_by_paragraph(F.col("text")).alias("made")).collect():
        mine = [["…" if t.startswith("...") else t for t in counting.plain_tokens(p)] for p in counting.plain_paragraphs(texts[r.id])]
        assert [t for t in mine if t] == [t for t in r.made if t], repr(texts[r.id])


@pytest.mark.parametrize("order,mode", [(1, "both"), (2, "both"), (4, "word"), (5, "char")])
def test_counts_equal_those_of_the_jvm(spark, order, mode, monkeypatch):
    """Texts for both tokenizers, nulls and empty ones, counted in one piece and in many."""
    rng = random.Random(order)
    words = ["dr", "prof", ".", "...", "!", '"', ")", "(", "it's", "ak-su", "ﬁn", "½", "şu", "İZ", "1.5", "\n\n", "\n", "x" * 70]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", " ", "\n \n", "tek"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = counted_by_jvm(docs, order, mode)
    for flush, merged in ((1 << 22, 1 << 20), (50, 1)):
        monkeypatch.setattr(counting, "FLUSH", flush)
        monkeypatch.setattr(counting, "MERGED", merged)
        got = model.transitions(docs, order, mode)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_windows_wider_than_an_integer():
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 1 << 30, (5, 3000)).astype(np.int32)
    columns, counts = counting.added(np.concatenate([wide, wide[:, :1000]], axis=1))
    assert sorted(map(tuple, columns.T.tolist())) == sorted(set(map(tuple, wide.T.tolist()))) == list(map(tuple, columns.T.tolist()))
    assert counts.sum() == 4000 and (counts == 2).sum() == 1000
    tokens = pa.array(["a", "", "çok", "x" * 300], pa.large_string())
    code, c, n, t = counting.unpack(counting.pack(np.array([[0, 2, 3], [3, 3, 0]], np.int32), np.array([1, 1 << 40, 7]), tokens, 1))
    assert code == 1 and n.tolist() == [1, 1 << 40, 7] and [[t[k].as_py() for k in x] for x in c.tolist()] == [["a", "çok", "x" * 300], ["x" * 300, "x" * 300, "a"]]


def test_little_is_shuffled(spark):
    """Word models go through the shuffle in 16 bytes a row at most, and no bucket has the sentence starts alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for order in (2, 3):
        packs = counting.packed(docs, order, ("word",)).select("bucket", F.length("packed").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        rows = model.transitions(docs, order).count()
        assert sum(r.n for r in packs) < 16 * rows and max(r.n for r in packs) < 2 * sum(r.n for r in packs) / len(packs)
    plan = model.transitions(docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "HashAggregate" not in plan


def test_models_are_stored_in_order(spark, tmp_path, monkeypatch):
    """Counted, dealt out and sorted without rows of strings: equal to the table written as rows, files in ranges of states."""
    from quillchain.sources import store

    monkeypatch.setattr(counting, "SAMPLED", 8)
    monkeypatch.setattr(counting, "ROWS_A_RANGE", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    store.write_model(model.transitions(docs, 2, "both"), str(tmp_path / "rows"), 2, "both")
    store.write_model(counting.Windows(docs, 2, ("word", "char")), str(tmp_path / "packed"), 2, "both")
    one, two = store.Model(spark, str(tmp_path / "rows")), store.Model(spark, str(tmp_path / "packed"))
    for name, key in (("transitions", "state"), ("backoff", "last_token"), ("models", "mode")):
        a, b = getattr(one, name), getattr(two, name)
        assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()
        if key != "mode":
            spans = b.groupBy("mode", F.input_file_name().alias("f")).agg(F.min(F.struct(key, "next_token")).alias("low"), F.max(F.struct(key, "next_token")).alias("high")).orderBy("mode", "low").collect()
            assert len(spans) > 3 and all(p.high < n.low for p, n in zip(spans, spans[1:]) if p.mode == n.mode)


@pytest.mark.parametrize("order,mode", [(1, "word"), (2, "word"), (2, "char")])
def test_what_is_asked_of_states(spark, order, mode):
    """In buckets as over the table of rows; the state of BOS alone is in all buckets."""
    from quillchain.operators import query

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = counted_by_jvm(docs, order, mode).select("state", "next_token", "frequency").persist()
    near = lambda df: df.withColumn("probability", F.round("probability", 9)) if "probability" in df.columns else df
    for got, want in [
        (counting.greedy(docs, order, mode), query.greedy(rows, "state")),
        (counting.sample(docs, order, mode), query.sample(rows, ["state"])),
        (counting.sample(docs, order, mode, 0), query.sample(rows, ["state"], 0)),
        *((counting.distribution(docs, order, mode, t), query.distribution(rows, ["state"], t)) for t in (0, 0.02, 1.5)),
    ]:
        got, want = near(got), near(want.select(got.columns))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    halves = [docs.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    both = counting.counted(halves, order, (mode,)).select(rows.columns)
    assert both.exceptAll(rows).isEmpty() and rows.exceptAll(both).isEmpty()
    assert counting.row_counts(docs, order, (mode,)).collect() == [(mode, rows.count())]
    rows.unpersist()


def test_stats_equal_those_of_the_jvm(spark):
    """Paragraphs without a token, blank ones, texts that the JVM cleans, nulls."""
    texts = ["~~~\n\n* a-b'c\n \n" + chr(0xAD), "ﬁn. ½\n\n…\n\n" + chr(0x2028), "Dr. Ali geldi. Sonra!\n\n\x1c\x07", None, "", "x" * 70 + " İZ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = counting.build_stats(docs), model.build_stats(sequences.token_rows(docs), docs)
    assert got.select(want.columns).collect() == want.collect()


def test_walks_ask_a_stored_model_for_few_states(spark, tmp_path):
    """The scan of a model is told what is wanted; states without rows are found without shuffling the model."""
    from quillchain.operators import generate, query
    from quillchain.sources import store

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    store.write_model(counting.Windows(docs, 2, ("word",)), str(tmp_path / "m"), 2, "word")
    m = store.Model(spark, str(tmp_path / "m"))
    wanted = spark.createDataFrame([("word", fx.SEP.join(s)) for s in (("of", "the"), ("no such", "the"), (fx.BOS, "no such"))], "mode string, state string")
    tables = generate._restricted(m, wanted)
    assert all("In(" in t._jdf.queryExecution().executedPlan().toString() for t in tables)
    got, want = query.candidates(*tables, wanted), query.candidates(m.transitions, m.backoff, wanted)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
