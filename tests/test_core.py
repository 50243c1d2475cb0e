"""Cleaning, tokens, models, generation, storage, streaming, command line, HTTP."""

import json
import random
import re
import threading
import unicodedata
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quillchain import cli, web
from quillchain.errors import ConfigurationError, CorpusError, GenerationError, ModelError
from quillchain.functions import text as fx
from quillchain.operators import generate, model, query, sequences
from quillchain.plans.oracle import ORACLE_SQL
from quillchain.plans.queries import QUERIES
from quillchain.sources import corpus, store
from quillchain.streaming import merge
from tests.oracle import same

SF = "/root/testdata/sf0.001"
CORPUS = "IĞDIR güzel bir şehirdir.\nIğdır kışın soğuktur.\n\nIĞDIR'da kayısı yetişir!\n"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SF)


CLEAN = [("I İ i ı", "ı i i ı"), ("IĞDIR İZMİR KIŞ IŞIĞI", "ığdır izmir kış ışığı"), ("I" + chr(0x307) + "STANBUL", "istanbul"), ("KÂĞIT MİLLÎ SÜKÛN", "kâğıt millî sükûn"), ("Ankara’da, İzmir‘de; Türkiyeʼnin", "ankara'da, izmir'de; türkiye'nin"), ("son....", "son..."), ("a" + chr(0x200D) + "b" + chr(0xAD) + "c", "a bc"), (" \t x\x0by ", "x y"), ("", ""), (None, None)]


def slow_clean(text, lowercase=True):
    text = unicodedata.normalize("NFKC", text)
    text = "".join(fx.PUNCT_TO[fx.PUNCT_FROM.index(c)] if c in fx.PUNCT_FROM[: len(fx.PUNCT_TO)] else "" if c in fx.DROPPED else c for c in text)
    text = re.sub("[.]{3,}", "…", "".join(" " if unicodedata.category(c) in ("Cc", "Cf", "Cs") else c for c in text))
    if lowercase:
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).replace("I", "ı").replace("İ", "i").lower())
    return " ".join(text.split())


def test_cleaning(spark):
    df = spark.createDataFrame(list(enumerate(r for r, _ in CLEAN)), "id int, text string")
    assert [r.clean for r in fx.cleaned(df, "text", "clean").orderBy("id").collect()] == [c for _, c in CLEAN]
    plan = fx.cleaned(df, "text", "clean")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Union" not in plan


def test_cleaning_of_all_sorts_of_text(spark):
    rng = random.Random(5)
    letters = "aIİıiğş'-.…,;:!?()[]\"“”’–" + chr(0xAD) + chr(0x200D) + " \t\nZ09½ﬁ＇é" + chr(0x301)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a" + chr(c) + "b" for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for lowercase in (True, False):
        got = fx.cleaned(df, "text", "clean", lowercase).collect()
        assert len(got) == len(texts)
        assert not [(texts[r.id], r.clean) for r in got if r.clean != slow_clean(texts[r.id], lowercase)]


def tokens(spark, texts, cleaned=True):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    df = fx.cleaned(df, "text", "clean") if cleaned else df.withColumnRenamed("text", "clean")
    return df.select("id", fx.tokens_of(F.col("clean")).alias("tokens"))


def test_tokens_and_prompts(spark):
    got = tokens(spark, ["“Ankara'da yemyeşil-masmavi bir dünya…”", "42abc 2024-01-02 3'te a_b 1,5", " ".join(fx.PUNCTUATION)])
    assert [r.tokens for r in got.orderBy("id").collect()] == [['"', "ankara'da", "yemyeşil-masmavi", "bir", "dünya", "…", '"'], "42 abc 2024 - 01 - 02 3 te a b 1,5".split(), list(fx.PUNCTUATION)]
    shown = spark.createDataFrame([(["merhaba", ",", "dünya", "!"],), ('" merhaba , dünya . "'.split(),), (["(", "a", ")", "%", "[", "b", "]"],)], "t array<string>").select(fx.detokenize(F.col("t")).alias("d"))
    assert [r.d for r in shown.collect()] == ["merhaba, dünya!", '"merhaba, dünya."', "(a)% [b]"]
    asked = tokens(spark, ["IŞ", "ak-su", "", "iki kelime", "qwx", "a1"]).select("id", fx.char_prompt(F.col("tokens")).alias("p")).orderBy("id").collect()
    assert [r.p.word for r in asked[:3]] == ["ış", "aksu", ""] and [r.p.problem is None for r in asked] == [True] * 3 + [False] * 3
    assert [fx.human_bytes(n) for n in (5, 1536, 1 << 41)] == ["5 B", "1.5 KiB", "2.0 TiB"]


def test_sentences_and_char_words(spark):
    cases = {"Dr. Ali geldi. Sonra gitti!": ["dr . ali geldi .", "sonra gitti !"], '"Merhaba." Sonra (gitti!)': ['" merhaba . "', "sonra ( gitti ! )"], 'Dedi. "Gel"': ['dedi . "', 'gel "']}
    df = fx.cleaned(spark.createDataFrame([(k,) for k in cases], "k string"), "k", "clean")
    assert {r.k: r.s for r in df.select("k", fx.sentences_of(fx.tokens_of(F.col("clean"))).alias("s")).collect()} == cases
    w = spark.createDataFrame([("ığdır'da, kâğıt-kalem ve café42",)], "c string").select(fx.char_words_of(fx.tokens_of(F.col("c"))).alias("w")).first().w
    assert w == "ığdırda kâğıt kalem ve".split()


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = (model.transitions(docs.repartition(n), 2, "both") for n in (1, 9))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    m = one.persist()
    assert m.groupBy("mode").agg(F.sum("frequency")).collect() and model.backoff(m).agg(F.sum("frequency")).first() == m.agg(F.sum("frequency")).first()
    one, two = model.backoff(m), model.backoff_transitions(docs, 2, "both")
    assert one.exceptAll(two.select(one.columns)).isEmpty() and two.select(one.columns).exceptAll(one).isEmpty()
    for heat in (0.7, 0.02, 1e-300):
        p = query.distribution(m, ["mode", "state"], heat).groupBy("mode", "state").agg(F.sum("probability").alias("p"))
        assert p.where("abs(p - 1) > 1e-9 or isnan(p)").isEmpty()
    m.unpersist()


def test_draws():
    rng = random.Random(1).random
    assert all(generate.draw([("az", 1), ("çok", 100)], t, rng) == "çok" for t in (0, 1e-320)) and generate.draw([("a", 5), ("b", 5)], 0, rng) == "b"
    for bad in (float("nan"), float("inf"), -1):
        with pytest.raises(ConfigurationError):
            generate.draw([("a", 1)], bad, rng)
    with pytest.raises(GenerationError):
        generate.draw([], 1, rng)
    got = [generate.draw([("a", 1), ("b", 3)], 1, rng) for _ in range(4000)]
    assert abs(got.count("b") / 4000 - 0.75) < 0.03


def test_moves():
    """Each rule of a walk on its own."""
    rules = generate.Rules("word", 2, 3, 0.0)
    walk = lambda **k: generate.Walk(**{"id": 1, "seed": 7, "said": ["a", "b", "a"], "context": ["b", "a"], "restarts": [], **k})
    assert generate.moved(walk(), [("(", 9), ("x", 1)], rules).said[-1] == "x" and generate.moved(walk(), [("(", 9)], rules).said[-1] == "("
    assert generate.moved(walk(said=["a", "b", "a", "b"]), [("a", 9), ("c", 1)], rules).said[-1] == "c"  # a b a was said
    assert generate.moved(walk(), [(fx.EOS, 9)], rules).end == "" and "no way on" in generate.moved(walk(), [], rules).end
    assert generate.moved(walk(), [(fx.BOS, 9)], rules).context == [fx.BOS] * 2
    again = generate.moved(walk(restarts=[["t"], ["t", "u"]], turns=1), [(fx.EOS, 9)], rules)
    assert again.said[-2:] == ["t", "u"] and again.turns == 2 and again.counted == 2 and again.context == ["t", "u"]
    short = generate.moved(walk(restarts=[["t"], ["t", "u"]], turns=1, counted=2), [(fx.EOS, 9)], rules)
    assert short.said[-1] == "t" and short.end == ""
    assert "too many" in generate.moved(walk(steps=99), [(",", 1)], rules).end
    letters = rules._replace(mode="char")
    assert generate.moved(walk(steps=2), [("x", 1)], letters).end == "" and generate.moved(walk(), [(fx.EOS, 1)], letters).end == ""
    drawn = [generate.moved(walk(drawn=k), [(c, 1) for c in "pqrstuvw"], rules._replace(temperature=1.0)).said[-1] for k in range(6)]
    stream = random.Random(7)
    assert drawn == [generate.moved(walk(), [(c, 1) for c in "pqrstuvw"], rules._replace(temperature=1.0), stream).said[-1] for _ in range(6)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    (top / "in" / "deep").mkdir(parents=True)
    (top / "in" / "deep" / "a.txt").write_text(CORPUS, encoding="utf-8")
    (top / "in" / "skipped.md").write_text("no", encoding="utf-8")
    report = store.build_model(spark, store.BuildConfig(str(top / "in"), str(top / "model"), 2, "both"))
    return top, report


def test_stored_model(spark, built):
    top, report = built
    m = store.Model(spark, str(top / "model"))
    assert m.frequency("word", (fx.BOS, fx.BOS), "ığdır") == 2 and m.info("char").state_size == 2 and m.sources().count() == 1
    assert report.transition_rows == {r.mode: r.transition_rows for r in m.models.collect()} and m.metadata()["order"] == "2"
    walk = generate.Generator(m, 1)
    assert walk.generate("word", "IĞDIR", 3, 0).startswith("ığdır") and fx.BOS not in walk.generate("word", "IĞDIR", 3, 1.0)
    assert walk.generate("char", "I", 12, 0.8).startswith("ı")
    again = [generate.Generator(m, 9).generate("word", "Iğdır", 6, 1.2) for _ in range(2)]
    assert again[0] == again[1]
    with pytest.raises(GenerationError):
        walk.generate("word", "qwx", 3, 0)
    with pytest.raises(GenerationError):
        walk.generate("char", "iki kelime", 3, 0)
    asked = spark.createDataFrame([(k, p) for k, p in enumerate(["Iğdır", "IĞDIR kışın", "", "qwx", "Iğdır güzel"])], "id long, prompt string")
    for mode, heat in (("word", 1.2), ("word", 0.0), ("char", 0.9)):
        for r in generate.generate_batch(asked, m, mode, 5, heat, 40).collect():
            prompt = asked.where(f"id = {r.id}").first().prompt
            try:
                assert r.text == generate.Generator(m, 40 + r.id).generate(mode, prompt, 5, heat)
            except GenerationError as bad:
                assert r.text is None and r.problem == str(bad)
    with pytest.raises(ConfigurationError):
        walk.generate("other", "a", 3)
    with pytest.raises(ModelError):
        store.build_model(spark, store.BuildConfig(str(top / "in"), str(top / "model")))
    with pytest.raises(ModelError):
        store.Model(spark, str(top / "nothing"))
    with pytest.raises(CorpusError):
        corpus.read_corpus(spark, str(top / "nothing"))
    with pytest.raises(CorpusError):
        corpus.read_corpus(spark, str(top / "in"), exclude=str(top / "in" / "deep"))
    assert corpus.read_corpus(spark, str(top / "in"), exclude=str(top / "in" / "de")).select("path").distinct().count() == 1
    assert not [p for p in top.iterdir() if "staging" in p.name]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"bozuk \xff metin.")
    assert corpus.read_corpus(spark, str(tmp_path), "replace").select("text", "replacements").first() == ("bozuk � metin.", 1)
    assert corpus.read_corpus(spark, str(tmp_path), "ignore").select("text").first()[0] == "bozuk  metin."
    with pytest.raises(Exception, match="x.txt"):
        corpus.read_corpus(spark, str(tmp_path)).collect()
    with pytest.raises(CorpusError, match="x.txt at byte 6"):
        store.build_model(spark, store.BuildConfig(str(tmp_path), str(tmp_path / "model")))
    assert not (tmp_path / "model").exists()


SPLIT = "spark.sql.files.maxPartitionBytes"


def test_one_file_in_many_splits(spark, tmp_path):
    """Counts do not depend on where a file is split: paragraphs, CRLF, blank lines of spaces, no last line end."""
    rng = random.Random(3)
    text = "".join("IĞDIR güzeldir." + rng.choice([" İZMİR de\ngüzeldir.", " Dr. Ali\r\ngeldi.", ""]) + rng.choice(["\n\n", "\n \t\n", "\r\n\r\n", "\n\n\n\n"]) for _ in range(6000)) + "son söz"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(text.encode())
    (tmp_path / "in" / "b.txt").write_bytes(b"tek bir sat\xc4\xb1r")
    whole = spark.createDataFrame([(1, text), (2, "tek bir satır")], "doc_id long, text string")
    want = model.transitions(whole, 2, "word")
    old = spark.conf.get(SPLIT)
    try:
        for size in (7000, 64 << 10, 1 << 30):
            spark.conf.set(SPLIT, size)
            got = corpus.read_corpus(spark, str(tmp_path / "in"))
            if size < 1 << 30:
                assert corpus.pieces(spark, str(tmp_path / "in")).select("block").distinct().count() > 3
            counts = model.transitions(got, 2, "word")
            assert counts.exceptAll(want).isEmpty() and want.exceptAll(counts).isEmpty()
    finally:
        spark.conf.set(SPLIT, old)


def test_long_paragraphs_are_cut_at_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_text("bir iki üç\n" * 5000, encoding="utf-8")
    got = corpus.read_corpus(spark, str(tmp_path), most_bytes=4096).collect()
    assert len(got) > 3 and sum(r.text.count("bir iki üç") for r in got) == 5000 and all(r.text.startswith("bir") for r in got)
    (tmp_path / "a.txt").write_text("ağ" * 120_000, encoding="utf-8")  # no line end at all
    assert corpus.read_corpus(spark, str(tmp_path)).first().text == "ağ" * 120_000


def test_replaced_models_survive_failures(spark, tmp_path):
    made = spark.createDataFrame([("word", "a", "b", 1)], "mode string, state string, next_token string, frequency long")
    path = str(tmp_path / "model")
    store.write_model(made, path, 1, "word")

    def changed():
        raise CorpusError("changed")

    with pytest.raises(CorpusError):
        store.write_model(made.union(made), path, 1, "word", overwrite=True, last_check=changed)
    assert store.Model(spark, path).transitions.count() == 1 and [p.name for p in tmp_path.iterdir()] == ["model"]
    store.write_model(made.union(made.withColumn("state", F.lit("c"))), path, 1, "word", overwrite=True)
    assert store.Model(spark, path).transitions.count() == 2 and [p.name for p in tmp_path.iterdir()] == ["model"]


def test_streamed_counts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).cache()
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge.stream_transitions(texts, str(tmp_path / "model")).awaitTermination()
    got, want = merge.stream_model(spark, str(tmp_path / "model")), model.transitions(docs, 2, "word")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert sequences.paragraphs(docs.limit(0)).isEmpty()


def test_command_line(spark, built, capsys, monkeypatch):
    top, _ = built
    monkeypatch.setattr(cli, "session", lambda *a: spark)
    assert cli.main(["generate", "--db", str(top / "model"), "--prompt", "IĞDIR", "--length", "2", "--temperature", "0"]) == 0
    out = capsys.readouterr()
    assert out.out.startswith("ığdır ") and not out.err
    assert cli.main(["generate", "--db", str(top / "none"), "--prompt", "a", "--length", "2"]) == 1
    assert capsys.readouterr().err.startswith("error: no model")
    assert cli.main(["build-db", "--input-dir", str(top / "in"), "--db", str(top / "second"), "--order", "1", "--quiet"]) == 0
    assert not capsys.readouterr().err
    assert cli.main(["build-db", "--input-dir", str(top / "in"), "--db", str(top / "second"), "--order", "1", "--overwrite"]) == 0
    told = capsys.readouterr().err
    assert "scan: 100%" in told and "index: " in told and "done: 100%" in told and "transition rows: word=" in told
    for bad in (["generate", "--prompt", "a", "--length", "2", "--temperature", "nan"], ["build-db", "--input-dir", "x", "--order", "0"], []):
        with pytest.raises(SystemExit) as stop:
            cli.main(bad)
        assert stop.value.code == 2


def test_http(spark, built):
    top, _ = built
    made = web.server(spark, str(top / "model"))
    threading.Thread(target=made.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{made.server_address[1]}"

    def post(path, body):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode())) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as bad:
            return bad.code, json.load(bad)

    assert post("/api/generate", {"prompt": "Iğdır", "length": 2, "temperature": 0})[1]["text"].startswith("ığdır")
    assert post("/api/generate", {"prompt": "qwx"})[0] == 400 and post("/api/nothing", {})[0] == 404
    assert json.load(urllib.request.urlopen(base + "/api/status"))["state"] == "idle" and b"<form" in urllib.request.urlopen(base + "/").read()
    assert post("/api/shutdown", {})[0] == 200
