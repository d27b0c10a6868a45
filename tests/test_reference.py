import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlens.functions import text as T
from tokenlens.operators import corpus, metrics, pools, vocab, zipf
from tokenlens.sources import files
from tokenlens.streaming import dedup


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize("text, n", [("   ", 0), ("the  quick\tbrown\nfox", 4), ("", 0), ("a\x1cb c", 3)])
def test_words(spark, text, n):
    assert len(one(spark, T.words(F.col("text")), text)) == n == len(text.split())


@pytest.mark.parametrize("text, n", [("कि", 1), ("a b", 3), ("👩‍💻", 1), ("क्षत्रिय", 3)])
def test_graphemes(spark, text, n):
    assert len(one(spark, T.graphemes(F.col("text")), text)) == n


def test_nfkc(spark):
    assert one(spark, T.nfkc(F.col("text")), "ﬁ x") == "fi x"


def test_utf8_windows(spark):
    rows = spark.createDataFrame([(bytearray(b),) for b in (b"a", b"\xe1", b"\xe1\x88", b"\xe1\x88\x80", b"\x88", b"")], "raw binary")
    got = {bytes(r.raw): r.w and (r.w.low, r.w.high) for r in rows.select("raw", T.utf8_window(F.col("raw")).alias("w")).collect()}
    assert got == {b"a": (97, 97), b"\xe1": (0x1000, 0x1FFF), b"\xe1\x88": (0x1200, 0x123F), b"\xe1\x88\x80": (0x1200, 0x1200), b"\x88": None, b"": None}
    assert {bytes(r.raw): (r.block, r.certain) for r in vocab.fragments(rows).collect()}[b"\xe1\x88"] == ("Ethiopic", True)


def test_gini_of_equal_languages_is_zero(spark):
    rows = spark.createDataFrame([("t", "a", 10, 5), ("t", "b", 20, 10)], "tokenizer string, lang string, ctc long, n_sentences long")
    assert metrics.gini(rows).first().gini == 0


def test_exclusivity(spark):
    sets = {"eng": [1, 2, 3, 4], "swh": [1, 2, 3, 5], "amh": [90, 91], "a": [5, 90], "b": [5]}
    rows = spark.createDataFrame([(k, str(x), 1) for k, v in sets.items() for x in v], "lang string, unit string, cnt long")
    got = {r.lang: r for r in vocab.exclusivity(rows, "eng", 2).collect()}
    assert (got["swh"].share_not_in_control, got["swh"].share_rare) == (0.25, 0.75) and got["amh"].share_rare == 1.0


def test_uniform_entropy(spark):
    got = zipf.entropy(spark.createDataFrame([("x", str(k), 3) for k in range(64)], "lang string, unit string, cnt long")).first()
    assert got.entropy_bits == 6 and got.entropy_norm == 1 and got.effective_vocab == 64 and abs(got.entropy_nats - math.log(64)) < 1e-7


@pytest.mark.parametrize("alpha, b", [(1.1, 2.0), (0.8, 0.5)])
def test_mandelbrot_recovers_parameters(alpha, b):
    p = (np.arange(1, 3001) + b) ** -alpha
    got = zipf.fit_mandelbrot(p / p.sum() * 1e6)
    assert abs(got["alpha"] - alpha) < 0.02 and abs(got["b"] - b) < 0.2 and got["ks"] < 1e-3
    assert not zipf.fit_mandelbrot(np.array([5.0]))["converged"]


def test_mandelbrot_runs_in_tasks(spark):
    rows = spark.createDataFrame([("x", str(k), 1000 // (k + 1)) for k in range(50)], "lang string, unit string, cnt long")
    assert 0.8 < zipf.fits(rows).first().alpha < 1.4


def test_running_sum_in_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, rng.randrange(9)) for k in range(300)]
    got = corpus.running_sum(spark.createDataFrame(rows, "g string, k long, v long"), "v", "k", ("g",), width=16).collect()
    assert all(r.running == sum(v for g, k, v in rows if g == r.g and k <= r.k) for r in got) and len(got) == 300


def test_running_sum_keeps_rows_with_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(200)]), n, rng.randrange(9)) for n in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, n long, v long")
    got = corpus.running_sum(df, "v", "k", ("g",), ("n",), width=16).collect()
    place = lambda r: (r[1] is None, r[1] or 0, r[2])
    assert len(got) == 400 and all(r.running == sum(x[3] for x in rows if x[0] == r.g and place(x) <= place(r)) for r in got)
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", None, "s"), (None, "dd", "en", None), (4, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert corpus.budget_prefix(docs, 100).count() == corpus.round_robin(docs, 100).count() == 4
    assert {(r.lang, r.doc_id) for r in pools.equal_lines(docs).collect()} == {("en", 1), (None, 2)}
    assert pools.shard_of(corpus.sized(docs), 2).count() == 4


def test_errors_instead_of_silence(spark):
    docs = spark.createDataFrame([(k, "en" if k < 4 else "fr") for k in range(6)], "doc_id long, lang string")
    assert corpus.holdout(docs, 2).count() == 4 and corpus.holdout(docs, 1, strict=True).count() == 2
    with pytest.raises(ValueError, match="fr"):
        corpus.holdout(docs, 2, strict=True)
    with pytest.raises(ValueError, match="1000"):
        corpus.unimax(spark.createDataFrame([("a", 10.0), ("b", 20.0)], "lang string, bytes double"), 1000, 4.0)
    arms = [("x", "en", 1.0), ("x", "fr", 2.0), ("y", "en", 1.0)]
    schema = "arm string, lang string, premium double"
    with pytest.raises(ValueError, match="y fr"):
        corpus.complete_arms(spark.createDataFrame(arms, schema))
    assert corpus.calibrated(corpus.complete_arms(spark.createDataFrame([*arms, ("y", "fr", 8.0)], schema))).where("lang = 'fr'").first().shared_premium == 4.0


def test_unimax_golden_case(spark):
    rows = [("hat", 0.772e9), ("swh", 4.577e9), ("eng", float("inf")), ("hin", 34.4e9), ("hun", 98.6e9), ("zho", 1622e9)]
    got = {r.lang: r for r in corpus.unimax(spark.createDataFrame(rows, "lang string, bytes double"), 78e9, 4.0).collect()}
    assert got["hat"].capped and got["hat"].epochs == 4 and abs(got["hat"].share - 0.0396) < 1e-4 and not got["swh"].capped
    assert abs(sum(r.allocated for r in got.values()) - 78e9) < 1


def test_license_class(spark):
    for raw, name in [("MIT", "mit"), ("CC BY-NC 4.0", "cc-by-4.0"), (None, "unknown"), ("odc_by", "odc-by-1.0"), ("cc-by-sa 4.0", "cc-by-sa-4.0"), ("Apache 2", "apache-2.0")]:
        assert one(spark, corpus.license_class(F.col("text")), raw) == name


def test_files(spark, tmp_path):
    (tmp_path / "dev").mkdir()
    (tmp_path / "dev/eng.dev").write_text("a\nb\n")
    (tmp_path / "dev/fra.dev").write_text("c\nd\n")
    rows = files.parallel_corpus(spark, str(tmp_path), "dev").collect()
    assert sorted((r.lang, r.sent_id, r.text) for r in rows) == [("eng", 0, "a"), ("eng", 1, "b"), ("fra", 0, "c"), ("fra", 1, "d")]
    (tmp_path / "pool").mkdir()
    (tmp_path / "pool/part-0.jsonl").write_text('{"id": "x", "text": "hello"}\n{"id": "y", "text": " "}\n{broken\n')
    assert sorted(r.text for r in files.pool(spark, str(tmp_path / "pool"), "eng").collect()) == ["hello", "{broken"]
    (tmp_path / "pool/docs.jsonl").write_text('{"text": "last"}\n[1, 2]\n')
    got = {r.text: r.id for r in files.pool(spark, str(tmp_path / "pool"), "eng").collect()}
    assert got == {"hello": "x", "{broken": "eng-00000002", "last": "eng-00000003"}
    (tmp_path / "devtest").mkdir()
    (tmp_path / "devtest/eng.devtest").write_text("e\n")
    assert [r.lang for r in files.languages_of(spark, str(tmp_path), ("dev", "devtest")).collect()] == ["eng"]
    assert [(r.sent_id, r.text) for r in files.concatenated(spark, str(tmp_path)).orderBy("sent_id").collect()] == [(0, "a"), (1, "b"), (2, "e")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/eng.one").write_text("f\n")
    assert [(r.sent_id, r.text) for r in files.concatenated(spark, str(tmp_path), ("devtest", "one")).orderBy("sent_id").collect()] == [(0, "e"), (1, "f")]
    assert [r.text for r in files.documents_of(spark, str(tmp_path / "dev/fra.dev"), 1).collect()] == ["c"]
    with pytest.raises(FileNotFoundError):
        files.parallel_corpus(spark, str(tmp_path), "dev", ["eng", "spa"])
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/eng.txt").write_text("one\n\n  \ntwo\n")
    (tmp_path / "texts/fra.jsonl").write_text('{"text": "trois"}\n{"text": ""}\n')
    (tmp_path / "texts/readme.md").write_text("no\n")
    assert sorted((r.lang, r.text) for r in files.language_dir(spark, str(tmp_path / "texts")).collect()) == [("eng", "one"), ("eng", "two"), ("fra", "trois")]
    assert [n.rsplit("/", 2)[1:] for n in files.input_files(spark, str(tmp_path), "*.{txt,dev}", str(tmp_path / "dev"))] == [["texts", "eng.txt"]]
    with pytest.raises(ValueError, match="no files"):
        files.input_files(spark, str(tmp_path / "texts"), "*.zip")
    (tmp_path / "inventory.json").write_text('{"sources": [{"source_id": "a", "role": "x"}, {"source_id": "b", "role": "y"}]}')
    assert files.inventory(spark, str(tmp_path / "inventory.json")).count() == 2
    files.write_json(str(tmp_path / "deep/x.json"), {"b": 1, "a": [2]})
    assert (tmp_path / "deep/x.json").read_text().startswith('{\n  "a"') and len(list((tmp_path / "deep").iterdir())) == 1
    tokens = spark.createDataFrame([(k, "en", [1, k], 9) for k in range(5)], "doc_id long, lang string, ids array<int>, n_bytes long")
    files.write_token_shards(tokens, str(tmp_path / "tokens"), "plain", "abc", 2)
    assert sorted((r.shard, r.doc_id, r.n_tokens) for r in spark.read.json(str(tmp_path / "tokens")).collect()) == [(k // 2, k, 2) for k in range(5)]
    written = files.write_pool(spark.createDataFrame([(0, "a", "x"), (0, "b", "yy"), (1, "c", "z")], "shard int, id string, text string"), str(tmp_path / "out"))
    assert sorted((r.shard, r.n_docs, r.n_bytes) for r in written.collect()) == [(0, 2, 3), (1, 1, 1)] and spark.read.json(str(tmp_path / "out")).count() == 3
    files.write_u32_shards(spark.createDataFrame([(0, 1, [1, 70000])], "shard int, doc_id long, ids array<int>"), str(tmp_path / "u32"))
    assert bytes(spark.read.parquet(str(tmp_path / "u32")).first().u32le) == (1).to_bytes(4, "little") + (70000).to_bytes(4, "little")


def test_decision_rule(spark):
    rows = [("t1", "en", 100, 100, 500, 1.0, 1.0), ("t2", "en", 100, 100, 500, 1.0, 1.0), ("t1", "amh", 220, 100, 400, 2.2, 2.2), ("t2", "amh", 210, 100, 400, 2.1, 2.1), ("t1", "hun", 190, 100, 500, 1.9, 1.9), ("t1", "zho_Hans", 150, 2, 300, 75.0, 1.5), ("t2", "fra", 230, 150, 500, 1.5, 2.3)]
    m = spark.createDataFrame(rows, "tokenizer string, lang string, ctc long, n_words long, n_chars long, fertility double, token_premium double")
    got = {r.lang: (r.n_premium, r.clause_a, r.clause_b) for r in metrics.decision(m, ("t1", "t2")).collect()}
    assert got == {"amh": (2, True, True), "hun": (0, False, False), "zho_Hans": (0, False, True), "fra": (1, False, False)}
    assert metrics.decision(m, ("t1", "t2"), ("hun",)).where("lang = 'amh'").first().clause_b is False
    with pytest.raises(ValueError, match="xx"):
        metrics.languages(m, "en", "xx")
    with pytest.raises(KeyError):
        metrics.tokenizers(("byte", "none"))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 7}", "en", "s", 6) for k in range(20)], dedup.DOCUMENT)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    query = dedup.running_counts(dedup.read_documents(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").first().n_docs == corpus.first_wins(docs).count() == 7
