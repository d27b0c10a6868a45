import json
import os
import random
import shutil

from pyspark.sql import functions as F

from tokenlens.operators import pools
from tokenlens.streaming import ingest


def write(folder, rows, per_file):
    folder.mkdir(parents=True)
    for k in range(0, len(rows), per_file):
        path = folder / f"part-{k:05d}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("doc_id", "text", "lang", "source"), r))) for r in rows[k : k + per_file]))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # the oldest file goes first


def documents():
    rng = random.Random(6)
    texts = ["y" * rng.randrange(1, 40) + str(k) for k in range(60)]
    rows, n = {0: [], 1: [], 2: []}, 0
    for rung in rows:
        for _ in range(60):
            rows[rung].append((n, rng.choice([*texts, None]), rng.choice(["en", "de", "fr"]), f"s{rung}"))
            n += 1
    rows[1].append((n, "no language", None, "s1"))
    return rows


def test_ingest_equals_the_ladder(spark, tmp_path):
    rows = documents()
    every = [r for own in rows.values() for r in own]
    docs = spark.createDataFrame([(k, t or "", lang, s) for k, t, lang, s in every], ingest.DOCUMENT)
    rungs = spark.createDataFrame([(f"s{k}", k) for k in rows], "source string, rung int")
    want = {tuple(r) for r in pools.ladder(docs.where("lang IS NOT NULL"), rungs, 500).select("lang", "rung", "doc_id", "bytes").collect()}
    assert len({w[1] for w in want}) > 1
    for per_file in (13, 61):
        ladder = ingest.LadderIngest(spark, str(tmp_path / f"pool{per_file}"), 500)
        for rung, own in rows.items():
            write(tmp_path / f"in{per_file}/{rung}", own, per_file)
            ladder.run(ingest.files(spark, str(tmp_path / f"in{per_file}/{rung}")), rung)
            ladder.run(ingest.files(spark, str(tmp_path / f"in{per_file}/{rung}")), rung)  # nothing new
        assert {tuple(r) for r in ladder.accepted().select("lang", "rung", "doc_id", "bytes").collect()} == want
        assert all(r.n <= 500 for r in ladder.accepted().groupBy("lang").agg(F.sum("bytes").alias("n")).collect())


def test_batches_that_run_again_count_once(spark, tmp_path):
    rows = documents()
    write(tmp_path / "in", rows[0], 20)
    ladder = ingest.LadderIngest(spark, str(tmp_path / "pool"), 400)
    ladder.run(ingest.files(spark, str(tmp_path / "in")), 0)
    before = {tuple(r) for r in ladder.accepted().collect()}
    shutil.rmtree(tmp_path / "pool/checkpoints")  # as if nothing had been told: all batches run again
    ladder.run(ingest.files(spark, str(tmp_path / "in")), 0)
    assert before and {tuple(r) for r in ladder.accepted().collect()} == before
    write(tmp_path / "later", [(1000, "late", "fr", "s0"), (1001, "y", None, "s0")], 5)
    ladder.run(ingest.files(spark, str(tmp_path / "later")), 1)
    assert {r.doc_id for r in ladder.accepted().where("rung = 1").collect()} <= {1000}


def test_an_empty_pool(spark, tmp_path):
    assert ingest.LadderIngest(spark, str(tmp_path / "none"), 5).accepted().collect() == []
