import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tokenlens.sources import shards


@pytest.fixture(scope="module")
def tokens(spark):
    shards.register(spark)
    rng = random.Random(5)
    rows = [("train" if k % 5 else "val", k, [rng.randrange(1 << 32) for _ in range(rng.choice([0, 3, 50]))]) for k in range(200)] + [("train", 1000, None), (None, 1001, [7])]
    return spark.createDataFrame(rows, "split string, doc_id long, ids array<long>").repartition(3).sortWithinPartitions("doc_id").persist()


def files_of(path) -> set:
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith(".")}


def test_token_shards_go_round(spark, tokens, tmp_path):
    path = str(tmp_path / "bin")
    tokens.write.format("token_shards").option("shardSize", 200).mode("append").save(path)
    got = {r.doc_id: (r.split, r.ids) for r in spark.read.format("token_shards").load(path).collect()}
    want = {r.doc_id: (r.split or "train", r.ids or []) for r in tokens.collect()}
    assert got == want
    listed = shards.manifest_of(path)
    assert files_of(path) == {f["name"] for f in listed} | {"manifest.json"}
    for f in listed:
        raw = open(f"{path}/{f['name']}", "rb").read()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and len(raw) == f["n_bytes"]
    bins = [f for f in listed if f["name"].endswith(".bin")]
    train = [f for f in bins if f["split"] == "train"]
    # A file is closed by the document that takes it to the size; the last one of a task may be smaller. Others are not rotated.
    assert len(train) > 6 and all(f["n_units"] < 250 for f in train) and sum(f["n_units"] >= 200 for f in train) >= len(train) - 3
    assert len([f for f in bins if f["split"] == "val"]) == 3 and sum(f["n_bytes"] for f in bins) == 4 * sum(len(ids) for _, ids in want.values())


def test_appending_and_overwriting(spark, tokens, tmp_path):
    path = "file://" + str(tmp_path / "bin")
    half = tokens.where("doc_id < 100")
    for part in (half, tokens.where("doc_id >= 100")):
        part.write.format("token_shards").mode("append").save(path)
    assert spark.read.format("token_shards").load(path).count() == tokens.count()
    half.write.format("token_shards").mode("overwrite").save(path)
    assert spark.read.format("token_shards").load(path).count() == half.count()
    assert files_of(tmp_path / "bin") == {f["name"] for f in shards.manifest_of(path)} | {"manifest.json"}


def test_failed_writes_leave_nothing(spark, tokens, tmp_path):
    path = str(tmp_path / "bin")
    bad = tokens.withColumn("ids", F.when(F.col("doc_id") == 150, F.array(F.lit(-1).cast("long"))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="32 bits"):
        bad.write.format("token_shards").option("shardSize", 10).mode("append").save(path)
    assert files_of(path) == set() and shards.manifest_of(path) == []
    tokens.write.format("token_shards").mode("append").save(path)
    before = files_of(path)
    with pytest.raises(Exception, match="32 bits"):
        bad.write.format("token_shards").mode("append").save(path)
    assert files_of(path) == before and spark.read.format("token_shards").load(path).count() == tokens.count()
    with pytest.raises(Exception, match="doc_id"):
        tokens.drop("doc_id").write.format("token_shards").mode("append").save(path)


def test_changed_files_are_told(spark, tokens, tmp_path):
    path = str(tmp_path / "bin")
    tokens.write.format("token_shards").mode("append").save(path)
    name = next(f["name"] for f in shards.manifest_of(path) if f["name"].endswith(".bin") and f["n_bytes"])
    raw = bytearray(open(f"{path}/{name}", "rb").read())
    raw[0] ^= 1
    open(f"{path}/{name}", "wb").write(raw)
    with pytest.raises(Exception, match="not what was written"):
        spark.read.format("token_shards").load(path).collect()


def test_json_lines_go_round(spark, tmp_path):
    shards.register(spark)
    rows = [("train" if k % 3 else "test", f"en-{k}", ["line\nbreak   \"quotes\"", "日本 🙂", "", None, "long " * 5000][k % 5]) for k in range(60)]
    docs = spark.createDataFrame(rows, "split string, id string, text string")
    path = str(tmp_path / "pool")
    docs.repartition(2).write.format("jsonl_shards").option("shardSize", 30_000).mode("append").save(path)
    assert sorted(map(repr, map(tuple, spark.read.format("jsonl_shards").load(path).collect()))) == sorted(map(repr, rows))
    listed = shards.manifest_of(path)
    assert sum(f["n_docs"] for f in listed) == 60 and len([f for f in listed if f["split"] == "train"]) > 4
    assert spark.read.format("jsonl_shards").load(str(tmp_path / "none")).count() == 0
