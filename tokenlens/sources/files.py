"""Readers and writers of the corpus file formats."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def languages_of(spark: SparkSession, root: str, splits: tuple[str, ...]) -> DataFrame:
    """(lang): the languages that have a file {root}/{split}/{lang}.{split} in every split."""
    found = None
    for split in splits:
        names = spark.read.format("binaryFile").load(f"{root}/{split}/*.{split}").select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("lang"))
        found = names if found is None else found.intersect(names)
    return found


def parallel_corpus(spark: SparkSession, root: str, split: str, languages: list[str] | None = None) -> DataFrame:
    """(lang, sent_id, text) from {root}/{split}/{lang}.{split}, lines in order.

    Languages of unequal length, and wanted `languages` without a file, are an error.
    """
    files = spark.read.text(f"{root}/{split}/*.{split}", wholetext=True).withColumn("lang", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))
    rows = files.select("lang", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("sent_id", "text"))
    if languages is not None:
        rows = rows.where(F.col("lang").isin(languages))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if missing := sorted(set(languages or ()) - sizes.keys()):
        raise FileNotFoundError(f"no file of {split} for: {', '.join(missing)}")
    if len(set(sizes.values())) > 1:
        raise ValueError(f"languages differ in length: {sorted(set(sizes.values()))}")
    return rows


def concatenated(spark: SparkSession, root: str, splits: tuple[str, ...] = ("dev", "devtest")) -> DataFrame:
    """(lang, sent_id, text) of all splits, one behind the other; languages that lack one of them are left out."""
    both, before = languages_of(spark, root, splits), 0
    out = None
    for split in splits:
        rows = parallel_corpus(spark, root, split).join(both, "lang", "left_semi")
        rows = rows.withColumn("sent_id", F.col("sent_id") + before)
        last = rows.agg(F.max("sent_id")).first()[0]
        before = before if last is None else last + 1
        out = rows if out is None else out.unionByName(rows)
    return out


def language_dir(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text): lines of {lang}.txt and {lang}.dev and the `text` of lines of {lang}.jsonl; blank ones and other files are left out."""
    lines = spark.read.option("pathGlobFilter", "*.{txt,dev,jsonl}").text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    text = F.when(F.col("file").endswith(".jsonl"), F.get_json_object("value", "$.text")).otherwise(F.col("value"))
    rows = lines.select(F.regexp_extract("file", r"^(.*)\.[^.]+$", 1).alias("lang"), text.alias("text")).where(F.trim("text") != "")
    if rows.isEmpty():
        raise ValueError(f"no texts in {path}")
    return rows


def documents_of(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(text): lines of a file that aren't empty, the first `most` of them, in the order of files and lines, if given (a limit that is the feature)."""
    rows = spark.read.text(path).select(F.col("value").alias("text"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).where("text <> ''")
    return (rows if most is None else rows.orderBy("file", "line").limit(most)).select("text")


def input_files(spark: SparkSession, path: str, pattern: str = "*", out: str | None = None) -> list[str]:
    """All files below a folder that match, in order, without those below `out`; none is an error. Only names are listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    names = sorted(r.path for r in found.distinct().collect())
    if out is not None:
        names = [n for n in names if not n.removeprefix("file:").startswith(out.removeprefix("file:").rstrip("/") + "/")]
    if not names:
        raise ValueError(f"no files in {path}")
    return names


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON document's `sources`, or of the document itself where it is a list."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select(F.explode("sources").alias("s")).select("s.*") if "sources" in rows.columns else rows


def pool(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(id, lang, text) of a JSONL pool (plain, .gz or .zst as Hadoop reads them).

    A folder's part-*.jsonl* are read before its docs.jsonl*, each file once. A line that begins like an object but is broken is raw
    text; other JSON and blank texts are left out. Where a document has no id, it is {lang}-{number of the text in the pool}.
    """
    lines = spark.read.option("pathGlobFilter", "{part-*,docs}*.jsonl*").text(path) if "." not in path.rsplit("/", 1)[-1] else spark.read.text(path)
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    lines = lines.select("value", F.struct(file.startswith("docs").alias("last"), file.alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))
    lines = lines.withColumn("j", F.from_json("value", "id string, text string"))
    text = F.coalesce(F.col("j.text"), F.when(F.trim("value").startswith("{") & F.get_json_object("value", "$").isNull(), F.col("value")))
    rows = lines.select(F.col("j.id").alias("id"), text.alias("text"), "at").where(F.trim("text") != "")
    # Numbers by file and line: rows before each file, and within a file by rank in slices of lines.
    slice_ = F.struct("at.last", "at.file", F.floor(F.col("at.line") / (1 << 16)).alias("part"))
    rows = rows.withColumn("slice", slice_)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65,536 lines
    sums = rows.groupBy("slice").agg(F.count("*").alias("k")).select("slice", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
    number = F.row_number().over(Window.partitionBy("slice").orderBy("at.line")) + F.col("k")
    return rows.join(sums, "slice").select(F.coalesce("id", F.format_string(f"{lang}-%08d", number.cast("long"))).alias("id"), F.lit(lang).alias("lang"), "text")


def u32(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit numbers, in built-in functions."""
    each = F.transform(ids, lambda i: F.lpad(F.hex(i.cast("long")), 8, "0"))
    return F.unhex(F.array_join(F.transform(each, lambda h: F.concat(*(h.substr(k, 2) for k in (7, 5, 3, 1)))), ""))


def write_u32_shards(tokens: DataFrame, path: str) -> None:
    """tokens(shard, doc_id, ids) as little-endian 32-bit rows, a binary column per document, in folders by shard."""
    tokens.select("shard", "doc_id", F.size("ids").alias("n_tokens"), u32(F.col("ids")).alias("u32le")).repartition("shard", F.pmod("doc_id", F.lit(8))).sortWithinPartitions("doc_id").write.partitionBy("shard").parquet(path)


def write_token_shards(tokens: DataFrame, path: str, arm: str, digest: str, shard_size: int) -> None:
    """tokens(doc_id, lang, ids, n_bytes) as JSON lines, in folders of `shard_size` documents by doc_id, with the tokenizer's name and digest."""
    rows = tokens.select(F.floor(F.col("doc_id") / shard_size).alias("shard"), "doc_id", F.size("ids").alias("n_tokens"), "n_bytes", F.col("ids").alias("token_ids"), F.lit(arm).alias("tokenizer_arm"), F.lit(digest).alias("tokenizer_vocab_sha256"))
    rows.repartition("shard").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").json(path)


def write_pool(docs: DataFrame, path: str) -> DataFrame:
    """docs(shard, id, text) as compressed JSON lines in folders by shard; (shard, n_docs, n_bytes, sha256 of the sum of the documents' hashes)."""
    docs.repartition("shard").sortWithinPartitions("shard", "id").write.partitionBy("shard").option("compression", "gzip").json(path)
    digests = docs.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).alias("sum"))
    return digests.select("shard", "n_docs", "n_bytes", F.sha2(F.col("sum").cast("string"), 256).alias("sha256"))


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_json(path: str, payload: object) -> None:
    """A small document on the driver: keys sorted, written beside its place and moved there, so that no reader sees half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".json-")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        json.dump(payload, file, ensure_ascii=False, indent=2, sort_keys=True)
        file.write("\n")
    os.replace(beside, path)
