"""Ingest of source files by a ladder of rungs, with state: what has been taken, by digest, and the bytes that each language has left.

    ladder = LadderIngest(spark, "pool", target=10**9)
    for rung, folder in enumerate(folders):
        ladder.run(files(spark, folder), rung)

The state is the table of accepted documents itself, in folders by rung and batch of the stream, so that a batch that is run again, after a crash or a
lost executor, writes what it wrote before and counts once. A rung begins where the one before it stopped; within a rung, documents come in the order of
batches and, within a batch, of doc_id. What is taken is what pools.ladder() takes from the same documents, if batches follow doc_id: of equal texts of a
language the first, and of a rung no document of a language after the first that would overshoot its target. Rows without a language are left out; a null
text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import running_sum
from ..sources.shared import stored

ACCEPTED = "lang string, doc_id long, text string, digest string, bytes long, closes boolean, rung int, batch long"
DOCUMENT = "doc_id long, text string, lang string, source string"


def files(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """A stream of JSON lines (doc_id, text, lang, source), `per_batch` files at a time, the oldest first."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", per_batch).json(folder)


class LadderIngest:
    def __init__(self, spark: SparkSession, path: str, target: int):
        self.spark, self.path, self.target = spark, path, target

    def table(self) -> DataFrame:
        """All rows written: accepted documents, and for each language that a rung has closed a row without a document."""
        # The folders' columns are listed first, so an empty pool has a schema as well.
        try:
            return self.spark.read.schema(ACCEPTED).parquet(f"{self.path}/accepted")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ACCEPTED)

    def accepted(self) -> DataFrame:
        """(lang, rung, doc_id, text, bytes) of everything taken so far."""
        return self.table().where("doc_id IS NOT NULL").select("lang", "rung", "doc_id", "text", "bytes")

    def take(self, docs: DataFrame, rung: int, batch: int) -> None:
        """One batch of a rung, written to its own folder; whatever is in that folder is replaced and doesn't count."""
        before = self.table().where((F.col("rung") < rung) | ((F.col("rung") == rung) & (F.col("batch") < batch)))
        state = before.groupBy(F.col("lang").alias("of")).agg(F.sum("bytes").alias("used"), F.max(F.col("closes") & (F.col("rung") == rung)).alias("closed"))  # a row per language
        rows = docs.where("lang IS NOT NULL").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256)).withColumn("bytes", F.octet_length("text").cast("long"))
        first = rows.groupBy("lang", "digest").agg(F.min(F.struct("doc_id", "text", "bytes")).alias("d")).select("lang", "digest", "d.*")
        new = first.join(before.where("digest IS NOT NULL").select("lang", "digest"), ["lang", "digest"], "left_anti")
        open_ = new.join(F.broadcast(state), F.col("lang") == F.col("of"), "left").where(~F.coalesce("closed", F.lit(False))).withColumn("left", self.target - F.coalesce("used", F.lit(0)))
        run = stored(running_sum(open_, "bytes", "doc_id", ("lang",), ("digest",)))
        fits = run.where(F.col("running") <= F.col("left")).select("lang", "doc_id", "text", "digest", "bytes", F.lit(False).alias("closes"))
        over = run.where(F.col("running") > F.col("left")).select("lang").distinct()
        marks = over.select("lang", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("digest", "string"))), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("closes"))
        fits.unionByName(marks).write.mode("overwrite").parquet(f"{self.path}/accepted/rung={rung}/batch={batch}")

    def run(self, stream: DataFrame, rung: int) -> None:
        """Everything that the rung's stream has now. Where it stopped before, it goes on from its checkpoint."""
        query = stream.writeStream.foreachBatch(lambda df, batch: self.take(df, rung, batch)).option("checkpointLocation", f"{self.path}/checkpoints/{rung}").trigger(availableNow=True).start()
        query.awaitTermination()
