"""Shards of nearly equal bytes by sampled splitters over the key (text hash, doc_id, row number).

A size-weighted sample of keys gives quantile boundaries; records fall into the ranges between them;
ranges that turn out overfull are subdivided by a denser sample of their own. A running sum within
each range, on top of the exact totals before it, places every record on the corpus's byte axis, which
is cut into equal shards. Equal texts are neighbours on that axis, and so share a shard unless a cut
falls among them; a text that holds a third of all rows is spread by doc_id, and rows that are equal in both by
a number that each row is given once, before anything is drawn.

Defined cases: a null text has no bytes; null doc_ids sort first; repeated rows each get a slot of their
own, in any order, as they have the same output; very long texts count with all of their bytes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

SHARDS = 24
#: Bytes that a range holds at most on average, so that ranges grow with the input; a range is one task's window.
RANGE_BYTES = 1 << 30
#: Ranges per shard at least, sampled keys per range (both bound what the driver holds), and the size that makes a range overfull.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERFULL, ROUNDS = 32, 12, 2.0, 3


def _key(*parts: pd.Series) -> np.ndarray:
    """Signed (h, id, number) as 24 bytes that sort as they do."""
    every = np.column_stack([p.to_numpy(np.int64) for p in parts]).view(np.uint64) ^ np.uint64(1 << 63)
    return every.byteswap().view("S24").ravel()


def _as_bytes(*parts: int) -> bytes:
    return b"".join((p + (1 << 63)).to_bytes(8, "big") for p in parts)


def _numbered(keyed: DataFrame, bounds: list[bytes]) -> DataFrame:
    """Adds `range`, the number of boundaries at or below the row's key."""
    limits = np.array(bounds, dtype="S24")

    @F.pandas_udf("int")
    def number(h: pd.Series, doc_id: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, _key(h, doc_id, n), side="right").astype(np.int32))

    return keyed.withColumn("range", number("h", "id", "n"))


def _sample(keyed: DataFrame, per_byte: float) -> list[tuple[bytes, float]]:
    """Keys drawn with a chance in proportion to size, by a hash, so that a rerun draws the same; sorted, with weights."""
    chance = F.col("size") * F.lit(per_byte)
    drawn = F.pmod(F.xxhash64("h", "id", "n", F.lit(7)), F.lit(1 << 40)) < chance * (1 << 40)
    return sorted((_as_bytes(r.h, r.id, r.n), max(1.0, r.size * per_byte)) for r in keyed.where(drawn).select("h", "id", "n", "size").collect())


def _quantiles(sample: list[tuple[bytes, float]], parts: int) -> list[bytes]:
    """Up to parts - 1 distinct boundaries that cut the sample's weight evenly."""
    if not sample or parts < 2:
        return []
    ends = np.cumsum([w for _, w in sample])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    return sorted({sample[min(int(i), len(sample) - 1)][0] for i in at})


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for the rows of `docs`(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"),
        F.monotonically_increasing_id().alias("n"),
    )
    keyed = checkpointed(keyed)  # the numbers stay what they are
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards * RANGES_PER_SHARD, total // RANGE_BYTES)
    full = max(1.0, total / ranges)
    bounds = _quantiles(_sample(keyed, SAMPLES_PER_RANGE / full), ranges)
    for round_ in range(ROUNDS + 1):
        numbered = _numbered(keyed, bounds)
        sums = sorted(tuple(r) for r in numbered.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
        over = {k: size for k, size, n in sums if size > OVERFULL * full and n > 1}
        if not over or round_ == ROUNDS:
            break
        denser = _sample(numbered.where(F.col("range").isin(list(over))), 4 * SAMPLES_PER_RANGE / full)
        for k, size in over.items():
            low, high = (bounds[k - 1] if k else b""), (bounds[k] if k < len(bounds) else b"\xff" * 25)
            keys = [x[0] for x in denser]
            bounds = bounds + _quantiles(denser[bisect.bisect_left(keys, low) : bisect.bisect_left(keys, high)], 1 + round(size / full))
        bounds = sorted(set(bounds))
    before, rows = {}, 0
    sums_so_far = 0
    for k, size, n in sums:
        before[k] = (k, sums_so_far, rows)
        sums_so_far, rows = sums_so_far + size, rows + n
    spark = docs.sparkSession
    starts = spark.createDataFrame(list(before.values()), "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("h", "id", "n")
    placed = (
        numbered.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(starts), "range")  # a row for each range, at most a few thousand
        .withColumn("middle", F.col("bytes_before") + F.col("end") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(max(1, total)))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("rank")).alias("place"))
    )
    placed = checkpointed(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
