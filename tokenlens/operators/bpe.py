"""Pair counts over distinct words with characters as atoms; vocabulary trains on bytes and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, symbols, cnt): each distinct pre-token once, as its characters."""
    words = docs.select(F.explode(T.pretokens(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return words.withColumn("symbols", F.split("word", ""))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, cnt) over adjacent symbols."""
    n = F.size("symbols")
    pairs = F.when(n > 1, F.arrays_zip(F.slice("symbols", F.lit(1), n - 1).alias("l"), F.slice("symbols", F.lit(2), n - 1).alias("r")))
    rows = words.select("cnt", F.explode(pairs).alias("p"))
    return rows.groupBy(F.col("p")["l"].alias("left"), F.col("p")["r"].alias("right")).agg(F.sum("cnt").alias("cnt"))
