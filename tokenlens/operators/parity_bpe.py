"""Words of each language by the atoms they are built from, their weights by byte mass, and merge lists side by side; vocabulary trains on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def atoms(word: Column, kind: str) -> Column:
    """The atoms a word is built from: "char", "byte" (two hex digits each) or "grapheme"."""
    if kind == "char":
        return F.split(word, "")
    if kind == "grapheme":
        return T.graphemes(word)
    if kind != "byte":
        raise ValueError(f"no such atoms: {kind}")
    raw = F.hex(F.encode(word, "utf-8"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(2)) - 1, F.lit(2)), lambda k: F.substring(raw, k, F.lit(2)))


def language_words(docs: DataFrame, kind: str = "char") -> DataFrame:
    """(lang, word, symbols, cnt double) for each distinct pre-token of each language; null languages are left out."""
    rows = docs.where("lang IS NOT NULL").select("lang", F.explode(T.pretokens(F.coalesce("text", F.lit("")))).alias("word"))
    return rows.groupBy("lang", "word").agg(F.count("*").cast("double").alias("cnt")).withColumn("symbols", atoms(F.col("word"), kind))


def reweighted(words: DataFrame, shares: DataFrame) -> DataFrame:
    """`words` with counts scaled so that each language's byte mass has its share of shares(lang, share); others are left out."""
    mass = words.groupBy("lang").agg(F.sum(F.col("cnt") * F.octet_length("word")).alias("mass")).join(F.broadcast(shares), "lang")  # a row per language
    every = Window.partitionBy()
    scale = (F.col("share") / F.sum("share").over(every)) / (F.col("mass") / F.sum("mass").over(every))
    scales = mass.where("mass > 0").select("lang", scale.alias("scale"))
    return words.join(F.broadcast(scales), "lang").select("lang", "word", "symbols", (F.col("cnt") * F.col("scale")).alias("cnt"))


def merge_lists_compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row over two merges(rank, left, right): sizes, length of the common prefix, merges in both."""
    named = lambda df, n: df.select("rank", F.struct("left", "right").alias(n))
    both = named(first, "a").join(named(second, "b"), "rank", "full_outer")
    differs = F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("rank"))
    sizes = both.agg(F.count("a").alias("n_first"), F.count("b").alias("n_second"), F.coalesce(F.min(differs), F.count("*")).alias("common_prefix"))
    shared = first.select("left", "right").join(second.select("left", "right"), ["left", "right"], "left_semi").agg(F.count("*").alias("n_shared"))
    return sizes.crossJoin(shared)  # one row each
