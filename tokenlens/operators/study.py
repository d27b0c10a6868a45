"""The Zipf study on top of the single statistics: deltas from a baseline unit, verdicts, curves. Draws are in draws, hypotheses in hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hypotheses import student_p
from .zipf import count_blocks, harmonic, spearman

def deltas(rows: DataFrame, value: str, baseline: str) -> DataFrame:
    """(lang, unit, delta) of rows(lang, unit, <value>) from the baseline unit of the same language; others without one drop out."""
    base = rows.where(F.col("unit") == baseline).select("lang", F.col(value).alias("_base"))
    return rows.where(F.col("unit") != baseline).join(base, "lang").select("lang", "unit", F.round(F.col(value) - F.col("_base"), 7).alias("delta"))


def verdicts(rows: DataFrame, x: str, y: str, by: str, level: float = 0.05) -> DataFrame:
    """(by, n, rho, p, supported): Spearman's rho of x and y in each `by` and whether it is below 0 at `level`."""
    got = spearman(rows, x, y, by).withColumn("p", F.round(student_p(F.col("rho"), F.col("n")), 8))
    return got.withColumn("supported", F.coalesce((F.col("rho") < 0) & (F.col("p") < level), F.lit(False)))


def rank_frequency_curve(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """(lang, first_rank, types, cnt, pure): observed counts and those of pure Zipf at the first rank of each block of ties."""
    blocks = count_blocks(counts)
    every = Window.partitionBy("lang")
    # The harmonic sum of all ranks, block by block, from its expansion at both ends.
    h = lambda n: F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n)
    rows = blocks.withColumn("_all", F.sum("types").over(every)).withColumn("_tokens", F.sum(F.col("types") * F.col("cnt")).over(every))
    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("_all", F.lit(20))), F.lit(0.0), lambda a, k: a + 1 / k)
    rows = rows.withColumn("pure", F.round(F.col("_tokens") / F.col("first_rank") / F.when(F.col("_all") > 20, h(F.col("_all").cast("double"))).otherwise(exact), 6))
    fit = fitted.select("lang", "alpha", "b")
    rows = rows.join(F.broadcast(fit), "lang", "left")  # a row per language
    top = F.pow(F.min("first_rank").over(every) + F.col("b"), -F.col("alpha"))
    return rows.select("lang", "first_rank", "types", "cnt", "pure", F.round(F.pow(F.col("first_rank") + F.col("b"), -F.col("alpha")) / top, 9).alias("shape"))


def pure_curve(counts: DataFrame) -> DataFrame:
    """(lang, first_rank, types, cnt, pure): observed counts and those of pure Zipf at the first rank of each block of types of one count."""
    every = Window.partitionBy("lang")
    rows = count_blocks(counts).withColumn("_v", F.sum("types").over(every)).withColumn("_n", F.sum(F.col("types") * F.col("cnt")).over(every))
    return rows.select("lang", "first_rank", "types", "cnt", F.round(F.col("_n") / F.col("first_rank") / harmonic(F.col("_v")), 5).alias("pure"))
