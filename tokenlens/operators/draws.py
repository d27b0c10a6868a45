"""Draws of whole sentences, as plans: matched draws without replacement, bootstraps with it, and the statistics of every draw.

Nothing random is gathered: the order of a draw's sentences is that of a hash of seed, draw and sentence, and what a bootstrap picks is a hash
of seed, draw and place. So draws are repeatable, the same in any SQL engine, and as wide as the cluster; a language is in no task as a whole.
sentences(lang, sent, units array<string>): sent is a number that tells a language's sentences apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored
from .corpus import running_sum
from .zipf import UNITS, against_zipf, entropy

#: What tells a language and a draw apart in one column.
BETWEEN = "\x1f"


def sentences(docs: DataFrame, unit: str = "word", number: str = "doc_id") -> DataFrame:
    """(lang, sent, units) of docs(lang, <number>, text) in normal form; rows without a language or a number are left out."""
    return docs.where(F.col("lang").isNotNull() & F.col(number).isNotNull()).select("lang", F.col(number).alias("sent"), UNITS[unit](T.normal(F.coalesce("text", F.lit("")))).alias("units"))


def hashed(seed: int, *parts: Column) -> Column:
    """MD5 of the seed plus the draw, and what is drawn, as text."""
    return F.md5(F.concat_ws(":", *((F.col("draw") + seed).cast("string"), *(p.cast("string") for p in parts))))


def number_of(digest: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def matched(rows: DataFrame, budget: int, draws: int, seed: int = 77) -> DataFrame:
    """(lang, draw, sent, units, n_units, budget_met): sentences of each draw until `budget` units, the last one cut, so that all draws have as many.

    A language with fewer units gives all, and `budget_met` is false. Sentences without units are never drawn. Only lengths are put in order.
    """
    every = stored(rows.select("lang", "sent", F.size("units").alias("n")))  # small, and read several times
    sized = every.where("n > 0")
    each = sized.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("hash", hashed(seed, F.col("sent")))
    run = running_sum(each.withColumn("order", number_of(F.col("hash"))), "n", "order", ("lang", "draw"), ("hash", "sent"))
    met = every.groupBy("lang").agg((F.sum("n") >= budget).alias("budget_met"))
    taken = run.where(F.col("running") - F.col("n") < budget).select("lang", "draw", "sent", F.least("n", budget - (F.col("running") - F.col("n"))).cast("int").alias("n_units"))
    cut = taken.join(rows, ["lang", "sent"]).withColumn("units", F.slice("units", F.lit(1), F.col("n_units")))
    return cut.join(met, "lang").select("lang", "draw", "sent", "units", "n_units", "budget_met")


def resampled(rows: DataFrame, draws: int, seed: int = 77) -> DataFrame:
    """(lang, draw, sent, weight): how often each draw of as many sentences as there are, with replacement, takes a sentence.

    Each place of a draw picks a sentence by its hash, so the weights of a draw are multinomial and their sum is exact.
    """
    one = rows.select("lang", "sent").withColumn("one", F.lit(1))
    places = running_sum(one, "one", "sent", ("lang",)).select("lang", "sent", (F.col("running") - 1).alias("place"))
    sizes = places.groupBy("lang").agg(F.count("*").alias("n"))
    each = places.join(sizes, "lang").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = each.select("lang", "draw", (number_of(hashed(seed, F.col("place")), 15) % F.col("n")).alias("place")).groupBy("lang", "draw", "place").agg(F.count("*").alias("weight"))
    return picked.join(places, ["lang", "place"]).select("lang", "draw", "sent", "weight")


def counts_of_matched(drawn: DataFrame) -> DataFrame:
    """(lang, draw, unit, cnt)."""
    return drawn.select("lang", "draw", F.explode("units").alias("unit")).groupBy("lang", "draw", "unit").agg(F.count("*").alias("cnt"))


def counts_of_resampled(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(lang, draw, unit, cnt): the weights of its sentences, whose units are shuffled once, for all draws."""
    each = weights.groupBy("lang", "sent").agg(F.collect_list(F.struct("draw", "weight")).alias("drawn"))  # a sentence's draws
    units = each.join(rows, ["lang", "sent"]).select("lang", "drawn", F.explode("units").alias("unit"))
    return units.select("lang", F.explode("drawn").alias("d"), "unit").groupBy("lang", F.col("d.draw").alias("draw"), "unit").agg(F.sum("d.weight").alias("cnt"))


def statistics(counts: DataFrame) -> DataFrame:
    """(lang, draw, n_tokens, n_types, entropy_nats, effective_vocab, ks_zipf, ols_slope) of counts(lang, draw, unit, cnt), all draws in one plan."""
    # All statistics need only how many units have each count, and are read from these several times.
    keyed = counts.groupBy("lang", "draw", "cnt").agg(F.count("*").alias("types")).select(F.concat_ws(BETWEEN, "lang", F.col("draw").cast("string")).alias("lang"), "cnt", "types")
    keyed = stored(keyed)
    rows = entropy(keyed).join(against_zipf(keyed).drop("n_types"), "lang")
    of = F.split("lang", BETWEEN)
    return rows.select(of[0].alias("lang"), of[1].cast("int").alias("draw"), "n_tokens", "n_types", "entropy_nats", "effective_vocab", "ks_zipf", F.col("loglog_ols_slope").alias("ols_slope"))


METRICS = ("entropy_nats", "ks_zipf", "ols_slope")


def summarised(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(lang, metric, mean, sd, low, high, n) over the finite values of each metric; sd is 0 for one value."""
    long = rows.unpivot(["lang"], list(metrics), "metric", "v").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    spread = F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("v"))
    values = F.avg("v"), spread, F.percentile("v", F.lit(0.025)), F.percentile("v", F.lit(0.975))
    return long.groupBy("lang", "metric").agg(*(F.round(v, 6).alias(k) for v, k in zip(values, ("mean", "sd", "low", "high"))), F.count("*").alias("n"))


def cells(rows: DataFrame, budget: int, draws: int, seed: int = 77) -> DataFrame:
    """A row per (view, lang, metric): point estimate and interval of a matched draw and of a bootstrap.

    matched_token has the mean of its draws as the point, as no draw is the whole; matched_sentence has the value of the whole corpus.
    """
    whole = rows.select("lang", F.lit(0).alias("draw"), F.explode("units").alias("unit")).groupBy("lang", "draw", "unit").agg(F.count("*").alias("cnt"))
    point = statistics(whole).unpivot(["lang"], list(METRICS), "metric", "point")
    drawn = matched(rows, budget, draws, seed)
    met = drawn.groupBy("lang").agg(F.min("budget_met").alias("budget_met"))
    token = summarised(statistics(counts_of_matched(drawn))).withColumn("point", F.col("mean")).join(met, "lang")
    sentence = summarised(statistics(counts_of_resampled(rows, resampled(rows, draws, seed)))).join(point, ["lang", "metric"]).withColumn("budget_met", F.lit(True))
    columns = ["view", "lang", "metric", F.round("point", 6).alias("point"), "mean", "sd", "low", "high", "n", "budget_met"]
    return token.withColumn("view", F.lit("matched_token")).select(columns).union(sentence.withColumn("view", F.lit("matched_sentence")).select(columns))
