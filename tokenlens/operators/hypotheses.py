"""The study's four hypotheses as one table: rank correlations over languages by (hypothesis, tokenizer, pair of measures), and spreads.

Mid-ranks, correlations and their p are expressions over one long table of pairs, so all correlations are one plan however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From this number of pairs on, t is taken as normal.
NORMAL_FROM = 100_000


def student_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees of freedom; null under four pairs.

    With f degrees, x = 1 - rho^2 and r = |rho|, 1 - p is r * sum of c(k) x^k for k < f / 2, where c(k) = c(k - 1) (2k - 1) / 2k, if f is even, else
    2 / pi * (asin(r) + r sqrt(x) * sum of d(k) x^k for k < (f - 1) / 2, d(k) = d(k - 1) 2k / (2k + 1)); both begin with 1. Terms below 1e-18 are left out.
    """
    r, f = F.abs(rho), n.cast("long") - 2
    x = 1 - r * r
    even = f % 2 == 0
    terms = F.when(even, f / 2).otherwise((f - 1) / 2)
    enough = F.ceil(F.least(terms, F.when(x < 1, F.greatest(F.lit(1.0), -41.5 / F.nullif(F.log(F.greatest(x, F.lit(1e-300))), F.lit(0.0)))).otherwise(terms)))
    ks = F.when(enough > 1, F.sequence(F.lit(1).cast("long"), enough.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * x * F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    total = F.when(terms >= 1, F.aggregate(ks, start, step, lambda a: a["sum"])).otherwise(0.0)
    inside = F.when(even, r * total).otherwise(2 / math.pi * (F.asin(r) + r * F.sqrt(x) * total))
    # The normal distribution by a rational approximation of erfc (fixed values; off by less than 1.5e-7).
    z = r * F.sqrt(f / F.greatest(x, F.lit(1e-300))) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    p = F.when(n >= NORMAL_FROM, tail).otherwise(F.greatest(F.lit(0.0), 1 - inside))
    return F.when(rho.isNull() | (n < 4), F.lit(None).cast("double")).when(r >= 1, 0.0).otherwise(p)


def correlations(pairs: DataFrame, keys: tuple[str, ...], level: float = 0.05) -> DataFrame:
    """(*keys, n, rho, p) of pairs(*keys, x, y), a row per language: Spearman's rho with mid-ranks over pairs where both are finite; null under four."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = pairs.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    good = rows.where(finite("x") & finite("y"))

    def mid(c: str) -> Column:  # a group has a row per language
        w = Window.partitionBy(*keys)
        return (F.rank().over(w.orderBy(c)) + F.count("*").over(w) + 1 - F.rank().over(w.orderBy(F.desc(c)))) / 2

    ranked = good.select(*keys, mid("x").alias("rx"), mid("y").alias("ry"))
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), (F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))).alias("rho"))
    every = pairs.select(*keys).distinct().join(got, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rho = F.when(F.col("n") >= 4, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.round("rho", 12))))
    return every.select(*keys, "n", F.round(rho, 8).alias("rho"), F.round(student_p(rho, F.col("n")), 8).alias("p"))


def evaluated(profile: DataFrame, fits: DataFrame, primary: str, frontier: tuple[str, ...], fair: str, level: float = 0.05) -> DataFrame:
    """(hypothesis, tokenizer, x, y, n, rho, p, spread, supported).

    profile(lang, share_of_vocab, share_mass_not_in_control, share_fragment_mass); fits(lang, tokenizer, unit, ks_zipf, log_effective_vocab) where unit is token,
    word or grapheme. H1: share of the vocabulary against the mass that the control lacks. H2: share (and fragments) against deviation. H3: share against the token's
    deviation less the baseline's. All of these for the `primary` tokenizer; a negative rho with p below `level` supports them. H4: `fair` has a smaller spread (sample
    standard deviation) of ks_zipf over languages than each of `frontier`.
    """
    share = F.col("share_of_vocab")
    row = lambda df, h, x, xc, y, yc: df.select(F.lit(h).alias("hypothesis"), F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.col(xc).alias("x") if isinstance(xc, str) else xc.alias("x"), F.col(yc).alias("y"))
    mine = fits.where(F.col("tokenizer") == primary)
    token = mine.where("unit = 'token'").join(profile, "lang")
    pairs = [row(profile, "H1", "share_of_vocab", share, "share_mass_not_in_control", "share_mass_not_in_control")]
    pairs += [row(token, "H2", "share_of_vocab", share, m, m) for m in ("ks_zipf", "log_effective_vocab")]
    pairs += [row(token, "H2", "share_fragment_mass", "share_fragment_mass", "ks_zipf", "ks_zipf")]
    for baseline in ("word", "grapheme"):
        base = mine.where(F.col("unit") == baseline).select("lang", *(F.col(m).alias(f"_{m}") for m in ("ks_zipf", "log_effective_vocab")))
        both = token.join(base, "lang")
        pairs += [row(both.withColumn("d", F.col(m) - F.col(f"_{m}")), "H3", "share_of_vocab", share, f"{m} less that of {baseline}", "d") for m in ("ks_zipf", "log_effective_vocab")]
    long = pairs[0]
    for p in pairs[1:]:
        long = long.unionByName(p)
    got = correlations(long, ("hypothesis", "x_name", "y_name"))
    supported = F.coalesce((F.col("rho") < 0) & (F.col("p") < level), F.lit(False))
    first = got.select("hypothesis", F.lit(primary).alias("tokenizer"), F.col("x_name").alias("x"), F.col("y_name").alias("y"), "n", "rho", "p", F.lit(None).cast("double").alias("spread"), supported.alias("supported"))
    spreads = fits.where("unit = 'token'").groupBy("tokenizer").agg(F.count("ks_zipf").alias("n"), F.stddev_samp("ks_zipf").alias("spread"))
    least = F.min(F.when(F.col("tokenizer").isin(*frontier), F.col("spread"))).over(Window.partitionBy())  # a row per tokenizer
    second = spreads.withColumn("least", least).select(
        F.lit("H4").alias("hypothesis"), "tokenizer", F.lit("language").alias("x"), F.lit("ks_zipf").alias("y"), "n", F.lit(None).cast("double").alias("rho"), F.lit(None).cast("double").alias("p"),
        F.round("spread", 6).alias("spread"), F.when(F.col("tokenizer") == fair, F.coalesce(F.col("spread") < F.col("least"), F.lit(False))).alias("supported"),
    )
    return first.unionByName(second)
