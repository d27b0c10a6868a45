"""Unit frequencies against Zipf's law: entropy family, KS, slopes, Zipf-Mandelbrot fits, bootstraps, rank correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

UNITS = {"word": T.words, "pretok": T.pretokens}
RENYI = 2.5
#: Ranks of a block of types of one count that one row stands for.
PIECE = 1 << 16


def unit_counts(docs: DataFrame, unit: str) -> DataFrame:
    """(lang, unit, cnt): partial counts are combined before the shuffle."""
    return docs.select("lang", F.explode(UNITS[unit](T.normal(F.coalesce("text", F.lit(""))))).alias("unit")).groupBy("lang", "unit").agg(F.count("*").alias("cnt"))


def types_by_count(counts: DataFrame) -> DataFrame:
    """(lang, cnt, types) of counts(lang, cnt), a row per type; rows that hold `types` already are left as they are."""
    return counts.select("lang", "cnt", "types") if "types" in counts.columns else counts.groupBy("lang", "cnt").agg(F.count("*").alias("types"))


def count_blocks(counts: DataFrame) -> DataFrame:
    """(lang, cnt, types, first_rank): all statistics need only how many types have each count.

    A language has at most sqrt(2 * tokens) distinct counts, so windows over them stay small whatever the corpus.
    """
    blocks = types_by_count(counts)
    before = Window.partitionBy("lang").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("first_rank", F.coalesce(F.sum("types").over(before), F.lit(0)) + 1)


def ranked(counts: DataFrame) -> DataFrame:
    """(lang, rank, cnt): one row per type, from the blocks; ties don't matter to any statistic."""
    blocks = count_blocks(counts)
    return blocks.select("lang", "cnt", F.explode(F.sequence("first_rank", F.col("first_rank") + F.col("types") - 1)).alias("rank")).select("lang", "rank", "cnt")


def entropy(counts: DataFrame) -> DataFrame:
    by = types_by_count(counts)
    blocks = by.join(by.groupBy("lang").agg(F.sum(F.col("cnt") * F.col("types")).alias("n")), "lang")
    p = F.col("cnt") / F.col("n")
    got = blocks.groupBy("lang").agg(F.max("n").alias("n_tokens"), F.sum("types").alias("n_types"), F.sum(-F.col("types") * p * F.log(p)).alias("h"), F.sum(F.col("types") * F.pow(p, F.lit(RENYI))).alias("q"))
    h, v = F.col("h"), F.col("n_types")
    renyi = F.log("q") / (1 - RENYI)
    return got.select(
        "lang", "n_tokens", "n_types", F.round(h, 8).alias("entropy_nats"), F.round(h / math.log(2), 8).alias("entropy_bits"),
        F.round(F.when(v > 1, h / F.log(v)), 8).alias("entropy_norm"), F.round(F.exp(h), 4).alias("effective_vocab"),
        F.round(renyi, 8).alias("renyi_entropy_nats"), F.round(F.when(v > 1, renyi / F.log(v)), 8).alias("renyi_efficiency_active"),
    )


def harmonic(n):
    """1 + 1/2 + ... + 1/n as a column: exact below 30, by its expansion (off by less than 1e-12) from there on; 0 for 0."""
    n = n.cast("double")
    far = F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n**4) - 1 / (252 * n**6)
    sums = F.array(*(F.lit(sum(1 / k for k in range(1, m + 1))) for m in range(31)))
    return F.when(n <= 30, F.get(sums, F.least(n, F.lit(30.0)).cast("int"))).otherwise(far)


def against_zipf(counts: DataFrame) -> DataFrame:
    """KS distance from pure Zipf (exponent 1), log-log RMSE from it, and the OLS slope, over all ranks, from blocks of types of one count.

    Within a block the empirical distribution rises by equal steps and pure Zipf's by ever smaller ones, so their difference is largest
    at an end of the block, or where a step of the one equals a step of the other; these ranks are looked at. Sums over the ranks of a block
    are differences of sums up to its ends. Windows run over a language's blocks, at most sqrt(2 * tokens) of them.
    """
    blocks = count_blocks(counts).withColumn("last", F.col("first_rank") + F.col("types") - 1)
    w = Window.partitionBy("lang")
    upto = w.orderBy("first_rank").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("cnt") * F.col("types")
    rows = blocks.withColumn("n", F.sum(mass).over(w)).withColumn("v", F.sum("types").over(w)).withColumn("before", F.coalesce(F.sum(mass).over(upto), F.lit(0)))
    # Long blocks go in pieces, each a row.
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("types") - 1) / PIECE)))).withColumn("before", F.col("before") + F.col("piece") * PIECE * F.col("cnt"))
    rows = rows.withColumn("first_rank", F.col("first_rank") + F.col("piece") * PIECE).withColumn("last", F.least("last", F.col("first_rank") + PIECE - 1)).withColumn("types", F.col("last") - F.col("first_rank") + 1)
    rows = rows.withColumn("hv", harmonic(F.col("v")))
    turn = F.col("n") / (F.col("cnt") * F.col("hv"))  # where 1 / (rank * hv) falls below cnt / n
    ranks = F.transform(F.array(F.col("first_rank").cast("double"), F.col("last").cast("double"), F.floor(turn).cast("double"), F.floor(turn).cast("double") + 1, F.col("first_rank") - 1.0), lambda r: F.least(F.greatest(r, F.col("first_rank") - 1.0), F.col("last").cast("double")))
    rows = rows.withColumn("gaps", F.transform(ranks, lambda r: F.abs((F.col("before") + (r - F.col("first_rank") + 1) * F.col("cnt")) / F.col("n") - harmonic(r) / F.col("hv"))))
    rows = rows.withColumn("logs", F.aggregate(F.sequence("first_rank", "last"), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, r: F.struct((a["s"] + F.log(r)).alias("s"), (a["q"] + F.log(r) * F.log(r)).alias("q"))))
    k, s, q, c = F.col("types"), F.col("logs.s"), F.col("logs.q"), F.log("cnt")
    # ln p - ln z of a rank is ln(rank) + d, where d is the block's.
    d = c - F.log("n") + F.log("hv")
    got = rows.groupBy("lang").agg(
        F.max("v").alias("n_types"), F.max(F.array_max("gaps")).alias("ks"), F.sum(q + 2 * d * s + k * d * d).alias("sq"),
        F.sum(s).alias("sx"), F.sum(q).alias("sxx"), F.sum(k * c).alias("sy"), F.sum(c * s).alias("sxy"),
    )
    v = F.col("n_types")
    slope = (v * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(v * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return got.select("lang", "n_types", F.round("ks", 7).alias("ks_zipf"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("sq") / v)), 7).alias("loglog_rmse"), F.round(-slope, 7).alias("loglog_ols_slope"))


def matched_counts(docs: DataFrame, budget_share: float = 0.95, seed: str = "7") -> DataFrame:
    """Types and tokens of a draw of whole documents in hash order to one budget of words for all languages."""
    sized = docs.select("lang", "doc_id", F.size(T.words(F.coalesce("text", F.lit("")))).alias("n"), F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"))).alias("h"))
    budget = sized.groupBy("lang").agg(F.sum("n").alias("t")).agg(F.greatest(F.lit(1), F.floor(F.min("t") * budget_share)).alias("budget"))
    from .corpus import running_sum

    sized = sized.withColumn("order", F.conv(F.substring("h", 1, 8), 16, 10).cast("long"))
    run = running_sum(sized, "n", "order", ("lang",), ("h",))
    return run.crossJoin(F.broadcast(budget)).where(F.col("running") - F.col("n") < F.col("budget")).groupBy("lang").agg(  # one row
        F.count("*").alias("n_docs"), F.sum(F.least("n", F.col("budget") - (F.col("running") - F.col("n")))).cast("long").alias("n_units"))


def _midranks(rows: DataFrame, c: str, by: str, slices: int = 256) -> DataFrame:
    """(by, <c>, rank): the mid-rank of each distinct value, from counts per value and sums over slices of the values' range.

    Slices are cut at sampled quantiles of all rows, so no task holds a whole group however hot it is.
    """
    counted = rows.groupBy(by, c).agg(F.count("*").alias("k"))
    cuts = [x for x in dict.fromkeys(counted.approxQuantile(c, [i / slices for i in range(1, slices)], 1 / (4 * slices))) if x is not None]
    slice_ = F.size(F.filter(F.array(*(F.lit(float(x)) for x in cuts)), lambda x: x < F.col(c))) if cuts else F.lit(0)
    counted = counted.withColumn("_slice", slice_)
    sums = counted.groupBy(by, "_slice").agg(F.sum("k").alias("_sum"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # `slices` rows a group
    sums = sums.select(by, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("k").over(Window.partitionBy(by, "_slice").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("_inside", inside).join(sums, [by, "_slice"]).select(by, c, (F.col("_before") + F.col("_inside") + (F.col("k") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Spearman's rho of x and y in each `by` (not null), with mid-ranks; null under four pairs."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(by).isNotNull()).groupBy(by, x, y).agg(F.count("*").alias("k"))
    both = pairs.join(_midranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, by).withColumnRenamed("rank", "rx"), [by, x]).join(_midranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), y, by).withColumnRenamed("rank", "ry"), [by, y])
    k, rx, ry = F.col("k"), F.col("rx"), F.col("ry")
    got = both.groupBy(by).agg(F.sum("k").alias("n"), F.sum(k * rx).alias("sx"), F.sum(k * rx * rx).alias("sxx"), F.sum(k * ry).alias("sy"), F.sum(k * ry * ry).alias("syy"), F.sum(k * rx * ry).alias("sxy"))
    n, mean = F.col("n"), (F.col("n") + 1) / 2
    top = F.col("sxy") - n * mean * mean
    under = F.sqrt((F.col("sxx") - n * mean * mean) * (F.col("syy") - n * mean * mean))
    return got.select(by, "n", F.round(F.when(n >= 4, top / F.nullif(under, F.lit(0.0))), 8).alias("rho"))


def spread(rows: DataFrame, value: str, by: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(by).agg(F.round(F.stddev_samp(v), 8).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.max(v) - F.min(v), 8).alias("range"), F.count(v).alias("n"))


#: Ranks that a fit takes one by one; behind them it takes stretches whose ends differ by this share.
EXACT_RANKS, STRETCH = 1 << 16, 5e-4


def stretches(cnt: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle rank, ranks, count) of stretches of ranks of one count, for blocks of `types` types of each count, the largest first.

    A sum of a smooth function over the ranks of a stretch is their number times its value in the middle, up to a share of
    STRETCH ** 2 / 24, so that what a fit holds grows with the blocks and the logarithm of the types.
    """
    ends = np.cumsum(types.astype(np.int64))
    last = int(ends[-1])
    cuts = np.arange(1, min(last, EXACT_RANKS) + 1)
    if last > EXACT_RANKS:
        steps = int(math.log(last / EXACT_RANKS) / STRETCH) + 1
        cuts = np.concatenate([cuts, (EXACT_RANKS * np.exp(STRETCH * np.arange(1, steps + 1))).astype(np.int64), ends])
    cuts = np.unique(cuts[cuts <= last])
    n = np.diff(cuts, prepend=0)
    return cuts - (n - 1) / 2, n, cnt[np.searchsorted(ends, cuts)]


def fit_mandelbrot(cnt: np.ndarray, types: np.ndarray | None = None) -> dict:
    """Maximum likelihood (alpha, b): concave in alpha at fixed b (Newton), b by golden section on a log scale.

    `cnt` are the counts of all types, or, with `types`, the distinct counts and how many types have each.
    """
    cnt = np.asarray(cnt, float)
    types = np.ones(len(cnt), np.int64) if types is None else np.asarray(types, np.int64)
    order = np.argsort(-cnt, kind="stable")
    cnt, types = cnt[order], types[order]
    if types.sum() < 2:
        return {"alpha": math.nan, "b": math.nan, "nll": math.nan, "ks": math.nan, "converged": False, "at_bound": False}
    rank, n, cnt = stretches(cnt, types)
    mass = cnt * n
    total = mass.sum()

    def best(b: float) -> tuple[float, float]:
        logs = np.log(rank + b)
        mean, alpha = mass @ logs / total, 1.0
        for _ in range(60):
            x = -alpha * logs
            p = n * np.exp(x - x.max())
            p /= p.sum()
            first = p @ logs
            second = p @ (logs * logs) - first * first
            step = (first - mean) / max(second, 1e-12)
            alpha = min(50.0, max(0.0, alpha + max(-2.0, min(2.0, step))))
            if abs(step) < 1e-10:
                break
        x = -alpha * logs
        return float(mass @ x - total * (x.max() + np.log((n * np.exp(x - x.max())).sum()))), alpha

    grid = np.linspace(math.log(0.1), math.log(1e4 + 1), 24)
    values = [best(math.exp(g) - 1)[0] for g in grid]
    k = int(np.argmax(values))
    low, high, gold = grid[max(0, k - 1)], grid[min(23, k + 1)], (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, c = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, c) if best(math.exp(a) - 1)[0] >= best(math.exp(c) - 1)[0] else (a, high)
    b = math.exp((low + high) / 2) - 1
    value, alpha = best(b)
    p = n * (rank + b) ** -alpha
    ks = float(np.abs(np.cumsum(mass) / total - np.cumsum(p) / p.sum()).max())
    # On an end of the range of b, or of alpha, the maximum may lie beyond it.
    at_bound = bool(k in (0, 23) and (b - (math.exp(grid[0]) - 1) < 1e-3 or b > 0.999 * (math.exp(grid[-1]) - 1)) or not 1e-6 < alpha < 50)
    return {"alpha": alpha, "b": b, "nll": -value, "ks": ks, "converged": not at_bound, "at_bound": at_bound}


def fits(counts: DataFrame) -> DataFrame:
    """Zipf-Mandelbrot fit per language; what a group gathers is its distinct counts, at most sqrt(2 * tokens)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"lang": pdf.lang.iloc[0], **fit_mandelbrot(pdf.cnt.to_numpy(), pdf.types.to_numpy())}])

    return count_blocks(counts).groupBy("lang").applyInPandas(one, "lang string, alpha double, b double, nll double, ks double, converged boolean, at_bound boolean")


#: Types whose resampled counts a bootstrap holds at a time.
RESAMPLED = 1 << 20


def resampled_entropy(rng: np.random.Generator, cnt: np.ndarray, types: np.ndarray) -> float:
    """Entropy of a multinomial resample of all tokens, types taken RESAMPLED at a time: each part first gets its number of tokens."""
    total, left, mass_left, h = int((cnt * types).sum()), int((cnt * types).sum()), float((cnt * types).sum()), 0.0
    for c, k in zip(cnt.tolist(), types.tolist()):
        for a in range(0, k, RESAMPLED):
            m = min(RESAMPLED, k - a)
            own = int(rng.binomial(left, min(1.0, c * m / mass_left))) if mass_left > 0 else left
            left, mass_left = left - own, mass_left - c * m
            x = rng.multinomial(own, np.full(m, 1 / m)) if m > 1 else np.array([own])
            x = x[x > 0] / total
            h -= float((x * np.log(x)).sum())
    return h


def bootstrap_entropy(counts: DataFrame, draws: int = 50, seed: int = 77) -> DataFrame:
    """Mean, sd and 95 % interval of entropy over multinomial resamples, one task per (language, draw) on its distinct counts."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(pdf.draw.iloc[0]))
        pdf = pdf.sort_values("cnt", ascending=False)
        return pd.DataFrame([{"lang": pdf.lang.iloc[0], "draw": int(pdf.draw.iloc[0]), "h": resampled_entropy(rng, pdf.cnt.to_numpy(), pdf.types.to_numpy())}])

    each = count_blocks(counts).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = each.groupBy("lang", "draw").applyInPandas(one, "lang string, draw int, h double")
    return drawn.groupBy("lang").agg(F.avg("h").alias("mean"), F.stddev_samp("h").alias("sd"), F.percentile("h", F.lit(0.025)).alias("low"), F.percentile("h", F.lit(0.975)).alias("high"), F.count("*").alias("n"))
