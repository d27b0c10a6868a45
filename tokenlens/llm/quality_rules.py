"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Everything is DataFrame expressions: per-text features are array functions inside one row, the
corpus enters only as counts of vote patterns (at most 3 ** rules rows), and each EM step is one
aggregate over that table. Rules see a fault from several sides, so that the data tell which of them agree. EM alone sets how often
good and bad texts get each outcome of a rule, and the share of good texts; START and PRIOR_WEIGHT only smooth. Which
of the two classes is called good is settled last: that where rules vote bad less often.

Defined cases: a null text is an empty one; no words means base_failed; repeated rows and ties are
scored alike, row by row; very long texts are whole; an empty table gives an empty result; other columns are kept by
filter_documents(), whatever their names, and ignored otherwise.
8-word windows are compared by a 64-bit hash of eight 64-bit word hashes, within one text only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, stored, table, words_column

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
EM_STEPS, PRIOR_WEIGHT, PRIOR = 60, 20.0, 0.8
KEEP_AT = 0.5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_stutter", "n_plain_words", "n_letters", "n_types")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row`, a struct of all columns of `docs`, and `f`, a struct of FEATURES."""
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    has_word = lambda line: F.trim(line, F.lit(SPACES)) != ""
    rows = docs.withColumn("_words", words_column(t)).withColumn("_lines", F.filter(F.split(t, "\n"), has_word))
    rows = rows.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hash")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.slice("_hash", i, WINDOW))))
    # Only texts with a repeated window pay for the sort that finds where the repeats are.
    numbered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), numbered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    rows = rows.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    symbols = sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    values = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": symbols,
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_lines"),
        "n_stutter": F.size(F.filter("_hash", lambda h, i: h == F.get("_hash", i - 1))),
        "n_ended": F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike("[.!?:;\"')]$"))),
        "n_plain_words": F.size(F.filter("_words", lambda w: w.rlike(r"^\p{L}+[.,;:!?]?$"))),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_types": F.size(F.array_distinct("_hash")),
    }
    return rows.withColumn("_f", F.struct(*(v.cast("long").alias(k) for k, v in values.items()))).select("row", F.col("_f").alias("f"))


def base_failed(f: str = "f") -> Column:
    x = F.col(f)
    return (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEATED_PERCENT * x["n_words"])


def votes(f: str = "f") -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains: between the two limits, or where a text is too short for the rule."""
    x = F.col(f)
    share = lambda a, b: x[a] / F.greatest(x[b], F.lit(1))
    low = lambda value, good, bad: F.when(value > bad, -1).when(value <= good, 1).otherwise(0)
    high = lambda value, good, bad: F.when(value < bad, -1).when(value >= good, 1).otherwise(0)
    return {
        "length": high(x["n_words"], 50, 5),
        "symbols": low(share("n_symbols", "word_chars"), 0.005, 0.03),
        "plain_words": high(share("n_plain_words", "n_words"), 0.9, 0.7),
        "letters": high(share("n_letters", "word_chars"), 0.93, 0.8),
        "repeats": low(share("n_repeat_words", "n_words"), 0.05, 0.25),
        # Long texts use their words again: the share of distinct ones is held against that of MIN_WORDS to 1,000 words.
        "variety": F.when(x["n_words"] < MIN_WORDS, 0).otherwise(high(share("n_types", "n_words") * F.greatest(F.lit(1.0), F.sqrt(x["n_words"] / 1000)), 0.5, 0.35)),
        "stutter": low(share("n_stutter", "n_words"), 0.05, 0.2),
        "dup_lines": F.when(x["n_lines"] < 3, 0).otherwise(low(share("n_dup_lines", "n_lines"), 0.1, 0.4)),
        "endings": high(share("n_ended", "n_lines"), 0.7, 0.1),
    }


def _log_odds(model: dict, vote: dict[str, Column]) -> Column:
    """log P(good | votes) - log P(bad | votes), votes being independent within a class."""
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k, v in vote.items():
        weigh = {o: math.log(g / b) for o, (g, b) in model["rates"][k].items()}
        total = total + F.when(v == -1, weigh[-1]).when(v == 1, weigh[1]).otherwise(weigh[0])
    return total


def posterior(model: dict, vote: dict[str, Column]) -> Column:
    return 1 / (1 + F.exp(-_log_odds(model, vote)))


#: Rates of a rule's outcomes among good and among bad texts before EM; they count as PRIOR_WEIGHT texts of each class.
START = {-1: (0.01, 0.25), 0: (0.29, 0.35), 1: (0.70, 0.40)}


def fit(featured: DataFrame, steps: int = EM_STEPS) -> dict:
    """Prior and, per rule, how often good and bad texts get each outcome, by EM over all rows' vote patterns."""
    names = list(votes())
    patterns = checkpointed(featured.select(*(v.alias(k) for k, v in votes().items())).groupBy(*names).agg(F.count("*").alias("n"))).coalesce(1)
    model = {"prior": PRIOR, "rates": {k: dict(START) for k in names}}
    for _ in range(steps):
        p = F.col("p")
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * p).alias("good")]
        for k in names:
            for o in START:
                hit = F.when(F.col(k) == o, F.col("n")).otherwise(0)
                sums += [F.sum(hit).alias(f"{k}{o}"), F.sum(hit * p).alias(f"{k}{o}g")]
        got = patterns.withColumn("p", posterior(model, {k: F.col(k) for k in names})).agg(*sums).first()
        if not got["all"]:
            break
        good, every = got["good"], got["all"]
        rates = {}
        for k in names:
            rates[k] = {}
            for o, (g, b) in START.items():
                hit, hit_good = got[f"{k}{o}"], got[f"{k}{o}g"]
                rates[k][o] = ((hit_good + PRIOR_WEIGHT * g) / (good + PRIOR_WEIGHT), (hit - hit_good + PRIOR_WEIGHT * b) / (every - good + PRIOR_WEIGHT))
        prior = (good + PRIOR * PRIOR_WEIGHT) / (every + PRIOR_WEIGHT)
        moved = max([abs(prior - model["prior"])] + [abs(x - y) for k in names for o in START for x, y in zip(rates[k][o], model["rates"][k][o])])
        model = {"prior": prior, "rates": rates}
        if moved < 1e-4:
            break
    if sum(r[-1][0] - r[-1][1] for r in model["rates"].values()) > 0:
        model = {"prior": 1 - model["prior"], "rates": {k: {o: x[::-1] for o, x in r.items()} for k, r in model["rates"].items()}}
    return model


def fitted_rates(spark: SparkSession, model: dict) -> DataFrame:
    """(rule, outcome, good, bad, weight): what EM has found; weight is the log of good to bad."""
    rows = [(k, o, g, b, math.log(g / b)) for k, r in model["rates"].items() for o, (g, b) in r.items()]
    return spark.createDataFrame(rows, "rule string, outcome int, good double, bad double, weight double")


def judge(featured: DataFrame, model: dict) -> DataFrame:
    """Adds `base_failed`, `quality` (posterior) and `kept`."""
    p = posterior(model, votes())
    return featured.withColumn("base_failed", base_failed()).withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (all its columns) whose verdict is to keep. Rows are stored with their features, so that
    these are computed once and the optimizer doesn't copy their expressions into every rule; no text is shuffled."""
    featured = stored(features(docs))
    return judge(featured, fit(featured)).where("kept").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = checkpointed(features(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "f"))
    judged = judge(featured, fit(featured))
    return judged.select("doc_id", *(F.col("f")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "quality")
