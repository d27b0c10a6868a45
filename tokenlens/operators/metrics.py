"""How evenly tokenizers treat languages: fertility, premiums, retention, shredding, Gini, decision rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOKENIZERS = ("byte", "char", "grapheme", "word", "pretok")
REFERENCE = "en"


#: Tokenizers without a vocabulary, by name: how many tokens a text in normal form has. Trained ones come as spec columns, see efficiency().
BUILDERS = {
    "byte": F.octet_length,
    "char": F.length,
    "grapheme": T.n_graphemes,
    "word": lambda t: F.size(T.words(t)),
    "pretok": lambda t: F.size(T.pretokens(t)),
}


def tokenizers(include: tuple[str, ...] | None = None) -> dict:
    """The named tokenizers, all by default; an unknown name is a KeyError."""
    if unknown := sorted(set(include or ()) - BUILDERS.keys()):
        raise KeyError(f"no such tokenizer: {', '.join(unknown)}")
    return {k: BUILDERS[k] for k in (include or BUILDERS)}


def counted(docs: DataFrame, include: tuple[str, ...] = TOKENIZERS) -> DataFrame:
    """Per row of docs(lang, text), with texts in normal form: tokens under each tokenizer, words, characters; one pass, no shuffle."""
    rows = docs.select("lang", T.normal(F.coalesce("text", F.lit(""))).alias("text"))
    columns = {k: f(F.col("text")) for k, f in tokenizers(include).items()}
    # Split at blanks once, for both columns that count words.
    rows = rows.select("lang", *(v.alias(k) for k, v in columns.items() if k != "word"), F.size(T.words(F.col("text"))).alias("n_words"), T.n_chars(F.col("text")).alias("n_chars"))
    return rows.withColumn("word", F.col("n_words")) if "word" in columns else rows


def languages(docs: DataFrame, *wanted: str) -> DataFrame:
    """`docs`, or an error where one of the wanted languages has no row: a premium without its reference would silently be null."""
    missing = set(wanted) - {r.lang for r in docs.select("lang").distinct().where(F.col("lang").isin(*wanted)).collect()}
    if missing:
        raise ValueError(f"no rows for: {', '.join(sorted(missing))}")
    return docs


def efficiency(docs: DataFrame) -> DataFrame:
    """One row per (tokenizer, language), with the premium over the reference language; null without it, see languages()."""
    sums = counted(docs).groupBy("lang").agg(F.count("*").alias("n_sentences"), *(F.sum(c).alias(c) for c in (*TOKENIZERS, "n_words", "n_chars")))
    long = sums.unpivot(["lang", "n_sentences", "n_words", "n_chars"], list(TOKENIZERS), "tokenizer", "ctc")
    base = F.max(F.when(F.col("lang") == REFERENCE, F.col("ctc"))).over(Window.partitionBy("tokenizer"))
    return long.select(
        "tokenizer", "lang", "n_sentences", "ctc", "n_words", "n_chars",
        ratio("ctc", "n_words").alias("fertility"), ratio("n_chars", "ctc").alias("chars_per_token"),
        F.round(F.col("ctc") / F.nullif(base, F.lit(0)), 9).alias("token_premium"),
    )


def ratio(a: str, b: str) -> Column:
    return F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 9)


def retention(docs: DataFrame) -> DataFrame:
    """STRR and STFR under pre-tokens: words kept whole behind a blank, and pre-tokens of one visible character."""
    docs = docs.select("lang", T.normal(F.coalesce("text", F.lit(""))).alias("text"))
    words = docs.select("lang", F.explode(T.words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = words.withColumn("whole", F.size(T.pretokens(F.concat(F.lit(" "), "w"))) == 1)
    kept = words.groupBy("lang").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("n_kept"), F.count("*").alias("n_types"), F.count(F.when(F.col("whole"), 1)).alias("n_types_kept"))
    tokens = docs.select("lang", T.pretokens(F.coalesce("text", F.lit(""))).alias("p"))
    shreds = tokens.groupBy("lang").agg(F.sum(F.size("p")).alias("n_tokens"), F.sum(F.size(F.filter("p", lambda t: (F.length(t) == 1) & (T.surface_length(t) == 1)))).alias("n_shreds"))
    return kept.join(shreds, "lang").select("lang", "n_words", "n_kept", "n_tokens", "n_shreds", ratio("n_kept", "n_words").alias("strr"), ratio("n_shreds", "n_tokens").alias("stfr"), ratio("n_types_kept", "n_types").alias("word_coverage"))


def gini(metrics: DataFrame) -> DataFrame:
    """Gini index of tokens per line over the languages of each tokenizer."""
    per = metrics.select("tokenizer", (F.col("ctc") / F.col("n_sentences")).alias("v"))
    w = Window.partitionBy("tokenizer")
    ranked = per.withColumn("i", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count("*").over(w))
    sums = ranked.groupBy("tokenizer").agg(F.max("n").alias("n"), F.sum("v").alias("s"), F.sum((F.col("n") + 1 - F.col("i")) * F.col("v")).alias("m"))
    return sums.select("tokenizer", F.when(F.col("s") > 0, F.round((F.col("n") + 1 - 2 * F.col("m") / F.col("s")) / F.col("n"), 9)).alias("gini"))


#: Languages whose words have no blanks between them (fixed values): characters stand for words there.
WITHOUT_BLANKS = ("zho_Hans", "zho_Hant", "yue_Hant", "jpn_Jpan", "tha_Thai", "khm_Khmr", "lao_Laoo", "mya_Mymr", "bod_Tibt", "dzo_Tibt")


def decision(metrics: DataFrame, frontier: tuple[str, ...] = TOKENIZERS, complex_langs: tuple[str, ...] | None = None, premium: float = 2.0, ratio_: float = 2.0, least: int = 2) -> DataFrame:
    """Per language but the reference: is a fairer tokenizer worth it?

    Clause A: it pays `premium` or more under `least` of the `frontier` tokenizers. Clause B, for complex_langs (all by default):
    under some tokenizer its fertility, or its tokens per character where words have no blanks between them, is `ratio_` times
    the reference's or more. A tokenizer without a row of the reference decides nothing.
    """
    rate = F.when(F.col("lang").isin(*WITHOUT_BLANKS), F.col("ctc") / F.nullif(F.col("n_chars"), F.lit(0))).otherwise(F.col("fertility"))
    base = metrics.where(F.col("lang") == REFERENCE).select("tokenizer", F.col("fertility").alias("ref_word"), (F.col("ctc") / F.nullif(F.col("n_chars"), F.lit(0))).alias("ref_char"))
    others = metrics.where(F.col("lang") != REFERENCE).join(F.broadcast(base), "tokenizer", "left")  # a row per tokenizer
    ref = F.when(F.col("lang").isin(*WITHOUT_BLANKS), F.col("ref_char")).otherwise(F.col("ref_word"))
    hard = F.lit(True) if complex_langs is None else F.col("lang").isin(*complex_langs)
    got = others.groupBy("lang").agg(
        F.count(F.when((F.col("token_premium") >= premium) & F.col("tokenizer").isin(*frontier), 1)).alias("n_premium"),
        F.round(F.max(rate / F.nullif(ref, F.lit(0.0))), 9).alias("most_ratio"),
        F.coalesce(F.max(hard & (rate >= ratio_ * ref)), F.lit(False)).alias("clause_b"),
    )
    a = F.col("n_premium") >= least
    return got.select("lang", "n_premium", "most_ratio", a.alias("clause_a"), "clause_b", (a | F.col("clause_b")).alias("worth"))


def group_premiums(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean premium by (group, tokenizer), reference left out, and over all groups (ROLLUP); groups(lang, family) is small."""
    joined = metrics.where(F.col("lang") != REFERENCE).join(groups, "lang", "left")
    return joined.rollup("tokenizer", "family").agg(F.round(F.avg("token_premium"), 9).alias("mean_premium"), F.count("*").alias("n")).where("tokenizer IS NOT NULL").select("tokenizer", F.coalesce("family", F.lit("all")).alias("family"), "mean_premium", "n")


def wide(metrics: DataFrame, value: str) -> DataFrame:
    return metrics.groupBy("lang").pivot("tokenizer", list(TOKENIZERS)).agg(F.first(value))


def compare(metrics: DataFrame, baseline: str, other: str) -> DataFrame:
    """Macro A/B summary: mean of each metric over languages under two tokenizers, difference and per cent."""
    long = metrics.select("tokenizer", "lang", "fertility", "chars_per_token", "token_premium").unpivot(["tokenizer", "lang"], ["fertility", "chars_per_token", "token_premium"], "metric", "value")
    of = lambda t: F.avg(F.when(F.col("tokenizer") == t, F.col("value")))
    got = long.groupBy("metric").agg(of(baseline).alias("b"), of(other).alias("c"))
    return got.select("metric", F.round("b", 8).alias("baseline"), F.round("c", 8).alias("compare"), F.round(F.col("c") - F.col("b"), 8).alias("delta"), F.round(100 * (F.col("c") - F.col("b")) / F.nullif(F.col("b"), F.lit(0.0)), 6).alias("pct_change"))
