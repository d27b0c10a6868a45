"""Metrics under a trained vocabulary: every distinct pre-token is encoded once, and joined with its occurrences.

The dictionary has a row for each pre-token of the texts, and for each word behind a blank that is one pre-token there. It is made by
one pass over distinct words, whatever the corpus, and joined by the word; what follows are sums over (language, word, count) rows. So
the vocabulary goes to the tasks that make the dictionary, and nothing but word counts is shuffled.

Texts are in normal form; a null text has no words; a null language is a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored
from .metrics import REFERENCE, WITHOUT_BLANKS, ratio
from .vocabulary import Counted, Encoder, Merge, vocabulary


def dictionary(words: DataFrame, merges: list[Merge], alphabet: list[str] | None = None) -> DataFrame:
    """(word, ids array<int>) for the distinct words(word)."""
    tokens = [bytes.fromhex(t) for t in vocabulary(merges, alphabet)]
    pairs, graphemes = [(bytes.fromhex(m[0]), bytes.fromhex(m[1])) for m in merges], alphabet is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pairs, tokens, graphemes)
        for batch in batches:
            ids = [encoder.encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids array<int>")


def encoded_pieces(rows: DataFrame, pairs: list[tuple[bytes, bytes]], ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, lang, ids array<int>) of rows(doc_id, lang, words array<string>): each distinct word is encoded once and joined back."""
    spread = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "words"))
    each = spread.select("row", F.posexplode("words").alias("place", "word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pairs, ids)
        for batch in batches:
            got = [encoder.encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(got, pa.list_(pa.int32()))], ["word", "ids"])

    entries = each.select("word").distinct().mapInArrow(run, "word string, ids array<int>")
    joined = each.join(entries, "word").groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    return spread.select("row", "doc_id", "lang").join(joined, "row", "left").select("doc_id", "lang", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def tokens_of(spark: SparkSession, merges: list[Merge], alphabet: list[str] | None = None) -> DataFrame:
    """(token_id, raw binary, surface_length): a row per token; the length is 0 for blanks and for what is not whole characters."""
    rows = spark.createDataFrame([(k, bytearray.fromhex(t)) for k, t in enumerate(vocabulary(merges, alphabet))], "token_id int, raw binary")
    surface = F.coalesce(F.try_validate_utf8(F.col("raw").cast("string")), F.lit("�"))
    return rows.withColumn("surface_length", T.surface_length(T.normal(surface)))


class Encoded:
    """docs(lang, text) under a vocabulary. texts(lang, word, cnt, ids): pre-tokens; words(lang, word, cnt, single): words between blanks, `single` if one token.

    Docs that are Counted already, and those of another arm, see under(), are not counted again. Each table is made when it is first asked for.
    """

    def __init__(self, docs: DataFrame | Counted, merges: list[Merge], alphabet: list[str] | None = None):
        self.counted = docs if isinstance(docs, Counted) else Counted(docs)
        self.spark, self.merges, self.alphabet = self.counted.docs.sparkSession, merges, alphabet

    def under(self, merges: list[Merge], alphabet: list[str] | None = None) -> Encoded:
        """The same texts under another vocabulary."""
        return Encoded(self.counted, merges, alphabet)

    @cached_property
    def texts(self) -> DataFrame:
        return self.counted.texts.join(stored(dictionary(self.counted.texts, self.merges, self.alphabet)), "word")

    @cached_property
    def words(self) -> DataFrame:
        piece = F.concat(F.lit(" "), "word")
        pieces = self.counted.words.select("word").distinct().select(piece.alias("word")).where(F.size(T.pretokens(F.col("word"))) == 1)
        one = stored(dictionary(pieces, self.merges, self.alphabet).where(F.size("ids") == 1).select(F.expr("substring(word, 2)").alias("word"), F.lit(True).alias("one")))
        return self.counted.words.join(one, "word", "left").select("lang", "word", "cnt", F.coalesce("one", F.lit(False)).alias("single"))

    def tokens(self) -> DataFrame:
        return tokens_of(self.spark, self.merges, self.alphabet)

    def counts(self) -> DataFrame:
        """(lang, token_id, cnt): the active vocabulary of each language."""
        return self.texts.select("lang", "cnt", F.explode("ids").alias("token_id")).groupBy("lang", "token_id").agg(F.sum("cnt").alias("cnt"))

    def retention(self) -> DataFrame:
        """STFR: tokens of one visible character; STRR: words that are one token behind a blank; coverage: the same of distinct words.

        STRR is null for languages without blanks between words.
        """
        shreds = self.counts().join(self.tokens().select("token_id", (F.col("surface_length") == 1).alias("shred")), "token_id").groupBy("lang")
        shreds = shreds.agg(F.sum("cnt").alias("n_tokens"), F.sum(F.when(F.col("shred"), F.col("cnt")).otherwise(0)).alias("n_shreds"))
        kept = self.words.groupBy("lang").agg(F.sum("cnt").alias("n_words"), F.sum(F.when(F.col("single"), F.col("cnt")).otherwise(0)).alias("n_kept"), F.count("*").alias("n_types"), F.count(F.when(F.col("single"), 1)).alias("n_types_kept"))
        rows = kept.join(shreds.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
        strr = F.when(~F.coalesce(F.col("lang").isin(*WITHOUT_BLANKS), F.lit(False)), ratio("n_kept", "n_words"))
        return rows.select("lang", "n_words", "n_kept", "n_tokens", "n_shreds", strr.alias("strr"), ratio("n_shreds", "n_tokens").alias("stfr"), ratio("n_types_kept", "n_types").alias("word_coverage"))


def efficiency(docs: DataFrame, arms: dict[str, Encoded], reference: str = REFERENCE) -> DataFrame:
    """Like metrics.efficiency(), a row per (arm, language); tokens per character as well for languages without blanks. No reference row is an error."""
    counted = next((arm.counted for arm in arms.values() if arm.counted.docs is docs), None) or Counted(docs)
    sums = counted.words.groupBy(F.col("lang").alias("with")).agg(F.sum("cnt").alias("n_words"), F.sum(F.col("cnt") * F.length("word")).alias("n_chars"))
    sums = docs.groupBy("lang").agg(F.count("*").alias("n_sentences")).join(sums, F.col("lang").eqNullSafe(F.col("with")), "left")
    sums = sums.select("lang", "n_sentences", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_chars")))
    ctc = None
    for name, arm in arms.items():
        one = arm.texts.groupBy(F.col("lang").alias("of")).agg(F.sum(F.col("cnt") * F.size("ids")).alias("ctc")).withColumn("tokenizer", F.lit(name))
        ctc = one if ctc is None else ctc.union(one)
    rows = stored(sums.join(ctc, F.col("lang").eqNullSafe(F.col("of"))).drop("of"))  # a row per arm and language
    if rows.where(F.col("lang") == reference).select("tokenizer").distinct().count() < len(arms):
        raise ValueError(f"no rows for: {reference}")
    base = F.max(F.when(F.col("lang") == reference, F.col("ctc"))).over(Window.partitionBy("tokenizer"))
    return rows.select(
        "tokenizer", "lang", "n_sentences", "ctc", "n_words", "n_chars", ratio("ctc", "n_words").alias("fertility"), ratio("n_chars", "ctc").alias("chars_per_token"),
        F.when(F.col("lang").isin(*WITHOUT_BLANKS), ratio("ctc", "n_chars")).alias("fertility_per_char"), F.round(F.col("ctc") / base, 9).alias("token_premium"),
    )


METRICS = ("fertility", "chars_per_token", "token_premium", "stfr", "strr")


def measured(docs: DataFrame, arms: dict[str, Encoded], reference: str = REFERENCE) -> DataFrame:
    """(tokenizer, lang, *METRICS, tokens_per_line): efficiency() and retention of each arm side by side."""
    kept = None
    for name, arm in arms.items():
        one = arm.retention().select(F.lit(name).alias("arm"), F.col("lang").alias("of"), "stfr", "strr")
        kept = one if kept is None else kept.union(one)
    rows = efficiency(docs, arms, reference).join(kept, (F.col("tokenizer") == F.col("arm")) & F.col("lang").eqNullSafe(F.col("of")))
    return rows.select("tokenizer", "lang", *METRICS, ratio("ctc", "n_sentences").alias("tokens_per_line"))


def arms_compared(rows: DataFrame, baseline: str, other: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(lang, metric, baseline, compare, delta, pct_change) of measured() rows: a row per language and metric, their means over languages as `macro`,
    and the Gini index of tokens per line.

    An arm without a row, or without a language that the other has, is an error: a mean over other languages is no comparison.
    """
    both = rows.where(F.col("tokenizer").isin(baseline, other))
    langs = {t: {r.lang for r in both.where(F.col("tokenizer") == t).select("lang").collect()} for t in (baseline, other)}  # a row per language
    if not langs[baseline] or langs[baseline] != langs[other]:
        differ = sorted(map(str, langs[baseline] ^ langs[other]))
        raise ValueError(f"{baseline} and {other} have to have the same languages" + (f", but not both have {', '.join(differ)}" if differ else ""))
    long = both.unpivot(["tokenizer", "lang"], list(metrics), "metric", "value")
    of = lambda t: F.max(F.when(F.col("tokenizer") == t, F.col("value")))
    each = long.groupBy("lang", "metric").agg(of(baseline).alias("b"), of(other).alias("c"))
    macro = each.groupBy("metric").agg(F.avg("b").alias("b"), F.avg("c").alias("c")).select(F.lit("macro").alias("lang"), "metric", "b", "c")
    w = Window.partitionBy("tokenizer")  # a row per language
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("tokens_per_line"))
    uneven = both.select("tokenizer", "tokens_per_line", n.alias("n"), i.alias("i")).groupBy("tokenizer").agg(
        ((F.max("n") + 1 - 2 * F.sum((F.col("n") + 1 - F.col("i")) * F.col("tokens_per_line")) / F.nullif(F.sum("tokens_per_line"), F.lit(0.0))) / F.max("n")).alias("value")
    )
    gini = uneven.agg(of(baseline).alias("b"), of(other).alias("c")).select(F.lit("macro").alias("lang"), F.lit("gini_tokens_per_line").alias("metric"), "b", "c")
    every = each.select("lang", "metric", "b", "c").union(macro).union(gini)
    pct = 100 * (F.col("c") - F.col("b")) / F.nullif(F.col("b"), F.lit(0.0))
    return every.select("lang", "metric", F.round("b", 8).alias("baseline"), F.round("c", 8).alias("compare"), F.round(F.col("c") - F.col("b"), 8).alias("delta"), F.round(pct, 6).alias("pct_change"))
