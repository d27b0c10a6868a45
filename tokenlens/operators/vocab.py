"""Vocabulary profile: active vocabulary, exclusivity, script allocation, byte fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U

NO_LETTER, MIXED = "<no_letter>", "<mixed_script>"

def exclusivity(counts: DataFrame, control: str = "en", rare_max: int = 1) -> DataFrame:
    """Per language: types (and mass) that the control lacks, and that at most `rare_max` languages reach."""
    reach = counts.groupBy("unit").agg(F.countDistinct("lang").alias("reached"), F.max(F.col("lang") == control).alias("in_control"))
    rows = counts.join(reach, "unit")
    out, rare = ~F.col("in_control"), F.col("reached") <= rare_max
    n = lambda c: F.count(F.when(c, 1))
    mass = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0))
    return rows.groupBy("lang").agg(F.count("*").alias("n_types"), F.sum("cnt").alias("n_tokens"), n(out).alias("n_not_in_control"), n(rare).alias("n_rare"), F.round(n(out) / F.count("*"), 9).alias("share_not_in_control"), F.round(n(rare) / F.count("*"), 9).alias("share_rare"), F.round(mass(out) / F.sum("cnt"), 9).alias("share_mass_not_in_control"), F.round(mass(rare) / F.sum("cnt"), 9).alias("share_mass_rare"))


def found_scripts(units: DataFrame) -> list[str]:
    """The scripts that occur in units(unit), in order: a range join of the distinct characters, by buckets of 256 code points.

    There are at most as many characters as Unicode has, and as many scripts as it names.
    """
    ranges = units.sparkSession.createDataFrame(list(U.script_ranges()), "first int, last int, script string")
    ranges = ranges.withColumn("bucket", F.explode(F.sequence(F.shiftright("first", 8), F.shiftright("last", 8))))
    chars = units.select(F.explode(F.array_distinct(F.split("unit", ""))).alias("c")).where("c <> ''").distinct().withColumn("at", F.ascii("c"))
    met = chars.withColumn("bucket", F.shiftright("at", 8)).join(F.broadcast(ranges), "bucket").where("at BETWEEN first AND last")  # about 1,500 rows
    return sorted(r.script for r in met.select("script").distinct().collect())


def scripts_of(token: Column, names: list[str]) -> Column:
    """Those of the scripts `names` that a token's characters are of, in order; digits, punctuation and shared marks are of none."""
    if not names:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(token.rlike(U.of_script(s)), F.lit(s)) for s in names)))


def script_bucket(token: Column, names: list[str]) -> Column:
    """The one script of a token, NO_LETTER without any, or MIXED; `names` are the scripts to look for, see found_scripts()."""
    found = scripts_of(token, names)
    return F.when(F.size(found) > 1, MIXED).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(NO_LETTER)


def script_allocation(counts: DataFrame) -> DataFrame:
    types = counts.groupBy("unit").agg(F.sum("cnt").alias("cnt"))
    return types.groupBy(script_bucket(F.col("unit"), found_scripts(counts)).alias("bucket")).agg(F.count("*").alias("n_types"), F.sum("cnt").alias("n_tokens"))


def fragments(tokens: DataFrame) -> DataFrame:
    """Blocks that byte fragments tokens(raw binary) can begin, by largest overlap; a range join with the fixed block list."""
    blocks = tokens.sparkSession.createDataFrame(list(U.block_ranges()), "block string, block_low long, block_high long")
    windows = tokens.select("raw", F.explode(F.array(T.utf8_window(F.col("raw")))).alias("w")).where("w IS NOT NULL")
    met = windows.join(F.broadcast(blocks), (F.col("w.low") <= F.col("block_high")) & (F.col("block_low") <= F.col("w.high")))  # a row per block
    overlap = F.least("w.high", "block_high") - F.greatest("w.low", "block_low") + 1
    certain = (F.col("w.low") >= F.col("block_low")) & (F.col("w.high") <= F.col("block_high"))
    return met.groupBy("raw").agg(F.max_by("block", F.struct(overlap, "block")).alias("block"), F.max(certain).alias("certain"))


def mixed_scripts(tokens: DataFrame) -> DataFrame:
    """(combination, n_types) of tokens(unit) whose characters are of several scripts, the scripts in order joined by +."""
    units = tokens.select("unit").distinct()
    rows = units.withColumn("found", scripts_of(F.col("unit"), found_scripts(units))).where(F.size("found") > 1)
    return rows.groupBy(F.array_join("found", "+").alias("combination")).agg(F.count("*").alias("n_types")).orderBy(F.desc("n_types"), "combination")


def allocation_shares(counts: DataFrame) -> DataFrame:
    """script_allocation() with each bucket's share of types, the largest first."""
    rows = script_allocation(counts)
    every = Window.partitionBy()  # a row per script
    return rows.withColumn("share", F.round(F.col("n_types") / F.sum("n_types").over(every), 9)).orderBy(F.desc("n_types"), "bucket")


def token_buckets(tokens: DataFrame) -> DataFrame:
    """tokens(token_id, raw binary) with `bucket`: the script of whole texts, <byte_fragment> for what is no whole UTF-8."""
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    names = found_scripts(tokens.select(text.alias("unit")).where("unit IS NOT NULL"))
    return tokens.withColumn("bucket", F.when(text.isNull(), "<byte_fragment>").otherwise(script_bucket(text, names)))


def fragment_blocks(tokens: DataFrame) -> DataFrame:
    """(block, n_tokens, n_certain): byte fragments of tokens(token_id, raw binary) by the block that they most likely begin; null where none can be told."""
    broken = tokens.where(F.try_validate_utf8(F.col("raw").cast("string")).isNull())
    rows = broken.join(fragments(broken.select("raw").distinct()), "raw", "left")
    return rows.groupBy("block").agg(F.count("*").alias("n_tokens"), F.count(F.when(F.col("certain"), 1)).alias("n_certain"))


def fragment_usage(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per language of counts(lang, token_id, cnt): types and mass that are byte fragments of tokens(token_id, raw binary)."""
    broken = tokens.where(F.try_validate_utf8(F.col("raw").cast("string")).isNull()).select("token_id", F.lit(1).alias("broken"))
    rows = counts.join(broken, "token_id", "left")
    hit = F.col("broken").isNotNull()
    return rows.groupBy("lang").agg(
        F.count(F.when(hit, 1)).alias("n_fragment_types"), F.sum(F.when(hit, F.col("cnt")).otherwise(0)).alias("n_fragment_tokens"),
        F.round(F.count(F.when(hit, 1)) / F.count("*"), 9).alias("share_types"), F.round(F.sum(F.when(hit, F.col("cnt")).otherwise(0)) / F.sum("cnt"), 9).alias("share_mass"),
    )
