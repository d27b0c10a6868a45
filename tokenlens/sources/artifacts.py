"""Tokenizers trained elsewhere: vocab.json, merges.txt and the pre-tokenizer of tokenizer.json, as tables and columns.

Tokens are written in a printable character per byte; columns turn them back into bytes. A text is cut by the artifact's own pattern, as any other cuts
other words and changes what is measured: without one, loading is an error. Distinct pieces are encoded once, merges by rank, and joined with their occurrences.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: the pattern of byte-level pre-tokenizers that have none of their own.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTES = T.byte_characters()
#: Characters of bytes, and 256 others in the order of bytes, of which UTF-16 is 28 and the byte.
_CHARACTERS, _ORDERED = "".join(_BYTES[b] for b in range(256)), "".join(chr(0x2800 + b) for b in range(256))


def bytes_of(token: Column) -> Column:
    """The bytes of a token in byte characters; null if it holds another character."""
    ordered = F.translate(token, _CHARACTERS, _ORDERED)
    return F.when(ordered.rlike(r"^[\x{2800}-\x{28FF}]*$"), F.unhex(F.regexp_replace(F.hex(F.encode(ordered, "UTF-16BE")), "28(..)", "$1")))


def _whole(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    return rows[0].value


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    """(token, token_id, raw) of vocab.json; raw is null for special tokens with other characters."""
    rows = spark.read.text(f"{folder}/vocab.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "token_id"))
    return rows.withColumn("raw", bytes_of(F.col("token")))


def merges(spark: SparkSession, folder: str) -> DataFrame:
    """(rank, left, right) of merges.txt, in byte characters; blank lines and those that begin with # don't count."""
    lines = spark.read.text(f"{folder}/merges.txt", wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = lines.where("value <> '' AND NOT startswith(value, '#')").withColumn("rank", F.row_number().over(Window.orderBy("line")) - 1)  # one file, read as a whole
    at = F.instr("value", " ")
    return rows.select("rank", F.substring(F.col("value"), F.lit(1), at - 1).alias("left"), F.substring(F.col("value"), at + 1, F.length("value")).alias("right"))


def pattern(spark: SparkSession, folder: str) -> str | None:
    """The pattern that cuts texts into pieces, for Java; None where the artifact leaves texts whole. No or an unknown pre-tokenizer is an error."""
    try:
        saved = json.loads(_whole(spark, f"{folder}/tokenizer.json")).get("pre_tokenizer")
    except Exception as e:
        raise FileNotFoundError(f"{folder}/tokenizer.json has to tell how texts were cut") from e
    if not saved:
        raise ValueError(f"{folder}/tokenizer.json has no pre-tokenizer")
    steps = saved["pretokenizers"] if saved["type"] == "Sequence" else [saved]
    found = None
    for step in steps:
        if step["type"] == "ByteLevel":
            if step.get("add_prefix_space"):
                raise ValueError("a blank before each text is not supported")
            if step.get("use_regex", True):
                if found is not None:
                    raise ValueError("two patterns in a row are not supported")
                found = BYTE_LEVEL
        elif step["type"] == "Split" and step.get("behavior") == "Isolated" and not step.get("invert") and "Regex" in step["pattern"] and found is None:
            found = step["pattern"]["Regex"]
        else:
            raise ValueError(f"no such pre-tokenizer: {step['type']}")
    return found


def pieces(text: Column, cut: str | None) -> Column:
    """A text in pieces: matches of the pattern, and what is between them."""
    if cut is None:
        return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(text, F.lit(rf"(?U)(?:{cut})|(?:(?!(?:{cut}))[\s\S])+"), F.lit(0))


class Artifact:
    """A folder's tables and its encoder. The vocabulary and the merges are read into the driver, and go to the tasks that encode."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.pattern = spark, pattern(spark, folder)
        self.vocab, self.merges = vocab(spark, folder), merges(spark, folder)
        listed = {r.raw: r.token_id for r in self.vocab.where("raw IS NOT NULL").collect()}
        pairs = self.merges.select("rank", bytes_of(F.col("left")).alias("a"), bytes_of(F.col("right")).alias("b")).orderBy("rank").collect()
        self.ids = {bytes(k): v for k, v in listed.items()}
        self.pairs = [(bytes(r.a), bytes(r.b)) for r in pairs]

    def encoded(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, ids) of docs(doc_id, lang, text), in normal form and in the order of the text."""
        from ..operators.token_metrics import encoded_pieces

        rows = docs.select("doc_id", "lang", pieces(T.normal(F.coalesce("text", F.lit(""))), self.pattern).alias("words"))
        return encoded_pieces(rows, self.pairs, self.ids)


def id_mismatches(first: DataFrame, second: DataFrame, below: int | None = None) -> DataFrame:
    """(token, token_id, other_id): tokens of the first vocab (with ids `below` a number, if given) that have another id in the second, or none."""
    rows = first.select("token", "token_id") if below is None else first.where(F.col("token_id") < below).select("token", "token_id")
    both = rows.join(second.select("token", F.col("token_id").alias("other_id")), "token", "left")
    return both.where(~F.col("token_id").eqNullSafe(F.col("other_id")))


def pair_verified(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], size: int, transition: int) -> DataFrame:
    """One row about two artifacts (vocab, merges), of which the second goes on from the first at `transition` tokens.

    `passed` asks for both sizes and a possible transition; the common merges and the mismatched ids below it are told, not asked for.
    """
    from ..operators.parity_bpe import merge_lists_compared

    sizes = [v.agg(F.count("*").alias("n")) for v, _ in (first, second)]
    lists = merge_lists_compared(first[1], second[1])
    wrong = id_mismatches(first[0], second[0], transition).agg(F.count("*").alias("shared_id_mismatches"))
    row = lists.crossJoin(sizes[0].withColumnRenamed("n", "first_size")).crossJoin(sizes[1].withColumnRenamed("n", "second_size")).crossJoin(wrong)  # one row each
    inherited = F.lit(transition) - (F.col("first_size") - F.col("n_first"))
    passed = (F.col("first_size") == size) & (F.col("second_size") == size) & (inherited > 0) & (inherited <= F.col("n_first"))
    return row.select("first_size", "second_size", "n_first", "n_second", "common_prefix", inherited.alias("inherited"), "shared_id_mismatches", passed.alias("passed"))
