"""Pair counts of words that are kept up to date by differences while pairs are merged.

The index is two tables: words as strings of marked symbols, and the counts of their pairs. A round reads the words once, narrowly, to find those that
hold one of its own pairs; only these are taken apart, their pairs before the merges count down and those after them up, and the differences are added
to the pair table, which is small and written anew. So a round shuffles what its own merges change, whatever was merged before. Words are merged as they are read;
after CUT_AFTER merges they are written anew to the shared folder too, and the files from before are deleted. (A table from pairs to words would
save no pass: Spark would scan it, and it is larger than the words.)

Counts are exact: whole numbers as such, others in millionths, so a count that went to zero is zero and sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discarded, stored

#: Merges between two times that the words are written.
CUT_AFTER = 16


def symbols_of(symbols: Column) -> Column:
    return F.split(F.substring(symbols, F.lit(2), F.length(symbols) - 2), r"\|\|")


def rule(left: str, right: str, unit: str = "byte") -> tuple[str, str]:
    """What to replace by what, so that every occurrence of the pair, from left to right, becomes one symbol; patterns where clusters constrain."""
    if unit == "grapheme_constrained":
        return rf"\|(?:(<?){left}\|\|{right}(>?)|(<){left}>\|\|<{right}(>))\|", f"|$1$3{left}{right}$2$4|"
    return f"|{left}||{right}|", f"|{left}{right}|"


def merge_all(symbols: Column, merges: list[tuple[str, str]], unit: str = "byte") -> tuple[Column, Column]:
    """(whether a word holds a pair of these merges, its symbols after all of them in order). The merges are one literal, not a chain of calls."""
    if not merges:
        return F.lit(False), symbols
    listed = ("\n".join(side) for side in zip(*(rule(a, b, unit) for a, b in merges)))
    rules = F.arrays_zip(*(F.split(F.lit(side), "\n").alias(name) for side, name in zip(listed, ("old", "new"))))
    if unit == "grapheme_constrained":
        return F.exists(rules, lambda m: F.regexp_like(symbols, m["old"])), F.aggregate(rules, symbols, lambda s, m: F.regexp_replace(s, m["old"], m["new"]))
    return F.exists(rules, lambda m: F.contains(symbols, m["old"])), F.aggregate(rules, symbols, lambda s, m: F.replace(s, m["old"], m["new"]))


def pairs_of(words: DataFrame, keys: tuple[str, ...], counts: tuple[str, ...], unit: str = "byte") -> DataFrame:
    """(*keys, left, right, *counts), a row per occurrence of a pair that may be merged; with `closing`, see PairIndex, where clusters constrain."""
    rows = words.select(*keys, *counts, symbols_of(F.col("symbols")).alias("s")).where(F.size("s") > 1)
    zipped = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("l"), F.slice("s", F.lit(2), F.size("s") - 1).alias("r"))
    rows = rows.select(*keys, *counts, F.explode(zipped).alias("p")).select(*keys, *counts, F.col("p.l").alias("left"), F.col("p.r").alias("right"))
    if unit != "grapheme_constrained":
        return rows
    l, r = F.col("left"), F.col("right")
    within = ~l.endswith(">") & ~r.startswith("<")
    closing = F.when(l.startswith("<") & ~l.endswith(">") & r.endswith(">"), F.col(counts[0]))
    rows = rows.where(within | (l.rlike("^<.*>$") & r.rlike("^<.*>$"))).withColumn("closing", F.coalesce(closing, F.lit(0)))
    return rows.withColumns({c: F.regexp_replace(c, "[<>]", "") for c in ("left", "right")})


def spread(df: DataFrame) -> DataFrame:
    """`df` for all cores: small files are read by few tasks otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class PairIndex:
    """words(*keys, symbols, *counts) and the counts of their pairs.

    `closing` counts occurrences whose merge completes a cluster: these make pairs with whole clusters beside them that didn't count before.
    """

    def __init__(self, words: DataFrame, unit: str = "byte", keys: tuple[str, ...] = (), counts: tuple[str, ...] = ("cnt",)):
        self.unit, self.keys, self.counts = unit, keys, counts
        self.sums = (*counts, "closing") if unit == "grapheme_constrained" else counts
        words = stored(words.select(*keys, "symbols", *counts))  # what counts them reads the texts once
        whole = words.agg(*(F.min(F.col(c) == F.floor(c)) for c in counts)).first()
        kind = "long" if all(x is not False for x in whole) else "decimal(38,6)"
        self.kind = kind
        self.base = spread(words.select(*keys, "symbols", *(F.col(c).cast(kind).alias(c) for c in counts))).persist()
        self.pairs = stored(self._added(pairs_of(self.base, keys, counts, unit)))
        self.files, self.since = words, []

    @property
    def words(self) -> DataFrame:
        """The words after all merges."""
        return self.base.withColumn("symbols", merge_all(F.col("symbols"), self.since, self.unit)[1])

    def _added(self, rows: DataFrame) -> DataFrame:
        got = rows.groupBy(*self.keys, "left", "right").agg(*(F.sum(c).cast(self.kind).alias(c) for c in self.sums))
        return got.where(" OR ".join(f"{c} <> 0" for c in self.counts))

    def top(self, n: int, by: str = "cnt") -> list:
        """The first n pairs by count, then by left and right: as many for each combination of the keys, if there are keys."""
        order = [F.desc(by), "left", "right"]
        if not self.keys:
            return self.pairs.where(F.col(by) > 0).orderBy(*order).limit(n).collect()
        ranked = self.pairs.where(F.col(by) > 0).withColumn("rank", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order)))
        return sorted(ranked.where(F.col("rank") <= n).collect(), key=lambda r: r["rank"])

    def merge(self, merges: list[tuple[str, str]]) -> None:
        """Merge these pairs, in order, in all words, and bring `pairs`, the counts after all merges, up to date."""
        was = self.pairs
        hit, after = merge_all(F.col("symbols"), merges, self.unit)
        sides = F.explode(F.array(F.struct(F.col("symbols"), F.lit(-1).alias("sign")), F.struct(after.alias("symbols"), F.lit(1).alias("sign")))).alias("side")
        touched = self.words.where(hit).select(*self.keys, *self.counts, sides)
        signed = touched.select(*self.keys, "side.symbols", *((F.col(c) * F.col("side.sign")).alias(c) for c in self.counts))
        columns = [*self.keys, "left", "right", *self.sums]
        self.pairs = stored(self._added(was.select(columns).union(pairs_of(signed, self.keys, self.counts, self.unit).select(columns))))
        discarded(was)
        self.since = self.since + merges
        if len(self.since) >= CUT_AFTER:
            was_words, was_files = self.base, self.files
            self.files, self.since = stored(self.words), []
            self.base = spread(self.files).persist()
            was_words.unpersist()
            discarded(was_files)

    def release(self) -> None:
        """Give back memory and files; the index is of no use afterwards."""
        self.base.unpersist()
        discarded(self.pairs, self.files)
