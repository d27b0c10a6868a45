"""What several operators of this subpackage share: inputs, checkpoints, components, bounded batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, stored  # noqa: F401  (for the operators)

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: Column) -> Column:
    """Words of a text by ASCII white space; null and blank texts have none."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about `most_bytes` of `column` (one value at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as distinct-ish (a, b) rows of one sortable type.

    Returns (node, component): component is the smallest node reachable. Alternates the large-star and
    small-star steps, each a grouped minimum and a join, so a hub with very many neighbours is joined
    (and split when skewed), never gathered. Rows with a = b and repeated rows are harmless. Each round's
    edges are checkpointed; the loop ends when a round changes nothing.
    """
    one = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        # Large star: every neighbour above the node is linked to the node's least neighbour (or the node).
        both = one.select("a", "b").union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: of the neighbours below, each is linked to the least.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        joined = large.join(low, large.a == low.k)
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        one = checkpointed(small)
        now = one.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return one.select(F.col("a").alias("node"), F.col("b").alias("component")).union(one.select(F.col("b"), F.col("b")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.RecordBatch]:
    """Regroup sorted Arrow batches so that no group of equal integer `keys` is cut, about `rows` rows at a time."""
    held: list[pa.RecordBatch] = []
    waiting = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.num_rows
        if waiting < rows:
            continue
        whole = joined(held)
        changes = np.zeros(whole.num_rows - 1, bool)
        for k in keys:
            changes |= np.diff(whole.column(k).to_numpy()) != 0
        ends = np.flatnonzero(changes) + 1
        if len(ends):
            yield from _cut(whole.slice(0, int(ends[-1])), [int(e) for e in ends], rows)
            whole = whole.slice(int(ends[-1]))
        held, waiting = [whole], whole.num_rows
    if held:
        yield joined(held)


def _cut(whole: pa.RecordBatch, ends: list[int], rows: int) -> Iterator[pa.RecordBatch]:
    start = 0
    for k, end in enumerate(ends):
        if end - start >= rows or k == len(ends) - 1:
            yield whole.slice(start, end - start)
            start = end


_kept: dict = {}


def release() -> None:
    """Give back what a Python worker no longer needs: later stages run in the same worker, beside the JVM."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def kept(key: object, make: Callable[[], object]):
    """What a Python worker keeps for its next tasks: one object at a time."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


class Numbers(dict):
    """Numbers keys from 0 on as they are looked up; names from `known` on are new since then.

    Where they are `full` (by number or by characters), cut() keeps those met first, which are the frequent ones.
    """

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n

    def since(self, known: int) -> list[str]:
        return list(islice(self, known, None))

    def of(self, keys: pa.Array, before: str = "") -> np.ndarray:
        """Numbers of all `keys`, each with `before` in front; none holds a NUL. Each distinct one is looked up once."""
        listed = keys.dictionary_encode()
        if not len(listed.dictionary):
            return np.zeros(0, np.int64)
        # One string for all of them is much faster to hand over than each on its own.
        every = pa.ListArray.from_arrays(pa.array([0, len(listed.dictionary)], pa.int32()), listed.dictionary.cast(pa.string()))
        names = (before + pa.compute.binary_join(every, "\0" + before)[0].as_py()).split("\0")
        return np.fromiter(map(self.__getitem__, names), np.int64, len(names))[listed.indices.to_numpy()]

    def full(self, most: int) -> bool:
        return len(self) > most or (len(self) > most // 16 and sum(map(len, self)) > 16 * most)

    def cut(self, first: int) -> None:
        names = list(islice(self, first))
        if sum(map(len, names)) > 16 * first:  # a few very long ones hold the room
            names = names[:2]
        self.clear()
        self.update((k, n) for n, k in enumerate(names))


#: Closing characters that stand behind a word; none is a letter, a digit or white space.
CLOSING = ".,;:!?#*$%&\")]}"


def is_plain(word: str) -> bool:
    """Letters only, and those of Latin-1: lower-casing them is one to one and no normal form changes them."""
    return word.isalpha() and (word.isascii() or max(word) < "Ā")
