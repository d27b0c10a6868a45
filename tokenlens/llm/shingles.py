"""The exact similarity of shingle sets: what near-duplicate candidates of texts are held against.

The sets of a candidate group meet in a task, where links are found on the sets themselves. A group with many or large sets is
cut into chunks, and every two chunks meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups

SEED = 42
#: Sets and shingles of a candidate group beyond which it is cut into chunks of about these many.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 19


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, in order; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or b"").lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def similar_rows(data: list[bytes], similar: float) -> np.ndarray:
    """Each set's root: the first set reached by links of similarity `similar` or more."""
    parts = [np.frombuffer(d, np.uint64) for d in data]
    size = np.array([len(p) for p in parts])
    names, number = np.unique(np.concatenate(parts), return_inverse=True)
    begin = np.cumsum(size) - size
    root, mine = np.arange(len(parts)), np.zeros(len(names), bool)
    for i in range(len(parts) - 1):
        # Sets already linked to this one, and sets of other sizes, need no comparison.
        others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        others = others[np.minimum(size[others], size[i]) >= similar * np.maximum(size[others], size[i])]
        if not len(others):
            continue
        own = number[begin[i] : begin[i] + size[i]]
        mine[own] = True
        n = size[others]
        start = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(begin[others] - start, n)
        common = np.add.reduceat(mine[number[at]], start, dtype=np.int64)
        mine[own] = False
        for j in others[common >= similar * (n + size[i] - common) - 1e-9].tolist():
            a, b = int(root[i]), int(root[j])
            if a != b:
                root[root == max(a, b)] = min(a, b)
    return root


def checked(grouped: DataFrame, similar: float) -> DataFrame:
    """Spanning edges (a, b) of the links of similarity `similar` or more within each group of grouped(group, node, n, shingles)."""
    sized = grouped.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select(F.col("group").alias("g"), F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    dealt = grouped.join(sized, F.col("group") == F.col("g")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least("own", j).cast("long") * (1 << 31) + F.greatest("own", j))
    met = dealt.withColumn("meet", F.explode(meets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("group", "meet"), 256):
            group, meet, node = (batch.column(c).to_numpy() for c in ("group", "meet", "node"))
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(meet) != 0)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                root = similar_rows(batch.column("shingles")[a:b].to_pylist(), similar)
                joined = np.flatnonzero(root != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b][joined]), pa.array(node[a:b][root[joined]])], ["a", "b"])

    return met.select("group", "meet", "node", "shingles").repartition("group", "meet").sortWithinPartitions("group", "meet").mapInArrow(run, "a long, b long")
