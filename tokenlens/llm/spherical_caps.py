"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A vector is turned by one fixed orthogonal matrix, so that no block holds more than its part of uneven coordinates, and cut
into BLOCKS blocks, whatever its dimension; each block has a code of signed rows of random orthogonal matrices. A filter is one
codeword of each block, its direction their concatenation. List decoding goes through each block's codewords from the best down
and visits only combinations that can still reach the limit; it returns all filters that do. The limit is where a random vector exceeds
EXPECTED filters; a vector that reaches fewer than LEAST lists all that score as well as its LEAST-th best. There are so many codewords
that filters outnumber vectors by SPARE. Vectors of a label that share a filter meet in a task and are verified by cosine in double
precision; a pair counts only under its smallest shared filter. A filter with very many vectors is cut into chunks that meet two by two.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and null labels, link with nothing;
equal vectors of a label are one node with a count, so copies are never expanded into pairs; vectors of different
lengths don't link; repeated vec_ids are one row each; vectors with a null vec_id only are left out of linking; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, table, whole_groups
from .simhash import spanning

COSINE = 0.98
BLOCKS, EXPECTED, LEAST, SPARE, SEED = 3, 8, 16, 64, 20240
#: Vectors of a filter beyond which it is cut into chunks of about this many.
CHUNK = 256


def codewords(vectors: int) -> int:
    """Codewords of a block: a power of two, 32 at least."""
    return 1 << max(5, math.ceil(math.log2(max(1, SPARE * vectors)) / BLOCKS))


@lru_cache(maxsize=4)
def codes(dims: int, words: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """The turning matrix (padding included), a code per block with words of norm 1 / sqrt(BLOCKS), and the limit."""
    rng = np.random.default_rng(SEED)
    width = -(-dims // BLOCKS)
    words = min(words, 2) if width == 1 else words  # on a line there are two directions
    turn = np.linalg.qr(rng.standard_normal((width * BLOCKS,) * 2))[0]
    out = []
    for _ in range(BLOCKS):
        rows = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-words // (2 * width)))]
        out.append(np.concatenate([m for r in rows for m in (r, -r)])[:words] / math.sqrt(BLOCKS))
    return turn, out, -NormalDist().inv_cdf(min(0.5, EXPECTED / words**BLOCKS)) / math.sqrt(width * BLOCKS)


def exceeding(scores: list[np.ndarray], order: list[np.ndarray], limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Names and scores of all filters that reach the limit; `scores` fall, `order` has their codewords."""
    first, second, third = scores
    n = int(np.searchsorted(-first, second[0] + third[0] - limit, side="right"))
    m = np.searchsorted(-second, first[:n] + third[0] - limit, side="right")
    i = np.repeat(np.arange(n), m)
    j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
    part = first[i] + second[j]
    m = np.searchsorted(-third, part - limit, side="right")
    i, j, part = np.repeat(i, m), np.repeat(j, m), np.repeat(part, m)
    k = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
    words = len(first)
    return (order[0][i] * words + order[1][j]) * words + order[2][k], part + third[k]


def decode(unit: np.ndarray, words: int) -> list[np.ndarray]:
    """For each unit vector the sorted names of its filters."""
    turn, code, limit = codes(unit.shape[1], words)
    turned = np.pad(unit, ((0, 0), (0, len(turn) - unit.shape[1]))) @ turn
    scores = [part @ c.T for part, c in zip(np.split(turned, BLOCKS, axis=1), code)]
    order = [np.argsort(-s, axis=1) for s in scores]
    scores = [np.take_along_axis(s, o, 1) for s, o in zip(scores, order)]
    step, least, out = 0.3 / math.sqrt(len(turn)), min(LEAST, len(code[0]) ** BLOCKS), []
    for v in range(len(unit)):
        own, by = [s[v] for s in scores], [o[v] for o in order]
        low = min(limit, sum(float(s[0]) for s in own))
        while len((got := exceeding(own, by, low))[0]) < least:
            low -= step
        names, values = got
        if low < limit:
            names = names[values >= np.partition(values, -least)[-least] - 1e-12]
        out.append(np.sort(names))
    return out


def _filters(vectors: DataFrame, words: int) -> DataFrame:
    """(node, place, filters array<long>) of valid vectors(node, place, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            dims, rows = np.diff(column.offsets.to_numpy()), [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = column.take(pa.array(own)).flatten().to_numpy().astype(np.float64).reshape(len(own), d)
                for k, names in zip(own.tolist(), decode(_unit(x), words)):
                    rows[k] = names
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("place"), pa.array(rows, pa.list_(pa.int64()))], ["node", "place", "filters"])

    return vectors.select("node", "place", "embedding").mapInArrow(run, "node long, place long, filters array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at norm 1; divided by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(met: DataFrame) -> DataFrame:
    """(node, links, root): under one filter and chunk pair, links won by each node and its local root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("place", "filter", "meet"), 1 << 12):
            place, filters, meet = (batch.column(c).to_numpy() for c in ("place", "filter", "meet"))
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(filters) != 0) | (np.diff(meet) != 0)) + 1).tolist(), len(place)]
            node, copies, chunk = (batch.column(c).to_numpy() for c in ("node", "copies", "chunk"))
            vectors, listed = batch.column("embedding"), batch.column("filters")
            out = [[], [], []]
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                x = _unit(vectors[a:b].flatten().to_numpy().astype(np.float64).reshape(b - a, -1))
                near = x @ x.T >= COSINE
                np.fill_diagonal(near, False)
                lower = [[f for f in own if f < filters[a]] for own in listed[a:b].to_pylist()]
                if names := sorted({f for own in lower for f in own}):
                    at = {f: k for k, f in enumerate(names)}
                    has = np.zeros((b - a, len(names)), np.float32)
                    for k, own in enumerate(lower):
                        has[k, [at[f] for f in own]] = 1
                    near &= has @ has.T == 0
                if (meet[a] >> 31) != (meet[a] & 0x7FFFFFFF):
                    near &= chunk[a:b, None] != chunk[None, a:b]
                if near.any():
                    root = spanning(b - a, iter([np.nonzero(np.triu(near))]))
                    linked = np.flatnonzero(near.any(1))
                    out[0].append(node[a:b][linked])
                    out[1].append((near @ copies[a:b])[linked])
                    out[2].append(node[a:b][root[linked]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["node", "links", "root"])

    columns = "place", "filter", "meet", "node", "copies", "chunk", "embedding", "filters"
    return met.select(*columns).repartition("place", "filter", "meet").sortWithinPartitions("place", "filter", "meet").mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for the rows of `vectors`(vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    if "array<float>" not in dict(rows.dtypes)["embedding"]:  # floats stay as small as they are; all sums are in double precision
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # A digest of the vector names its class, so that hot copies are counted before they are dealt.
    rows = rows.withColumn("class", F.when(valid, F.sha2(F.to_json(F.struct("label", "embedding")), 256)))
    classed = checkpointed(rows)
    classes = checkpointed(classed.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).where("node IS NOT NULL"))
    first = classed.where("class IS NOT NULL").join(classes, ["class"]).where("vec_id = node").dropDuplicates(["node"])
    nodes = checkpointed(first.select("node", "copies", "embedding", F.xxhash64("label", F.size("embedding")).alias("place")))
    member = checkpointed(_filters(nodes, codewords(nodes.count())).select("node", "place", F.explode("filters").alias("filter")))
    sizes = member.groupBy("place", "filter").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(F.col("place").alias("p"), F.col("filter").alias("f"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    shared = member.join(sizes, (member.place == sizes.p) & (member["filter"] == sizes.f)).select("node", "filter", "chunks")
    # A list holds the filters of one vector that others share; a filter's vectors are never gathered.
    lists = shared.groupBy("node").agg(F.collect_list(F.struct("filter", "chunks")).alias("shared"))
    met = nodes.join(lists, "node").withColumn("filters", F.sort_array("shared.filter")).withColumn("s", F.explode("shared"))
    met = met.withColumn("filter", F.col("s.filter")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("s.chunks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("s.chunks") - 1), lambda j: F.least("chunk", j).cast("long") * (1 << 31) + F.greatest("chunk", j))
    found = checkpointed(_verified(met.withColumn("meet", F.explode(meets))))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "node", "left").join(grouped, "node", "left")
    named = checkpointed(named.select(F.col("class").alias("own"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    back = classed.select("vec_id", "class").join(named, F.col("class") == F.col("own"), "left")
    back = back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return back.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
