"""SimHash near-duplicates by bit-sliced comparison.

Texts become fingerprints: a bit is set if it is in over half the hashes of the text's shingles. Equal fingerprints (or sets) are
one node. Rows are dealt by keys that near ones share; a key that very many share is cut into chunks, and every two
chunks meet in a task. Within a task, bit planes are stored vertically (64 fingerprints a machine word), one shift of the rows
against themselves updates the distances of all rows with carry-save counters, and words whose lanes all exceed the radius are
abandoned. Tasks return spanning edges only.

near_duplicates() links 64-bit fingerprints at RADIUS bits. Two such agree on k of k + RADIUS blocks, whatever k; the keys are these
k blocks, with k chosen by the number of nodes, so that keys stay about as many as nodes. near_texts() links texts whose sets of
SHINGLE-word shingles have a Jaccard similarity of SIMILAR or more. Such sets agree on a bit with a chance of 1 - acos(2s / (1 + s)) / pi
at least (s = SIMILAR: 0.849); they have bands() slices of bits, of which they share one with a chance of RECALL; what shares one
is compared on the first SKETCH bits with a radius of four standard deviations, and what is left on the sets themselves.

Defined cases: a text without words has fingerprint zero and the empty set, linked like any other; fewer words than a shingle has are one
shingle; repeated rows share a component, and filter_documents() keeps one of them; rows that share a doc_id are one node's names; a null
doc_id is never a component's name (null where there is no other), and rows without a doc_id are all kept; very long texts are whole;
an empty table gives an empty result; other columns are kept by filter_documents(), whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, release, slices, stored, table, whole_groups
from .shingles import checked, shingle_set

SHINGLE, SEED, RADIUS = 3, 42, 3
#: For texts: words of a shingle, similarity, the share of pairs at just that similarity that share a band, bits compared in a task.
TEXT_SHINGLE, SIMILAR, RECALL, SKETCH = 5, 0.8, 0.96, 128
#: Rows of a key beyond which it is cut into chunks of about this many.
CHUNK = 1024
#: Names of nodes without a doc_id begin here.
NAMELESS = 1 << 62
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_batch(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints (as signed 64-bit numbers) of UTF-8 texts."""
    hashes, counts = [], []
    for text in texts:
        words = (text or b"").lower().split()
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1))
        elif words:
            hashes.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
        else:
            hashes.append(np.zeros(1, np.uint64))
        counts.append(len(hashes[-1]))
    if not counts:
        return np.zeros(0, np.int64)
    every, n = np.concatenate(hashes), np.array(counts)
    bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_ = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
    return np.packbits(2 * set_ > n[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprint_batch(texts))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of values (n, words): row k holds bit k of all values, 64 values a word, with spare words behind."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(len(values), -1), axis=1)
    packed = np.packbits(bits, axis=0, bitorder="little")
    out = np.zeros((bits.shape[1], (len(packed) + 7) // 8 * 8 + 16), np.uint8)
    out[:, : len(packed)] = packed.T
    return out.view(np.uint64)


def near_rows(groups: np.ndarray, values: np.ndarray, radius: int = RADIUS, root: np.ndarray | None = None, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (groups are contiguous) within `radius` bits, and of different `side` if given; by distance between the rows.

    Counters begin so high that they overflow just where a distance exceeds the radius. Rows that have the same `root` by
    now are linked already and are left out, so that a group of very many near copies is soon done.
    """
    n, values = len(values), values.reshape(len(values), -1).view(np.uint64)
    planes, places = planes_of(values), radius.bit_length()
    width = planes.shape[1] - 2
    for shift in range(1, n):
        same = groups[shift:] == groups[:-shift]
        if not same.any():
            return
        if root is not None:
            same &= root[shift:] != root[:-shift]
        if side is not None:
            same &= side[shift:] != side[:-shift]
        together = np.packbits(same, bitorder="little")
        valid = np.zeros(width * 8, np.uint8)
        valid[: len(together)] = together
        valid = valid.view(np.uint64)
        words = np.flatnonzero(valid)
        if not len(words):
            continue
        over = ~valid[words]
        counter = [np.full(len(words), ALL if ((1 << places) - 1 - radius) >> k & 1 else 0, np.uint64) for k in range(places)]
        skip, rest = divmod(shift, 64)
        for k, plane in enumerate(planes):
            other = plane[words + skip]
            if rest:
                other = (other >> np.uint64(rest)) | (plane[words + skip + 1] << np.uint64(64 - rest))
            carry = plane[words] ^ other
            for c in counter:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if k % 8 == 7:
                live = over != ALL
                if not live.all():
                    words, over, counter = words[live], over[live], [c[live] for c in counter]
                    if not len(words):
                        break
        if len(words):
            word, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            rows = words[word] * 64 + lane
            yield rows, rows + shift


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """Of the graph of the pairs of rows: each row's root, the smallest row it can reach. A `root` that is given is kept up to date."""
    root = np.arange(n) if root is None else root
    for a, b in pairs:
        a, b = root[a], root[b]
        new = a != b
        for x, y in {*zip(a[new].tolist(), b[new].tolist())}:
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root[:] = root[root]
    return root


def block_keys(nodes: int) -> Column:
    """The keys of a 64-bit `fp`: all choices of k of k + RADIUS blocks, k such that keys are about as many as nodes, or more."""
    k = next((k for k in (1, 2, 3) if 64 * k // (k + RADIUS) + 2 >= math.log2(max(2, nodes))), 4)
    cuts = [round(64 * i / (k + RADIUS)) for i in range(k + RADIUS + 1)]
    masks = []
    for own in combinations(range(k + RADIUS), k):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in own)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)))


def links(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning edges (a, b) between the rows keyed(node long, key long, *prints long) that share a key, within `radius` bits.

    An edge leads to the smallest node that a task reaches, so that keys which the same rows share give the same edges. Where two chunks meet, what
    is linked within a chunk is one node already: only edges between such are returned, so that a row has one edge of a key, not one of each chunk.
    """
    prints = [c for c in keyed.columns if c not in ("node", "key")]
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = keyed.join(full, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least("own", j).cast("long") * (1 << 31) + F.greatest("own", j))
    dealt = dealt.select("node", *prints, "key", "own", F.explode(meets).alias("meet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("key", "meet"), 1 << 14):
            key, meet, own = (batch.column(c).to_numpy() for c in ("key", "meet", "own"))
            groups = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(meet) != 0)]))
            chunks = np.cumsum(np.concatenate([[0], (np.diff(groups) != 0) | (np.diff(own) != 0)]))
            values = np.stack([batch.column(c).to_numpy() for c in prints], axis=1)
            root = np.arange(len(values))
            spanning(len(values), near_rows(chunks, values, radius, root), root)
            within, alone = root.copy(), meet >> 31 == meet & ((1 << 31) - 1)
            if not alone.all():
                spanning(len(values), near_rows(groups, values, radius, root, own), root)
            joined = np.flatnonzero((root != np.arange(len(root))) & (alone | (within == np.arange(len(root)))))
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[root[joined]])], ["a", "b"])

    return dealt.repartition("key", "meet").sortWithinPartitions("key", "meet", "own", "node").mapInArrow(run, "a long, b long")


def _node(kind: str) -> Column:
    """The smallest doc_id of a kind; a number beyond all doc_ids where it has none."""
    return F.coalesce(F.min("doc_id"), F.pmod(F.xxhash64(kind), F.lit(1 << 61)) + F.lit(NAMELESS))


def _named(component: Column) -> Column:
    return F.when(component < NAMELESS, component)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id)."""
    prints = checkpointed(fingerprints(docs))
    nodes = checkpointed(prints.groupBy("fp").agg(_node("fp").alias("node")))
    keyed = nodes.select("node", "fp", F.explode(block_keys(nodes.count())).alias("key"))
    joined = components(checkpointed(links(keyed)))
    named = nodes.join(joined.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    named = checkpointed(named.select(F.col("fp").alias("own"), _named(F.coalesce("component", "node")).alias("component_id")))
    return prints.join(named, prints.fp == named.own, "left").select("doc_id", "fp", "component_id")


def bands(nodes: int, similar: float = SIMILAR) -> tuple[int, int]:
    """(bits of a band, bands): bands as wide as keeps their values about as many as nodes, and as many as RECALL asks for."""
    width = min(24, max(16, math.ceil(math.log2(max(2, nodes))) - 2))
    agree = 1 - math.acos(2 * similar / (1 + similar)) / math.pi
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**width))


def set_bits(own: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` bits of the fingerprint of a set of hashes."""
    words = -(-bits // 64)
    times = np.random.default_rng(SEED).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(64 * words, np.int64)
    for a in range(0, len(own), 255):  # as many as a byte can count
        h = own[a : a + 255, None] * times
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.uint8)
    return (2 * total > len(own))[:bits]


def near_texts(docs: DataFrame, shingle: int = TEXT_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, same, component_id): `same` is a hash of the text; links are texts of similarity `similar` or more."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    width, count = bands(docs.count(), similar)
    sketch = [f"s{k}" for k in range(SKETCH // 64)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weigh = 1 << np.arange(width, dtype=np.int64)
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            own = np.array([set_bits(s, max(SKETCH, width * count)) for s in sets])
            values = own[:, : width * count].reshape(len(own), count, width) @ weigh + (np.arange(count, dtype=np.int64) << width)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, count), pa.int32()), pa.array(values.ravel()))
            parts = np.packbits(own[:, :SKETCH], axis=1).view(">u8").astype(np.uint64).view(np.int64)
            kinds = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), kinds, keys, *(pa.array(parts[:, k]) for k in range(len(sketch)))], ["doc_id", "same", "kind", "keys", *sketch])

    rows = stored(texts.mapInArrow(prints, "doc_id long, same long, kind binary, keys array<long>, " + ", ".join(f"{c} long" for c in sketch)))
    # Equal sets are one node, which has the text of one row.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("first")
    nodes = stored(rows.groupBy("kind").agg(_node("kind").alias("node"), first, F.first(F.struct("keys", *sketch)).alias("p")))
    keyed = nodes.select("node", *(f"p.{c}" for c in sketch), F.explode("p.keys").alias("key"))
    differ = math.acos(2 * similar / (1 + similar)) / math.pi
    radius = math.ceil(SKETCH * differ + 4 * math.sqrt(SKETCH * differ * (1 - differ)))
    edges = stored(links(keyed, radius).distinct())
    groups = components(edges).select(F.col("node").alias("member"), F.col("component").alias("group"))
    members = stored(groups.join(nodes.select("node", "first"), F.col("node") == F.col("member")).select("group", "node", F.col("first.doc_id").alias("first_id"), F.col("first.same").alias("first_same")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", 1 << 20):
            data = [shingle_set(t, shingle).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), pa.array([len(d) // 8 for d in data], pa.int32()), pa.array(data, pa.binary())], ["group", "node", "n", "shingles"])

    met = texts.join(members, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("same") == F.col("first_same"))).select("group", "node", "text")
    linked = components(stored(checked(stored(met.mapInArrow(sets, "group long, node long, n int, shingles binary")), similar)))
    named = nodes.select("kind", "node").join(linked.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    named = stored(named.select(F.col("kind").alias("own"), _named(F.coalesce("component", "node")).alias("component_id")))
    return rows.select("doc_id", "same", "kind").join(named, F.col("kind") == F.col("own"), "left").select("doc_id", "same", "component_id")


def filter_documents(docs: DataFrame, shingle: int = TEXT_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """One row of every component of near_texts(), that with the smallest (doc_id, hash of the text); rows without a doc_id stay."""
    best = near_texts(docs, shingle, similar).where("doc_id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("doc_id", "same")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.same").alias("best_same"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("same"))
    stay = rows.where("id IS NOT NULL").join(best, (F.col("id") == F.col("best_id")) & (F.col("same") == F.col("best_same")))
    return stay.dropDuplicates(["id", "same"]).select("row.*").union(rows.where("id IS NULL").select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
