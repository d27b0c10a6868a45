"""Katz backoff scoring: word bigrams with Good-Turing discounts over a discounted unigram model.

    P(w | h) = d(c(h, w)) * c(h, w) / c(h)      where h, w was seen in training
             = alpha(h) * P1(w)                 otherwise; P1(w) if h itself is new
    P1(w)    = d1(c(w)) * c(w) / N, and the mass the discounts leave for all unknown words together

alpha(h) makes each history sum to one exactly. Counts above MOST_DISCOUNTED keep the fixed share LARGE, so that every
history leaves some mass. Tokens are 64-bit hashes.

Texts are cut into blocks, stored as numbered tokens with the block's own list of words. A block asks for the counts of
its distinct words, then of its distinct pairs, each once; questions are dealt by word, then by history, and answers
come back in the order of the questions. So what is shuffled grows with the blocks' distinct words and pairs, and a
text's score is summed where its block is. The pairs of a history with more than 1 / HOT_PARTS of all tokens are dealt
by history and word; the sums of these histories (at most HOT_PARTS of them) go to the driver and to all blocks.

Defined cases: a null or blank text is the end token alone; a null doc_id is a training text; repeated rows count each in
training and score alike; with no training text every token is unknown; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, whole_groups

MOST_DISCOUNTED, LARGE, HOT_PARTS = 5, 0.999, 2000
#: Bytes of text in a block, and tokens per bucket of questions.
BLOCK_BYTES, BUCKET_TOKENS = 8 << 20, 2_000_000
BEGIN, END = (xxhash.xxh64_intdigest(x) for x in (b" begin ", b" end "))  # no word holds a blank
_SHIFT = np.uint64(29)


def discounts(n: dict[int, int]) -> list[float]:
    """Factors for counts 0 (unused) to MOST_DISCOUNTED from counts of counts, by Good-Turing as Katz has it.

    Where the counts of counts are too thin for that, the count loses one half instead.
    """
    k, out = MOST_DISCOUNTED, [1.0]
    tail = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 0.0
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - tail) / (1 - tail) if n.get(r) and tail < 1 else 0.0
        out.append(d if 0.05 < d < LARGE else (r - 0.5) / r)
    return out


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, a BEGIN before and an END behind each text, and the number of tokens of each text, END included."""
    words = [(t or b"").lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    last = np.cumsum(n + 1) - 1
    out = np.full(int(n.sum()) + len(n), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[last] = inner[last - n] = False
    out[last - n] = BEGIN
    out[inner] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(inner.sum()))
    return out, n


def squeezed(a: np.ndarray) -> bytes:
    """Compressed, the lowest bytes of all numbers first: high bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def expanded(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


BLOCK = "block long, tokens long, words binary, ids binary, rids binary, known binary, lengths binary, train binary"


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for k, batch in enumerate(slices(batches, "text", BLOCK_BYTES)):
        stream, n = tokens(batch.column("text").cast(pa.binary()).to_pylist())
        own, ids, count = np.unique(stream, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers
        number = np.empty(len(own), np.int32)
        number[order] = np.arange(len(own), dtype=np.int32)
        rid, train = batch.column("rid"), batch.column("train").to_numpy(zero_copy_only=False)
        arrays = (own[order], number[ids], rid.fill_null(0).to_numpy(), rid.is_valid().to_numpy(zero_copy_only=False), n, train.astype(bool))
        yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in BLOCK.split(", ")], (base + k, int(n.sum()), *map(squeezed, arrays))))])


class Block:
    def __init__(self, row: dict):
        self.block = row["block"]
        self.words, self.ids = expanded(row["words"], np.uint64), expanded(row["ids"], np.int32)
        self.rids, self.known = expanded(row["rids"], np.int64), expanded(row["known"], bool)
        self.n, self.train = expanded(row["lengths"], np.int64), expanded(row["train"], bool)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each word in training texts and in all texts."""
        taught = np.repeat(self.train, self.n + 1)
        return np.bincount(self.ids[taught], minlength=len(self.words)), np.bincount(self.ids, minlength=len(self.words))

    def word_buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order of their buckets, and where each bucket begins in it."""
        return _in_buckets(self.words * np.uint64(0x9E3779B97F4A7C15), buckets)

    def pairs(self) -> None:
        """Distinct pairs by history and word; the pair of each token; the pairs' occurrences in training texts."""
        inner = np.ones(len(self.ids) - 1, bool)
        inner[np.cumsum(self.n[:-1] + 1) - 1] = False  # from an END to the next BEGIN
        codes = (self.ids[:-1][inner].astype(np.int64) * len(self.words)) + self.ids[1:][inner]
        own, self.pair = np.unique(codes, return_inverse=True)
        self.history, self.word = np.divmod(own, len(self.words))
        self.taught = np.bincount(self.pair[np.repeat(self.train, self.n)], minlength=len(own))

    def pair_buckets(self, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (self.words * np.uint64(0x9E3779B97F4A7C15))[self.history]
        spread = np.isin(self.words, hot)[self.history]
        mixed[spread] ^= self.words[self.word[spread]] * np.uint64(0xC2B2AE3D27D4EB4F)
        return _in_buckets(mixed, buckets)


def _in_buckets(mixed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((mixed >> _SHIFT) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    return np.concatenate([np.ones(min(1, len(sorted_values)), bool), sorted_values[1:] != sorted_values[:-1]])


def _answered(batch: pa.RecordBatch) -> tuple[Block, list[dict], list[dict]]:
    """A block and the answers to its questions on words and on pairs, in the order of buckets."""
    first, *rest = batch.to_pylist()
    return Block(first), [r for r in rest if r["kind"] == 1], [r for r in rest if r["kind"] == 2]


def _joined(answers: list[dict], column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(expanded(r[column], kind) for r in answers)])


WORD_QUESTION = "bucket int, block long, words binary, taught binary, count binary"
PAIR_QUESTION = "bucket int, block long, histories binary, runs binary, words binary, counts binary, at binary, taught binary"
SUMS = tuple(f"r{r}" for r in range(1, MOST_DISCOUNTED + 1)) + ("big", "mass")
#: kind 1 and 2: answers to a block; 3: counts of counts by level; 4: words that are hot, or sums of a hot history.
ANSWER = "kind int, block long, bucket int, counts binary, sums binary, key long, n long, " + ", ".join(f"{s} double" for s in SUMS)
ANSWER_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[k]) for n, k in (x.split() for x in ANSWER.split(", "))])


def _levels(counts: np.ndarray) -> list[dict]:
    """Counts of counts up to MOST_DISCOUNTED + 1; larger ones are taken together."""
    level = np.minimum(counts[counts > 0], MOST_DISCOUNTED + 2)
    sums = np.bincount(level, counts[counts > 0])
    return [{"kind": 3, "key": int(r), "n": int(n), "mass": float(sums[r])} for r, n in enumerate(np.bincount(level)) if n]


def score(docs: DataFrame, train) -> DataFrame:
    """(rid, n_tokens, n_known, train_tokens, base_score, score), a row per row of `docs`(rid, text); `train` is a boolean column."""
    spark = docs.sparkSession
    blocks = stored(docs.select("rid", "text", train.alias("train")).mapInArrow(blocks_of, BLOCK))
    size = blocks.agg(F.sum("tokens"), F.count("*")).first()
    everything, least = size[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = max(least, everything // BUCKET_TOKENS + 1), max(least, size[1] // 4 + 1)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.slice(k, 1).to_pylist() for b in batches for k in range(b.num_rows)):
            block = Block(row)
            (taught, count), (order, cuts) = block.word_counts(), block.word_buckets(buckets)
            out = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    out.append((k, block.block, *(squeezed(x[order[a:b]]) for x in (block.words, taught, count))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), *[pa.binary()] * 3])], ["bucket", "block", "words", "taught", "count"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("bucket",), 1):
            rows = batch.to_pylist()
            parts = [expanded(r["words"], np.uint64) for r in rows]
            own, place = np.unique(np.concatenate(parts), return_inverse=True)
            taught = np.bincount(place, _joined(rows, "taught", np.int64), len(own)).astype(np.int64)
            count = np.bincount(place, _joined(rows, "count", np.int64), len(own))
            ends = np.cumsum([len(p) for p in parts])
            out = [{"kind": 1, "block": r["block"], "bucket": r["bucket"], "counts": squeezed(c)} for r, c in zip(rows, np.split(taught[place], ends[:-1]))]
            out += _levels(taught[own != BEGIN])
            out += [{"kind": 4, "key": int(w)} for w in own[count > everything / HOT_PARTS].view(np.int64)]
            yield pa.RecordBatch.from_pylist(out, schema=ANSWER_ARROW)

    asked = blocks.mapInArrow(ask_words, WORD_QUESTION).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    on_words = stored(asked.mapInArrow(count_words, ANSWER))
    levels = on_words.where("kind = 3").groupBy("key").agg(F.sum("n").alias("n"), F.sum("mass").alias("c")).collect()
    total, types = int(sum(r.c for r in levels)), sum(r.n for r in levels)
    n1 = {r.key: r.n for r in levels}
    p1 = discounts(n1)
    small = sum(r * n1.get(r, 0) for r in range(1, MOST_DISCOUNTED + 1))
    mass = sum(p1[r] * r * n1.get(r, 0) for r in range(1, MOST_DISCOUNTED + 1)) + LARGE * (total - small)
    unknown = 1 - mass / total if total else 1.0
    hot = np.array([r.key for r in on_words.where("kind = 4").select("key").collect()], np.int64).view(np.uint64)
    factor1 = np.array([*p1, LARGE])

    def p_word(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, factor1[np.minimum(c, MOST_DISCOUNTED + 1)] * c / max(1, total), unknown)

    def with_answers(*answers: DataFrame) -> DataFrame:
        """Each block before its answers, in one task."""
        names = [f.name for f in blocks.schema]
        rows = blocks.select(F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), *names)
        for df in answers:
            rows = rows.unionByName(df.where("kind in (1, 2)").select("kind", "block", "bucket", "counts", "sums"), allowMissingColumns=True)
        return rows.repartition(tasks, "block").sortWithinPartitions("block", "kind", "bucket")

    def word_answers(block: Block, answers: list[dict]) -> np.ndarray:
        c = np.zeros(len(block.words), np.int64)
        c[block.word_buckets(buckets)[0]] = _joined(answers, "counts", np.int64)
        return c

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("block",), 1):
            block, answers, _ = _answered(batch)
            c = word_answers(block, answers)
            block.pairs()
            order, cuts = block.pair_buckets(buckets, hot)
            out = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    own = order[a:b]
                    starts = np.flatnonzero(_runs(block.history[own]))
                    words, at = np.unique(block.word[own], return_inverse=True)
                    arrays = (block.words[block.history[own[starts]]], np.diff(starts, append=len(own)), block.words[words], c[words], at.astype(np.int32), block.taught[own])
                    out.append((k, block.block, *map(squeezed, arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32(), pa.int64(), *[pa.binary()] * 6])], [x.split()[0] for x in PAIR_QUESTION.split(", ")])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("bucket",), 1):
            rows = batch.to_pylist()
            runs = [expanded(r["runs"], np.int64) for r in rows]
            histories = _joined(rows, "histories", np.uint64)
            own_h, at_h = np.unique(histories, return_inverse=True)
            # Each row lists its own words and their counts once
            words, ats = [expanded(r["words"], np.uint64) for r in rows], [expanded(r["at"], np.int32) for r in rows]
            own_w, at_w = np.unique(np.concatenate(words), return_inverse=True)
            p_own = np.zeros(len(own_w))
            p_own[at_w] = p_word(_joined(rows, "counts", np.int64))
            word = np.concatenate([at_w[a + k] for a, k in zip(np.cumsum([0, *map(len, words[:-1])]), ats)])
            history = np.repeat(at_h, np.concatenate(runs))
            order = np.lexsort((word, history))
            new = _runs(history[order]) | _runs(word[order])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            count = np.bincount(place, _joined(rows, "taught", np.int64)).astype(np.int64)
            first = order[new]
            seen = count > 0
            n, of, p = count[seen], history[first][seen], p_own[word[first][seen]]
            sums = [np.bincount(of, n == r, len(own_h)) for r in range(1, MOST_DISCOUNTED + 1)]
            sums = np.stack([*sums, np.bincount(of, np.where(n > MOST_DISCOUNTED, n, 0), len(own_h)), np.bincount(of, p, len(own_h))], axis=1)
            spread, out = np.isin(own_h, hot), _levels(count)
            out += [{"kind": 4, "key": int(own_h[k].view(np.int64)), **dict(zip(SUMS, sums[k].tolist()))} for k in np.flatnonzero(spread)]
            a = b = 0
            for r, run in zip(rows, runs):
                got, at = count[place[a : a + int(run.sum())]], at_h[b : b + len(run)]
                # Sums of the histories with a pair that training lacks; those of hot histories come otherwise.
                lacks = (np.add.reduceat(got == 0, np.cumsum(run) - run) > 0) & ~spread[at]
                out.append({"kind": 2, "block": r["block"], "bucket": r["bucket"], "counts": squeezed(got), "sums": squeezed(sums[at[lacks]].ravel())})
                a, b = a + len(got), b + len(run)
            yield pa.RecordBatch.from_pylist(out, schema=ANSWER_ARROW)

    asked = with_answers(on_words).mapInArrow(ask_pairs, PAIR_QUESTION).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    on_pairs = stored(asked.mapInArrow(count_pairs, ANSWER))
    d2 = discounts({r.key: r.n for r in on_pairs.where("kind = 3").groupBy("key").agg(F.sum("n").alias("n")).collect()})
    hot_rows = on_pairs.where("kind = 4").groupBy("key").agg(*(F.sum(s).alias(s) for s in SUMS)).orderBy("key").collect()
    hot_sums = {r.key & 0xFFFFFFFFFFFFFFFF: [r[s] for s in SUMS] for r in hot_rows}
    factor2 = np.array([*d2, LARGE])
    weights = np.array([r * d2[r] for r in range(1, MOST_DISCOUNTED + 1)] + [LARGE])
    norm = math.log10(total + 0.1 * (types + 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("block",), 1):
            block, words, answers = _answered(batch)
            c = word_answers(block, words)
            block.pairs()
            order, _ = block.pair_buckets(buckets, hot)
            got = _joined(answers, "counts", np.int64)
            count = np.zeros(len(order), np.int64)
            count[order] = got
            # Where a history lacks a pair: the sums that its bucket sent, in the order of the pairs
            sums = np.zeros((len(block.words), len(SUMS)))
            own = order[(got == 0) & ~np.isin(block.words, hot)[block.history[order]]]
            if len(own):
                lacking = block.history[own]
                sums[lacking[_runs(lacking)]] = _joined(answers, "sums", np.float64).reshape(-1, len(SUMS))
            for k in np.flatnonzero(np.isin(block.words, hot)):
                sums[k] = hot_sums.get(int(block.words[k]), sums[k])
            begun = c[block.history]
            left = np.maximum((c - sums[:, :-1] @ weights) / (1 - sums[:, -1]), 1e-300)
            seen = np.log10(np.maximum(factor2[np.minimum(count, MOST_DISCOUNTED + 1)] * count, 1e-300))
            backed = np.log10(p_word(c))[block.word] + np.where(begun > 0, np.log10(left)[block.history], 0.0)
            each = np.where(count > 0, seen, backed) - np.log10(np.maximum(begun, 1))
            starts = np.cumsum(block.n) - block.n
            known, base = (c > 0).astype(np.int64), np.log10(c + 0.1) - norm
            by_text = lambda x: np.add.reduceat(x[block.pair], starts)
            arrays = [block.n, by_text(known[block.word]), np.full(len(block.n), total), by_text(base[block.word]), by_text(each)]
            rid = pa.array(block.rids, mask=~block.known)
            yield pa.RecordBatch.from_arrays([rid, *map(pa.array, arrays)], ["rid", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(on_words, on_pairs).mapInArrow(finish, "rid long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("rid"), "text")
    held_out = F.coalesce(F.crc32(F.col("rid").cast("string")) % 10 == 0, F.lit(False))
    return score(docs, ~held_out).select(F.col("rid").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
