"""Toxicity by class-conditional Kneser-Ney models: how much likelier toxic texts have a text's words than ordinary ones.

    P_c(w) = (n_c(w) - D_c(n_c(w))) / N_c + L_c * P(w)       c: toxic or ordinary; n_c: its texts that hold w, N_c: the sum of that
    P(w)   = (k(w) - D(k(w))) / K + L / (V + 1)              k: distinct words seen before w in either class, K their sum, V words

D are the modified Kneser-Ney discounts of each table of counts, L what they set free. So the classes share what rare expressions back off
to, and a word that neither has says nothing: its log-ratio is 0. A text is compared by log-likelihoods normalised by length, over all of
its words and over the PEAK words that speak most for toxic (few words make a long text toxic). Both go through a logistic
curve, fitted on the texts learned from, each compared by the counts that all others leave.

Learning takes a bounded sample: texts of LONGEST bytes at most, of each class as many as have SAMPLE_BYTES bytes in expectation (a text
counts BESIDE bytes besides its own), drawn by the hash of doc_id and each distinct text once. It bounds the words of the model, which goes
to every task as 12 bytes a word. Words are letters between white space, in lower case.

Defined cases: null and empty texts, and those without letters, are scored with both comparisons at 0; where labels have one class only,
that class is certain (score 0 or 1), without labels the score is 0; of labels that disagree about a doc_id the toxic one counts; a null
doc_id has no label and is never held out; repeated rows are scored alike; very long texts are whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLOSING, Numbers, is_plain, kept, release, slices, stored, table
from .language_id import letters_of

SAMPLE_BYTES, BESIDE, LONGEST = 32 << 20, 1000, 1 << 20
#: Highest words that a text is judged by, texts of a class that a word needs to count there, chunks whose values a task keeps.
PEAK, LEAST, CACHED = 2, 3, 150_000
#: Bytes of text that a task takes apart at a time.
PIECE = 1 << 20
BEGIN = 0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def word_of(chunk: str) -> str:
    bare = chunk.strip(CLOSING)
    return bare.lower() if is_plain(bare) else letters_of(chunk)


def key_of(word: str) -> int:
    """Signed 64-bit hash; 0 stands for what is before the first word."""
    return int(np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64)) or 1


class Words:
    """Numbers chunks between white space, and keeps a value for each (of the kind that `make` gives for a word)."""

    def __init__(self, make, kind: type):
        self.make, self.kind = make, kind
        self.index, self.values = Numbers(), np.zeros(0, kind)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(a value for each chunk of all texts, chunks of each text)."""
        if self.index.full(CACHED):
            self.index.cut(CACHED // 2)
            self.values = self.values[: len(self.index)].copy()
        chunks = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring(texts.fill_null(""), "\0", " ")))
        at, n = self.index.of(chunks.flatten()), np.diff(chunks.offsets.to_numpy()).astype(np.int64)
        new = self.index.since(len(self.values))
        if new:
            self.values = np.concatenate([self.values, np.asarray(self.make([word_of(c) for c in new]), self.kind)])
        return self.values[at], n


def discounts(counts: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and more, by counts of counts; half a count where these are too thin."""
    n = [np.count_nonzero(counts == k) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return np.array([0.0] + [d if n[k] and 0 < (d := k - (k + 1) * y * n[k + 1] / n[k]) < k else 0.5 for k in (1, 2, 3)])


class Model:
    """Counts of words in toxic and in ordinary texts, and the distribution that both back off to."""

    def __init__(self, words: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, before: np.ndarray):
        d, total = discounts(before), before.sum()
        lost = d[np.minimum(before, 3)]
        self.words, self.counts = words, (toxic, ordinary)
        self.shared = (before - lost + lost.sum() / (len(words) + 1)) / total
        # A toxic count below LEAST is left to what both classes share.
        self.discounts = [np.append(np.where(np.arange(3) < LEAST, np.arange(3), discounts(toxic)[:3]), discounts(toxic)[3]), discounts(ordinary)]
        self.totals = [int(c.sum()) for c in self.counts]
        self.free = [d[np.minimum(c, 3)].sum() / c.sum() for d, c in zip(self.discounts, self.counts)]

    def ratios(self, at: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of the words numbered `at`, as if they had these counts; 0 for a word that neither class has."""
        logs = [np.log((c - d[np.minimum(c, 3)]) / n + free * self.shared[at]) for c, d, n, free in zip((toxic, ordinary), self.discounts, self.totals, self.free)]
        return np.where(toxic + ordinary > 0, logs[0] - logs[1], 0.0)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is no known word."""
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, at, -1)

    def without_itself(self, keys: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Log-ratios for the words of texts that were learned from, by the counts that all others leave."""
        at, text = self.places(keys), np.repeat(np.arange(len(n)), n)
        known = at >= 0
        word, is_toxic = at[known], toxic[text[known]]
        out = np.where(keys == 0, np.nan, 0.0)
        out[known] = self.ratios(word, self.counts[0][word] - is_toxic, self.counts[1][word] - ~is_toxic)
        return out


def features(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, mean log-ratio of its PEAK highest words (missing ones are 0), and of all its words; NaN is no word."""
    out = np.zeros((len(n), 2))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts, of = (np.cumsum(n) - n)[some], np.repeat(np.arange(len(some)), n[some])
    real = ~np.isnan(values)
    words = np.bincount(of, real, len(some))
    out[some, 1] = np.bincount(of, np.where(real, values, 0.0), len(some)) / np.maximum(words, 1)
    rest, places = np.where(real, values, -np.inf), np.arange(len(values))
    for _ in range(PEAK):
        top = np.maximum.reduceat(rest, starts)
        out[some, 0] += np.where(np.isfinite(top), top, 0.0) / PEAK
        rest[np.minimum.reduceat(np.where(rest == top[of], places, len(values)), starts)] = -np.inf
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and slopes by Newton's method, slightly held towards 0."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = curve(x @ b)
        gradient = x.T @ (weight * (y - p)) - ridge * b
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(b)), gradient)
        b += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return b


def curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, chance): what is learned from, see above. Lengths alone are joined with all labels, texts with those drawn."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.where(~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.octet_length("text") > 0) & (F.octet_length("text") <= LONGEST))
    sizes = rows.select("doc_id", (F.octet_length("text").cast("long") + BESIDE).alias("size")).join(known, "doc_id").groupBy("toxic").agg(F.sum("size").alias("size")).collect()
    share = {r.toxic: min(1.0, SAMPLE_BYTES / r.size) for r in sizes}
    below = lambda p: F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < F.lit(int(p * (1 << 40)))
    own = F.when(F.col("toxic"), share.get(True, 0.0)).otherwise(share.get(False, 0.0))
    drawn = known.withColumn("chance", own).where((F.col("toxic") & below(share.get(True, 0.0))) | (~F.col("toxic") & below(share.get(False, 0.0))))
    got = rows.where(below(max(share.values(), default=0.0))).join(drawn, "doc_id")
    return stored(got.groupBy("text", "toxic").agg(F.max("chance").alias("chance")))


def keys_of(words: list[str]) -> np.ndarray:
    return np.array([key_of(w) if w else 0 for w in words], np.int64)


def _one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both numbers in one 64-bit hash."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) ^ b.view(np.uint64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, word, t, o): toxic and ordinary texts that hold the word, counted where it is met first, behind another; 0 behind others."""
    words = Words(keys_of, np.int64)
    for batch in slices(batches, "text", PIECE):
        keys, n = words.of(batch.column("text"))
        text, keys = np.repeat(np.arange(len(n)), n)[keys != 0], keys[keys != 0]
        before = np.where(np.diff(text, prepend=-1) == 0, np.concatenate([[BEGIN], keys])[: len(keys)], BEGIN)
        first = np.zeros(len(keys), bool)
        first[np.unique(_one(text, keys), return_index=True)[1]] = True
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[text]
        _, own, at = np.unique(_one(before, keys), return_index=True, return_inverse=True)
        counts = [np.bincount(at[first & kind], minlength=len(own)) for kind in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (before[own], keys[own], *counts)], ["before", "word", "t", "o"])
    words = None
    release()


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """words (sorted hashes), ratios, and the curve's numbers; where a class is missing only `score`, which then holds for all texts."""
    drawn = sample(docs, labels)
    pairs = drawn.mapInArrow(_pairs, "before long, word long, t long, o long").groupBy("before", "word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    known = pairs.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("k")).orderBy("word")
    word, t, o, k = (c.to_numpy() for c in known.toArrow().columns)  # the words of the sample, which bounds them
    if not t.sum() or not o.sum():
        return {"score": float(t.sum() > 0)}
    shared = docs.sparkSession.sparkContext.broadcast(Model(word, t, o, k))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(keys_of, np.int64)
        for batch in slices(batches, "text", PIECE):
            keys, n = words.of(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            x = features(shared.value.without_itself(keys, n, toxic), n)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic"), batch.column("chance")], ["peak", "mean", "toxic", "chance"])
        words = None
        release()

    rows = drawn.mapInArrow(compare, "peak double, mean double, toxic boolean, chance double").toArrow()  # a row per text of the sample
    peak, mean, toxic, chance = (c.to_numpy() for c in rows.columns)
    order = np.lexsort((mean, peak))  # sums don't depend on the order of rows
    b = logistic(np.column_stack([peak, mean])[order], toxic[order].astype(float), 1 / chance[order])
    return {"words": word, "ratios": shared.value.ratios(np.arange(len(word)), t, o).astype(np.float32), "curve": b}


def looked_up(words: np.ndarray, values: np.ndarray, new: list[str]) -> np.ndarray:
    """Log-ratios of words: 0 for those not known, NaN where there are no letters."""
    keys = keys_of(new)
    at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
    got = np.where(words[at] == keys, values[at], 0.0) if len(words) else np.zeros(len(keys))
    return np.where(keys == 0, np.nan, got)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted, peak_ratio, mean_ratio) for docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if "score" in model:
        score = F.lit(model["score"])
        return rows.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.lit(0.0).alias("peak_ratio"), F.lit(0.0).alias("mean_ratio"))
    shared = docs.sparkSession.sparkContext.broadcast(model | {"key": uuid.uuid4().hex})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text", PIECE):
            words = kept(("toxicity", m["key"]), lambda: Words(lambda new: looked_up(m["words"], m["ratios"], new), np.float32))
            x = features(*words.of(batch.column("text")))
            score = curve(m["curve"][0] + x @ m["curve"][1:])
            columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "peak_ratio", "mean_ratio"])
        words = None
        release()

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, peak_ratio double, mean_ratio double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted", "peak_ratio", "mean_ratio")
