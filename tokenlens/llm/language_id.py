"""Language spans of mixed texts: script ranges narrow the candidates, Viterbi over per-word scores labels words.

A word's score in a language is the log probability of its letter trigrams there, for the languages whose
training texts use the word's script; a constant penalty is paid for each change of language. The language of
a text is the one whose spans hold the most words with letters.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the language that
sorts first; repeated rows are labelled alike; an empty table, or one with nothing to learn from, gives `und`;
other columns are kept by filter_documents() and ignored otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLOSING, Numbers, is_plain, kept, release, slices, table

#: Training sample: so many texts in expectation, those whose hash of doc_id is below the share that this is of all labelled ones. It
#: bounds the model: it has no more trigrams and scripts than these texts.
SAMPLE_DOCS = 4_000
SWITCH_PENALTY, SMOOTHING, LEAST_SCRIPT_SHARE = 14.0, 0.5, 0.001
CACHED = 150_000
LEAST_SCORE = 0.5
#: First code points of script ranges (fixed values of the Unicode standard, coarse): letters from there on are of that script.
SCRIPTS = [(0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han")]
_FIRST = [a for a, _ in SCRIPTS]
LETTERS = re.compile(r"[^\W\d_]+")


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(letter)) - 1][1]


def letters_of(chunk: str) -> str:
    return "".join(LETTERS.findall(chunk.lower()))


def grams_of(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[k : k + 3] for k in range(len(marked) - 2)]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def train(docs: DataFrame) -> dict:
    """Trigram and script counts by language over the sample; small enough to go to every task."""
    labelled = docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    # Each task draws its own share by the hash; the count reads no text.
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE_DOCS / max(1, labelled.count())))
    sample = labelled.where(drawn & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: Counter = Counter()
        for batch in slices(batches, "text", 4 << 20):
            words: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words.update((lang, w) for w in map(letters_of, text.split()) if w)
            for (lang, word), n in words.items():
                total[lang, "s", script_of(word[0])] += n
                for g in grams_of(word):
                    total[lang, "g", g] += n
        keys = list(zip(*total)) if total else [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(total.values()), pa.int64())], ["lang", "kind", "item", "n"])

    counted = sample.mapInArrow(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    langs = sorted({r.lang for r in rows})
    grams = sorted({r.item for r in rows if r.kind == "g"})
    at, of = {g: k for k, g in enumerate(grams)}, {x: k for k, x in enumerate(langs)}
    counts, scripts = np.zeros((len(grams) + 1, len(langs))), {}
    for r in rows:
        if r.kind == "g":
            counts[at[r.item], of[r.lang]] = r.n
        else:
            scripts.setdefault(r.item, np.zeros(len(langs)))[of[r.lang]] = r.n
    probs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * max(1, len(counts)))).astype(np.float32)
    words = sum(scripts.values()) if scripts else 0
    used = {s: n >= LEAST_SCRIPT_SHARE * words for s, n in scripts.items()}
    allowed = np.array([used.get(s, np.zeros(len(langs), bool)) for _, s in SCRIPTS]).reshape(len(SCRIPTS), len(langs))
    codes = np.array([(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in grams], np.int64)
    order = np.argsort(codes)
    return {"langs": langs, "codes": codes[order], "log": probs[np.append(order, len(order))], "allowed": allowed}


class Labeller:
    """Scores words (keeping those seen) and labels many texts at once."""

    def __init__(self, model: dict):
        self.model, self.k = model, len(model["langs"])
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.core = np.zeros(0, np.int32)
        self.cores = Numbers({"": 0})
        self.scores = np.zeros((1, self.k), np.float32)

    def shrink(self, first: int) -> None:
        self.index.cut(first)
        self.core = self.core[: len(self.index)].copy()
        self.cores.cut(int(self.core.max(initial=0)) + 1)
        if len(self.cores) <= int(self.core.max(initial=0)):
            self.clear()
            return
        self.scores = self.scores[: len(self.cores)].copy()

    def learn(self) -> None:
        """Letters of the chunks that are new in `index`, and scores of the words that are new."""
        words, known, core = self.cores, len(self.cores), []
        for c in self.index.since(len(self.core)):
            bare = c.strip(CLOSING)
            core.append(words[bare.lower() if is_plain(bare) else letters_of(c)])
        self.core = np.concatenate([self.core, np.array(core, np.int32)])
        new = words.since(known)
        if not new:
            return
        # All words in one string, a blank around each; a trigram belongs to the word that its middle is in.
        text = np.frombuffer(f" {' '.join(new)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        inner = np.flatnonzero(text[1:-1] != 32)
        gram = (text[inner] << 42) | (text[inner + 1] << 21) | text[inner + 2]
        codes = self.model["codes"]
        at = np.minimum(np.searchsorted(codes, gram), max(0, len(codes) - 1))
        rows = self.model["log"][np.where(codes[at] == gram, at, len(codes)) if len(codes) else np.zeros(len(gram), np.int64)]
        first = np.flatnonzero(text[inner] == 32)
        scores = np.add.reduceat(rows, first, axis=0)
        script = np.searchsorted(_FIRST, text[inner[first] + 1], side="right") - 1
        allowed = self.model["allowed"][script]
        scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 50.0)
        scores[~allowed.any(1)] = 0  # a script that no language uses is no evidence
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])

    def label(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[str, float, int, str]]:
        """For each text: language, share of lettered words in it, number of spans, spans as lang:first-end (words)."""
        if self.index.full(CACHED):
            self.shrink(CACHED // 2)
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring(texts, "\0", " ")))
        at, n = self.index.of(words.flatten()), np.diff(words.offsets.to_numpy()).astype(np.int64)
        if len(self.index) > len(self.core):
            self.learn()
        at = self.core[at]
        starts = np.cumsum(n) - n
        path = self.viterbi(at, starts, n) if self.k and len(at) else np.zeros(len(at), np.int32)
        lettered, langs = at > 0, self.model["langs"]
        for a, m in zip(starts.tolist(), n.tolist()):
            own, real = path[a : a + m], lettered[a : a + m]
            if not langs or not real.any():
                yield "und", 0.0, 0, ""
                continue
            share = np.bincount(own[real], minlength=self.k) / real.sum()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), m]
            spans = " ".join(f"{langs[own[x]]}:{x}-{y}" for x, y in zip(cuts, cuts[1:]))
            yield langs[int(share.argmax())], float(share.max()), len(cuts) - 1, spans

    def viterbi(self, at: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The best path of each text, a step for all texts that still have a word there."""
        order = np.argsort(-n, kind="stable")
        starts, n = starts[order], n[order]
        most = int(n[0])
        alive = len(n) - np.searchsorted(n[::-1], np.arange(most), side="right")
        number = np.min_scalar_type(max(1, self.k - 1))  # wide enough for the numbers of all languages
        came = np.empty((len(at), self.k), number)  # by word: where each language's best path comes from
        stay = np.arange(self.k, dtype=number)
        best = self.scores[at[starts[: alive[0]]]].copy()
        for t in range(1, most):
            m = alive[t]
            here = starts[:m] + t
            old = best[:m]
            top = old.argmax(1)
            switched = old.max(1)[:, None] - SWITCH_PENALTY
            came[here] = np.where(old >= switched, stay, top[:, None].astype(number))
            best[:m] = np.maximum(old, switched) + self.scores[at[here]]
        path = np.empty(len(at), number)
        state = best.argmax(1)
        for t in range(most - 1, -1, -1):
            m = alive[t]
            here = starts[:m] + t
            path[here] = state[:m]
            if t:
                state[:m] = came[here, state[:m]]
        return path


def _labeller(shared) -> Labeller:
    return kept(("languages", shared.value["key"]), lambda: Labeller(shared.value))


def _share(spark: SparkSession, model: dict):
    """The model as a broadcast: the trigrams of SAMPLE_DOCS texts at most."""
    import uuid

    return spark.sparkContext.broadcast(model | {"key": uuid.uuid4().hex})


def predictions(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans, spans)."""
    shared = _share(docs.sparkSession, model)
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = zip(*_labeller(shared).label(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long, spans string")


def filter_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language that fills LEAST_SCORE of its words."""
    shared = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            stays = [lang != "und" and score >= LEAST_SCORE for lang, score, _, _ in _labeller(shared).label(batch.column("text"))]
            yield batch.filter(pa.array(stays, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predictions(docs, train(docs))
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans", "spans")
