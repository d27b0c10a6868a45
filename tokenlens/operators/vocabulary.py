"""Byte-pair vocabularies with ids: exact training in rounds of many merges, encoding to ids, artifacts, comparison.

Distinct pre-tokens are the table that training works on, each as a string of marked symbols: |61||62| are the bytes a and b, in
hexadecimal. Their pairs are counted once; from then on a round merges pairs in the words that hold them and adds the differences to the
counts (pair_index). A round takes as many of the best pairs as are sure to be next. Merging (a, b) changes the counts of
pairs that end in a or begin with b, and makes pairs that count at most as much as one of these; all other counts stay. So the best
pairs are next, in order, up to the first that ends in what one before it begins with, or the other way round. The merges and their order
are those of merging one pair at a time.

Units: "byte"; "grapheme" (clusters as atoms, bytes known too); "grapheme_constrained" (bytes, and a merge either stays within a
cluster or joins whole clusters; < and > mark where clusters begin and end). A pair whose bytes are in the vocabulary already is
never merged. Ties go to the smaller bytes on the left, then on the right. Null and empty texts have no words.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored
from .pair_index import PairIndex, merge_all, pairs_of, rule, symbols_of

UNITS = ("byte", "grapheme", "grapheme_constrained")
#: Pairs that a round looks at (a top-k; of each of L languages FAIR_TOP // L), and merges that it takes at most.
TOP, MOST, FAIR_TOP = 512, 128, 4096
#: Words that a task encodes at once, and words whose ids it keeps.
SLICE, KEPT = 1 << 16, 1 << 16
Merge = tuple[str, str, float]


def marked(word: Column, unit: str = "byte") -> Column:
    """A word as a string of marked symbols."""
    if unit not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    if unit == "byte":
        return F.regexp_replace(F.hex(F.encode(word, "utf-8")), "(..)", "|$1|")
    if unit == "grapheme":
        return F.array_join(F.transform(T.graphemes(word), lambda g: F.concat(F.lit("|"), F.hex(F.encode(g, "utf-8")), F.lit("|"))), "")
    ends = F.transform(T.graphemes(word), lambda g: F.regexp_replace(F.regexp_replace(F.concat(F.lit("<"), F.hex(F.encode(g, "utf-8")), F.lit(">")), "(<?..>?)", "|$1|"), r"\|\|", "||"))
    return F.array_join(ends, "")


def word_counts(docs: DataFrame, unit: str = "byte") -> DataFrame:
    """(word, cnt double, symbols): each distinct pre-token of docs(text), in its normal form."""
    words = docs.select(F.explode(T.pretokens(T.normal(F.coalesce("text", F.lit(""))))).alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("cnt"))
    return words.withColumn("symbols", marked(F.col("word"), unit))


class Counted:
    """What docs(lang, text) hold, each counted by one pass when it is first asked for and stored from then on.

    texts(lang, word, cnt): pre-tokens; words(lang, word, cnt): words between blanks. Null languages count as one.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def _count(self, units) -> DataFrame:
        rows = self.docs.select("lang", F.explode(units(T.normal(F.coalesce("text", F.lit(""))))).alias("word"))
        return stored(rows.groupBy("lang", "word").agg(F.count("*").alias("cnt")))

    @cached_property
    def texts(self) -> DataFrame:
        return self._count(T.pretokens)

    @cached_property
    def words(self) -> DataFrame:
        return self._count(T.words)

    def word_counts(self, unit: str = "byte") -> DataFrame:
        """Like word_counts() of the docs."""
        return self.texts.groupBy("word").agg(F.sum("cnt").cast("double").alias("cnt")).withColumn("symbols", marked(F.col("word"), unit))

    def language_words(self, unit: str = "byte") -> DataFrame:
        """Like language_words() of the docs."""
        return self.texts.where("lang IS NOT NULL").select("lang", "word", F.col("cnt").cast("double").alias("cnt"), marked(F.col("word"), unit).alias("symbols"))


def pair_counts(words: DataFrame, unit: str = "byte") -> DataFrame:
    """(left, right, cnt) over the pairs that may be merged."""
    return pairs_of(words, (), ("cnt",), unit).groupBy("left", "right").agg(F.sum("cnt").alias("cnt"))


def merge(symbols: Column, left: str, right: str, unit: str = "byte") -> Column:
    """Every occurrence of the pair, from left to right, as one symbol."""
    old, new = rule(left, right, unit)
    return F.regexp_replace(symbols, old, new) if unit == "grapheme_constrained" else F.replace(symbols, F.lit(old), F.lit(new))


def sure(top: list[tuple], known: set[str], most: int, complete: bool) -> list[Merge]:
    """Of pairs (left, right, count, closing) in order, those that are the next merges for certain; `complete` if there are no further pairs.

    What a merge makes counts at most as much as a pair that ends in its left symbol or begins with its right one. So the first such
    pair ends the list, and what counts no more than that is left for the next round. A merge also ends it if such a pair stands before it (it is never
    merged, as its bytes are a token), if it can follow itself, or if it is closing.
    """
    taken: list[Merge] = []
    lefts, rights, skipped_lefts, skipped_rights, made = set(), set(), set(), set(), set()
    bound = -1 if complete or not top else top[-1][2]
    for k, (left, right, cnt, closing) in enumerate(top):
        if right in lefts or left in rights or len(taken) == most:
            bound = cnt
            break
        if left + right in known or left + right in made:
            skipped_lefts.add(left)
            skipped_rights.add(right)
            continue
        taken.append((left, right, cnt))
        lefts.add(left)
        rights.add(right)
        made.add(left + right)
        if left == right or left in skipped_rights or right in skipped_lefts or closing:
            bound = top[k + 1][2] if k + 1 < len(top) else bound
            break
    return taken[:1] + [m for m in taken[1:] if m[2] > bound]


def train(words: DataFrame, merges: int, unit: str = "byte", most: int = MOST, known: set[str] | None = None) -> list[Merge]:
    """The first `merges` merges (left, right, cnt), symbols in hexadecimal; `known` are tokens that there are already besides bytes.

    A round is one job, and the driver holds its top pairs only; pairs that are never merged are not counted among the TOP.
    """
    out: list[Merge] = []
    known = {f"{b:02X}" for b in range(256)} | (known or set())
    index, skipped = PairIndex(words, unit), 0
    if unit == "grapheme":
        known |= {r.s for r in index.words.select(F.explode(F.array_distinct(symbols_of(F.col("symbols")))).alias("s")).distinct().collect()}  # the alphabet
    while len(out) < merges:
        rows = index.top(TOP + skipped)
        top = [(r.left, r.right, r.cnt, bool(r.closing) if unit == "grapheme_constrained" else False) for r in rows]
        taken = sure(top, known, min(most, merges - len(out)), len(top) < TOP + skipped)
        if not taken and len(top) < TOP + skipped:
            break
        skipped = sum(r.left + r.right in known for r in rows)
        if taken:
            out += [(a, b, float(c)) for a, b, c in taken]
            known |= {a + b for a, b, _ in taken}
            index.merge([(a, b) for a, b, _ in taken])
    index.release()
    return out


def language_words(docs: DataFrame, unit: str = "byte") -> DataFrame:
    """(lang, word, cnt double, symbols) for each distinct pre-token of each language; null languages are left out."""
    rows = docs.where("lang IS NOT NULL").select("lang", F.explode(T.pretokens(T.normal(F.coalesce("text", F.lit(""))))).alias("word"))
    return rows.groupBy("lang", "word").agg(F.count("*").cast("double").alias("cnt")).withColumn("symbols", marked(F.col("word"), unit))


def n_symbols(symbols: Column) -> Column:
    return ((F.length(symbols) - F.length(F.replace(symbols, F.lit("|"), F.lit("")))) / 2).cast("long")


def fair_batch(tops: dict[str, list[tuple]], complete: set[str], dev: dict[tuple, dict], tokens: dict[str, int], n_lines: dict[str, int], known: set[str]) -> tuple[list[tuple], bool]:
    """(merges (left, right, lang, count) that are the next ones for certain, whether the last of them changes `tokens` in a way to be counted anew).

    A merge takes from each language as many tokens as its `dev` text holds the pair, so the next language to help is known. Its best pair is known as
    well as long as no pair before it, or with the same count, ends in what a merge of this batch begins with or begins with what one ends in.
    `known` and `tokens` are brought up to date.
    """
    taken: list[tuple] = []
    lefts, rights = set(), set()
    while len(taken) < MOST:
        found = None
        for lang in sorted(tops, key=lambda x: (-tokens[x] / n_lines[x], x)):
            for k, (left, right, cnt) in enumerate(tops[lang]):
                if right in lefts or left in rights:
                    return taken, False
                if left + right not in known:
                    found = (left, right, lang, cnt)
                    break
            if found:
                equal = [p for p in tops[lang][k + 1 :] if p[2] == cnt]
                if taken and (any(r in lefts or l in rights for l, r, _ in equal) or (len(equal) == len(tops[lang]) - k - 1 and lang not in complete)):
                    return taken, False
                break
            if taken or lang not in complete:
                return taken, False
        if not found:
            return taken, False
        left, right, lang, cnt = found
        taken.append(found)
        known.add(left + right)
        lefts.add(left)
        rights.add(right)
        if left == right:
            return taken, True
        for x, n in dev.get((left, right), {}).items():
            if x in tokens:
                tokens[x] -= n
    return taken, False


def train_fair(train_words: DataFrame, dev_words: DataFrame, lines: DataFrame, merges: int) -> list[tuple[str, str, str, float]]:
    """Merges (left, right, lang, cnt), each for the language that is worst off: most tokens per line of `dev_words`, then the first by name.

    Its best pair in `train_words` is merged in all languages. A language without a pair passes its turn on. lines(lang, n_lines). A round takes the
    merges that are sure to be next, see fair_batch(); the driver gets some pairs of each language, and what each language holds of them.
    """
    known = {f"{b:02X}" for b in range(256)}
    out: list[tuple[str, str, str, float]] = []
    sides = [df.select("lang", "symbols", *(F.when(F.lit(k == side), F.col("cnt")).otherwise(0).alias(c) for k, c in enumerate(("train", "dev")))) for side, df in enumerate((train_words, dev_words))]
    if train_words is dev_words:
        words = train_words.select("lang", "symbols", F.col("cnt").alias("train"), F.col("cnt").alias("dev"))
    else:
        words = sides[0].union(sides[1]).groupBy("lang", "symbols").agg(F.sum("train").alias("train"), F.sum("dev").alias("dev"))
    index = PairIndex(words, "byte", ("lang",), ("train", "dev"))
    n_lines = {r.lang: r.n_lines for r in lines.collect()}  # a row per language
    count_tokens = lambda: {r.lang: r.n for r in index.words.groupBy("lang").agg(F.sum(F.col("dev") * n_symbols(F.col("symbols"))).alias("n"), F.sum("dev").alias("any")).where("any > 0").collect() if r.lang in n_lines}
    tokens, k = count_tokens(), max(8, FAIR_TOP // max(1, len(n_lines)))
    while len(out) < merges and tokens:
        rows = index.top(k, "train")
        tops: dict[str, list[tuple]] = {lang: [] for lang in tokens}
        for r in rows:
            tops.get(r.lang, []).append((r.left, r.right, r.train))
        complete = {lang for lang, pairs in tops.items() if len(pairs) < k}
        listed = words.sparkSession.createDataFrame(sorted({(r.left, r.right) for r in rows}), "left string, right string")
        dev: dict[tuple, dict] = {}
        for r in index.pairs.where("dev > 0").join(F.broadcast(listed), ["left", "right"], "left_semi").collect():  # k pairs of each language
            dev.setdefault((r.left, r.right), {})[r.lang] = r.dev
        taken, anew = fair_batch(tops, complete, dev, tokens, n_lines, known)
        if not taken and len(complete) == len(tops):
            break
        if not taken:  # all pairs of a language are known ones
            k *= 2
            continue
        over = max(0, len(out) + len(taken) - merges)
        out += [(a, b, lang, float(c)) for a, b, lang, c in taken][: len(taken) - over]
        index.merge([(a, b) for a, b, _, _ in taken])
        if anew:
            tokens = count_tokens()
    index.release()
    return out


def arms_compared(words: DataFrame, lines: DataFrame, arms: dict[str, list[tuple]], reference: str = "en") -> DataFrame:
    """(arm, lang, n_tokens, per_line, premium): each arm's merges, in order, over the same words(lang, symbols, cnt)."""
    done = None
    for name, merges in arms.items():
        _, symbols = merge_all(F.col("symbols"), [m[:2] for m in merges])
        one = words.groupBy("lang").agg(F.sum(F.col("cnt") * n_symbols(symbols)).cast("long").alias("n_tokens")).withColumn("arm", F.lit(name))
        done = one if done is None else done.union(one)
    rows = done.join(F.broadcast(lines), "lang")  # a row per language
    base = F.max(F.when(F.col("lang") == reference, F.col("n_tokens"))).over(Window.partitionBy("arm"))
    return rows.select("arm", "lang", "n_tokens", F.round(F.col("n_tokens") / F.col("n_lines"), 9).alias("per_line"), F.round(F.col("n_tokens") / base, 9).alias("premium"))


def vocabulary(merges: list[Merge], alphabet: list[str] | None = None) -> list[str]:
    """Tokens in hexadecimal by id: the 256 bytes, further atoms, then what each merge makes."""
    atoms = [f"{b:02X}" for b in range(256)]
    atoms += sorted(set(alphabet or ()) - set(atoms))
    return atoms + [a + b for a, b, _ in merges]


def merges_table(spark: SparkSession, merges: list[Merge]) -> DataFrame:
    return spark.createDataFrame([(k, a, b, float(c)) for k, (a, b, c) in enumerate(merges)], "rank int, left string, right string, cnt double")


class Encoder:
    """Ids of pre-tokens: always the neighbours whose merge has the lowest rank, the leftmost of equals.

    Candidates wait in a heap by rank and place, and neighbours are linked, so a word of n symbols takes n log n steps. `tokens` are in the order
    of their ids, or a table of ids; a word that is a token already but that no merges make up is still encoded by merges.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens: list[bytes] | dict[bytes, int], graphemes: bool = False):
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(merges):
            self.rank.setdefault(m, k)
        self.ids = tokens if isinstance(tokens, dict) else {t: k for k, t in enumerate(tokens)}
        self.graphemes, self.known = graphemes, {}

    def atoms(self, word: str) -> list[bytes]:
        if not self.graphemes:
            return [bytes([b]) for b in word.encode()]
        import regex

        parts = [g.encode() for g in regex.findall(r"\X", word)]
        return [x for g in parts for x in ([g] if g in self.ids else [bytes([b]) for b in g])]

    def merged(self, symbols: list[bytes | None]) -> list[bytes]:
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get((a, b))) is not None]
        heapify(heap)
        while heap:
            _, k, a, b = heappop(heap)
            right = after[k]
            if symbols[k] != a or right >= n or symbols[right] != b:  # one of them has been merged since
                continue
            symbols[k], symbols[right] = a + b, None
            after[k] = end = after[right]
            if end < n:
                before[end] = k
                if (r := rank.get((a + b, symbols[end]))) is not None:
                    heappush(heap, (r, k, a + b, symbols[end]))
            if (left := before[k]) >= 0 and (r := rank.get((symbols[left], a + b))) is not None:
                heappush(heap, (r, left, symbols[left], a + b))
        return [s for s in symbols if s is not None]

    def encode(self, word: str) -> list[int]:
        if (ids := self.known.get(word)) is None:
            ids = [self.ids[s] for s in self.merged(self.atoms(word))]
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = ids
        return ids


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of about SLICE words of a batch's `words`, of one row at least."""
    n = pa.compute.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // SLICE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(docs: DataFrame, merges: list[Merge], alphabet: list[str] | None = None) -> DataFrame:
    """(doc_id, lang, ids array<int>) for docs(doc_id, lang, text), in the order of the text. The vocabulary goes to every task.

    A task takes as many texts at once as hold SLICE words, or one text, and each distinct word among them becomes ids once.
    """
    tokens = [bytes.fromhex(t) for t in vocabulary(merges, alphabet)]
    pairs = [(bytes.fromhex(a), bytes.fromhex(b)) for a, b, _ in merges]
    graphemes = alphabet is not None
    rows = docs.select("doc_id", "lang", T.pretokens(T.normal(F.coalesce("text", F.lit("")))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pairs, tokens, graphemes)
        for batch in batches:
            for part in _slices(batch):
                words = part.column("words").flatten().dictionary_encode()
                ids = pa.array([encoder.encode(w) for w in words.dictionary.to_pylist()], pa.list_(pa.int32())).take(words.indices)
                ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64)])
                texts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(part.column("words")).to_numpy(zero_copy_only=False), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.ListArray.from_arrays(pa.array(ends[texts], pa.int32()), ids.flatten())], ["doc_id", "lang", "ids"])

    return rows.mapInArrow(run, "doc_id long, lang string, ids array<int>")


def superwords(tokens: list[str]) -> int:
    """Tokens (in hexadecimal) with a blank behind their first byte."""
    return sum("20" in [t[k : k + 2] for k in range(2, len(t), 2)] for t in tokens)


def train_superwords(docs: DataFrame, first: int, second: int, most_bytes: int = 128) -> list[Merge]:
    """Two stages: `first` merges within pre-tokens, then `second` more over whole lines with those merges applied.

    Lines are cut into units of at most `most_bytes` bytes' worth of pre-tokens; there, merges may cross blanks.
    """
    merges = train(word_counts(docs), first)
    lines = docs.select(F.explode(F.split(T.normal(F.coalesce("text", F.lit(""))), "\n")).alias("line")).where("line <> ''")
    words = lines.select(F.monotonically_increasing_id().alias("line"), T.pretokens(F.col("line")).alias("words"))
    # A unit is a run of pre-tokens; a new one begins where the running size passes a multiple of most_bytes.
    size = F.aggregate("words", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")), lambda a, w: F.struct((a["n"] + F.octet_length(w)).alias("n"), F.concat(a["at"], F.array((a["n"] / most_bytes).cast("int"))).alias("at")), lambda a: a["at"])
    rows = words.withColumn("at", size).select("line", F.posexplode(F.arrays_zip("words", "at")).alias("place", "w"))
    units = rows.groupBy("line", F.col("w.at").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("w.words").alias("word")))), lambda x: x["word"]), "").alias("word"))
    counted = units.groupBy("word").agg(F.count("*").cast("double").alias("cnt")).withColumn("symbols", marked(F.col("word")))
    _, symbols = merge_all(F.col("symbols"), [m[:2] for m in merges])
    return merges + train(counted.withColumn("symbols", symbols), second, known={a + b for a, b, _ in merges})


def save(path: str, merges: list[Merge], unit: str, alphabet: list[str] | None = None) -> dict:
    """Write {path}/tokenizer.json: unit, sizes, vocabulary by id and merges in base64."""
    from ..sources.files import write_json

    b64 = lambda h: base64.standard_b64encode(bytes.fromhex(h)).decode()
    tokens = vocabulary(merges, alphabet)
    payload = {"unit": unit, "target_vocab_size": len(tokens), "vocab_size": len(tokens), "vocab": [b64(t) for t in tokens], "merges": [[b64(a), b64(b)] for a, b, _ in merges]}
    write_json(f"{path}/tokenizer.json", payload)
    return payload


def load(path: str) -> tuple[list[bytes], list[tuple[bytes, bytes]], str]:
    """(tokens by id, merges, unit) of an artifact."""
    with open(f"{path}/tokenizer.json", encoding="utf-8") as file:
        data = json.load(file)
    raw = base64.standard_b64decode
    return [raw(t) for t in data["vocab"]], [(raw(a), raw(b)) for a, b in data["merges"]], data["unit"]
