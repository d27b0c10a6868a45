"""Hierarchical multi-length packing of token ids.

Each task packs the texts of its own input split, so nothing is shuffled. Full windows are cut from
long texts; what is left of a text goes to the shortest tier that holds it. Tiers are packed from long
to short: a window opens with the longest waiting piece of its tier and its gap is filled from shorter
tiers, whole pieces first, at last with a cut piece. The one window of a round that stays open is cut at
powers of two, so no sequence needs padding. Sequences of all tiers are interleaved and cut into step
groups of equal tokens.

Defined cases: a null text is empty and has only its end id; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored. A text is held whole in memory by one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Numbers, is_plain, kept, release, slices, table

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 64 * 2048
END = 1
#: Distinct units of text whose ids a worker keeps (and sixteen times as many characters); beyond, it goes on with the half that it met first.
CACHED = 250_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


#: Letters, numerals and white space of Latin-1, in lower case, as in the classes \p{L}, \p{N} and \s of the tokenizer's pattern.
_LETTERS, _NUMERALS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
#: What the tokenizer's own pattern finds besides runs of letters (fixed values), over lower-case texts of Latin-1.
BETWEEN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_NUMERALS}]|[^{_BLANKS}{_LETTERS}{_NUMERALS}]+"
#: Texts with other characters, with control characters, or with what may be a special token are cut at blanks only.
ODD = "[^\x01-\xff]|[\x1c-\x1f]|<\\|"


class UnitEncoder:
    """Ids of texts, unit by unit: the tokenizer encodes what its pattern finds one by one, and drops white space.

    A batch is lower-cased, cut and listed once per distinct unit by Arrow; ids of the units seen before are kept. New
    units of letters only are encoded many in one text and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = Numbers({"": 0, "\n": 1})  # no unit is a line feed: it stands for the end id
        self.flat, self.starts, self.lengths = np.array([END], np.uint32), np.array([0, 0]), np.array([0, 1])

    def shrink(self, first: int) -> None:
        self.index.cut(max(2, first))
        n = len(self.index)
        self.starts, self.lengths = self.starts[:n].copy(), self.lengths[:n].copy()
        self.flat = self.flat[: int((self.starts + self.lengths).max())].copy()

    def learn(self) -> None:
        """Ids of the units that are new in `index`."""
        new = self.index.since(len(self.starts))
        ids: list = [None] * len(new)
        plain = [k for k, u in enumerate(new) if is_plain(u)]
        rest = [k for k, u in enumerate(new) if not is_plain(u)]
        groups = [plain[a : a + 512] for a in range(0, len(plain), 512)]
        for own, encoding in zip(groups, self.tokenizer.encode_batch_fast([" ".join([new[k] for k in g]) for g in groups], add_special_tokens=False)):
            got = encoding.ids
            ends = (np.flatnonzero(self.ends_word[got]) + 1).tolist()
            if len(ends) != len(own):
                rest += own
                continue
            for k, a, b in zip(own, [0, *ends], ends):
                ids[k] = got[a:b]
        for k, encoding in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False)):
            ids[k] = encoding.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' units, and how many each text has."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, "", texts)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), BETWEEN, r" \0 "))
        at, counts = self.index.of(lists.flatten()), np.diff(lists.offsets.to_numpy())
        if pc.any(odd).as_py():
            parts = np.split(at, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                parts[k] = np.fromiter(map(self.index.__getitem__, texts[k].as_py().replace("\n", " ").split(" ")), np.int64)
            at, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return at, counts

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END behind it, in one array; where each text begins in it."""
        if self.index.full(CACHED):
            self.shrink(CACHED // 2)
        at, counts = self.units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if len(self.index) > len(self.starts):
            self.learn()
        at = np.insert(at, np.cumsum(counts), 1)
        ends = np.flatnonzero(at == 1)
        n = self.lengths[at]
        after = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[at] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate([[0], after[ends]])


def encoder(path: str) -> UnitEncoder:
    return kept(("units", path), lambda: UnitEncoder(path))


class _Waiting:
    """Pieces (length, text, start) by length, shortest first; take() prefers the longest that fits."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted(pieces)

    def take(self, room: int, below: int) -> tuple[int, int, int] | None:
        """The longest piece of at most `room` ids, among those of less than `below` ids; else a cut from the shortest piece."""
        if not self.pieces:
            return None
        k = min(bisect_right(self.pieces, (room, 1 << 62, 0)), bisect_right(self.pieces, (below - 1, 1 << 62, 0)))
        if k:
            return self.pieces.pop(k - 1)
        n, text, start = self.pieces.pop(0)
        if n > room:
            rest = (n - room, text, start + room)
            self.pieces.insert(bisect_right(self.pieces, rest), rest)
        return min(n, room), text, start


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces) over texts of these lengths; a piece is (length, text, start), and each id is in exactly one."""
    top, done, waiting = tiers[-1], [], []
    for k, n in enumerate(lengths):
        done += [(top, [(top, k, i)]) for i in range(0, n - top + 1, top)]
        if n % top:
            waiting.append((n % top, k, n - n % top))
    left = _Waiting(waiting)
    while left.pieces:
        n = left.pieces[-1][0]
        tier = next(t for t in tiers if t >= n)
        window, room = [left.pieces.pop()], tier - n
        while room and (piece := left.take(room, tier // 2 + 1)):
            window.append(piece)
            room -= piece[0]
        if not room:
            done.append((tier, window))
            continue
        total = tier - room  # the last window: its ids are cut at the powers of two of their number
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        while sizes:
            size, own = sizes.pop(0), []
            need = size
            while need:
                n, text, start = window[0]
                own.append((min(n, need), text, start))
                window[0] = (n - own[-1][0], text, start + own[-1][0])
                need -= own[-1][0]
                if not window[0][0]:
                    window.pop(0)
            done.append((size, own))
    return done


def interleaved(sequences: list) -> list:
    """Spread the sequences of every tier evenly, so that step groups cut from this order hold the same mix of lengths."""
    count: dict[int, int] = {}
    for tier, _ in sequences:
        count[tier] = count.get(tier, 0) + 1
    seen: dict[int, int] = {}
    keyed = []
    for k, (tier, pieces) in enumerate(sequences):
        seen[tier] = seen.get(tier, 0) + 1
        keyed.append(((seen[tier] - 0.5) / count[tier], k, tier, pieces))
    return [(tier, pieces) for _, _, tier, pieces in sorted(keyed, key=lambda x: x[:2])]


def packed(docs: DataFrame, path: str) -> DataFrame:
    """A row per piece of the texts of `docs`(doc_id, text); see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        sequence = tokens = 0
        for batch in slices(batches, "text"):
            doc_id = batch.column("doc_id").to_pylist()
            ids, begin = encoder(path).encode(batch.column("text"))
            n = np.diff(begin).tolist()
            begin = begin.tolist()
            rows = []
            for tier, pieces in interleaved(pack(n)):
                offset = 0
                for length, text, start in pieces:
                    a = begin[text] + start
                    rows.append((doc_id[text], start, length, zlib.crc32(ids[a : a + length]), n[text], base + sequence, offset, tier, base + tokens // STEP_TOKENS))
                    offset += length
                sequence += 1
                tokens += tier
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
        release()  # what is kept would lie beside the JVM in later stages

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
