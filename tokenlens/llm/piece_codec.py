"""Merge-type SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

A text is marked (blanks become U+2581, one in front) and cut into runs of marks with what follows. No piece
of the vocabulary holds a character and then a mark, so no merge crosses a cut, and a run's ids can be
kept and used again. Within a run, wherever two neighbours stand together in no piece, it is cut too.
Each new run is checked against the sentencepiece library, batch by batch; if the two differ, the library's ids
are used and the text's `n_differing` counts it.

Defined cases: a null or empty text has the end id only; very long texts are whole; repeated rows are
encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import CLOSING, Numbers, kept, slices, table

MARK = "▁"
RUN = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts that are empty, or where more than one blank stands between words, are cut into runs by RUN; others at their blanks.
ODD = f"^$|^ | $|  |{MARK}|\\x00"
#: Distinct runs whose ids a worker keeps (and sixteen times as many characters); beyond, it goes on with the half that it met first.
CACHED = 300_000
NEVER = 1 << 30
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_differing", pa.int64())])


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.id_of = {lib.id_to_piece(i): i for i in plain}
        self.rank = {p: -lib.get_score(i) for p, i in self.id_of.items() if len(p) > 1}
        self.byte_id = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.byte_id.items()}
        self.together = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any(x[1] == MARK != x[0] for x in self.together):
            raise ValueError("this vocabulary has pieces that cross a blank")
        self.end = lib.eos_id()
        # Joint pieces of two neighbours as a sorted table, and the order in which pieces are merged.
        joint = {(self.id_of[p[:k]] * size + self.id_of[p[k:]]): self.id_of[p] for p in self.rank for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of}
        self.size, self.pair_keys = size, np.array(sorted(joint), np.int64)
        self.pair_ids = np.array([joint[k] for k in self.pair_keys.tolist()], np.int64)
        levels = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        self.level = np.full(size + 1, NEVER, np.int32)
        for p, r in self.rank.items():
            self.level[self.id_of[p]] = levels[r]
        chars = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.char_codes = np.array(sorted(map(ord, chars)), np.int64)
        self.char_ids = np.array([chars[chr(c)] for c in self.char_codes.tolist()], np.int64)
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.ids: list[str] = []
        self.decoded: list[bytes] = []
        self.differing: set[int] = set()
        self.part_of = Numbers({"": 0})
        self.part_ids: list[list[int]] = [[]]

    def shrink(self, first: int) -> None:
        self.index.cut(first)
        n = len(self.index)
        del self.ids[n:], self.decoded[n:]
        self.differing = {k for k in self.differing if k < n}
        self.part_of, self.part_ids = Numbers({"": 0}), [[]]

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or `size` where there is none (or no neighbour)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left < self.size) & (right < self.size), self.pair_ids[at], self.size)

    def merge_many(self, parts: list[str]) -> list[list[int]]:
        """Like merge() for many parts of known characters: each part's agenda is a row of merge orders, its least is next."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        symbols = np.full((len(parts), width + 1), self.size, np.int64)
        symbols[:, :width][inside] = self.char_ids[np.searchsorted(self.char_codes, codes)]
        made = self.joint(symbols[:, :-1], symbols[:, 1:])
        agenda = self.level[made]
        rows, out = np.arange(len(parts)), np.empty((len(parts), width + 1), np.int64)
        place = np.arange(width + 1)
        while len(rows):
            at = agenda.argmin(1)
            more = agenda[np.arange(len(rows)), at] < NEVER
            if not more.all():
                out[rows[~more]] = symbols[~more]
                rows, at, symbols, made, agenda = rows[more], at[more], symbols[more], made[more], agenda[more]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            symbols[each, at] = made[each, at]
            source = place + (place > at[:, None])
            symbols = np.take_along_axis(np.pad(symbols, ((0, 0), (0, 1)), constant_values=self.size), source, 1)
            source = np.minimum(source[:, :-1], width)
            made = np.take_along_axis(np.pad(made, ((0, 0), (0, 1)), constant_values=self.size), source, 1)
            for k in (np.maximum(at - 1, 0), at):
                made[each, k] = self.joint(symbols[each, k], symbols[each, k + 1])
            agenda = self.level[made]
        keep = out < self.size
        ends = np.cumsum(keep.sum(1))
        flat = out[keep].tolist()
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def merge(self, part: str) -> list[int]:
        """Ids of a part: always merge the neighbours whose joint piece scores best, the leftmost of equals."""
        symbols, n, rank = list(part), len(part), self.rank
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for k in range(n - 1):
            if (r := rank.get(part[k : k + 2])) is not None:
                agenda.append((r, k, k + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, length = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != length:
                continue  # one of the two has been merged otherwise since
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (r := rank.get(s := symbols[a] + symbols[c])) is not None:
                    heapq.heappush(agenda, (r, a, c, len(s)))
            if (p := before[a]) >= 0 and (r := rank.get(s := symbols[p] + symbols[a])) is not None:
                heapq.heappush(agenda, (r, p, a, len(s)))
        ids = []
        for s in symbols:
            if s:
                if (i := self.id_of.get(s)) is not None:
                    ids.append(i)
                else:
                    ids += [self.byte_id[b] for b in s.encode()]
        return ids

    def learn(self) -> None:
        """Ids of the runs that are new in `index`, from those of their parts, held against the library's."""
        new, part_of, known = self.index.since(len(self.ids)), self.part_of, len(self.part_ids)
        pairs = []
        for run in new:
            core = run.rstrip(CLOSING)
            if 0 < len(core) < len(run) and run[len(core) - 1 : len(core) + 1] not in self.together:
                pairs.append((part_of[core], part_of[run[len(core) :]]))
            else:
                pairs.append((part_of[run], 0))
        fresh = part_of.since(known)
        self.part_ids += [None] * len(fresh)
        simple = {chr(c) for c in self.char_codes.tolist()}
        by_width: dict[int, list[int]] = {}
        for k, part in enumerate(fresh, known):
            if 1 < len(part) <= 32 and simple.issuperset(part):
                by_width.setdefault((len(part) + 3) // 4, []).append(k)
            else:
                self.part_ids[k] = self.merge(part)
        for own in by_width.values():
            for k, ids in zip(own, self.merge_many([fresh[k - known] for k in own])):
                self.part_ids[k] = ids
        theirs = self.library.encode([r[1:].replace(MARK, " ") for r in new], num_threads=1)
        for k, ((a, b), run, other) in enumerate(zip(pairs, new, theirs), len(self.ids)):
            ids = self.part_ids[a] + self.part_ids[b]
            if ids != other and run != MARK:  # the library adds no mark to an empty text
                self.differing.add(k)
                ids = other
            self.ids.append(" ".join(map(str, ids)))
            self.decoded.append(b"".join([self.bytes_of[i] for i in ids]))

    def runs(self, texts: pa.Array) -> list[list[int]]:
        """Numbers of each text's runs, whose ids are then known."""
        if self.index.full(CACHED):
            self.shrink(CACHED // 2)
        odd = pc.match_substring_regex(texts.fill_null(""), ODD)
        lists = pc.split_pattern(pc.if_else(odd, "", texts.fill_null("")), " ")
        at, cuts = self.index.of(lists.flatten(), MARK).tolist(), lists.offsets.to_pylist()
        out = [at[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = texts[k].as_py()
            out[k] = list(map(self.index.__getitem__, RUN.findall((MARK + text).replace(" ", MARK)))) if text else []
        if len(self.index) > len(self.ids):
            self.learn()
        return out

    def digests(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[int, str, str, int]]:
        found = self.runs(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))  # first: it may start the lists below afresh
        end, id_of, bytes_of = str(self.end), self.ids, self.decoded
        for runs in found:
            ids = " ".join([*map(id_of.__getitem__, runs), end])
            text = b"".join(map(bytes_of.__getitem__, runs))[1:].decode("utf-8", "replace")
            differing = sum(r in self.differing for r in runs) if self.differing else 0
            yield ids.count(" ") + 1, sha256(ids.encode()).hexdigest(), sha256(text.encode()).hexdigest(), differing

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for r in self.runs(pa.array([text], pa.string()))[0] for i in self.ids[r].split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of.get(i, b"") for i in ids])[1:].decode("utf-8", "replace")


def codec(path: str) -> PieceCodec:
    return kept(("pieces", path), lambda: PieceCodec(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """`docs` as (doc_id, ids array<int>, decoded string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            ids = [codec(path).encode(t) for t in batch.column("text").to_pylist()]
            decoded = [codec(path).decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            columns = zip(*codec(path).digests(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(ARROW)[1:]))], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
