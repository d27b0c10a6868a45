"""Removal of repeated 200-byte strings with suffix sorting in small, content-chosen groups.

Sorting every suffix of the corpus together would make one task see it all. Equal 200-byte strings hold the same
64-byte strings, so both have their least-hashed 64-byte string (the anchor) at the same place. All windows of
SPAN bytes are therefore dealt by anchor: a run of windows with one anchor is a segment, and only segments with equal
anchor hash can share a window. (1) Segments whose anchor is alone drop out. (2) Segments with equal bytes are one class;
a class of two or more is repeated whole. (3) Where classes share an anchor, a group's window starts are suffix-sorted,
deep-shallow: multikey sorting on eight-byte characters to SHALLOW bytes, then a blind trie orders what still
ties; neighbours in that order that share SPAN bytes are repeats. (4) Groups of more than GROUP classes are settled by counting
128-bit digests of blocks of windows, cut ever finer, which gathers no group.

Texts are bytes in UTF-8. Rows are told apart by a hash of doc_id and text. Defined cases: a null text is empty; texts under
SPAN bytes lose nothing; repeated rows are repeats of each other; equal strings are all removed, none is kept as the first; a
very long text is cut into overlapping parts of PART bytes, which meet like any others; an empty table gives an empty result;
op10 ignores other columns and remove_repeats() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, release, slices, stored, table, whole_groups

SPAN, ANCHOR, SHALLOW, GROUP = 200, 64, 32, 1024
#: Bytes of text whose windows are dealt at a time; ranks hold places in 24 bits, so that they are the same for any such part.
PART = 1 << 18
#: Windows in a block, from coarse to fine, where a group has more than GROUP classes.
BLOCKS = (64, 16, 4, 1)
_WIDTH = SPAN - ANCHOR + 1
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64, kept and grown when needed."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, PART + SPAN)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed rolling hash of each ANCHOR bytes."""
    up, down = _power(len(data))
    sums = np.cumsum(_TABLE[data] * up, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], sums])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, class) of all segments: `windows` window starts from `start` on have one anchor."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = b"".join(texts)
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(whole) < SPAN:
        return empty
    h = anchor_hashes(np.frombuffer(whole, np.uint8))
    if len(whole) >> 24:
        raise ValueError("more than 16 MB of text at a time")
    mask = np.uint64((1 << 24) - 1)
    n = len(whole) - SPAN + 1
    # Ties between equal hashes go to the rightmost, in any text alike.
    ranked = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    blocks = -(-len(ranked) // _WIDTH)
    padded = np.full(blocks * _WIDTH, ~np.uint64(0))
    padded[: len(ranked)] = ranked
    padded = padded.reshape(blocks, _WIDTH)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[_WIDTH - 1 : _WIDTH - 1 + n])
    anchor = (mask - (least & mask)).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    # A window is valid if it ends within the text where it starts.
    own = np.repeat(np.arange(len(texts)), lengths)[:n]
    valid = np.arange(n) + SPAN <= (begin + lengths)[own]
    changes = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(own) != 0) | (np.diff(valid) != 0)) + 1
    first = np.concatenate([[0], changes])
    windows = np.diff(np.concatenate([first, [n]]))
    good = valid[first]
    first, windows = first[good], windows[good]
    view = memoryview(whole)
    classes = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + windows + SPAN - 1).tolist())), np.uint64, len(first))
    text = own[first]
    return text, first - begin[text], windows, h[anchor[first]].view(np.int64), classes.view(np.int64)


def parts_of(texts: list[bytes], most: int = PART) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, start, bytes) in lists of about `most` bytes; parts of one text overlap, so that each window is in exactly one part."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - SPAN + 1), most):
            part = text[a : a + most + SPAN - 1]
            if size + len(part) > most + SPAN and held:
                yield held
                held, size = [], 0
            held.append((k, a, part))
            size += len(part)
    if held:
        yield held


def multikey(words: np.ndarray, at: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Multikey quicksort of the strings that begin at `at`, group by group, down to SHALLOW bytes, eight at a time.

    All buckets of a level are split at once: below, equal to and above a pivot; what equals it goes on eight bytes deeper.
    Returns the buckets that still tie at SHALLOW bytes. `words` are the eight bytes from each position on, as numbers.
    """
    order = np.argsort(group, kind="stable")
    bucket = np.cumsum(np.concatenate([np.zeros(min(1, len(order)), np.int64), np.diff(group[order]) != 0]))
    depth, tied = np.zeros(len(order), np.int64), []
    while len(order):
        first = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
        size = np.diff(np.concatenate([first, [len(order)]]))
        word = words[at[order] + depth]
        three = np.sort(np.stack([word[first], word[first + size // 2], word[first + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        key = np.repeat(np.arange(len(first)), size) * 3 + side
        by = np.argsort(key, kind="stable")
        order, key, depth = order[by], key[by], depth[by] + 8 * (side[by] == 1)
        bucket = np.cumsum(np.concatenate([[0], np.diff(key) != 0]))
        more = np.bincount(bucket)[bucket] > 1  # what is alone is in its place
        deep = more & (depth >= SHALLOW)
        if deep.any():
            tied += np.split(order[deep], np.flatnonzero(np.diff(bucket[deep])) + 1)
        go = more & ~deep
        order, bucket, depth = order[go], bucket[go], depth[go]
    return tied


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Numbers of strings of one length in order, and how many bytes each shares with the one before it (0 for the first).

    The trie branches on the byte where strings first differ and holds no skipped bytes: a string goes down blindly to any leaf,
    is compared with it once, and branches off where they differ. Equal strings share a leaf.
    """
    length = len(strings[0])
    root: list | tuple = [0]
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while type(node) is tuple:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf = strings[node[0]]
        if s == leaf:
            node.append(k)
            continue
        at = length - ((int.from_bytes(s) ^ int.from_bytes(leaf)).bit_length() + 7) // 8
        parent, node = None, root
        while type(node) is tuple and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == at:
            node[1][s[at]] = [k]
            continue
        made = (at, {leaf[at]: node, s[at]: [k]})
        if parent is None:
            root = made
        else:
            parent[1][s[parent[0]]] = made
    order, shared, stack = [], [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if type(node) is tuple:
            children = sorted(node[1].items())
            # The first child follows what was before the node; the others follow a sibling.
            stack += [(child, node[0] if i else depth) for i, (_, child) in reversed(list(enumerate(children)))]
        else:
            order += node
            shared += [depth, *[length] * (len(node) - 1)]
    return order, shared


def repeated_windows(group: np.ndarray, copies: np.ndarray, windows: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For all windows of all segments, in order: is it found twice or more among its group (copies counted)?"""
    total = int(windows.sum())
    segment = np.repeat(np.arange(len(texts)), windows)
    lengths = windows + SPAN - 1
    data = b"".join(texts) + bytes(8)
    at = np.arange(total) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(windows) - windows), windows)
    codes, words = np.frombuffer(data, np.uint8), np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        words <<= np.uint64(8)
        words |= codes[k : k + len(words)]
    repeated = (copies > 1)[segment]
    for bucket in multikey(words, at, group[segment]):
        order, shared = blind_trie([data[a : a + SPAN] for a in at[bucket].tolist()])
        # Neighbours that share SPAN bytes are the same string.
        same = np.array([*shared, 0]) >= SPAN
        repeated[bucket[order]] |= same[:-1] | same[1:]
    return repeated


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeats(docs: DataFrame) -> DataFrame:
    """(rid, runs array<struct<start, windows>>) for texts with repeated windows; docs has (rid, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", 1 << 20):
            rids = batch.column("rid").to_numpy()
            for parts in parts_of([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]):
                text, start, windows, key, kind = segments([p for _, _, p in parts])
                rid = rids[np.array([k for k, _, _ in parts])[text]]
                start = start + np.array([a for _, a, _ in parts])[text]
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(key), pa.array(kind)], ["rid", "start", "windows", "key", "kind"])
        release()

    found = stored(docs.select("rid", "text").mapInArrow(find, "rid long, start int, windows int, key long, kind long"))
    shared = found.groupBy("key").agg(F.count("*").alias("n"), F.min("kind").alias("one"), F.max("kind").alias("other")).where("n > 1")
    shared = stored(shared.select(F.col("key").alias("k"), (F.col("one") == F.col("other")).alias("single")))
    met = stored(found.join(shared, found.key == shared.k).drop("k"))
    mixed = met.where("NOT single").drop("single")
    classes = mixed.groupBy("key", "kind").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "windows")).alias("first"))
    classes = stored(classes.select(F.col("key").alias("k"), F.col("kind").alias("c"), "copies", "first.*"))
    counts = classes.select("k", "c").where("copies > 1")
    again = mixed.join(counts, (mixed.key == counts.k) & (mixed.kind == counts.c))
    whole = met.where("single").select("rid", "start", "windows").union(again.select("rid", "start", "windows"))
    # One text per class, cut out of its first row.
    sized = classes.groupBy("k").agg(F.count("*").alias("size")).select(F.col("k").alias("g"), "size")
    sized = classes.join(sized, classes.k == sized.g)
    wanted = sized.groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "k", "copies", "size")).alias("cuts")).withColumnRenamed("rid", "r")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for rid, text, cuts in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cuts").to_pylist()):
                rows += [(c["k"], c["copies"], c["size"], rid, c["start"], c["windows"], text[c["start"] : c["start"] + c["windows"] + SPAN - 1]) for c in cuts]
            columns = zip(*rows)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k", "copies", "size", "rid", "start", "windows", "bytes"])

    texts = docs.select("rid", "text").join(wanted, F.col("rid") == F.col("r")).select("rid", "text", "cuts").dropDuplicates(["rid"])
    pieces = stored(texts.mapInArrow(cut, "k long, copies long, size long, rid long, start int, windows int, bytes binary"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("k",), 1024):
            copies, windows = batch.column("copies").to_numpy(), batch.column("windows").to_numpy().astype(np.int64)
            flags = repeated_windows(batch.column("k").to_numpy(), copies, windows, batch.column("bytes").to_pylist())
            ends = np.cumsum(windows)
            rid, start = batch.column("rid").to_pylist(), batch.column("start").to_pylist()
            rows = [(rid[k], start[k] + a, b - a) for k in np.flatnonzero(copies == 1).tolist() for a, b in _runs(flags[ends[k] - windows[k] : ends[k]])]
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), kinds)], ["rid", "start", "windows"])

    run_schema = "rid long, start int, windows int"
    few = pieces.where(F.col("size") <= GROUP).select("k", "copies", "rid", "start", "windows", "bytes").repartition("k").sortWithinPartitions("k").mapInArrow(sort, run_schema)

    many = repeated_blocks(pieces.where(F.col("size") > GROUP).select("k", "copies", "rid", "start", "windows", "bytes"))
    return whole.union(few).union(many).groupBy("rid").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))


PIECE = "copies long, rid long, start int, windows int, place int, bytes binary"
BLOCK = PIECE + ", union_digest binary, core_digest binary"


def _record(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def blocks_of(place: int, windows: int, data: bytes, size: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first window, windows, union, core) of the aligned blocks of `size` places that a run of windows is cut into.

    A window's place is how far its anchor is behind its start; `place` is that of the first window. The union is all
    bytes of the block's windows; the core is what every window of the block, cut off or not, has in common.
    """
    a = 0
    while a < windows:
        low = (place - a) // size * size
        b = min(windows, place - low + 1)
        high = min(low + size - 1, _WIDTH - 1)
        yield a, b - a, data[a : b - 1 + SPAN], data[place - low : place - high + SPAN]
        a = b


def repeated_blocks(pieces: DataFrame) -> DataFrame:
    """(rid, start, windows) of the repeated windows of groups of any size, by blocks of windows.

    Two blocks with equal unions are repeated whole; a block whose core is alone has no repeated window; what
    is neither is cut finer, down to single windows, and is counted together with one copy of each union found twice
    that has the same core. Only digests are counted, so no group is gathered, and a passage shared by many texts
    is told by a few blocks a text.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = np.flatnonzero(anchor_hashes(np.frombuffer(r["bytes"], np.uint8)[:SPAN]).view(np.int64) == r["k"])
                rows.append((r["copies"], r["rid"], r["start"], r["windows"], int(found[-1]), r["bytes"]))
            yield _record(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()], ["copies", "rid", "start", "windows", "place", "bytes"])

    def cut_into(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    for a, n, union, core in blocks_of(r["place"], r["windows"], r["bytes"], size):
                        rows.append((r["copies"], r["rid"], r["start"] + a, n, r["place"] - a, union, xxhash.xxh3_128_digest(union), xxhash.xxh3_128_digest(core)))
                yield _record(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["copies", "rid", "start", "windows", "place", "bytes", "union_digest", "core_digest"])

        return run

    left, out = pieces.mapInArrow(placed, PIECE), []
    for size in BLOCKS:
        blocks = stored(left.mapInArrow(cut_into(size), BLOCK))
        unions = checkpointed(blocks.groupBy("union_digest").agg(F.sum("copies").alias("n"), F.min(F.struct("rid", "start")).alias("first")).where("n > 1").select(F.col("union_digest").alias("d"), "first"))
        equal, single = F.col("union_digest") == F.col("d"), blocks.where("copies = 1")
        out.append(single.select("rid", "start", "windows", "union_digest").join(unions, equal, "left_semi").select("rid", "start", "windows"))
        cores = blocks.groupBy("core_digest").agg(F.sum("copies").alias("n")).where("n > 1").select(F.col("core_digest").alias("d"))
        open_ = checkpointed(single.join(unions, equal, "left_anti").join(cores, F.col("core_digest") == F.col("d"), "left_semi"))
        # What is known to be repeated only counts from here on: one row a union, while an open block has its core.
        known = blocks.join(unions, equal & (F.col("rid") == F.col("first.rid")) & (F.col("start") == F.col("first.start"))).withColumn("copies", F.lit(2).cast("long"))
        known = known.join(open_.select(F.col("core_digest").alias("c")).distinct(), F.col("core_digest") == F.col("c"), "left_semi")
        part = "copies", "rid", "start", "windows", "place", "bytes"
        left = open_.select(*part).union(known.select(*part))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def _removed(n: int, runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs [a, b) of a text of n bytes."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["start"] + r["windows"] - 1 + SPAN) for r in runs or ()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(text)]
    return b"".join([text[a:b] for a, b in zip(cuts[::2], cuts[1::2])])


def _with_runs(docs: DataFrame) -> DataFrame:
    """(row, runs): each row of `docs` as a struct, so that no column name of theirs can clash, and its repeated windows."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text", F.struct("*").alias("row"))
    runs = stored(repeats(rows)).select(F.col("rid").alias("r"), "runs")
    return rows.drop("text").join(runs, F.col("rid") == F.col("r"), "left").select("row", "runs")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated strings cut out of `text` (a character cut in two goes whole) and `n_chars`, if there, renewed.

    A null text stays null; a text that is repeated as a whole becomes empty; no row is dropped.
    """
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", 2 << 20):
            out = []
            for text, runs in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(columns)).to_pylist()):
                out.append(text.decode() if not runs and text is not None else text and _kept(text, _removed(len(text), runs)).decode("utf-8", "ignore"))
            new = {"text": pa.array(out, pa.string())}
            if "n_chars" in columns:
                kind = batch.schema.field(columns.index("n_chars")).type
                new["n_chars"] = pa.array([t if t is None else len(t) for t in out]).cast(kind)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for k, c in enumerate(columns)], columns)
        release()

    fields = [F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(columns)]
    return _with_runs(docs).select(*fields, F.col("runs").alias("runs")).mapInArrow(run, docs.schema)


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
                text = text or b""
                spans = _removed(len(text), runs)
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), sha256(_kept(text, spans)).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(docs).select("row.*", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
