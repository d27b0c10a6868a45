import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenlens.llm import katz, language_id, licenses, packing, piece_codec, queries, quality_rules, sharding, shingles, simhash, spherical_caps, suffix_dedup


ODD_TEXTS = ["it's 12.5 don't!'s 1's O'Reilly", "<|endoftext|> a<|b|>", "  lead\ttab\x0bx\x85y\xa0z ", "É é Ñ ² ½x µ ª", "日本語 ok Ω", "", None, "   ", " ", "a\x1cb", "x\n\ny...!!!@#  '", "\x00nul x", "ß ẞ İ ÀÉ", "'S 'LL 'D we'LL", "▁a ▁▁b", " x", "x ", "a  b", "<s> </s> <0x0A>", "q" * 70_000, "word " * 40_000]


def run(spark, name, path):
    return queries.queries()[name](spark, path).collect()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


def test_extra_columns_do_not_matter(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clash = ("key", "fp", "node", "rid", "r", "k", "bucket", "range", "h", "id", "runs", "start", "row", "f", "same", "kind", "form", "lines", "words", "label", "size", "shard", "place", "train", "block")
    docs = docs.selectExpr("*", *(f"'x' AS {c}" for c in clash))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors.selectExpr("*", *(f"'x' AS {c}" for c in ("node", "place", "filter", "filters", "class", "copies", "chunk", "meet"))).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").selectExpr("*", *(f"'x' AS {c}" for c in ("text", "chance", "size", "before", "word"))).write.parquet(str(tmp_path / "labels.parquet"))
    for name in queries.queries():
        if name not in ("op4_vectors", "op5_packing", "op13_divergence", "pipeline"):
            assert len(run(spark, name, str(tmp_path))) == docs.count(), name
    assert run(spark, "op13_divergence", str(tmp_path)) and len(run(spark, "op4_vectors", str(tmp_path))) == vectors.count() and run(spark, "op5_packing", str(tmp_path))
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, "")
        assert left.columns == docs.columns and all(r[c] == "x" for r in left.collect() for c in clash), name


def test_language(spark, data, documents):
    got = {r.doc_id: r for r in run(spark, "op1_language", data)}
    for d in documents:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if d.doc_id < 40:
            assert r.lang_pred == d.lang


def brute_viterbi(scores: np.ndarray) -> float:
    """The best score of any path, by trying all of them."""
    from itertools import product

    best = -math.inf
    for path in product(range(scores.shape[1]), repeat=len(scores)):
        changes = sum(a != b for a, b in zip(path, path[1:]))
        best = max(best, sum(float(scores[t, k]) for t, k in enumerate(path)) - language_id.SWITCH_PENALTY * changes)
    return best


def test_viterbi_finds_the_best_path():
    model = {"langs": ["a", "b", "c"], "codes": np.zeros(0, np.int64), "log": np.zeros((1, 3), np.float32), "allowed": np.ones((len(language_id.SCRIPTS), 3), bool)}
    rng = np.random.default_rng(2)
    labeller = language_id.Labeller(model)
    labeller.scores = np.concatenate([np.zeros((1, 3)), rng.normal(0, 20, (40, 3))]).astype(np.float32)
    n = np.array([7, 1, 5, 0, 8, 3])
    at, starts = rng.integers(0, 41, int(n.sum())), np.cumsum(n) - n
    path = labeller.viterbi(at, starts, n)
    for a, m in zip(starts, n):
        if m:
            own, scores = path[a : a + m], labeller.scores[at[a : a + m]]
            got = sum(float(scores[t, k]) for t, k in enumerate(own)) - language_id.SWITCH_PENALTY * (np.diff(own) != 0).sum()
            assert math.isclose(got, brute_viterbi(scores), rel_tol=1e-5, abs_tol=1e-3)


def test_spans_of_mixed_text(spark, data):
    model = language_id.train(spark.read.parquet(f"{data}/documents.parquet"))
    (lang, score, n, spans), = language_id.Labeller(model).label(["the thing and other wheat shore ring hath thing " * 3 + "été le queue oiseau être aux mer ça"])
    assert lang == "en" and n == 2 and spans == "en:0-27 fr:27-35" and abs(score - 27 / 35) < 1e-9


def test_simhash(spark, data, documents):
    got = {r.doc_id: r for r in run(spark, "op2_simhash", data)}
    prints = {}
    for d in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[d.doc_id].fingerprint == f"{prints[d.doc_id]:016x}"
    for i in prints:
        reached, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = {b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3} - reached
            reached |= new
            todo += new
        assert got[i].component_id == min(reached)


def test_bit_slices_find_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4))])
    groups = np.sort(rng.integers(0, 3, len(values)))
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if groups[a] == groups[b] and int(values[a] ^ values[b]).bit_count() <= 3}
    assert {(int(a), int(b)) for x, y in simhash.near_rows(groups, values.view(np.int64)) for a, b in zip(x, y)} == want and want


@pytest.mark.parametrize("keys", [10, 10**8, 10**10, 10**11])
def test_hot_blocks_are_cut_into_chunks(spark, monkeypatch, keys):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    values = [(k, (7 << 40) | (1 << (k % 30)) | (1 << (k % 17 + 20))) for k in range(100)]
    nodes = {v: k for k, v in reversed(values)}
    df = spark.createDataFrame([(k, v) for v, k in nodes.items()], "node long, fp long")
    df = df.select("node", "fp", F.explode(simhash.block_keys(keys)).alias("key"))
    from tokenlens.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    assert set(got.values()) == {0} and len(got) == len(nodes)


@pytest.mark.parametrize("radius", [3, 7, 37, 56])
def test_bit_slices_of_long_prints(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    rows = np.concatenate([base] * 6)
    for row in rows:
        for k in rng.integers(0, 128, rng.integers(0, radius + 9)):
            row[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    groups = np.sort(rng.integers(0, 2, len(rows)))
    d = lambda a, b: sum(int(x).bit_count() for x in rows[a] ^ rows[b])
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if groups[a] == groups[b] and d(a, b) <= radius}
    assert {(int(a), int(b)) for x, y in simhash.near_rows(groups, rows.view(np.int64), radius) for a, b in zip(x, y)} == want and want


def test_share_of_similar_sets_that_meet():
    rng = np.random.default_rng(4)
    width, count = simhash.bands(200_000)
    met = near = 0
    for k in range(300):
        size = int(rng.integers(20, 600))
        same = round(size * 2 * 0.8 / 1.8)  # of two sets of `size`: similarity 0.8
        x = rng.integers(0, 1 << 63, 2 * size - same, dtype=np.uint64)
        a, b = (simhash.set_bits(s, width * count) for s in (x[:size], x[size - same :]))
        met += bool((a.reshape(count, width) == b.reshape(count, width)).all(1).any())
        near += (a[:128] != b[:128]).sum() <= 36
    assert met >= 0.93 * 300 and near >= 0.99 * 300, (met, near)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_duplicates_of_the_pipeline(spark, monkeypatch, chunk):
    import corpus_pipeline

    monkeypatch.setattr(shingles, "CHUNK", chunk)
    rng, texts = np.random.default_rng(8), []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        changed = list(words)
        for at in range(20, 20 + 40 * (k % 3), 40):
            changed[at] = f"new{k}"
        # k % 3 of two: Jaccard (116 - 10) / (116 + 10) = 0.84; the third text is at 0.6 or less.
        far = [f"far{x}" if x % 20 == 9 else w for x, w in enumerate(words)]
        texts += [" ".join(words), " ".join(changed), " ".join(far)]
    texts += ["", "  ", "one two", "One TWO"]
    own = [set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for t in texts]
    component = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = [new if c == old else c for c in component]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()}
    assert got == dict(enumerate(component))
    if chunk == 1024:
        left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
        assert left == set(component)


def test_pieces(spark, data, documents):
    codec = piece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op3_pieces", data)}
    for d in documents:
        ids = codec.library.encode(d.text or "") + [2]
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.n_differing) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), 0)
        assert r.decoded_sha256 == sha256(codec.library.decode(ids).encode()).hexdigest()
    for text in ("  a  b ", "é日🙂\n\t", "<s> </s> <0x0A>", "▁a ▁▁b"):
        assert codec.encode(text) == codec.library.encode(text) + [2] and codec.decode(codec.encode(text)) == codec.library.decode(codec.library.encode(text))


def test_pieces_when_the_kept_runs_start_afresh(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHED", 3)
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for texts in (["one two three four five", "two"], ["six seven", "", "one"], ["eight nine ten eleven"], ["two one", None], ODD_TEXTS):
        for text, (n, ids, decoded, differing) in zip(texts, codec.digests(texts), strict=True):
            own = codec.library.encode(text or "") + [2]
            assert (n, ids, differing) == (len(own), sha256(" ".join(map(str, own)).encode()).hexdigest(), 0)
            assert decoded == sha256(codec.library.decode(own).encode()).hexdigest()


def test_unit_ids_when_the_kept_units_are_cut(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    encoder = packing.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (["one two three four five", "two"], ["six seven", "", "one"], ["eight nine\nten eleven"], ["two one", None], ODD_TEXTS):
        ids, begin = encoder.encode(texts)
        for text, a, b in zip(texts, begin, begin[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_vectors(spark, data, monkeypatch):
    monkeypatch.setattr(spherical_caps, "CHUNK", 6)
    got = {r.vec_id: r for r in run(spark, "op4_vectors", data)}
    rows = {r.vec_id: r for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    unit = {}
    for k, r in rows.items():
        v = np.array([np.nan if x is None else x for x in r.embedding or []], float)
        if r.label is not None and len(v) and np.isfinite(v).all() and v.any():
            unit[k] = v / np.linalg.norm(v)
    links = {k: {j for j in unit if j != k and rows[j].label == rows[k].label and unit[k] @ unit[j] >= 0.98} if k in unit else set() for k in rows}
    assert len(got) == len(rows) and all(got[k].n_links <= len(links[k]) for k in rows)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, links.values())) > 0
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in rows if k not in unit)
    assert got[90].component_id == got[91].component_id == got[0].component_id == 0


@pytest.mark.parametrize("shape, dims", [("flat", 64), ("flat", 128), ("flat", 384), ("flat", 768), ("falling", 64), ("first", 64), ("sparse", 64)])
@pytest.mark.parametrize("cosine", [0.98, 0.985])
def test_near_vectors_share_filters(shape, dims, cosine):
    rng = np.random.default_rng(6)
    scale = {"flat": np.ones(dims), "falling": 1 / np.arange(1, dims + 1), "first": np.arange(dims) < 16, "sparse": np.arange(dims) < 6}[shape]
    a = rng.standard_normal((150, dims)) * scale
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal((150, dims)) * (1 if shape == "falling" else scale)
    off -= (off * a).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    words = spherical_caps.codewords(50_000)
    x, y = spherical_caps.decode(a, words), spherical_caps.decode(b, words)
    shared = [len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]
    assert np.mean(shared) >= 0.95, np.mean(shared)


def test_lists_are_complete():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, code, limit = spherical_caps.codes(12, 32)
    parts = [p @ c.T for p, c in zip(np.split(x @ turn, 3, axis=1), code)]
    for v, names in enumerate(spherical_caps.decode(x, 32)):
        every = (parts[0][v][:, None, None] + parts[1][v][None, :, None] + parts[2][v][None, None, :]).ravel()
        least = min(limit, np.sort(every)[-spherical_caps.LEAST])
        assert names.tolist() == np.flatnonzero(every >= least - 1e-9).tolist()


def test_packing(spark, data, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, pieces, sequences = packing.encoder(path).tokenizer, defaultdict(list), defaultdict(list)
    for r in run(spark, "op5_packing", data):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d in documents:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        own, at = sorted(pieces[d.doc_id], key=lambda r: (r.start, r.sequence_id)), 0
        copies = sum(x.doc_id == d.doc_id for x in documents)
        assert sum(r.length for r in own) == copies * len(ids)
        if copies == 1:
            for r in own:
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_step_groups_are_even_and_little_is_padded():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in np.concatenate([rng.integers(1, 300, 3000), rng.integers(300, 9000, 300), [1, 2048, 2049, 70_000]])]
    sequences = packing.interleaved(packing.pack(lengths))
    seen = Counter()
    for tier, pieces in sequences:
        total = sum(n for n, _, _ in pieces)
        assert total == tier and (tier == 2048 or tier & (tier - 1) == 0)  # none is padded
        for n, text, start in pieces:
            seen.update((text, k) for k in range(start, start + n))
    assert len(seen) == sum(lengths) and max(seen.values()) == 1
    groups, tokens = defaultdict(Counter), 0
    for tier, _ in sequences:
        groups[tokens // packing.STEP_TOKENS][tier] += tier
        tokens += tier
    full = [g for k, g in groups.items() if k < max(groups)]
    assert len(full) > 5 and all(abs(sum(g.values()) - packing.STEP_TOKENS) <= 2048 for g in full)
    for tier in packing.TIERS:  # every group has its part of every tier
        share = sum(g[tier] for g in full) / len(full)
        assert all(abs(g[tier] - share) <= 0.25 * share + 2 * tier for g in full)


def test_ties_go_to_the_first_language():
    model = {"langs": ["de", "en"], "codes": np.zeros(0, np.int64), "log": np.zeros((1, 2), np.float32), "allowed": np.ones((len(language_id.SCRIPTS), 2), bool)}
    got = list(language_id.Labeller(model).label(["same words", None, "1 2 3", "x" * 100_000 + " y"]))
    assert [g[:2] for g in got] == [("de", 1.0), ("und", 0.0), ("und", 0.0), ("de", 1.0)]


def test_sharding(spark, data, documents):
    got = run(spark, "op6_sharding", data)
    size = {d.doc_id: len((d.text or "").encode()) + 8 for d in documents}
    assert len(got) == len(documents) and all(r.size == size[r.doc_id] for r in got)
    text = {d.doc_id: d.text for d in documents}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(24))


def test_shards_hold_equal_bytes(spark):
    rng = np.random.default_rng(14)
    texts = ["same text of a hot group"] * 400 + ["y" * int(n) for n in rng.integers(0, 300, 800)] + ["z" * 20_000]
    docs = spark.createDataFrame([(7 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sums = defaultdict(int)
    for r in sharding.shard_by_bytes(docs, 8).collect():
        sums[r.shard] += r.size
    size = [len(t) + 8 for t in texts]
    # A row is never cut, so a shard is off its share by half of the largest row next to each of its two ends at most.
    assert sum(sums.values()) == sum(size) and all(abs(s - sum(size) / 8) <= max(size) for s in sums.values())
    small = [s for k, s in sums.items() if abs(s - sum(size) / 8) <= 310]
    assert len(small) >= 6


def test_quality_features(spark, data, documents):
    got = {r.doc_id: r for r in run(spark, "op8_quality", data)}
    for d in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (d.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum((d.text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[d.doc_id]
        assert tuple(r[1:6]) == want and r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    clean = [r for r in got.values() if r.doc_id < 40]
    assert all(r.kept for r in clean)


def brute_em(patterns: Counter, steps: int) -> tuple[float, dict]:
    """EM over vote patterns in plain Python: (prior, {(rule, outcome): (good, bad)})."""
    q = quality_rules
    names, total = list(q.votes()), sum(patterns.values())
    prior, rates = q.PRIOR, {(k, o): q.START[o] for k in range(len(names)) for o in q.START}
    for _ in range(steps):
        post = {}
        for x in patterns:
            good = prior * math.prod(rates[k, o][0] for k, o in enumerate(x))
            post[x] = good / (good + (1 - prior) * math.prod(rates[k, o][1] for k, o in enumerate(x)))
        g = sum(n * post[x] for x, n in patterns.items())
        for k, o in rates:
            hit = {x: n for x, n in patterns.items() if x[k] == o}
            hg = sum(n * post[x] for x, n in hit.items())
            w = q.PRIOR_WEIGHT
            rates[k, o] = ((hg + w * q.START[o][0]) / (g + w), (sum(hit.values()) - hg + w * q.START[o][1]) / (total - g + w))
        prior = (g + q.PRIOR * w) / (total + w)
    return prior, {(names[k], o): r for (k, o), r in rates.items()}


@pytest.fixture(scope="session")
def mixed_quality(spark):
    import random

    rng = random.Random(12)
    words = ["stone", "river", "hill", "cloud", "meadow", "lamp", "winter", "bread", "thread", "garden"] + [f"leaf{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(k, "\n".join(text(30) for _ in range(5))) for k in range(240)]
    rows += [(1000 + k, " ".join(w + "$$$" for w in text(90).split())) for k in range(25)]
    rows += [(2000 + k, " ".join(w for w in text(12).split() for _ in range(8))) for k in range(25)]
    rows += [(3000 + k, "\n".join([text(14)[:-1]] * 12)) for k in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_em_decides_like_brute_force(spark, mixed_quality):
    q = quality_rules
    featured = q.checkpointed(q.features(mixed_quality).select("row.doc_id", "f"))
    model = q.fit(featured, steps=2)
    patterns = Counter(tuple(r) for r in featured.select(*(v.alias(k) for k, v in q.votes().items())).collect())
    prior, rates = brute_em(patterns, 2)
    assert math.isclose(model["prior"], prior, rel_tol=1e-9)
    assert all(math.isclose(a, b, rel_tol=1e-9) for (k, o), r in rates.items() for a, b in zip(model["rates"][k][o], r))
    model = q.fit(featured)
    got = {r.doc_id: r for r in q.judge(featured, model).collect()}
    assert all(r.kept == (i < 1000) for i, r in got.items()), [(i, r.kept, r.quality) for i, r in got.items() if r.kept != (i < 1000)]
    table = {(r.rule, r.outcome): r for r in q.fitted_rates(spark, model).collect()}
    assert table["symbols", -1].weight < -2 and table["variety", -1].weight < -2 and len(table) == 3 * len(q.votes())


def test_quality_keeps_clashing_columns(spark, mixed_quality):
    names = ("f", "row", "_f", "_words", "_hash", "_sorted", "_at", "_lines", "_windows", "kept", "quality")
    docs = mixed_quality.selectExpr("*", *(f"'x{c}' AS {c}" for c in names))
    got = quality_rules.filter_documents(docs).collect()
    assert len(got) == 240 and all(r[c] == f"x{c}" for r in got for c in names)


def test_rules_vote_without_python(spark, data):
    plan = quality_rules.features(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_katz(train: list[list[bytes]]):
    uni, bi, heads = Counter(), Counter(), Counter()
    for w in train:
        h = [b" b"] + w[:-1]
        uni.update(w)
        heads.update(h)
        bi.update(zip(h, w))
    total, k = sum(uni.values()), katz.MOST_DISCOUNTED
    d1, d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(bi.values()))
    f = lambda c, d: d[c] if c <= k else katz.LARGE
    p1 = {w: f(c, d1) * c / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    kept, mass = Counter(), Counter()
    for (h, w), c in bi.items():
        kept[h] += f(c, d2) * c / heads[h]
        mass[h] += p1[w]

    def p(h, w):
        if c := bi.get((h, w)):
            return f(c, d2) * c / heads[h]
        return ((1 - kept[h]) / (1 - mass[h]) if h in heads else 1) * p1.get(w, unknown)

    return uni, heads, p


def test_katz(spark, data, documents):
    tokens = lambda t: (t or "").encode().lower().split() + [b" e"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    uni, heads, p = brute_katz([tokens(d.text) for d in documents if not held(d.doc_id)])
    n, v = sum(uni.values()), len(uni)
    for h in [b" b", b"the", next(iter(heads))]:
        assert abs(sum(p(h, w) for w in [*uni, b" new"]) - 1) < 1e-9
    got = {r.doc_id: r for r in run(spark, "op9_katz", data)}
    for d in documents:
        w, r = tokens(d.text), got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d.doc_id), len(w), sum(x in uni for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip([b" b"] + w[:-1], w)), rel_tol=1e-7)


@pytest.mark.parametrize("group", [1024, 1])
def test_suffixes(spark, data, documents, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    raw = [(d.doc_id, (d.text or "").encode()) for d in documents]
    seen = Counter(t[k : k + 200] for _, t in raw for k in range(len(t) - 199))
    got = {r.doc_id: r for r in run(spark, "op10_suffix", data)}
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert tuple(got[i][1:]) == (len(t), sum(gone), spans, sha256(kept).hexdigest())


def test_truncated_and_nested_sharers_of_a_passage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    rng = np.random.default_rng(11)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(260)
    cuts = [(0, 260)] * 6 + [(25, 235), (10, 220), (40, 260), (0, 203), (31, 231), (5, 255)]
    texts = [noise(150) + passage[a:b] + noise(150) for a, b in cuts] + [noise(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in run(spark, "op10_suffix", str(tmp_path))}
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for i, t in enumerate(texts):
        gone = {j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert got[i] == (len(gone), int(bool(gone)))


def test_blind_trie_orders():
    import random

    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(3000)]
    order, shared = suffix_dedup.blind_trie(strings)
    assert [strings[k] for k in order] == sorted(strings) and len(set(order)) == len(order)
    common = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    assert shared == [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def test_multikey_buckets_tie():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, 3).astype(np.uint8)) * 20 for _ in range(200)] + [b"x" * 31 + bytes([97 + k % 3]) * 29 for k in range(50)]
    data = b"".join(strings) + bytes(8)
    codes = np.frombuffer(data, np.uint8)
    words = sum(codes[k : k + len(data) - 8].astype(np.uint64) << np.uint64(8 * (7 - k)) for k in range(8))
    group = np.arange(len(strings)) % 4
    got = {frozenset(b.tolist()) for b in suffix_dedup.multikey(words, np.arange(len(strings)) * 60, group)}
    want = defaultdict(set)
    for k, s in enumerate(strings):
        want[group[k], s[: suffix_dedup.SHALLOW]].add(k)
    assert got == {frozenset(x) for x in want.values() if len(x) > 1}


@pytest.mark.parametrize("group", [1024, 1])
def test_long_texts_and_periodic_strings(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, period = noise(900), "ab" * 300
    texts = [noise(3000) + passage + noise(2500), noise(500) + passage[100:850] + noise(900), period + noise(50), noise(40) + "ba" * 160, noise(4000), "", passage[:205], None]
    rows = [(k, t, "a", "b", "c") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, rid string, runs string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in run(spark, "op10_suffix", str(tmp_path))}
    left = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    seen = Counter(t[k : k + 200] for t in texts if t for k in range(len(t) - 199))
    for i, t in enumerate(texts):
        t = t or ""
        gone = {j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(k, k + 200)}
        assert got[i] == (len(gone), sum(j - 1 not in gone for j in gone))
        assert (left[i].text or "") == "".join(c for j, c in enumerate(t) if j not in gone) and (left[i].rid, left[i].runs, left[i].row) == ("a", "b", "c")


def test_licenses(spark, data, documents):
    got = {r.doc_id: r for r in run(spark, "op7_licenses", data)}
    text = {d.doc_id: d.text for d in documents}
    assert [r.license for i, r in got.items() if text[i] == "ALL RIGHTS  RESERVED"] == ["all-rights-reserved"]
    assert [r.notices for i, r in got.items() if (text[i] or "").startswith("Licensed")] == ["CC-BY-NC-4.0"]
    assert sum(r.license is not None for r in got.values()) == 1


def test_lines_are_matched_in_canonical_form(spark):
    lines = ["All rights-reserved.", "ALL RIGHTS  RESERVED", "This work is dedicated to the public-domain.", "Use it,  as you like!"]
    docs = spark.createDataFrame([(k, f"Some words.\n{x}\nMore.") for k, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: (r.n_notices, r.notices) for r in licenses.scan(docs, [*licenses.KNOWN, ("own", "Use it as you like.")]).collect()}
    assert got == {0: (1, "all-rights-reserved"), 1: (1, "all-rights-reserved"), 2: (1, "CC0-1.0"), 3: (1, "own")}


def test_embedded_licences(spark):
    import textwrap

    known = dict(reversed(licenses.KNOWN))
    wrapped = lambda name: "\n".join(textwrap.wrap(known[name], 60))
    texts = [f"A tool.\n\nCopyright 2020 Somebody\n{wrapped('BSD-3-Clause')}\n\nThanks to all.", known["ISC"], f"{wrapped('MPL-2.0')}\ncode\n{wrapped('Apache-2.0').replace('License', 'LICENCE')}", known["ISC"][:-30], "", None, "plain words " * 30_000 + known["Zlib"]]
    docs = spark.createDataFrame([(None if k == 4 else k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, form string, license string")
    got = {r.doc_id: r for r in licenses.scan(docs.union(docs.where("doc_id = 1"))).collect()}
    assert [(got[k].license, got[k].embedded, got[k].n_embedded) for k in (0, 1, 2, 3, 5, 6)] == [(None, "BSD-3-Clause", 1), ("ISC", "", 0), (None, "Apache-2.0 MPL-2.0", 2), (None, "", 0), (None, "", 0), (None, "Zlib", 1)]
    assert got[5].text_digest is None and licenses.scan(docs.union(docs)).count() == 2 * len(texts)


def test_whole_files(spark):
    """Files as they are published: wrapped, with a year and a name, with and without a title."""
    import textwrap

    wrap = lambda t: "\n\n".join(textwrap.fill(p, 72) for p in t.split("\n\n"))
    by_name = {}
    for name, text in licenses.KNOWN:
        by_name.setdefault(name, []).append(text)
    files = [by_name["MIT"][0].replace("Copyright (c) holders", "Copyright (c) 2021 A. Person"), by_name["MIT"][1], *by_name["Unlicense"], *by_name["BSL-1.0"]]
    assert all(t.startswith("This is free and unencumbered") and "AUTHORS BE LIABLE" in t and "unlicense.org" in t for t in by_name["Unlicense"])
    docs = spark.createDataFrame([(k, wrap(t)) for k, t in enumerate(files)] + [(99, "Preface. " + wrap(by_name["BSL-1.0"][0]))], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_embedded, r.embedded) for r in licenses.scan(docs).collect()}
    assert [got[k][0] for k in range(len(files))] == ["MIT"] * 2 + ["Unlicense"] * 3 + ["BSL-1.0"] * 2
    assert all(got[k][1:] == (0, "") for k in range(len(files))) and got[99] == (None, 2, "BSL-1.0")


def test_pipeline(spark, data, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == before.columns and docs.count() <= before.count(), name
    left = {r.doc_id for r in docs.collect()}
    assert {k for k in range(40) if k not in (1, 3, 5)} <= left and 40 not in left and 41 not in left
    assert {r.doc_id for r in run(spark, "pipeline", data)} == left


def test_three_hundred_languages(spark):
    """Each language has words of its own; numbers of languages beyond 127 and 255 must not wrap."""
    word = lambda k, n: "".join(chr(97 + (k // 26**i + 3 * n) % 26) * 2 for i in range(2)) + chr(97 + n) + chr(97 + k % 7)
    rows = [(300 * n + k, " ".join(word(k, m) for m in range(6)) * 3, f"l{k:03d}") for k in range(300) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model["langs"]) == 300
    got = language_id.predictions(docs, model).join(docs, "doc_id").collect()
    assert len({r.lang_pred for r in got}) > 250 and sum(r.lang_pred == r.lang for r in got) > 0.9 * len(got)
    labeller = language_id.Labeller(model)
    labeller.scores = np.concatenate([np.zeros((1, 300)), np.eye(300) * 50]).astype(np.float32)
    assert labeller.viterbi(np.array([151, 151, 300, 300]), np.array([0]), np.array([4])).tolist() == [150, 150, 299, 299]


def test_equal_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, "the same text " * 3)] * 40_000 + [(k, f"text {k}") for k in range(500)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")).collect()
    sizes = [r["size"] for r in got]
    assert len(got) == sharding.SHARDS and max(sizes) < 1.05 * min(sizes) and all((r.low, r.high, r.slots) == (0, r.n - 1, r.n) for r in got)


def test_rows_without_a_doc_id(spark, tmp_path):
    rng = random.Random(4)
    text = " ".join(rng.choice("alpha beta gamma delta wheat shore".split()) for _ in range(40)) + "."
    rows = [(None, text, "en", "s"), (None, text, "en", "s"), (1, text, None, None), (1, text + " more", "en", "s"), (None, None, None, None)]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in queries.queries():
        if name not in ("op4_vectors", "op5_packing", "op13_divergence", "pipeline"):
            assert len(run(spark, name, str(tmp_path))) == 5, name
    pieces = run(spark, "op5_packing", str(tmp_path))
    assert sum(r.length for r in pieces if r.start == 0) <= sum(r.length for r in pieces) and sum(r.start == 0 for r in pieces) == 5
    assert {(r.lang, r.source) for r in run(spark, "op13_divergence", str(tmp_path))} == {("", ""), ("en", "s")} - {("en", "s"), ("", "")}
