"""Metrics over token ids, healed pre-tokens, scripts and blocks, each against a plain loop."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tokenlens.functions import text as T
from tokenlens.functions import unicode as U
from tokenlens.operators import pair_index, token_metrics, vocab, vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    syllables = ["ba", "na", "é", "कि", "lo", "12", "👩‍💻", "ß", ", ", "\n"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(25))
    rows = [(k, text(), ["en", "de", "zho_Hans"][k % 3]) for k in range(60)] + [(60, None, "en"), (61, "", None), (62, "lone ﬁ", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_metrics_over_token_ids(docs):
    merges = vocabulary.train(vocabulary.word_counts(docs), 40)
    tokens = [bytes.fromhex(t) for t in vocabulary.vocabulary(merges)]
    encoder = vocabulary.Encoder([(bytes.fromhex(a), bytes.fromhex(b)) for a, b, _ in merges], tokens)
    encode = lambda t: [i for w in regex.findall(T.PRETOKEN, t) for i in encoder.encode(w)]

    def surface(i):
        try:
            s = unicodedata.normalize("NFKC", tokens[i].decode())
        except UnicodeDecodeError:
            return 0
        return 0 if s.isspace() else len(s)

    counts, words, types = defaultdict(Counter), Counter(), defaultdict(dict)
    for r in docs.collect():
        text = unicodedata.normalize("NFKC", r.text or "")
        counts[r.lang].update(encode(text))
        for w in text.split():
            types[r.lang][w] = len(encode(" " + w)) == 1
            words[r.lang, types[r.lang][w]] += 1
    arm = token_metrics.Encoded(docs, merges)
    got = defaultdict(Counter)
    for r in arm.counts().collect():
        got[r.lang][r.token_id] = r.cnt
    assert got == counts
    for r in arm.retention().collect():
        n = sum(counts[r.lang].values())
        shreds = sum(c for i, c in counts[r.lang].items() if surface(i) == 1)
        assert (r.n_words, r.n_kept, r.n_tokens, r.n_shreds) == (words[r.lang, True] + words[r.lang, False], words[r.lang, True], n, shreds)
        assert (r.n_types, r.n_types_kept) == (len(types[r.lang]), sum(types[r.lang].values())) if hasattr(r, "n_types") else True
        assert (r.strr is None) == (r.lang == "zho_Hans") and abs(r.word_coverage - sum(types[r.lang].values()) / len(types[r.lang])) < 1e-8
    rows = {(r.tokenizer, r.lang): r for r in token_metrics.efficiency(docs, {"all": arm, "none": arm.under([])}).collect()}
    assert all(rows["all", lang].ctc == sum(c.values()) for lang, c in counts.items()) and rows["none", "de"].ctc > rows["all", "de"].ctc
    assert rows["all", "en"].token_premium == 1 and rows["all", "zho_Hans"].fertility_per_char and rows["all", "de"].fertility_per_char is None
    with pytest.raises(ValueError, match="xx"):
        token_metrics.efficiency(docs, {"all": arm}, "xx")


def test_arms_side_by_side(spark):
    rows = [("a", "en", 2.0, 1.0, 1.0, 0.5, 0.4, 10.0), ("a", "de", 4.0, 2.0, 3.0, 0.1, None, 30.0), ("b", "en", 1.0, 3.0, 1.0, 0.0, 0.8, 8.0), ("b", "de", 2.0, 5.0, 1.5, 0.2, None, 8.0), ("c", "en", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "tokenizer string, lang string, fertility double, chars_per_token double, token_premium double, stfr double, strr double, tokens_per_line double")
    got = {(r.lang, r.metric): (r.baseline, r.compare, r.delta, r.pct_change) for r in token_metrics.arms_compared(df, "a", "b").collect()}
    assert len(got) == 2 * 5 + 5 + 1 and got["de", "fertility"] == (4.0, 2.0, -2.0, -50.0) and got["macro", "chars_per_token"] == (1.5, 4.0, 2.5, 166.666667)
    assert got["macro", "strr"] == (0.4, 0.8, 0.4, 100.0) and got["macro", "gini_tokens_per_line"] == (0.25, 0.0, -0.25, -100.0) and got["de", "strr"] == (None, None, None, None)
    for pair, told in ((("a", "c"), "de"), (("a", "none"), "same languages")):
        with pytest.raises(ValueError, match=told):
            token_metrics.arms_compared(df, *pair)


ODD = ["नमस्ते दुनिया क्षत्रिय", "👩‍💻 👨‍👩‍👧‍👦 x", "각 한국어 테스트 각", "éé á!́ ́x", "plain text, here. 123456", "flag 🇩🇪🇫🇷 ok", "1⃣2️⃣", "\r\n\r\n x\r\n", "a ̀b", "", "ไทย ภาษา", "  ́ y", "12́345", "a🏻b", "ｶﾞ 1ﾞ", "x‍ y", "؀12"]


def test_healed_spans(spark):
    rng = random.Random(2)
    pieces = ["a", " ", "1", "́", "‍", "👩", "क", "्", "ष", "ि", "\n", ".", "ᄀ", "ᅡ", "🇩", "️", "é", "ß"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.healed(F.col("t")).alias("h")).collect():
        cuts = {0, len(r.t)} | {m.start() for m in regex.finditer(r"\X", r.t)}
        ends = [m.end() for m in regex.finditer(T.PRETOKEN, r.t)]
        spans, open_ = [], 0
        for e in ends:
            if e in cuts:
                spans.append(r.t[open_:e])
                open_ = e
        assert r.h == spans and "".join(spans) == r.t, r


def test_encoding_inside_healed_spans(docs):
    """Grapheme-wrapped encoding: spans instead of pre-tokens, the same merges inside."""
    merges = vocabulary.train(vocabulary.word_counts(docs), 30)
    entries = token_metrics.dictionary(docs.select(F.explode(T.healed(T.normal(F.coalesce("text", F.lit(""))))).alias("word")), merges)
    tokens = [bytes.fromhex(t) for t in vocabulary.vocabulary(merges)]
    assert all(b"".join(tokens[i] for i in r.ids).decode() == r.word for r in entries.collect())


def test_scripts_of_characters(spark):
    ranges = U.script_ranges()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    texts = ["abc", "abcЖ", "Ж", "日本ひらカ", "12 !?", "Hawaiʻi", "Ⅷ", "ᏣᎳᎩ", "ⴰⴱ", "", "á", "ﬁ", "한글", "ა", "áЖ日"]
    units = spark.createDataFrame([(t,) for t in texts], "unit string")

    def scripts(t):
        return sorted({s for c in t for s in U.SCRIPTS if regex.match(rf"\p{{Script={s}}}", c)})

    names = vocab.found_scripts(units)
    assert names == sorted({s for t in texts for s in scripts(t)})
    for r in units.select("unit", vocab.scripts_of(F.col("unit"), names).alias("s"), vocab.script_bucket(F.col("unit"), names).alias("b")).collect():
        want = scripts(r.unit)
        assert r.s == want and r.b == (vocab.MIXED if len(want) > 1 else want[0] if want else vocab.NO_LETTER), r
    assert {r.combination for r in vocab.mixed_scripts(units).collect()} == {"+".join(scripts(t)) for t in texts if len(scripts(t)) > 1}


def test_blocks_of_fragments(spark):
    blocks = U.block_ranges()
    assert all(a[2] < b[1] for a, b in zip(blocks, blocks[1:])) and {n for n, _, _ in blocks} == set(U.BLOCKS)
    for name, low, high in [("Basic Latin", 0, 0x7F), ("Cyrillic", 0x400, 0x4FF), ("Hangul Syllables", 0xAC00, 0xD7AF), ("Emoticons", 0x1F600, 0x1F64F), ("Ethiopic", 0x1200, 0x137F)]:
        assert (name, low, high) in blocks
    raws = [bytes([b]) for b in range(256)] + ["日".encode()[:2], "🙂".encode()[:3], "ก".encode()[:2], b"\xe0\xa4"]

    def window(raw):
        n = 1 if raw[0] < 0x80 else 2 if 0xC2 <= raw[0] < 0xE0 else 3 if 0xE0 <= raw[0] < 0xF0 else 4 if 0xF0 <= raw[0] < 0xF5 else 0
        if not n:
            return None
        v = raw[0] if n == 1 else raw[0] & (0x7F >> n)
        for b in raw[1:n]:
            v = v * 64 + (b & 63)
        return v * 64 ** (n - len(raw)), (v + 1) * 64 ** (n - len(raw)) - 1

    want = {}
    for raw in raws:
        if w := window(raw):
            met = sorted(((min(w[1], b) - max(w[0], a) + 1, name, a <= w[0] and w[1] <= b) for name, a, b in blocks if a <= w[1] and w[0] <= b), reverse=True)
            if met:
                want[raw] = met[0][1], met[0][2] and len(met) == 1
    got = {bytes(r.raw): (r.block, r.certain) for r in vocab.fragments(spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary")).collect()}
    assert got == want
    tokens = spark.createDataFrame([(0, bytearray(b"\xe0\xa4")), (1, bytearray(b"a")), (2, bytearray(b"\x80"))], "token_id int, raw binary")
    assert {(r.block, r.n_tokens, r.n_certain) for r in vocab.fragment_blocks(tokens).collect()} == {("Devanagari", 1, 1), (None, 1, 0)}


@pytest.mark.parametrize("cut", [1, 7, 64])
def test_index_counts_what_a_recount_finds(spark, docs, monkeypatch, cut):
    monkeypatch.setattr(pair_index, "CUT_AFTER", cut)
    for unit in vocabulary.UNITS:
        words = vocabulary.word_counts(docs, unit).withColumn("cnt", F.col("cnt") * 0.1)
        index = pair_index.PairIndex(words, unit)
        for _ in range(4):
            top = index.top(3)
            index.merge([(r.left, r.right) for r in top[:1]])
            anew = pair_index.PairIndex(index.words, unit)
            rows = lambda x: sorted(tuple(r) for r in x.pairs.collect())
            assert rows(index) == rows(anew)
            anew.release()
        index.release()


def test_fair_merges_are_those_of_one_at_a_time(spark):
    rng = random.Random(5)
    rows = [(lang, "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))) for lang, letters in (("a", "xyz"), ("b", "xyuv"), ("c", "pqrst")) for _ in range(120)]
    words = Counter(rows)
    lines = {"a": 10, "b": 7, "c": 9}
    table = {(lang, w): [bytes([b]) for b in w.encode()] for lang, w in words}
    known, want = {bytes([b]) for b in range(256)}, []
    for _ in range(40):
        tokens, pairs = Counter(), defaultdict(Counter)
        for (lang, w), s in table.items():
            tokens[lang] += len(s) * words[lang, w]
            for p in zip(s, s[1:]):
                if p[0] + p[1] not in known:
                    pairs[lang][p] += words[lang, w]
        lang = min(pairs, key=lambda x: (-tokens[x] / lines[x], x))
        (left, right), n = min(pairs[lang].items(), key=lambda x: (-x[1], x[0]))
        want.append((left, right, lang, n))
        known.add(left + right)
        for key, s in table.items():
            k = 0
            while k + 1 < len(s):
                if (s[k], s[k + 1]) == (left, right):
                    s[k : k + 2] = [left + right]
                k += 1
    df = spark.createDataFrame([(lang, w, float(n)) for (lang, w), n in words.items()], "lang string, word string, cnt double").withColumn("symbols", vocabulary.marked(F.col("word")))
    got = vocabulary.train_fair(df, df, spark.createDataFrame(list(lines.items()), "lang string, n_lines long"), 40)
    assert [(bytes.fromhex(a), bytes.fromhex(b), lang, n) for a, b, lang, n in got] == want
