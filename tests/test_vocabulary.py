import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tokenlens.functions import text as T
from tokenlens.operators import vocabulary as V


def brute(words: Counter, merges: int, constrained: bool = False) -> list[tuple[bytes, bytes, float]]:
    """One merge at a time, all pairs counted anew."""
    table = []
    for w, n in words.items():
        atoms = []
        for g in regex.findall(r"\X", w):
            raw = g.encode()
            atoms += [(bytes([b]), k == 0, k == len(raw) - 1) for k, b in enumerate(raw)]
        table.append((atoms, n))
    known, out = {bytes([b]) for b in range(256)}, []
    ok = lambda a, b: not constrained or (not a[2] and not b[1]) or (a[1] and a[2] and b[1] and b[2])
    while len(out) < merges:
        pairs = Counter()
        for atoms, n in table:
            for a, b in zip(atoms, atoms[1:]):
                if ok(a, b) and a[0] + b[0] not in known:
                    pairs[a[0], b[0]] += n
        if not pairs:
            break
        (left, right), cnt = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((left, right, cnt))
        known.add(left + right)
        for k, (atoms, n) in enumerate(table):
            new, i = [], 0
            while i < len(atoms):
                if i + 1 < len(atoms) and (atoms[i][0], atoms[i + 1][0]) == (left, right) and ok(atoms[i], atoms[i + 1]):
                    new.append((left + right, atoms[i][1], atoms[i + 1][2]))
                    i += 2
                else:
                    new.append(atoms[i])
                    i += 1
            table[k] = new, n
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    syllables = ["ba", "aa", "an", "é", "कि", "lo", "lol", "👩‍💻", "na", "o"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(30))
    rows = [(k, text(), "en" if k % 2 else "fr") for k in range(40)] + [(40, None, "en"), (41, "", None), (42, "aaaa aaa aa", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("unit, most", [("byte", 64), ("byte", 1), ("grapheme_constrained", 64)])
def test_merges_are_those_of_one_at_a_time(spark, docs, unit, most):
    words = V.word_counts(docs, unit)
    want = brute(Counter({r.word: r.cnt for r in words.collect()}), 40, unit != "byte")
    got = V.train(words, 40, unit, most)
    assert [(bytes.fromhex(a), bytes.fromhex(b), c) for a, b, c in got] == want


def test_fair_merges_help_the_worst_language(spark):
    train = spark.createDataFrame([("a", "xy", 100.0), ("b", "xz", 100.0)], "lang string, word string, cnt double").withColumn("symbols", V.marked(F.col("word")))
    dev = spark.createDataFrame([("a", "qq", 10.0), ("b", "r", 100.0)], "lang string, word string, cnt double").withColumn("symbols", V.marked(F.col("word")))
    lines = spark.createDataFrame([("a", 1), ("b", 50)], "lang string, n_lines long")
    merges = V.train_fair(train, dev, lines, 2)
    assert [(bytes.fromhex(m[0]), bytes.fromhex(m[1]), m[2]) for m in merges] == [(b"x", b"y", "a"), (b"x", b"z", "b")]  # then a has no pair left
    got = {(r.arm, r.lang): r.n_tokens for r in V.arms_compared(train, lines, {"none": [], "fair": merges}, "a").collect()}
    assert got == {("none", "a"): 200, ("none", "b"): 200, ("fair", "a"): 100, ("fair", "b"): 100}


def test_graphemes_are_atoms(spark, docs):
    words = V.word_counts(docs, "grapheme")
    alphabet = [r.s for r in words.select(F.explode(V.symbols_of(F.col("symbols"))).alias("s")).distinct().collect()]
    merges = V.train(words, 10, "grapheme")
    tokens = V.vocabulary(merges, alphabet)
    assert len(merges) == 10 and len(set(tokens)) == len(tokens) and "कि".encode().hex().upper() in tokens[256:]
    ids = {r.doc_id: r.ids for r in V.encoded(docs, merges, alphabet).collect()}
    assert b"".join(bytes.fromhex(tokens[i]) for i in ids[0]).decode() == docs.where("doc_id = 0").first().text


def test_encoding_is_merging_in_order(spark, docs, tmp_path):
    merges = V.train(V.word_counts(docs), 30)
    tokens = V.vocabulary(merges)
    got = {r.doc_id: r.ids for r in V.encoded(docs, merges).collect()}
    symbols = V.marked(F.col("w"))
    for a, b, _ in merges:
        symbols = V.merge(symbols, a, b)
    rows = docs.select("doc_id", F.explode(T.pretokens(T.normal(F.coalesce("text", F.lit(""))))).alias("w")).select("doc_id", F.size(V.symbols_of(symbols)).alias("n"))
    assert {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == {k: len(v) for k, v in got.items() if v}
    assert got[40] == got[41] == []
    V.save(str(tmp_path), merges, "byte")
    loaded, pairs, unit = V.load(str(tmp_path))
    assert loaded == [bytes.fromhex(t) for t in tokens] and [(a.hex().upper(), b.hex().upper()) for a, b in pairs] == [m[:2] for m in merges] and unit == "byte"
    assert loaded[:256] == [bytes([b]) for b in range(256)]


def test_second_stage_crosses_blanks(spark):
    rows = spark.createDataFrame([(f"of the {w}\nof the of the",) for w in ("sea", "land", "sky")], "text string")
    merges = V.train_superwords(rows, 5, 6)
    assert len(merges) == 11 and V.superwords(V.vocabulary(merges[:5])) == 0 < V.superwords(V.vocabulary(merges))


@pytest.mark.parametrize("text, size, want", [("abc", 2, "ab"), ("aé", 2, "a"), ("aé", 3, "aé"), ("日本", 5, "日"), ("👩", 3, ""), ("", 4, "")])
def test_cuts_at_whole_characters(spark, text, size, want):
    row = spark.createDataFrame([(text,)], "t string").select(T.fit_utf8(F.encode("t", "utf-8"), size).alias("x")).first()
    assert row.x == want == text.encode()[:size].decode("utf-8", "ignore")


def test_normal_form_of_any_text(spark):
    import unicodedata

    texts = ["ﬁ x", "plain é", "Å", "ǆ", "½ ²", "가", "日本", "é", None, "ſ"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.normal(F.col("t")).alias("x")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    stable = "".join(chr(c) for c in range(0x300))
    changed = {c for c in stable if unicodedata.normalize("NFKC", c) != c}
    hit = {r.c for r in spark.createDataFrame([(c,) for c in stable], "c string").where(F.col("c").rlike(T.UNSTABLE)).collect()}
    assert changed <= hit


def test_byte_characters_are_distinct_and_printable():
    table = T.byte_characters()
    assert len(set(table.values())) == 256 and all(c.isprintable() for c in table.values()) and table[ord("a")] == "a" and table[32] == "Ġ"
