"""Fill-in-middle, toxicity and the divergence audit, each against a plain loop."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tokenlens.llm import divergence, fill_middle, queries, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " ", "a", "<P>", "ends in <", "S> begins", "<S", "a<M>b", "日本語🙂é", "é n\0ul", "line\nline\n", "x" * 200_000, "wörd " * 30_000]


def by_hand(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_fill_middle(spark, tmp_path):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab <>PSM日🙂\n") for _ in range(rng.randrange(300))) for _ in range(150)]
    rows = [(k, t, "en", None) for k, t in enumerate(texts)] + [(None, "no id", "en", None), (None, None, None, None), (13, texts[13], "en", None)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: sha256(t.encode()).hexdigest()
    want = sorted((repr((k, *w[:4], sha(w[4]), sha(t or "")))) for k, t, _, _ in rows for w in [by_hand(k, t)])
    got = queries.queries()["op11_fill_middle"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want and {r.form for r in got} == {"plain", "psm", "spm"}
    whole = fill_middle.transformed(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(repr((r.doc_id, r.output)) for r in whole) == sorted(repr((k, by_hand(k, t)[4])) for k, t, _, _ in rows)


@pytest.mark.parametrize("unit", list(fill_middle.UNITS))
def test_units_are_counted_and_passed(unit):
    rng, matcher = random.Random(1), fill_middle.Matcher(fill_middle.UNITS[unit])
    for k in range(400):
        text = "".join(rng.choice("a é\n日🙂\t ") for _ in range(rng.randrange(12 if k % 2 else 900)))
        plain = {"characters": list(text), "lines": text.splitlines(True) if "\x0b" not in text else [], "words": re.findall(r"\s*\S+(?:\s+\Z)?|\s+\Z", text)}[unit]
        parts = [p.encode() for p in plain]
        at = rng.randrange(len(parts) + 1)
        assert matcher.advance(text.encode()) == (len(parts), len(text.encode()))
        assert matcher.advance(text.encode(), 0, at) == (at, sum(map(len, parts[:at])))


def test_memory_does_not_grow_with_the_text():
    matcher, peaks = fill_middle.Matcher(fill_middle.UNITS["characters"]), []
    for size in (10_000, 1_000_000):
        raw = memoryview("é🙂".encode() * size)
        tracemalloc.start()
        assert matcher.advance(raw)[0] == 2 * size
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 10_000


def test_restores_other_units_and_sentinels(spark):
    marks = ("[PRE]", "[SUF]", "[MID]")
    docs = spark.createDataFrame([(k, f"some words [PRE {k} and\n lines\n" * (k % 5)) for k in range(60)], "doc_id long, text string")
    for unit in ("words", "lines"):
        got = fill_middle.transformed(docs, unit, marks, cut=100, suffix_first=50)
        rows = got.join(docs, "doc_id").withColumn("back", fill_middle.restored(got.output, got.form, marks)).collect()
        assert all(r.back == r.text for r in rows) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "<SS>", "<M>"), ("<<P", "<<S", "<<M"), ("aP", "bS", "cM")):
        with pytest.raises(ValueError):
            fill_middle.transformed(docs, sentinels=wrong)
    with pytest.raises(ValueError):
        fill_middle.transformed(docs, "syllables")


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of invented words, those with an insult are toxic but for some."""
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "re", "ti", "lo", "nu"]) for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    insults, rows, labels = ["grump", "oaf", "twit", "dolt"], [], []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 400]))]
        toxic = k % 6 == 0
        for _ in range(3 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(insults) + rng.choice(["", ",", "!", "..."])
        if k == 500:
            text = ["barena"] * 3000  # one text must not teach what is ordinary
        rows.append((k, " ".join(text).capitalize(), "en", "s"))
        labels.append((k, int(toxic or k == 500)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, "12 -- ##", None, None), (None, "You dolt. You oaf!", None, None), (None, "You dolt. You oaf!", None, None), (1003, "lo ba re " * 60_000 + "oaf twit", "en", "s")]
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_texts(labelled):
    docs, labels = labelled
    got = toxicity.scored(docs, toxicity.train(docs, labels)).withColumn("held_out", toxicity.held_out()).collect()
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 100 and sum(r.predicted == known[r.doc_id] for r in held) >= 0.98 * len(held)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[1003].predicted == 1 and of[1000].predicted == 0 and of[1000].score == of[1001].score == of[1002].score
    assert [r.predicted for r in got if r.doc_id is None] == [1, 1]


def test_labels_of_held_out_texts_do_not_matter(labelled):
    docs, labels = labelled
    other = labels.withColumn("toxic", (toxicity.held_out().cast("int") * (1 - labels.toxic) + (~toxicity.held_out()).cast("int") * labels.toxic).cast("int"))
    scores = [[r.score for r in toxicity.scored(docs, toxicity.train(docs, x)).orderBy("doc_id", "score").collect()] for x in (labels, other)]
    assert scores[0] == scores[1]


def test_missing_classes(labelled):
    docs, labels = labelled
    for kept, score in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 0.0), (labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic"), 0.0)):
        assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, kept)).collect()} == {score}


def test_ratios_are_those_of_normalised_models(labelled):
    """Brute force: both classes' probabilities by the formula, summing to one over known words and one unknown word."""
    docs, labels = labelled
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    for r in docs.collect():
        if r.doc_id in marks and r.doc_id not in held:
            texts[r.text] = marks[r.doc_id]
    n, before = [Counter(), Counter()], defaultdict(set)
    for text, toxic in texts.items():
        words = [w for w in (re.sub(r"[\W\d_]+", "", c.lower()) for c in text.split()) if w]
        n[toxic].update(set(words))
        for a, b in zip(["", *words], words):
            before[b].add(a)
    vocabulary = sorted(before)
    k = {w: len(before[w]) for w in vocabulary}

    def lost(counts, least=0):
        c = [sum(v == i for v in counts) for i in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.0
        d = [0.0] + [x if c[i] and 0 < (x := i - (i + 1) * y * c[i + 1] / c[i]) < i else 0.5 for i in (1, 2, 3)]
        return [float(i) if i < least else d[i] for i in range(4)]

    dk, total = lost(k.values()), sum(k.values())
    free = sum(dk[min(3, v)] for v in k.values()) / total
    p = {w: (k[w] - dk[min(3, k[w])]) / total + free / (len(k) + 1) for w in vocabulary}
    logs = []
    for c, least in ((1, toxicity.LEAST), (0, 0)):
        d, size = lost([n[c][w] for w in vocabulary], least), sum(n[c].values())
        own = sum(d[min(3, n[c][w])] for w in vocabulary) / size
        q = {w: (n[c][w] - d[min(3, n[c][w])]) / size + own * p[w] for w in vocabulary}
        assert abs(sum(q.values()) + own * free / (len(k) + 1) - 1) < 1e-9
        logs.append({w: math.log(x) for w, x in q.items()})
    model = toxicity.train(docs, labels)
    got = toxicity.looked_up(model["words"], model["ratios"], vocabulary)
    assert len(model["words"]) == len(vocabulary) and np.allclose(got, [logs[0][w] - logs[1][w] for w in vocabulary], atol=1e-5)


def test_features_by_a_loop():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 6, 50)
    values = np.where(rng.random(int(n.sum())) < 0.2, np.nan, rng.integers(-3, 4, int(n.sum())).astype(float))
    got, at = toxicity.features(values, n), 0
    for k, m in enumerate(n):
        own = sorted((v for v in values[at : at + m] if v == v), reverse=True)
        at += m
        assert np.allclose(got[k], [sum(own[: toxicity.PEAK]) / toxicity.PEAK, sum(own) / max(1, len(own))])


def audit_by_hand(rows: list[tuple], least: int) -> set[tuple]:
    rows = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(s, w) for (_, g, s), w in zip(rows, terms) if g == lang]
        held = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t, c in held.items() if c >= least)
        count = defaultdict(Counter)
        for s, w in mine:
            count[s].update(t for t in w if held[t] >= least)
            count[None].update(t for t in w if held[t] >= least)
        p = {s: {t: 1 + 10**9 * (count[s][t] + 5) // (sum(count[s].values()) + 5 * len(kept)) for t in kept} for s in count}
        for s in {s for s, _ in mine}:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in {o for o, _ in mine} - {s}))
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            first = sorted((-(p[s][t] - p[None][t]), t.encode()) for t in kept if count[s][t] and p[s][t] > p[None][t])[:50]
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(first)}
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("The", "no", "É", "日本", "zu", "ß") for b in ("", "re", "AN", "ti", "ü")]
    rows = [(k, " ,.1".join(rng.choice(words[: 6 + 3 * (k % 9)]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "Ä", "z", None])) for k in range(400)]
    rows += [(None, None, "fr", "a"), (None, "", "fr", "b"), (None, "un deux", "fr", "c"), (900, "12", "xx", "alone"), (901, "no " * 5000, "en", "a"), rows[7], rows[7]]
    rows += [(k, "same words here", "en", "hot") for k in range(1000, 1300)]
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_divergence(spark, tmp_path, monkeypatch, sourced, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    spark.createDataFrame(sourced, DOCUMENTS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_divergence"](spark, str(tmp_path))
    rows = [tuple(r) for r in got.collect()]
    want = audit_by_hand(sourced, 30)
    assert len(rows) == len(set(rows)) and set(rows) == want and [f.dataType.simpleString() for f in got.schema[4:]] == ["bigint", "int"]
    assert {w[2] for w in want} == {"pair", "term"} and any(w[0] == "fr" and w[4] == 0 for w in want) and not any(w[0] == "xx" for w in want)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert set(db.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.op13_sql()})").fetchall()) == want


def test_counting_by_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 3)
    texts = ["aß b " + "é" * 30 + "x c, c", "", "long" * 9, " ", "日本 日本.Z z"]
    batch = pa.record_batch({"lang": ["g"] * 5, "source": ["s"] * 5, "text": texts})
    n, docs = Counter(), Counter()
    for out in divergence.counted(iter([batch, batch])):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n == Counter({"aß": 2, "b": 2, "é" * 30 + "x": 2, "c": 4, "long" * 9: 2, "日本": 4, "z": 4})
    assert docs == Counter({"aß": 2, "b": 2, "é" * 30 + "x": 2, "c": 2, "long" * 9: 2, "日本": 2, "z": 2})


def test_a_shard_adds_up_as_rows_come_in(monkeypatch):
    monkeypatch.setattr(divergence, "WAITING", 3)
    part = pa.record_batch({"lang": ["g", "g", "h"], "source": ["s", "t", "s"], "term": ["a", "a", "a"], "n": [2, 1, 5], "docs": [1, 1, 3]})
    rows = [r for out in divergence.summed(10)(iter([part] * 5)) for r in out.to_pylist()]
    assert sorted((r["lang"], r["source"], r["term"], r["n"]) for r in rows) == [("g", "s", "a", 10), ("g", "t", "a", 5), ("h", "s", "a", 25)]
    assert not [r for out in divergence.summed(16)(iter([part] * 5)) for r in out.to_pylist()]
