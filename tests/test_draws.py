"""Draws of sentences and the hypotheses table, each against a plain loop."""

import math
import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest

from tokenlens.operators import draws, hypotheses


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(lang, k, " ".join(rng.choice(words[: 10 + 25 * (lang == "a")]) for _ in range(rng.randrange(0, 12)))) for lang, n in (("a", 90), ("b", 40), ("c", 3)) for k in range(n)]
    return rows + [("a", 1000, None), (None, 5, "left out"), ("b", None, "left out")]


@pytest.fixture(scope="module")
def rows(spark, corpus):
    return draws.sentences(spark.createDataFrame(corpus, "lang string, doc_id long, text string")).persist()


def of(corpus) -> dict:
    out = defaultdict(dict)
    for lang, k, text in corpus:
        if lang is not None and k is not None:
            out[lang][k] = (text or "").split()
    return out


def test_matched_draws(rows, corpus):
    got = draws.matched(rows, 100, 4, seed=5).collect()
    for lang, own in of(corpus).items():
        for draw in range(4):
            mine = {r.sent: r.units for r in got if (r.lang, r.draw) == (lang, draw)}
            order = sorted((k for k in own if own[k]), key=lambda k: md5(f"{5 + draw}:{k}".encode()).hexdigest())
            left, want = 100, {}
            for k in order:
                if left > 0:
                    want[k] = own[k][:left]
                    left -= len(want[k])
            assert mine == want
    assert {r.lang: r.budget_met for r in got} == {"a": True, "b": True, "c": False}
    assert all(sum(r.n_units for r in got if (r.lang, r.draw) == (lang, d)) == 100 for lang in "ab" for d in range(4))
    orders = {tuple(sorted(r.sent for r in got if (r.lang, r.draw) == ("a", d))) for d in range(4)}
    assert len(orders) == 4


def test_bootstraps(rows, corpus):
    weights = draws.resampled(rows, 200, seed=5)
    got = defaultdict(Counter)
    for r in weights.collect():
        got[r.lang, r.draw][r.sent] = r.weight
    for lang, own in of(corpus).items():
        places = sorted(own)
        for draw in range(200):
            want = Counter(places[int(md5(f"{5 + draw}:{k}".encode()).hexdigest()[:15], 16) % len(places)] for k in range(len(places)))
            assert got[lang, draw] == want and sum(want.values()) == len(places)
    # Weights of one sentence are binomial over draws: mean 1, variance 1 - 1 / n.
    w = np.array([[got["a", d][k] for k in of(corpus)["a"]] for d in range(200)])
    assert abs(w.mean() - 1) < 1e-12 and abs(w.var() - (1 - 1 / 91)) < 0.05
    counts = {(r.lang, r.unit): r.cnt for r in draws.counts_of_resampled(rows, weights.where("draw = 7")).collect()}
    want = Counter()
    for lang, own in of(corpus).items():
        for k, units in own.items():
            for u in units:
                want[lang, u] += got[lang, 7][k]
    assert counts == {k: n for k, n in want.items() if n}


def statistics(cnt: list[int]) -> tuple:
    cnt = np.sort(np.array(cnt, float))[::-1]
    p, rank = cnt / cnt.sum(), np.arange(1, len(cnt) + 1)
    z = (1 / rank) / (1 / rank).sum()
    return -(p * np.log(p)).sum(), np.abs(np.cumsum(p) - np.cumsum(z)).max(), -np.polyfit(np.log(rank), np.log(cnt), 1)[0]


def test_cells(rows, corpus):
    drawn = draws.matched(rows, 60, 3)
    counts = draws.counts_of_matched(drawn)
    by = defaultdict(list)
    for r in counts.collect():
        by[r.lang, r.draw].append(r.cnt)
    each = {(r.lang, r.draw): (r.entropy_nats, r.ks_zipf, r.ols_slope) for r in draws.statistics(counts).collect()}
    assert each.keys() == by.keys() and all(np.allclose(each[k], statistics(v), atol=1e-6) for k, v in by.items())
    cells = {(r.view, r.lang, r.metric): r for r in draws.cells(rows, 60, 3).collect()}
    assert len(cells) == 2 * 3 * 3
    for lang in "ab":
        values = [each[lang, d][0] for d in range(3)]
        r = cells["matched_token", lang, "entropy_nats"]
        assert abs(r.mean - np.mean(values)) < 2e-6 and abs(r.sd - np.std(values, ddof=1)) < 2e-6 and abs(r.low - np.quantile(values, 0.025)) < 2e-6 and r.budget_met and r.n == 3
        whole = Counter(u for units in of(corpus)[lang].values() for u in units)
        assert abs(cells["matched_sentence", lang, "entropy_nats"].point - statistics(list(whole.values()))[0]) < 2e-6
    assert not cells["matched_token", "c", "ks_zipf"].budget_met


def test_hypotheses(spark):
    rng = random.Random(3)
    langs = [f"l{k}" for k in range(9)]
    share = {x: rng.choice([0.1, 0.2, 0.3, 0.4, 0.5]) for x in langs}
    profile = spark.createDataFrame([(x, share[x], 1 - share[x], rng.random() if x != "l3" else None) for x in langs], "lang string, share_of_vocab double, share_mass_not_in_control double, share_fragment_mass double")
    rows = [(x, t, u, -share[x] * (t == "big") + rng.random() * (5 if t == "b2" else 0.01), float("inf") if x == "l0" else rng.random()) for x in langs for t in ("big", "b2", "fair") for u in ("token", "word", "grapheme")]
    fits = spark.createDataFrame(rows, "lang string, tokenizer string, unit string, ks_zipf double, log_effective_vocab double")
    got = {(r.hypothesis, r.tokenizer, r.x, r.y): r for r in hypotheses.evaluated(profile, fits, "big", ("big", "b2"), "fair").collect()}
    assert len(got) == 1 + 3 + 4 + 3

    def rho(pairs):
        x, y = (np.array(v) for v in zip(*pairs))
        mid = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        return np.corrcoef(mid(x), mid(y))[0, 1]

    ks, ev = {(x, t, u): k for x, t, u, k, _ in rows}, {(x, t, u): e for x, t, u, _, e in rows}
    h1 = got["H1", "big", "share_of_vocab", "share_mass_not_in_control"]
    assert h1.rho == -1 and h1.p == 0 and h1.supported
    want = rho([(share[x], ks[x, "big", "token"]) for x in langs])
    assert math.isclose(got["H2", "big", "share_of_vocab", "ks_zipf"].rho, want, abs_tol=1e-7)
    r = got["H2", "big", "share_of_vocab", "log_effective_vocab"]
    assert r.n == 8 and math.isclose(r.rho, rho([(share[x], ev[x, "big", "token"]) for x in langs if x != "l0"]), abs_tol=1e-7)
    assert got["H2", "big", "share_fragment_mass", "ks_zipf"].n == 8
    r = got["H3", "big", "share_of_vocab", "ks_zipf less that of word"]
    assert math.isclose(r.rho, rho([(share[x], ks[x, "big", "token"] - ks[x, "big", "word"]) for x in langs]), abs_tol=1e-7)
    spread = {t: np.std([ks[x, t, "token"] for x in langs], ddof=1) for t in ("big", "b2", "fair")}
    assert all(abs(got["H4", t, "language", "ks_zipf"].spread - v) < 1e-6 for t, v in spread.items())
    assert got["H4", "fair", "language", "ks_zipf"].supported is True and got["H4", "big", "language", "ks_zipf"].supported is None
    few = {r.hypothesis: r for r in hypotheses.evaluated(profile.limit(3), fits, "big", ("big",), "fair").collect()}
    assert few["H1"].rho is None and few["H1"].p is None and few["H1"].n == 3 and not few["H1"].supported
