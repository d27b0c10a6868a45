import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlens.operators import corpus, study, vocab, zipf


def test_language_files_have_exactly_the_budget(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé日👩") for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    rows = [(k, t, rng.choice(["en", "fr"])) for k, t in enumerate(texts)] + [(500, None, "en"), (501, "crlf\r\n", "fr"), (502, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for budget in (101, 102, 103, 104, 400):
        got = corpus.equal_files(corpus.language_files(docs, budget), budget).collect()
        for lang in ("en", "fr"):
            want, out = b"".join(((t or "").rstrip("\r\n") + "\n").encode() for _, t, x in sorted(rows, key=lambda r: r[0]) if x == lang), b""
            for r in sorted((r for r in got if r.lang == lang), key=lambda r: r.doc_id):
                out += r.line.encode()
            cut = want[:budget].decode("utf-8", "ignore").encode()
            assert out == cut + b"\n" * (budget - len(cut)) and sum(r.padding for r in got if r.lang == lang) == budget - len(cut) <= 3
    with pytest.raises(ValueError, match="fewer than"):
        corpus.language_files(docs, 10**6)
    with pytest.raises(ValueError, match="differ"):
        corpus.equal_files(corpus.language_files(docs, 100), 101)


def test_tier_budgets(spark):
    tiers = spark.createDataFrame([("smoke", 10, 40), ("wrong", 10, 41)], "tier string, bytes_per_language long, corpus_bytes long")
    assert corpus.tier_budget(tiers, "smoke", 4, 100) == 10
    for tier, ceiling, error in (("wrong", 100, ValueError), ("smoke", 39, ValueError), ("none", 100, KeyError)):
        with pytest.raises(error):
            corpus.tier_budget(tiers, tier, 4, ceiling)


def test_selected_sources(spark):
    rows = [("a", "train_candidate", "mit", "mit", True), ("b", "train_candidate", "cc-by-sa-4.0", "permissive_open", True), ("c", "train_candidate", "custom", None, False), ("d", "benchmark", "mit", "mit", True), ("e", "train_candidate", "gpl", "copyleft_sharealike", None), ("f", "train_candidate", None, "restricted", None)]
    sources = spark.createDataFrame(rows, "source_id string, role string, license string, license_status string, is_permissive_open boolean")
    got = {r.source_id: (r.selected, r.reason) for r in corpus.selected_sources(sources, True).collect()}
    assert got == {"a": (True, None), "b": (False, "cc_by_sa_excluded"), "c": (False, "not_permissive_open"), "e": (False, "cc_by_sa_excluded"), "f": (False, "restricted")}
    assert all(r.selected for r in corpus.selected_sources(sources, False).collect())


def test_licences_and_addresses(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c.alias("y")).first().y
    for raw, want in (("MIT", True), ("CC BY 4.0", True), ("cc-by-sa 4.0", False), ("gpl", False), (None, False), ("CC0", True)):
        assert row(corpus.is_permissive(F.col("x")), raw) is want
    assert row(corpus.is_mit(F.col("x")), "mit") and row(corpus.dataset_id(F.col("x")), "https://huggingface.co/datasets/a/b#c") == "a/b"
    assert row(corpus.dataset_id(F.col("x")), "https://example.org/a/b") is None


def test_zipf_statistics_against_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(zipf, "PIECE", 50)
    rng = np.random.default_rng(2)
    groups = {"a": rng.zipf(1.6, 900), "b": rng.integers(1, 4, 300), "c": np.array([5])}
    counts = spark.createDataFrame([(k, str(i), int(min(c, 10**6))) for k, v in groups.items() for i, c in enumerate(v)], "lang string, unit string, cnt long")
    got = {r.lang: r for r in zipf.against_zipf(counts).collect()}
    for lang, v in groups.items():
        cnt = np.sort(np.minimum(v, 10**6).astype(float))[::-1]
        rank = np.arange(1, len(cnt) + 1)
        p, z = cnt / cnt.sum(), (1 / rank) / (1 / rank).sum()
        assert abs(got[lang].ks_zipf - np.abs(np.cumsum(p) - np.cumsum(z)).max()) < 2e-7
        assert abs(got[lang].loglog_rmse - np.sqrt(np.mean((np.log(p) - np.log(z)) ** 2))) < 2e-7
        slope = -np.polyfit(np.log(rank), np.log(cnt), 1)[0] if len(cnt) > 1 else None
        assert (got[lang].loglog_ols_slope is None) == (slope is None) and (slope is None or abs(got[lang].loglog_ols_slope - slope) < 1e-6)
    pure = {(r.lang, r.first_rank): r.pure for r in study.pure_curve(counts).collect()}
    assert math.isclose(pure["a", 1], np.minimum(groups["a"], 10**6).sum() / (1 / np.arange(1, 901)).sum(), rel_tol=1e-9)


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(x), float(rng.integers(0, 9) + x)) for g, n in (("a", 400), ("b", 30), ("c", 3), ("d", 10)) for x in rng.integers(0, 12, n)]
    rows += [("a", None, 1.0), (None, 1.0, 2.0)] + [("e", 1.0, float(k)) for k in range(6)]
    got = {r.g: r for r in zipf.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g").collect()}

    def mid(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for g in "abd":
        x, y = (np.array([r[k] for r in rows if r[0] == g and r[1] is not None]) for k in (1, 2))
        assert got[g].n == len(x) and abs(got[g].rho - np.corrcoef(mid(x), mid(y))[0, 1]) < 1e-7
    assert got["c"].rho is None and got["e"].rho is None and set(got) == set("abcde")


def test_fits_of_blocks_are_those_of_types(monkeypatch):
    rng = np.random.default_rng(4)
    cnt = np.sort(np.minimum(rng.zipf(1.5, 40_000), 10**6))[::-1]
    whole = zipf.fit_mandelbrot(cnt)
    distinct, types = np.unique(cnt, return_counts=True)
    monkeypatch.setattr(zipf, "EXACT_RANKS", 500)
    got = zipf.fit_mandelbrot(distinct, types)
    for k, tolerance in (("alpha", 1e-4), ("b", 1e-3), ("nll", 1e-6), ("ks", 1e-3)):
        assert math.isclose(got[k], whole[k], rel_tol=tolerance, abs_tol=1e-4), (k, got, whole)
    rank, n, _ = zipf.stretches(distinct[::-1], types[::-1])
    assert n.sum() == 40_000 and len(n) < 15_000


def test_resampling_in_parts(monkeypatch):
    cnt, types = np.array([500, 40, 3, 1]), np.array([2, 30, 900, 4000])
    means = []
    for part in (1 << 20, 64):
        monkeypatch.setattr(zipf, "RESAMPLED", part)
        rng = np.random.default_rng(1)
        means.append(np.mean([zipf.resampled_entropy(rng, cnt, types) for _ in range(60)]))
    p = np.repeat(cnt, types) / (cnt * types).sum()
    rng = np.random.default_rng(2)
    h = lambda x: -(x[x > 0] * np.log(x[x > 0])).sum()
    want = np.mean([h(rng.multinomial(int((cnt * types).sum()), p) / (cnt * types).sum()) for _ in range(60)])
    assert np.allclose(means, want, atol=0.01)


def test_bounds_of_fits_are_told():
    assert not zipf.fit_mandelbrot((np.arange(1, 2000) + 2.0) ** -1.1 * 1e6)["at_bound"]
    flat = zipf.fit_mandelbrot(np.full(500, 200.0))
    assert flat["at_bound"] and not flat["converged"]


def test_fragments_and_mixed_scripts(spark):
    tokens = spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"\xe1\x88")), (2, bytearray("é".encode())), (3, bytearray(b"\x88"))], "token_id int, raw binary")
    counts = spark.createDataFrame([("en", 0, 8), ("en", 2, 2), ("amh", 1, 30), ("amh", 3, 10), ("amh", 0, 10)], "lang string, token_id int, cnt long")
    got = {r.lang: (r.n_fragment_types, r.n_fragment_tokens, r.share_types, r.share_mass) for r in vocab.fragment_usage(counts, tokens).collect()}
    assert got == {"en": (0, 0, 0.0, 0.0), "amh": (2, 40, round(2 / 3, 9), 0.8)}
    assert Counter(r.bucket for r in vocab.token_buckets(tokens).collect()) == {"Latin": 2, "<byte_fragment>": 2}
    units = spark.createDataFrame([("aя",), ("яb",), ("日a",), ("plain",), ("12",)], "unit string")
    assert [tuple(r) for r in vocab.mixed_scripts(units).collect()] == [("Cyrillic+Latin", 2), ("Han+Latin", 1)]
    shares = vocab.allocation_shares(units.withColumn("cnt", F.lit(1))).collect()
    assert shares[0].bucket == "<mixed_script>" and math.isclose(sum(r.share for r in shares), 1, abs_tol=1e-6)


def test_contamination_of_any_text(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [make(20), make(5), None, "x " * 12]
    texts = [make(10) + " " + items[0] + " " + make(4), make(50), None, "", "X x " * 9, items[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    grams = lambda t: {tuple(w[k : k + 8]) for w in [(t or "").lower().split()] for k in range(len(w) - 7)}
    known = set().union(*map(grams, items))
    want = {k: len(grams(t) & known) for k, t in enumerate(texts) if grams(t) & known}
    assert {r.doc_id: r.n_shared for r in corpus.contaminated(docs, bench).collect()} == want and len(want) == 2
