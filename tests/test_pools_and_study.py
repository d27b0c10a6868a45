import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlens.operators import hypotheses, parity_bpe, pools, study

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["x" * rng.randrange(1, 60) for _ in range(90)]
    return [(k, rng.choice(texts), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(120)]


def test_ladder_against_a_loop(spark, rows):
    rungs = {"a": 0, "b": 1, "c": 1}
    got = pools.ladder(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(rungs.items()), "source string, rung int"), 700).collect()
    want = set()
    for lang in ("en", "fr"):
        seen, used = set(), 0
        for rung in (0, 1):
            for k, text, x, source in sorted(rows):
                digest = hashlib.sha256(text.encode()).digest()
                if x != lang or rungs[source] != rung or digest in seen:
                    continue
                if used + len(text) > 700:
                    break
                seen.add(digest)
                used += len(text)
                want.add((lang, rung, k, len(text)))
    assert {tuple(r) for r in got} == want and {r.rung for r in got} == {0, 1}


def test_passes_reach_the_target(spark):
    sized = spark.createDataFrame([("en", k, 10) for k in range(5)] + [("fr", 9, 1000)], "lang string, doc_id long, bytes long")
    got = pools.tokenise_passes(sized, spark.createDataFrame([("en", 125), ("fr", 125)], "lang string, target long")).collect()
    assert sum(r.bytes for r in got if r.lang == "en") == 130 and max(r["pass"] for r in got) == 2
    assert [r.doc_id for r in got if r.lang == "fr"] == [9]


def test_sentences_are_packed(spark):
    text = "One two. Three! " + "y" * 25 + " Four? Five."
    got = spark.createDataFrame([(text,), ("",), ("  ",)], "t string").select(pools.sentences(F.col("t"), 16).alias("s")).collect()
    parts = [p[k : k + 16] for p in re.split(r"(?<=[.!?])\s+", text) for k in range(0, len(p), 16)]
    want, held = [], ""
    for p in parts:
        if held and len(held) + 1 + len(p) <= 16:
            held += " " + p
        else:
            want += [held] if held else []
            held = p
    assert got[0].s == [*want, held] and got[1].s == got[2].s == []


def test_pool_needs_and_top_up(spark):
    rows = spark.createDataFrame([("a", 100.0, 400.0), ("b", 1000.0, 500.0)], "lang string, bytes double, allocated double")
    needs = {r.lang: r for r in pools.pool_needs(rows).collect()}
    assert (needs["a"].passes_over_pool, needs["a"].acquire_bytes, needs["b"].acquire_bytes) == (4.0, 100.0, 550.0)
    got = pools.top_up(pools.pool_needs(rows), spark.createDataFrame([("a", 100), ("b", 50)], "lang string, bytes long")).collect()
    assert [(r.lang, r.missing_bytes) for r in got] == [("b", 500)]


def test_contexts_hold_equal_bytes(spark):
    rows = spark.createDataFrame([("plain", 4.0), ("super", 5.0)], "arm string, bytes_per_token double")
    assert {r.arm: r.context for r in pools.byte_matched_context(rows, "plain").collect()} == {"plain": 2048, "super": 1638}


def test_merge_lists_side_by_side(spark):
    one = parity_bpe.merge_lists_compared(*(spark.createDataFrame(x, "rank int, left string, right string") for x in ([(0, "a", "b"), (1, "c", "d")], [(0, "a", "b"), (1, "d", "c")]))).first()
    assert (one.n_first, one.n_second, one.common_prefix, one.n_shared) == (2, 2, 1, 1)


@pytest.mark.parametrize("kind, want", [("char", ["é", "b"]), ("byte", ["C3", "A9", "62"]), ("grapheme", ["é", "b"])])
def test_atoms(spark, kind, want):
    assert spark.createDataFrame([("éb",)], "w string").select(parity_bpe.atoms(F.col("w"), kind).alias("a")).first().a == want


def test_reweighting_gives_the_shares(spark):
    words = spark.createDataFrame([("en", "ab", 9.0), ("fr", "c", 2.0), ("es", "d", 5.0)], "lang string, word string, cnt double").withColumn("symbols", F.split("word", ""))
    got = {r.lang: r.cnt * len(r.word) for r in parity_bpe.reweighted(words, spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "lang string, share double")).collect()}
    assert got.keys() == {"en", "fr"} and abs(got["en"] - got["fr"]) < 1e-9 and abs(sum(got.values()) - 20) < 1e-9


@pytest.mark.parametrize("rho, n, p", [(0.0, 10, 1.0), (0.6, 10, 0.0667), (-0.686, 18, 0.0017), (-0.711, 18, 0.00094), (0.5, 4, 0.5), (0.5, 5, 0.391), (1.0, 9, 0.0), (0.01, 200_000, 7.7e-6)])
def test_p_of_a_rank_correlation(spark, rho, n, p):
    got = spark.createDataFrame([(rho, n)], "rho double, n long").select(hypotheses.student_p(F.col("rho"), F.col("n")).alias("p")).first().p
    assert abs(got - p) < 0.02 * p + 1e-9
    assert spark.createDataFrame([(None, 3), (0.5, 3)], "rho double, n long").where(hypotheses.student_p(F.col("rho"), F.col("n")).isNotNull()).count() == 0


def test_p_by_integrating_the_density(spark):
    rows = [(r / 10, n) for r in range(0, 10, 3) for n in (4, 5, 6, 7, 30, 31)]
    got = spark.createDataFrame(rows, "rho double, n long").select("rho", "n", hypotheses.student_p(F.col("rho"), F.col("n")).alias("p")).collect()
    for r in got:
        f = r.n - 2
        # With t = sqrt(f) tan(u) the density is cos(u)^(f - 1) up to a factor.
        u = (np.arange(400_000) + 0.5) / 400_000 * np.pi / 2
        weight = np.cos(u) ** (f - 1)
        want = weight[u > math.asin(r.rho)].sum() / weight.sum()
        assert abs(r.p - want) < 1e-5, (r, want)


def test_curve_of_pure_zipf(spark):
    counts = spark.createDataFrame([("x", str(k), 2520 // k) for k in range(1, 11)], "lang string, unit string, cnt long")
    fitted = spark.createDataFrame([("x", 1.0, 0.0)], "lang string, alpha double, b double")
    assert all(abs(r.pure - r.cnt) < 1 and abs(r.shape - 1 / r.first_rank) < 1e-9 for r in study.rank_frequency_curve(counts, fitted).collect())
