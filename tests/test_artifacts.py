import json
import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers, trainers

from tokenlens.functions import text as T
from tokenlens.operators import pools, vocabulary
from tokenlens.sources import artifacts

TEXTS = ["the cat sat on the mat, it's 2024!", "  the   cats\n\nsat", "été déjà vu ñandú", "日本語 日本", "🙂🙂 ok", "", "a" * 300, "tabs\tand\r\nlines"]


def saved(folder, pre_tokenizer, size=400):
    """A small artifact: merges are learned here by the library, from these few texts."""
    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizer
    tokenizer.train_from_iterator(TEXTS * 3, trainers.BpeTrainer(vocab_size=size, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), special_tokens=["<|end of text|>"], show_progress=False))
    folder.mkdir(exist_ok=True)
    model = json.loads(tokenizer.to_str())["model"]
    (folder / "vocab.json").write_text(json.dumps(model["vocab"], ensure_ascii=False), encoding="utf-8")
    lines = [" ".join(m) if isinstance(m, list) else m for m in model["merges"]]
    (folder / "merges.txt").write_text("#version: 0.2\n" + "\n".join(lines) + "\n", encoding="utf-8")
    tokenizer.save(str(folder / "tokenizer.json"))
    return tokenizer


STAGE = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(T.PRETOKEN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])


@pytest.mark.parametrize("kind", ["split", "byte_level", "whole", "gaps"])
def test_ids_are_those_of_the_library(spark, tmp_path, kind):
    step = {
        "split": STAGE, "byte_level": pre_tokenizers.ByteLevel(add_prefix_space=False), "whole": pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        "gaps": pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\p{L}+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]),
    }[kind]
    tokenizer = saved(tmp_path / "arm", step)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("the cat é日🙂,. \n12'st") for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(k, "x", t) for k, t in enumerate(texts)] + [(900, None, None)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.ids for r in artifacts.Artifact(spark, str(tmp_path / "arm")).encoded(docs).collect()}
    assert got == {k: tokenizer.encode(t).ids for k, t in enumerate(texts)} | {900: []}


def test_missing_pre_tokenizers_are_errors(spark, tmp_path):
    saved(tmp_path / "arm", STAGE)
    path = tmp_path / "arm/tokenizer.json"
    data = json.loads(path.read_text())
    for step, message in ((None, "no pre-tokenizer"), ({"type": "Metaspace"}, "Metaspace"), ({"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}, "blank")):
        path.write_text(json.dumps(data | {"pre_tokenizer": step}))
        with pytest.raises(ValueError, match=message):
            artifacts.Artifact(spark, str(tmp_path / "arm"))
    path.unlink()
    with pytest.raises(FileNotFoundError):
        artifacts.Artifact(spark, str(tmp_path / "arm"))


def test_bytes_of_tokens(spark):
    table = T.byte_characters()
    tokens = [("".join(table[b] for b in raw), raw) for raw in (b" the", bytes(range(256)), "é".encode())] + [("<| |>", None), ("日", None)]
    rows = spark.createDataFrame([(t,) for t, _ in tokens], "token string").select("token", artifacts.bytes_of(F.col("token")).alias("raw")).collect()
    assert {r.token: r.raw if r.raw is None else bytes(r.raw) for r in rows} == dict(tokens)


def test_pairs_of_artifacts(spark, tmp_path):
    for name, size in (("a", 300), ("b", 300), ("c", 320)):
        saved(tmp_path / name, STAGE if name != "b" else pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), size)
    tables = {n: (artifacts.vocab(spark, str(tmp_path / n)), artifacts.merges(spark, str(tmp_path / n))) for n in "abc"}
    listed = {n: json.loads((tmp_path / n / "vocab.json").read_text()) for n in "abc"}
    lines = {n: [x for x in (tmp_path / n / "merges.txt").read_text().splitlines() if x and not x.startswith("#")] for n in "abc"}
    assert [(r.rank, f"{r.left} {r.right}") for r in tables["a"][1].orderBy("rank").collect()] == list(enumerate(lines["a"]))
    row = artifacts.pair_verified(tables["a"], tables["b"], 300, 270).first()
    wrong = {t for t, k in listed["a"].items() if k < 270 and listed["b"].get(t) != k}
    prefix = next((k for k, (x, y) in enumerate(zip(lines["a"], lines["b"])) if x != y), min(map(len, (lines["a"], lines["b"]))))
    assert (row.first_size, row.second_size, row.n_first, row.common_prefix, row.shared_id_mismatches) == (300, 300, len(lines["a"]), prefix, len(wrong))
    assert row.passed and row.inherited == 270 - (300 - len(lines["a"])) and {r.token for r in artifacts.id_mismatches(tables["a"][0], tables["b"][0], 270).collect()} == wrong
    assert not artifacts.pair_verified(tables["a"], tables["c"], 300, 270).first().passed and not artifacts.pair_verified(tables["a"], tables["b"], 300, 200).first().passed


def test_encoder_by_a_plain_loop():
    rng = random.Random(7)
    for _ in range(60):
        merges, tokens = [], [bytes([b]) for b in b"abc"]
        for _ in range(rng.randrange(1, 12)):
            m = rng.choice(tokens), rng.choice(tokens)
            if m not in merges:
                merges.append(m)
                tokens.append(m[0] + m[1])
        encoder = vocabulary.Encoder(merges, {t: k for k, t in enumerate(tokens)})
        rank = {m: k for k, m in enumerate(merges)}
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))
            s = [bytes([b]) for b in word.encode()]
            while len(s) > 1:
                best, at = min((rank.get(p, len(rank)), k) for k, p in enumerate(zip(s, s[1:])))
                if best == len(rank):
                    break
                s[at : at + 2] = [s[at] + s[at + 1]]
            assert encoder.encode(word) == [encoder.ids[x] for x in s]


def test_first_sentences(spark):
    rng = random.Random(3)
    text = lambda: " ".join("x" * rng.randrange(1, 200) + rng.choice(".!?") for _ in range(rng.randrange(0, 9)))
    rows = [(lang, k, text()) for lang in ("a", "b") for k in range(40)] + [(None, 1, "left out."), ("a", 100, None)]
    docs = spark.createDataFrame(rows, "lang string, doc_id long, text string")

    def units(t):
        out = []
        for s in (s for s in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if s):
            if out and len(out[-1]) + 1 + len(s) <= 280:
                out[-1] += " " + s
            else:
                out.append(s)
        return out

    got = pools.first_sentences(docs, 30).collect()
    for lang in "ab":
        every = [(u, k) for g, k, t in sorted((r for r in rows if r[0] == lang), key=lambda r: r[1]) for u in units(t)]
        mine = sorted((r.place, r.unit, r.doc_id) for r in got if r.lang == lang)
        assert mine == [(p, u, k) for p, (u, k) in enumerate(every[:30])]
        assert {r.docs_used for r in got if r.lang == lang} == {len({k for _, k in every[:30]})}
    with pytest.raises(ValueError, match="a \\("):
        pools.first_sentences(docs, 100_000)
