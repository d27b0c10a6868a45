import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def sentences(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def rows() -> list[tuple]:
    rng = random.Random(5)
    english, french = ["the", "and", "thing", "other", "wheat", "shore", "ring", "hath"], ["été", "le", "queue", "aux", "être", "oiseau", "mer", "ça"]
    texts = [(sentences(rng, english if k % 2 else french, 40 + k), "en" if k % 2 else "fr") for k in range(40)]
    long = sentences(rng, english, 3000)
    passage = sentences(rng, [f"w{k}" for k in range(500)], 60)
    texts += [(texts[1][0], "en"), (texts[1][0], "en"), (texts[3][0] + " more", "en"), (long, "en"), (long + " tail", None)]
    texts += [(sentences(rng, english, 30) + " " + passage + " " + sentences(rng, french, 30), "en") for _ in range(4)]
    texts += [(None, "en"), ("", None), ("   ", "fr"), ("12 34", None), ("日本語 テキスト", None), ("a" * 700, None), ("x y", "en"), ("🙂 émoji \n\n line\nline\nline", "fr"), ("Licensed under CC BY-NC 4.0.\nSome words.", "en"), ("ALL RIGHTS  RESERVED", None)]
    texts += [("a b c d e f g h " * 12, "en"), ("Reen " * 50, "en"), ("w$$$ w%%% " * 30, "en")]
    out = [(k, t, lang, f"s{k % 3}", len(t or "")) for k, (t, lang) in enumerate(texts)]
    return [*out, out[5]]


@pytest.fixture(scope="session")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    spark.createDataFrame(rows(), DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    base = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(30)]
    vectors = [(k, v, k % 2) for k, v in enumerate(base)]
    for k in range(30, 90):
        b = rng.choice(base[:6])
        vectors.append((k, [x + rng.gauss(0, 0.09) for x in b], k % 2))
    vectors += [(90, base[0], 0), (91, base[0], 0), (92, base[0], None), (93, None, 0), (94, [0.0] * 32, 0), (95, [float("nan")] * 32, 0), (96, [1.0, None], 0), (97, [1e30] * 32, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(40)] + [(7, 1, 0), (None, 1, 1), (3, 0, None)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def documents(data, spark):
    return spark.read.parquet(f"{data}/documents.parquet").collect()
