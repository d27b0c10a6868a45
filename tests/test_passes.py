"""How often a query reads the texts: counted by the rows that pass, whatever the plan."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
import regex

from tokenlens.functions import text as T
from tokenlens.operators import corpus, draws, vocabulary
from tokenlens.plans import queries

TEXTS = {"en": "the cat sat on the mat, and the dog saw it", "de": "die Katze saß auf der Matte und der Hund sah zu", "fr": "le chat était assis sur le tapis", "es": "el gato se sentó en la alfombra 12"}
ROWS = [(k, f"{text} {k % 5} {'xyz' * (k % 3)}", lang, "web") for k, (lang, text) in enumerate([*TEXTS.items()] * 5)]
#: Queries and the most times that they may read the texts.
MOST = [("study_hypotheses", 2), ("token_entropy", 1), ("token_efficiency", 3), ("bpe_arms_compared", 3), ("bpe_encode_ctc", 2), ("matched_draw_summary", 3)]


def passes(spark, monkeypatch, name: str) -> float:
    seen = spark.sparkContext.accumulator(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(queries, "docs", lambda *_: table.mapInArrow(run, table.schema))
    queries.queries()[name](spark, "").collect()
    return seen.value / len(ROWS)


@pytest.mark.parametrize("name,most", MOST)
def test_texts_are_read_a_fixed_number_of_times(spark, monkeypatch, name, most):
    assert passes(spark, monkeypatch, name) <= most


def test_a_task_encodes_few_words_at_once(monkeypatch):
    monkeypatch.setattr(vocabulary, "SLICE", 10)
    words = [["a"] * n for n in (3, 0, 9, 25, 1, 1, 1, 8)]
    parts = [*vocabulary._slices(pa.RecordBatch.from_pydict({"words": words}))]
    assert [w for part in parts for w in part.column("words").to_pylist()] == words
    sizes = [[len(w) for w in part.column("words").to_pylist()] for part in parts]
    assert all(sum(n) - max(n) < 10 for n in sizes) and len(parts) > 3  # one text may be longer


def test_units_of_a_bootstrap_are_shuffled_once(spark, capsys):
    rows = draws.sentences(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string"))
    weights = spark.createDataFrame([("en", 0, 0, 2)], "lang string, draw int, sent long, weight long")
    draws.counts_of_resampled(rows, weights).explain()
    shuffles = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("unit#" in line for line in shuffles) == 1


def test_number_of_clusters(spark):
    texts = ["", "abc\r\n\r\r\nx\n\r", "é\u00ad\u00a9 ß", "e\u0301a", "\u0915\u094d\u0937", "\U0001f468\u200d\U0001f469", "\u0000\t\r\n"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.n_graphemes(T.F.col("text")).alias("n")).collect()
    assert {r.text: r.n for r in got} == {t: len(regex.findall(r"\X", t)) for t in texts}


def test_rows_of_one_document_share_an_ngram_once(spark):
    text = "a b c d e f g h i"
    rows = spark.createDataFrame([(1, text), (1, f"{text} x {text}"), (2, text[:-2]), (3, "a b c d")], "doc_id long, text string")
    got = corpus.contaminated(rows, spark.createDataFrame([(text,)], "text string"))
    assert {r.doc_id: r.n_shared for r in got.collect()} == {1: 2, 2: 1}
