"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import bpe, corpus, draws, hypotheses, metrics, parity_bpe, pools, study, token_metrics, vocab, vocabulary, zipf
from ..sources.shared import stored

FAMILIES = [("en", "Germanic"), ("de", "Germanic"), ("fr", "Romance"), ("es", "Romance")]
HOLDOUT, BUDGET, ROBIN, CAP = 5, 100_000, 400_000, 4.0
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


PATTERN = T.PRETOKEN_PLAIN.replace("'", "''")
EFFICIENCY = f"""
  WITH c AS (SELECT lang, count(*) AS n_sentences, sum(strlen(text)) AS byte, sum(length(text)) AS char, sum(length_grapheme(text)) AS grapheme,
      sum(len(regexp_extract_all(text, '\\S+'))) AS word, sum(len(regexp_extract_all(text, '{PATTERN}'))) AS pretok,
      sum(len(regexp_extract_all(text, '\\S+'))) AS n_words, sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS n_chars FROM documents GROUP BY lang),
  u AS (UNPIVOT c ON byte, char, grapheme, word, pretok INTO NAME tokenizer VALUE ctc),
  m AS (SELECT tokenizer, lang, n_sentences::BIGINT AS n_sentences, ctc::BIGINT AS ctc, n_words::BIGINT AS n_words, n_chars::BIGINT AS n_chars,
      round(ctc / n_words, 9) AS fertility, round(n_chars / ctc, 9) AS chars_per_token,
      round(ctc / max(CASE WHEN lang = 'en' THEN ctc END) OVER (PARTITION BY tokenizer), 9) AS token_premium FROM u)
"""


@register(EFFICIENCY + "SELECT * FROM m")
def efficiency_metrics(spark, sf_dir):
    return metrics.efficiency(docs(spark, sf_dir))


WORDS = "w AS (SELECT lang, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents)"


@register(f"""
  WITH {WORDS}, t AS (SELECT lang, w, count(*) AS n, len(regexp_extract_all(' ' || w, '{PATTERN}')) = 1 AS kept FROM w GROUP BY lang, w),
  k AS (SELECT lang, sum(n)::BIGINT AS n_words, sum(CASE WHEN kept THEN n ELSE 0 END)::BIGINT AS n_kept, count(*) AS n_types, count(CASE WHEN kept THEN 1 END) AS n_types_kept FROM t GROUP BY lang),
  p AS (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS p FROM documents),
  s AS (SELECT lang, count(*) AS n_tokens, count(CASE WHEN length(p) = 1 AND NOT regexp_matches(p, '^\\s$') THEN 1 END) AS n_shreds FROM p GROUP BY lang)
  SELECT lang, n_words, n_kept, n_tokens, n_shreds, round(n_kept / n_words, 9) AS strr, round(n_shreds / n_tokens, 9) AS stfr, round(n_types_kept / n_types, 9) AS word_coverage FROM k JOIN s USING (lang)""")
def retention_and_shredding(spark, sf_dir):
    return metrics.retention(docs(spark, sf_dir))


@register(EFFICIENCY + """, r AS (SELECT tokenizer, ctc / n_sentences AS v, row_number() OVER (PARTITION BY tokenizer ORDER BY ctc / n_sentences) AS i, count(*) OVER (PARTITION BY tokenizer) AS n FROM m)
  SELECT tokenizer, round((max(n) + 1 - 2 * sum((n + 1 - i) * v) / sum(v)) / max(n), 9) AS gini FROM r GROUP BY tokenizer""")
def gini_tokens_per_line(spark, sf_dir):
    return metrics.gini(efficiency_metrics(spark, sf_dir))


@register(EFFICIENCY + """, b AS (SELECT tokenizer, fertility AS ref FROM m WHERE lang = 'en'),
  g AS (SELECT lang, count(CASE WHEN token_premium >= 2.0 THEN 1 END) AS n_premium, round(max(fertility / ref), 9) AS most_ratio, bool_or(fertility >= 2.0 * ref) AS clause_b FROM m JOIN b USING (tokenizer) WHERE lang <> 'en' GROUP BY lang)
  SELECT lang, n_premium, most_ratio, n_premium >= 2 AS clause_a, clause_b, n_premium >= 2 OR clause_b AS worth FROM g""")
def decision_rule(spark, sf_dir):
    return metrics.decision(stored(efficiency_metrics(spark, sf_dir)))  # a row per tokenizer and language


@register(EFFICIENCY + """, f(lang, family) AS (VALUES ('en', 'Germanic'), ('de', 'Germanic'), ('fr', 'Romance'), ('es', 'Romance'))
  SELECT tokenizer, coalesce(family, 'all') AS family, round(avg(token_premium), 9) AS mean_premium, count(*) AS n FROM m LEFT JOIN f USING (lang) WHERE lang <> 'en' GROUP BY GROUPING SETS ((tokenizer, family), (tokenizer))""")
def group_mean_premium(spark, sf_dir):
    return metrics.group_premiums(efficiency_metrics(spark, sf_dir), spark.createDataFrame(FAMILIES, "lang string, family string"))


@register(EFFICIENCY + "SELECT lang, " + ", ".join(f"max(CASE WHEN tokenizer = '{t}' THEN token_premium END) AS {t}" for t in metrics.TOKENIZERS) + " FROM m GROUP BY lang")
def wide_premium_pivot(spark, sf_dir):
    return metrics.wide(efficiency_metrics(spark, sf_dir), "token_premium")


@register(EFFICIENCY + """, l AS (UNPIVOT (SELECT tokenizer, lang, fertility, chars_per_token, token_premium FROM m) ON fertility, chars_per_token, token_premium INTO NAME metric VALUE value),
  g AS (SELECT metric, avg(CASE WHEN tokenizer = 'byte' THEN value END) AS b, avg(CASE WHEN tokenizer = 'pretok' THEN value END) AS c FROM l GROUP BY metric)
  SELECT metric, round(b, 8) AS baseline, round(c, 8) AS compare, round(c - b, 8) AS delta, round(100 * (c - b) / b, 6) AS pct_change FROM g""")
def ab_summary(spark, sf_dir):
    return metrics.compare(efficiency_metrics(spark, sf_dir), "byte", "pretok")


COUNTS = f"WITH {WORDS}, u AS (SELECT lang, w AS unit, count(*) AS cnt FROM w GROUP BY lang, w)"


def words_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipf.unit_counts(docs(spark, sf_dir), "word")


@register(COUNTS + "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC) AS rank, cnt FROM u")
def rank_frequency(spark, sf_dir):
    return zipf.ranked(words_counted(spark, sf_dir))


@register(COUNTS + """, p AS (SELECT lang, cnt, cnt / sum(cnt) OVER (PARTITION BY lang) AS p FROM u),
  g AS (SELECT lang, sum(cnt)::BIGINT AS n_tokens, count(*) AS n_types, -sum(p * ln(p)) AS h, sum(pow(p, 2.5)) AS q FROM p GROUP BY lang)
  SELECT lang, n_tokens, n_types, round(h, 8) AS entropy_nats, round(h / ln(2), 8) AS entropy_bits, round(h / ln(n_types), 8) AS entropy_norm, round(exp(h), 4) AS effective_vocab,
    round(ln(q) / -1.5, 8) AS renyi_entropy_nats, round(ln(q) / -1.5 / ln(n_types), 8) AS renyi_efficiency_active FROM g""")
def entropy_family(spark, sf_dir):
    return zipf.entropy(words_counted(spark, sf_dir))


@register(COUNTS + """, r AS (SELECT lang, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC) AS r FROM u),
  c AS (SELECT lang, cnt, r, sum(cnt) OVER w / sum(cnt) OVER l AS emp, sum(1.0::DOUBLE / r) OVER w / sum(1.0::DOUBLE / r) OVER l AS zipf, cnt / sum(cnt) OVER l AS p, (1.0::DOUBLE / r) / sum(1.0::DOUBLE / r) OVER l AS z FROM r
    WINDOW l AS (PARTITION BY lang), w AS (PARTITION BY lang ORDER BY r ROWS UNBOUNDED PRECEDING))
  SELECT lang, count(*) AS n_types, round(max(abs(emp - zipf)), 7) AS ks_zipf, round(sqrt(avg(pow(ln(p) - ln(z), 2))), 7) AS loglog_rmse, round(-regr_slope(ln(cnt), ln(r)), 7) AS loglog_ols_slope FROM c GROUP BY lang""")
def ks_pure_zipf(spark, sf_dir):
    return zipf.against_zipf(words_counted(spark, sf_dir))


@register("""WITH s AS (SELECT lang, doc_id, len(regexp_extract_all(text, '\\S+')) AS n, md5('7:' || doc_id) AS h FROM documents),
  b AS (SELECT greatest(1, floor(min(t) * 0.95)) AS budget FROM (SELECT sum(n) AS t FROM s GROUP BY lang)),
  r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY substr(h, 1, 8), h) AS running FROM s)
  SELECT lang, count(*) AS n_docs, sum(least(n, budget - (running - n)))::BIGINT AS n_units FROM r, b WHERE running - n < budget GROUP BY lang""")
def matched_budget_counts(spark, sf_dir):
    return zipf.matched_counts(docs(spark, sf_dir))


@register("""WITH d AS (SELECT lang, strlen(text)::DOUBLE AS x, len(regexp_extract_all(text, '\\S+')) / strlen(text) AS y FROM documents WHERE strlen(text) > 0),
  r AS (SELECT lang, (rank() OVER (PARTITION BY lang ORDER BY x) + count(*) OVER (PARTITION BY lang) + 1 - rank() OVER (PARTITION BY lang ORDER BY x DESC)) / 2 AS rx,
    (rank() OVER (PARTITION BY lang ORDER BY y) + count(*) OVER (PARTITION BY lang) + 1 - rank() OVER (PARTITION BY lang ORDER BY y DESC)) / 2 AS ry FROM d)
  SELECT lang, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN corr(rx, ry) END, 8) AS rho FROM r GROUP BY lang""")
def spearman_length_density(spark, sf_dir):
    size = F.octet_length("text").cast("double")
    return zipf.spearman(docs(spark, sf_dir).where(size > 0).select("lang", size.alias("x"), (F.size(T.words(F.col("text"))) / size).alias("y")), "x", "y", "lang")


@register(EFFICIENCY + "SELECT tokenizer, round(stddev_samp(fertility), 8) AS std, min(fertility) AS min, max(fertility) AS max, round(max(fertility) - min(fertility), 8) AS range, count(fertility) AS n FROM m GROUP BY tokenizer")
def tokenizer_spread(spark, sf_dir):
    return zipf.spread(efficiency_metrics(spark, sf_dir), "fertility", "tokenizer")


@register(f"""WITH {WORDS}, p AS (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents),
  e AS (SELECT 'word' AS u, lang, w, count(*) AS c FROM w GROUP BY lang, w UNION ALL SELECT 'pretok', lang, w, count(*) FROM p GROUP BY lang, w),
  s AS (SELECT u, lang, c / sum(c) OVER (PARTITION BY u, lang) AS p FROM e), h AS (SELECT u, lang, -sum(p * ln(p)) AS h FROM s GROUP BY u, lang)
  SELECT lang, round(sum(CASE WHEN u = 'pretok' THEN h ELSE -h END), 7) AS token_minus_word FROM h GROUP BY lang""")
def token_minus_word_delta(spark, sf_dir):
    d = docs(spark, sf_dir)
    e = lambda unit: zipf.entropy(zipf.unit_counts(d, unit)).select("lang", F.col("entropy_nats").alias(unit))
    return e("pretok").join(e("word"), "lang").select("lang", F.round(F.col("pretok") - F.col("word"), 7).alias("token_minus_word"))


@register()
def zipf_mandelbrot_fit(spark, sf_dir):
    return zipf.fits(words_counted(spark, sf_dir))


@register()
def entropy_bootstrap(spark, sf_dir):
    return zipf.bootstrap_entropy(words_counted(spark, sf_dir))


@register(COUNTS + """, r AS (SELECT unit, count(DISTINCT lang) AS reached, bool_or(lang = 'en') AS ic FROM u GROUP BY unit)
  SELECT lang, count(*) AS n_types, sum(cnt)::BIGINT AS n_tokens, count(CASE WHEN NOT ic THEN 1 END) AS n_not_in_control, count(CASE WHEN reached <= 1 THEN 1 END) AS n_rare,
    round(count(CASE WHEN NOT ic THEN 1 END) / count(*), 9) AS share_not_in_control, round(count(CASE WHEN reached <= 1 THEN 1 END) / count(*), 9) AS share_rare,
    round(sum(CASE WHEN NOT ic THEN cnt ELSE 0 END) / sum(cnt), 9) AS share_mass_not_in_control, round(sum(CASE WHEN reached <= 1 THEN cnt ELSE 0 END) / sum(cnt), 9) AS share_mass_rare
  FROM u JOIN r USING (unit) GROUP BY lang""")
def vocabulary_exclusivity(spark, sf_dir):
    return vocab.exclusivity(words_counted(spark, sf_dir))


@register(COUNTS + """, t AS (SELECT unit, sum(cnt)::BIGINT AS cnt FROM u GROUP BY unit)
  SELECT CASE WHEN regexp_matches(unit, '\\p{Latin}') THEN 'Latin' WHEN regexp_matches(unit, '\\p{L}') THEN '<unknown_script>' ELSE '<no_letter>' END AS bucket, count(*) AS n_types, sum(cnt)::BIGINT AS n_tokens FROM t GROUP BY 1""")
def script_allocation(spark, sf_dir):
    return vocab.script_allocation(words_counted(spark, sf_dir))


_BLOCK_ROWS = ", ".join(f"('{name}', {low}, {high})" for name, low, high in U.block_ranges())


@register(f"""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents), h AS (SELECT c, hex(encode(c)) AS h, unicode(c)::BIGINT AS u FROM c WHERE c <> ''),
  l AS (SELECT DISTINCT substr(h, 1, 2) AS h FROM h), v AS (SELECT h, ('0x' || h)::BIGINT AS v FROM l),
  w AS (SELECT h AS raw, u AS low, u AS high FROM h UNION SELECT h, CASE WHEN v < 128 THEN v WHEN v < 224 THEN (v - 192) * 64 WHEN v < 240 THEN (v - 224) * 4096 ELSE (v - 240) * 262144 END,
    CASE WHEN v < 128 THEN v WHEN v < 224 THEN (v - 192) * 64 + 63 WHEN v < 240 THEN (v - 224) * 4096 + 4095 ELSE (v - 240) * 262144 + 262143 END FROM v),
  b(block, bl, bh) AS (VALUES {_BLOCK_ROWS}), m AS (SELECT raw, block, least(high, bh) - greatest(low, bl) + 1 AS overlap, low >= bl AND high <= bh AS certain FROM w JOIN b ON low <= bh AND bl <= high),
  r AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY overlap DESC, block DESC) AS i, bool_or(certain) OVER (PARTITION BY raw) AS any_certain FROM m)
  SELECT raw, block, any_certain AS certain FROM r WHERE i = 1""")
def byte_fragments(spark, sf_dir):
    raw = F.encode(F.col("c"), "utf-8")
    chars = docs(spark, sf_dir).select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    found = vocab.fragments(chars.select(F.substring(raw, 1, 1).alias("raw")).union(chars.select(raw)).distinct())
    return found.select(F.hex("raw").alias("raw"), "block", "certain")


@register("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def exact_dedup_first_wins(spark, sf_dir):
    return corpus.first_wins(docs(spark, sf_dir))


SIZED = "s AS (SELECT doc_id, lang, source, strlen(text) AS bytes FROM documents)"


@register(f"WITH {SIZED}, r AS (SELECT *, sum(bytes) OVER (PARTITION BY lang ORDER BY doc_id) AS running FROM s) SELECT lang, doc_id, bytes FROM r WHERE running - bytes < {BUDGET}")
def budget_prefix_docs(spark, sf_dir):
    return corpus.budget_prefix(docs(spark, sf_dir), BUDGET)


@register(f"""WITH {SIZED}, b AS (SELECT min(t) AS budget FROM (SELECT sum(bytes) AS t FROM s GROUP BY lang)), r AS (SELECT *, sum(bytes) OVER (PARTITION BY lang ORDER BY doc_id) AS running FROM s, b)
  SELECT lang, count(*) AS n_docs, sum(least(bytes, budget - (running - bytes)))::BIGINT AS n_bytes, max(doc_id) AS last_doc FROM r WHERE least(bytes, budget - (running - bytes)) > 0 GROUP BY lang""")
def equal_bytes_lines(spark, sf_dir):
    return corpus.equal_bytes(docs(spark, sf_dir))


@register(f"""WITH {SIZED}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM s), r AS (SELECT *, sum(bytes) OVER (ORDER BY turn, source) AS running FROM t)
  SELECT doc_id, source, turn, least(bytes, {ROBIN} - (running - bytes))::BIGINT AS used FROM r WHERE running - bytes < {ROBIN}""")
def round_robin_corpus(spark, sf_dir):
    return corpus.round_robin(docs(spark, sf_dir), ROBIN)


@register(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= {HOLDOUT}")
def holdout_val(spark, sf_dir):
    return corpus.holdout(docs(spark, sf_dir), HOLDOUT)


@register("""WITH a AS (SELECT lang, sum(strlen(text))::DOUBLE AS bytes FROM documents GROUP BY lang), b AS (SELECT 2.5 * sum(bytes) AS budget FROM a),
  o AS (SELECT *, row_number() OVER (ORDER BY bytes, lang) AS i, count(*) OVER () AS n, coalesce(sum(bytes) OVER (ORDER BY bytes, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a, b),
  c AS (SELECT *, bool_and((budget - 4 * before) / (n - i + 1) > 4 * bytes + 1e-9) OVER (ORDER BY bytes, lang ROWS UNBOUNDED PRECEDING) AS capped FROM o),
  x AS (SELECT lang, bytes, capped, CASE WHEN capped THEN 4 * bytes ELSE (budget - sum(CASE WHEN capped THEN 4 * bytes ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE 1 END) OVER () END AS allocated FROM c)
  SELECT lang, bytes, round(allocated, 4) AS allocated, round(allocated / bytes, 9) AS epochs, capped, round(allocated / sum(allocated) OVER (), 9) AS share, ceil(allocated / bytes)::BIGINT AS passes FROM x""")
def unimax_allocation(spark, sf_dir):
    available = docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.octet_length("text")).cast("double").alias("bytes"))
    return corpus.unimax(available, 2.5 * F.sum("bytes").over(Window.partitionBy()), CAP)


@register(EFFICIENCY + """, g AS (SELECT lang, exp(avg(ln(token_premium))) AS mean FROM m GROUP BY lang), t AS (SELECT lang, mean, mean / sum(mean) OVER () AS target, 1.0::DOUBLE / count(*) OVER () AS prior FROM g)
  SELECT lang, round(mean, 8) AS shared_premium, round(target, 8) AS target_share, round(0.5 * prior + 0.5 * target, 8) AS damped_share, round(max(abs(0.5 * prior + 0.5 * target - prior)) OVER (), 8) AS max_delta FROM t""")
def calibrated_shares(spark, sf_dir):
    return corpus.calibrated(efficiency_metrics(spark, sf_dir).select(F.col("tokenizer").alias("arm"), "lang", F.col("token_premium").alias("premium")))


_S = "replace(replace(lower(trim(raw)), ' ', '-'), 'odc_by', 'odc-by')"
_RAW = "regexp_extract(text, '(?i)licensed under (?:the )?([^.\\n]+)', 1)"


@register(f"""WITH r AS (SELECT {_RAW} AS raw FROM documents), s AS (SELECT raw, {_S} AS s FROM r),
  c AS (SELECT CASE WHEN raw = '' THEN 'unknown' WHEN s IN ('odc-by', 'odc-by-1.0') THEN 'odc-by-1.0' WHEN s LIKE 'cc-by-sa%' THEN CASE WHEN s LIKE '%4%' THEN 'cc-by-sa-4.0' ELSE 'cc-by-sa' END WHEN s = 'mit' THEN 'mit'
    WHEN s IN ('apache-2.0', 'apache2', 'apache-2') THEN 'apache-2.0' WHEN s IN ('cc0', 'cc-0', 'cc0-1.0') THEN 'cc0-1.0' WHEN s LIKE 'cc-by%' AND s NOT LIKE '%sa%' THEN CASE WHEN s LIKE '%4%' THEN 'cc-by-4.0' ELSE s END ELSE s END AS license FROM s)
  SELECT license, count(*) AS n FROM c GROUP BY license""")
def license_gate(spark, sf_dir):
    raw = F.regexp_extract("text", r"(?i)licensed under (?:the )?([^.\n]+)", 1)
    return docs(spark, sf_dir).groupBy(corpus.license_class(raw).alias("license")).agg(F.count("*").alias("n"))


@register("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w FROM documents), b AS (SELECT regexp_extract_all(lower(text), '\\S+') AS w FROM benchmark),
  g AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b)),
  x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d))
  SELECT doc_id, count(*) AS n_shared FROM x SEMI JOIN g USING (gram) GROUP BY doc_id""")
def ngram_contamination(spark, sf_dir):
    return corpus.contaminated(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register(EFFICIENCY + """, a AS (SELECT lang, token_premium AS a FROM m WHERE tokenizer = 'char'), b AS (SELECT lang, token_premium AS b FROM m WHERE tokenizer = 'grapheme')
  SELECT lang, a, b, round(abs(b - a) / abs(a), 8) AS relative_delta, coalesce(abs(b - a) / abs(a) <= 0.01, false) AS agrees FROM a FULL JOIN b USING (lang)""")
def trainer_cross_check(spark, sf_dir):
    m = efficiency_metrics(spark, sf_dir)
    return corpus.cross_check(m.where("tokenizer = 'char'"), m.where("tokenizer = 'grapheme'"), 0.01)


@register(f"""WITH p AS (SELECT unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents), c AS (SELECT w, count(*) AS cnt FROM p GROUP BY w),
  i AS (SELECT w, cnt, unnest(range(1, length(w))) AS i FROM c) SELECT w[i] AS left, w[i + 1] AS right, sum(cnt)::BIGINT AS cnt FROM i GROUP BY 1, 2""")
def bpe_pair_counts(spark, sf_dir):
    return bpe.pair_counts(bpe.word_counts(docs(spark, sf_dir)))


MERGES = 12
_MARKED = f"""t0 AS MATERIALIZED (SELECT w, regexp_replace(hex(encode(w)), '(..)', '|\\1|', 'g') AS s, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents) GROUP BY w)"""


def _round_sql(k: int) -> str:
    return f"""p{k} AS MATERIALIZED (SELECT l, r, sum(cnt) AS c FROM (SELECT cnt, y[i] AS l, y[i + 1] AS r FROM (SELECT cnt, y, unnest(range(1, len(y))) AS i FROM (SELECT cnt, string_split(substr(s, 2, length(s) - 2), '||') AS y FROM t{k}))) GROUP BY l, r ORDER BY c DESC, l, r LIMIT 1),
  t{k + 1} AS MATERIALIZED (SELECT w, replace(s, '|' || l || '||' || r || '|', '|' || l || r || '|') AS s, cnt FROM t{k}, p{k})"""


_ROUNDS = _MARKED + ", " + ", ".join(map(_round_sql, range(MERGES)))


@register(f"WITH {_ROUNDS} " + " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right", c::DOUBLE AS cnt FROM p{k}' for k in range(MERGES)))
def bpe_first_merges(spark, sf_dir):
    return vocabulary.merges_table(spark, vocabulary.train(vocabulary.word_counts(docs(spark, sf_dir)), MERGES))


@register()
def bpe_vocabulary(spark, sf_dir):
    """Enough merges for a vocabulary of 512 tokens."""
    return vocabulary.merges_table(spark, vocabulary.train(vocabulary.word_counts(docs(spark, sf_dir)), 256))


@register(f"""WITH {_ROUNDS}, n AS (SELECT w, len(string_split(s, '||')) AS n FROM t{MERGES}), d AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents)
  SELECT lang, sum(n)::BIGINT AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM d JOIN n USING (w) GROUP BY lang""")
def bpe_encode_ctc(spark, sf_dir):
    d = docs(spark, sf_dir)
    rows = vocabulary.encoded(d, vocabulary.train(vocabulary.word_counts(d), MERGES)).where(F.size("ids") > 0)
    return rows.groupBy("lang").agg(F.sum(F.size("ids")).alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"))


def lines_of(d: DataFrame) -> DataFrame:
    return d.groupBy("lang").agg(F.count("*").alias("n_lines"))


FAIR = 8


def arms_of(d: DataFrame) -> tuple[DataFrame, dict[str, list[tuple]]]:
    """The words of each language, and the merges of both arms over one count of the pre-tokens."""
    counted = vocabulary.Counted(d)
    words = stored(counted.language_words())
    return words, {"plain": vocabulary.train(counted.word_counts(), FAIR), "fair": vocabulary.train_fair(words, words, lines_of(d), FAIR)}


_FAIR = f"""n AS (SELECT lang, count(*) AS n_lines FROM documents GROUP BY lang),
  f0 AS MATERIALIZED (SELECT lang, w, regexp_replace(hex(encode(w)), '(..)', '|\\1|', 'g') AS s, count(*) AS cnt FROM (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents) GROUP BY lang, w)"""


def _fair_sql(k: int) -> str:
    return f"""x{k} AS (SELECT lang FROM (SELECT lang, sum(cnt * len(string_split(s, '||'))) AS t FROM f{k} GROUP BY lang) JOIN n USING (lang) ORDER BY t / n_lines DESC, lang LIMIT 1),
  q{k} AS MATERIALIZED (SELECT lang, l, r, sum(cnt) AS c FROM (SELECT lang, cnt, y[i] AS l, y[i + 1] AS r FROM (SELECT lang, cnt, y, unnest(range(1, len(y))) AS i FROM (SELECT lang, cnt, string_split(substr(s, 2, length(s) - 2), '||') AS y FROM f{k} JOIN x{k} USING (lang)))) GROUP BY lang, l, r ORDER BY c DESC, l, r LIMIT 1),
  f{k + 1} AS MATERIALIZED (SELECT f.lang, w, replace(s, '|' || l || '||' || r || '|', '|' || l || r || '|') AS s, cnt FROM f{k} f, q{k})"""


_FAIR_ROUNDS = _FAIR + ", " + ", ".join(map(_fair_sql, range(FAIR)))


@register(f"WITH {_FAIR_ROUNDS} " + " UNION ALL ".join(f'SELECT {k} AS rank, l AS "left", r AS "right", lang, c::DOUBLE AS cnt FROM q{k}' for k in range(FAIR)))
def parity_bpe_merges(spark, sf_dir):
    d = docs(spark, sf_dir)
    words = vocabulary.language_words(d)
    merges = vocabulary.train_fair(words, words, lines_of(d), FAIR)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], "rank int, left string, right string, lang string, cnt double")


@register(f"""WITH {_FAIR_ROUNDS}, {", ".join(["t0 AS MATERIALIZED (SELECT w, s, sum(cnt) AS cnt FROM f0 GROUP BY w, s)"] + [_round_sql(k) for k in range(FAIR)])},
  a AS (SELECT 'fair' AS arm, lang, sum(cnt * len(string_split(s, '||')))::BIGINT AS n_tokens FROM f{FAIR} GROUP BY lang
    UNION ALL SELECT 'plain', f0.lang, sum(f0.cnt * len(string_split(t.s, '||')))::BIGINT FROM f0 JOIN t{FAIR} t USING (w) GROUP BY f0.lang)
  SELECT arm, lang, n_tokens, round(n_tokens / n_lines, 9) AS per_line, round(n_tokens / max(CASE WHEN lang = 'en' THEN n_tokens END) OVER (PARTITION BY arm), 9) AS premium FROM a JOIN n USING (lang)""")
def bpe_arms_compared(spark, sf_dir):
    d = docs(spark, sf_dir)
    words, arms = arms_of(d)
    return stored(vocabulary.arms_compared(words, lines_of(d), arms))  # a row per arm and language


@register(f"""WITH {_FAIR_ROUNDS}, {", ".join(["t0 AS MATERIALIZED (SELECT w, s, sum(cnt) AS cnt FROM f0 GROUP BY w, s)"] + [_round_sql(k) for k in range(FAIR)])},
  a AS ({" UNION ALL ".join(f"SELECT {k} AS rank, l, r FROM p{k}" for k in range(FAIR))}), b AS ({" UNION ALL ".join(f"SELECT {k} AS rank, l, r FROM q{k}" for k in range(FAIR))})
  SELECT (SELECT count(*) FROM a) AS n_first, (SELECT count(*) FROM b) AS n_second, (SELECT coalesce(min(CASE WHEN a.l <> b.l OR a.r <> b.r THEN rank END), count(*))::INTEGER FROM a JOIN b USING (rank)) AS common_prefix, (SELECT count(*) FROM a SEMI JOIN b USING (l, r)) AS n_shared""")
def merge_lists(spark, sf_dir):
    d = docs(spark, sf_dir)
    rows = arms_of(d)[1].values()
    tables = [spark.createDataFrame([(k, m[0], m[1]) for k, m in enumerate(x)], "rank int, left string, right string") for x in rows]
    return parity_bpe.merge_lists_compared(*tables).withColumn("common_prefix", F.col("common_prefix").cast("int"))


@register(EFFICIENCY + """, a AS (SELECT tokenizer AS arm, sum(CASE WHEN tokenizer <> '' THEN ctc END) AS n FROM m GROUP BY tokenizer), b AS (SELECT arm, (SELECT n FROM a WHERE arm = 'byte') / n AS bpt FROM a)
  SELECT arm, greatest(1, round_even(2048 * (SELECT bpt FROM b WHERE arm = 'pretok') / bpt, 0))::INTEGER AS context FROM b""")
def matched_contexts(spark, sf_dir):
    sums = efficiency_metrics(spark, sf_dir).groupBy(F.col("tokenizer").alias("arm")).agg(F.sum("ctc").alias("n"))
    total = F.max(F.when(F.col("arm") == "byte", F.col("n"))).over(Window.partitionBy())  # a row per tokenizer
    return pools.byte_matched_context(sums.select("arm", (total / F.col("n")).alias("bytes_per_token")), "pretok")


_TOKENS = f"""{_ROUNDS}, e AS MATERIALIZED (SELECT w, string_split(substr(s, 2, length(s) - 2), '||') AS y FROM t{MERGES}),
  o AS MATERIALIZED (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS w FROM documents) GROUP BY lang, w),
  k AS MATERIALIZED (SELECT lang, tok AS unit, sum(c)::BIGINT AS cnt FROM (SELECT lang, c, unnest(y) AS tok FROM o JOIN e USING (w)) GROUP BY lang, tok)"""


def encoded(d: DataFrame, n: int = MERGES) -> token_metrics.Encoded:
    """Training and the metrics share one count of the pre-tokens."""
    counted = vocabulary.Counted(d)
    return token_metrics.Encoded(counted, vocabulary.train(counted.word_counts(), n))


@register(f"""WITH {_TOKENS}, f AS (SELECT w, len(string_split(s, '||')) AS n FROM t4), z AS (SELECT 'bpe_{MERGES}' AS tokenizer, lang, sum(cnt)::BIGINT AS ctc FROM k GROUP BY lang
    UNION ALL SELECT 'bpe_4', lang, sum(c * n)::BIGINT FROM o JOIN f USING (w) GROUP BY lang),
  d AS (SELECT lang, count(*)::BIGINT AS n_sentences, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS n_words, sum(length(regexp_replace(text, '\\s+', '', 'g')))::BIGINT AS n_chars FROM documents GROUP BY lang)
  SELECT tokenizer, lang, n_sentences, ctc, n_words, n_chars, round(ctc / n_words, 9) AS fertility, round(n_chars / ctc, 9) AS chars_per_token, NULL::DOUBLE AS fertility_per_char,
    round(ctc / max(CASE WHEN lang = 'en' THEN ctc END) OVER (PARTITION BY tokenizer), 9) AS token_premium FROM d JOIN z USING (lang)""")
def token_efficiency(spark, sf_dir):
    d = docs(spark, sf_dir)
    arm = encoded(d)
    return token_metrics.efficiency(d, {"bpe_4": arm.under(arm.merges[:4]), f"bpe_{MERGES}": arm})


def _piece_sql(k: int) -> str:
    return f"z{k + 1} AS (SELECT w, one, replace(s, '|' || l || '||' || r || '|', '|' || l || r || '|') AS s FROM z{k}, p{k})"


@register(f"""WITH {_TOKENS}, v AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY lang, w),
  z0 AS (SELECT w, len(regexp_extract_all(' ' || w, '{PATTERN}')) = 1 AS one, regexp_replace(hex(encode(' ' || w)), '(..)', '|\\1|', 'g') AS s FROM (SELECT DISTINCT w FROM v)), {", ".join(map(_piece_sql, range(MERGES)))},
  h AS (SELECT lang, sum(c)::BIGINT AS n_words, sum(CASE WHEN one AND len(string_split(s, '||')) = 1 THEN c ELSE 0 END)::BIGINT AS n_kept, count(*) AS n_types, count(CASE WHEN one AND len(string_split(s, '||')) = 1 THEN 1 END) AS n_types_kept FROM v JOIN z{MERGES} USING (w) GROUP BY lang),
  x AS (SELECT lang, sum(cnt)::BIGINT AS n_tokens, sum(CASE WHEN regexp_matches(unit, '^(0[0-8EF]|1[0-9AB]|2[1-9A-F]|[3-7].|C[2-9A-F]..|D...|E.....|F.......)$') AND unit <> 'C2A0' THEN cnt ELSE 0 END)::BIGINT AS n_shreds FROM k GROUP BY lang)
  SELECT lang, n_words, n_kept, n_tokens, n_shreds, round(n_kept / n_words, 9) AS strr, round(n_shreds / n_tokens, 9) AS stfr, round(n_types_kept / n_types, 9) AS word_coverage FROM h JOIN x USING (lang)""")
def token_retention(spark, sf_dir):
    return encoded(docs(spark, sf_dir)).retention()


def _arm_sql(n: int) -> str:
    return f"""e_{n} AS (SELECT w, string_split(substr(s, 2, length(s) - 2), '||') AS y FROM t{n}),
  x_{n} AS (SELECT lang, sum(c) AS n_tokens, sum(CASE WHEN regexp_matches(tok, '^(0[0-8EF]|1[0-9AB]|2[1-9A-F]|[3-7].|C[2-9A-F]..|D...|E.....|F.......)$') AND tok <> 'C2A0' THEN c ELSE 0 END) AS n_shreds
    FROM (SELECT lang, c, unnest(y) AS tok FROM o JOIN e_{n} USING (w)) GROUP BY lang),
  h_{n} AS (SELECT lang, sum(CASE WHEN one AND len(string_split(s, '||')) = 1 THEN c ELSE 0 END) / sum(c) AS strr FROM v JOIN z{n} USING (w) GROUP BY lang),
  m_{n} AS (SELECT 'bpe_{n}' AS arm, lang, round(n_tokens / n_words, 9) AS fertility, round(n_chars / n_tokens, 9) AS chars_per_token, round(n_tokens / max(CASE WHEN lang = 'en' THEN n_tokens END) OVER (), 9) AS token_premium,
    round(n_shreds / n_tokens, 9) AS stfr, round(strr, 9) AS strr, round(n_tokens / n_sentences, 9) AS tokens_per_line FROM d JOIN x_{n} USING (lang) JOIN h_{n} USING (lang))"""


@register(f"""WITH {_TOKENS}, v AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY lang, w),
  z0 AS (SELECT w, len(regexp_extract_all(' ' || w, '{PATTERN}')) = 1 AS one, regexp_replace(hex(encode(' ' || w)), '(..)', '|\\1|', 'g') AS s FROM (SELECT DISTINCT w FROM v)), {", ".join(map(_piece_sql, range(MERGES)))},
  d AS (SELECT lang, count(*) AS n_sentences, sum(len(regexp_extract_all(text, '\\S+'))) AS n_words, sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS n_chars FROM documents GROUP BY lang),
  {_arm_sql(4)}, {_arm_sql(MERGES)}, m AS (SELECT * FROM m_4 UNION ALL SELECT * FROM m_{MERGES}),
  l AS (UNPIVOT (SELECT arm, lang, fertility, chars_per_token, token_premium, stfr, strr FROM m) ON fertility, chars_per_token, token_premium, stfr, strr INTO NAME metric VALUE value),
  b AS (SELECT lang, metric, max(CASE WHEN arm = 'bpe_4' THEN value END) AS b, max(CASE WHEN arm = 'bpe_{MERGES}' THEN value END) AS c FROM l GROUP BY lang, metric),
  i AS (SELECT arm, tokens_per_line AS x, row_number() OVER (PARTITION BY arm ORDER BY tokens_per_line) AS i, count(*) OVER (PARTITION BY arm) AS n FROM m),
  g AS (SELECT arm, (max(n) + 1 - 2 * sum((n + 1 - i) * x) / sum(x)) / max(n) AS value FROM i GROUP BY arm),
  a AS (SELECT * FROM b UNION ALL SELECT 'macro', metric, avg(b), avg(c) FROM b GROUP BY metric
    UNION ALL SELECT 'macro', 'gini_tokens_per_line', max(CASE WHEN arm = 'bpe_4' THEN value END), max(CASE WHEN arm = 'bpe_{MERGES}' THEN value END) FROM g)
  SELECT lang, metric, round(b, 8) AS baseline, round(c, 8) AS compare, round(c - b, 8) AS delta, round(100 * (c - b) / nullif(b, 0), 6) AS pct_change FROM a""")
def trained_arms_ab(spark, sf_dir):
    d = docs(spark, sf_dir)
    arm = encoded(d)
    rows = token_metrics.measured(d, {"bpe_4": arm.under(arm.merges[:4]), f"bpe_{MERGES}": arm})
    return token_metrics.arms_compared(stored(rows), "bpe_4", f"bpe_{MERGES}")


@register(f"""WITH {_TOKENS}, r AS (SELECT unit, count(DISTINCT lang) AS reached, bool_or(lang = 'en') AS ic FROM k GROUP BY unit)
  SELECT lang, count(*) AS n_types, sum(cnt)::BIGINT AS n_tokens, count(CASE WHEN NOT ic THEN 1 END) AS n_not_in_control, count(CASE WHEN reached <= 1 THEN 1 END) AS n_rare,
    round(count(CASE WHEN NOT ic THEN 1 END) / count(*), 9) AS share_not_in_control, round(count(CASE WHEN reached <= 1 THEN 1 END) / count(*), 9) AS share_rare,
    round(sum(CASE WHEN NOT ic THEN cnt ELSE 0 END) / sum(cnt), 9) AS share_mass_not_in_control, round(sum(CASE WHEN reached <= 1 THEN cnt ELSE 0 END) / sum(cnt), 9) AS share_mass_rare
  FROM k JOIN r USING (unit) GROUP BY lang""")
def token_exclusivity(spark, sf_dir):
    return vocab.exclusivity(encoded(docs(spark, sf_dir)).counts().withColumnRenamed("token_id", "unit"))


@register(f"""WITH {_TOKENS}, b AS (SELECT *, NOT regexp_matches(unit, '^([0-7].|[CD].[89AB].|E.([89AB].){{2}}|F[0-4]([89AB].){{3}})+$') AS broken FROM k)
  SELECT lang, count(CASE WHEN broken THEN 1 END) AS n_fragment_types, sum(CASE WHEN broken THEN cnt ELSE 0 END)::BIGINT AS n_fragment_tokens, round(count(CASE WHEN broken THEN 1 END) / count(*), 9) AS share_types,
    round(sum(CASE WHEN broken THEN cnt ELSE 0 END) / sum(cnt), 9) AS share_mass FROM b GROUP BY lang""")
def token_fragments(spark, sf_dir):
    arm = encoded(docs(spark, sf_dir))
    return vocab.fragment_usage(arm.counts(), arm.tokens())


@register(f"""WITH {_TOKENS}, p AS (SELECT lang, cnt, cnt / sum(cnt) OVER (PARTITION BY lang) AS p FROM k),
  g AS (SELECT lang, sum(cnt)::BIGINT AS n_tokens, count(*) AS n_types, -sum(p * ln(p)) AS h, sum(pow(p, 2.5)) AS q FROM p GROUP BY lang)
  SELECT lang, n_tokens, n_types, round(h, 8) AS entropy_nats, round(h / ln(2), 8) AS entropy_bits, round(h / ln(n_types), 8) AS entropy_norm, round(exp(h), 4) AS effective_vocab,
    round(ln(q) / -1.5, 8) AS renyi_entropy_nats, round(ln(q) / -1.5 / ln(n_types), 8) AS renyi_efficiency_active FROM g""")
def token_entropy(spark, sf_dir):
    return zipf.entropy(encoded(docs(spark, sf_dir)).counts().withColumnRenamed("token_id", "unit"))


@register(f"""WITH m AS ({_sql["bpe_arms_compared"]}), a AS (SELECT lang, premium AS a FROM m WHERE arm = 'plain'), b AS (SELECT lang, premium AS b FROM m WHERE arm = 'fair')
  SELECT lang, a, b, round(abs(b - a) / abs(a), 8) AS relative_delta, coalesce(abs(b - a) / abs(a) <= 0.01, false) AS agrees FROM a FULL JOIN b USING (lang)""")
def trained_arms_cross_check(spark, sf_dir):
    m = bpe_arms_compared(spark, sf_dir).withColumnRenamed("premium", "token_premium")
    return corpus.cross_check(m.where("arm = 'plain'"), m.where("arm = 'fair'"), 0.01)


@register(f"""WITH m AS ({_sql["bpe_arms_compared"]}), g AS (SELECT lang, exp(avg(ln(premium))) AS mean FROM m GROUP BY lang), t AS (SELECT lang, mean, mean / sum(mean) OVER () AS target, 1.0::DOUBLE / count(*) OVER () AS prior FROM g)
  SELECT lang, round(mean, 8) AS shared_premium, round(target, 8) AS target_share, round(0.5 * prior + 0.5 * target, 8) AS damped_share, round(max(abs(0.5 * prior + 0.5 * target - prior)) OVER (), 8) AS max_delta FROM t""")
def trained_arms_shares(spark, sf_dir):
    return corpus.calibrated(corpus.complete_arms(bpe_arms_compared(spark, sf_dir).select("arm", "lang", "premium")))


@register(f"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '{PATTERN}') AS p FROM documents)
  SELECT doc_id, len(p)::INTEGER AS n_spans, length(p[1])::INTEGER AS first_length, length(p[-1])::INTEGER AS last_length FROM s""")
def healed_pretokens(spark, sf_dir):
    """These texts have no cluster across pre-tokens; those that have are tested against a loop."""
    spans = docs(spark, sf_dir).select("doc_id", T.healed(F.coalesce("text", F.lit(""))).alias("p"))
    return spans.select("doc_id", F.size("p").alias("n_spans"), F.length(F.get("p", F.lit(0))).alias("first_length"), F.length(F.element_at("p", -1)).alias("last_length"))



SHARES = [("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)]


@register(f"""WITH p AS (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS p FROM documents), m AS (SELECT lang, count(*) AS n, sum(strlen(p)) AS mass FROM p GROUP BY lang),
  s(lang, share) AS (VALUES ('en', 0.4::DOUBLE), ('de', 0.3::DOUBLE), ('fr', 0.2::DOUBLE), ('es', 0.1::DOUBLE))
  SELECT lang, round(n * (share / sum(share) OVER ()) / (mass / sum(mass) OVER ()), 3) AS weighted FROM m JOIN s USING (lang)""")
def byte_mass_reweighted(spark, sf_dir):
    words = parity_bpe.reweighted(parity_bpe.language_words(docs(spark, sf_dir)), spark.createDataFrame(SHARES, "lang string, share double"))
    return words.groupBy("lang").agg(F.round(F.sum("cnt"), 3).alias("weighted"))


DRAWS = 3
#: Statistics of each (lang, draw) of a table x(lang, draw, unit, cnt).
_STATISTICS = """q AS (SELECT lang, draw, cnt, row_number() OVER (PARTITION BY lang, draw ORDER BY cnt DESC) AS r FROM x),
  c AS (SELECT lang, draw, cnt, r, cnt / sum(cnt) OVER l AS p, sum(cnt) OVER w / sum(cnt) OVER l AS emp, sum(1.0::DOUBLE / r) OVER w / sum(1.0::DOUBLE / r) OVER l AS zipf FROM q
    WINDOW l AS (PARTITION BY lang, draw), w AS (PARTITION BY lang, draw ORDER BY r ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT lang, draw, sum(cnt)::BIGINT AS n_tokens, round(-sum(p * ln(p)), 8) AS entropy_nats, round(max(abs(emp - zipf)), 7) AS ks_zipf, round(-regr_slope(ln(cnt), ln(r)), 7) AS ols_slope FROM c GROUP BY lang, draw),
  v AS (UNPIVOT m ON entropy_nats, ks_zipf, ols_slope INTO NAME metric VALUE v)"""
_SUMMARY = "round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n"
_SENTENCES = "s AS (SELECT lang, doc_id, regexp_extract_all(text, '\\S+') AS units FROM documents)"
_MATCHED = f"""{_SENTENCES}, b AS (SELECT greatest(1, floor(min(t) * 0.95)) AS budget FROM (SELECT sum(len(units)) AS t FROM s GROUP BY lang)),
  h AS (SELECT lang, doc_id, units, len(units) AS n, draw, md5((77 + draw) || ':' || doc_id) AS h FROM s, (SELECT unnest(range({DRAWS})) AS draw)),
  o AS (SELECT *, sum(n) OVER (PARTITION BY lang, draw ORDER BY h) AS running FROM h),
  x AS (SELECT lang, draw, unit, count(*) AS cnt FROM (SELECT lang, draw, unnest(units[1:least(n, budget - (running - n))::BIGINT]) AS unit FROM o, b WHERE running - n < budget) GROUP BY ALL)"""


def _budget(sentences: DataFrame) -> int:
    least = sentences.groupBy("lang").agg(F.sum(F.size("units")).alias("n")).agg(F.min("n")).first()[0] or 0
    return max(1, int(0.95 * least))


@register(f"WITH {_MATCHED}, {_STATISTICS} SELECT lang, metric, {_SUMMARY} FROM v GROUP BY lang, metric")
def matched_draw_summary(spark, sf_dir):
    """Documents as sentences, drawn until all languages have as many words."""
    rows = draws.sentences(docs(spark, sf_dir))
    return draws.summarised(draws.statistics(draws.counts_of_matched(draws.matched(rows, _budget(rows), DRAWS))))


@register(f"""WITH {_SENTENCES}, i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM s),
  k AS (SELECT lang, draw, ('0x' || substr(md5((77 + draw) || ':' || place), 1, 15))::BIGINT % n AS place, count(*) AS weight FROM i, (SELECT unnest(range({DRAWS})) AS draw) GROUP BY ALL),
  x AS (SELECT lang, draw, unit, sum(weight)::BIGINT AS cnt FROM (SELECT lang, draw, weight, unnest(units) AS unit FROM k JOIN i USING (lang, place)) GROUP BY ALL), {_STATISTICS}
  SELECT lang, metric, {_SUMMARY} FROM v GROUP BY lang, metric""")
def sentence_bootstrap(spark, sf_dir):
    """As many documents as each language has, drawn with replacement."""
    rows = draws.sentences(docs(spark, sf_dir))
    return draws.summarised(draws.statistics(draws.counts_of_resampled(rows, draws.resampled(rows, DRAWS))))


#: Two-sided p of column rho over n pairs, by the gamma function instead of a series of products.
_P = """CASE WHEN n < 4 THEN NULL WHEN abs(rho) >= 1 THEN 0 WHEN n % 2 = 0 THEN greatest(0, 1 - abs(rho) * list_sum(list_transform(range(0, ((n - 2) / 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln(1 - rho * rho)))))
    ELSE greatest(0, 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * sqrt(1 - rho * rho) * coalesce(list_sum(list_transform(range(0, ((n - 3) / 2)::BIGINT), lambda k: exp(lgamma(1.5) + lgamma(k + 1) - lgamma(k + 1.5) + k * ln(1 - rho * rho)))), 0))) END"""


@register(f"""WITH r AS ({_sql["spearman_length_density"]}) SELECT lang, n, rho, round({_P}, 8) AS p, coalesce(rho < 0 AND {_P} < 0.05, false) AS supported FROM r""")
def length_density_verdict(spark, sf_dir):
    size = F.octet_length("text").cast("double")
    rows = docs(spark, sf_dir).where(size > 0).select("lang", size.alias("x"), (F.size(T.words(F.col("text"))) / size).alias("y"))
    return study.verdicts(rows, "x", "y", "lang")


def _unit_sql(name: str, units: str) -> str:
    return f"SELECT '{name}' AS unit, lang, u, count(*) AS cnt FROM (SELECT lang, unnest({units}) AS u FROM documents) GROUP BY lang, u"


_PROFILE = f"""y AS MATERIALIZED ({_unit_sql('word', "regexp_extract_all(text, '\\S+')")} UNION ALL {_unit_sql('token', f"regexp_extract_all(text, '{PATTERN}')")}),
  z AS (SELECT unit, lang, cnt, row_number() OVER (PARTITION BY unit, lang ORDER BY cnt DESC) AS r FROM y),
  c AS (SELECT unit, lang, cnt / sum(cnt) OVER l AS p, sum(cnt) OVER w / sum(cnt) OVER l AS emp, sum(1.0::DOUBLE / r) OVER w / sum(1.0::DOUBLE / r) OVER l AS zipf FROM z
    WINDOW l AS (PARTITION BY unit, lang), w AS (PARTITION BY unit, lang ORDER BY r ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT unit, lang, round(max(abs(emp - zipf)), 7) AS ks_zipf, round(-sum(p * ln(p)), 8) AS log_effective_vocab FROM c GROUP BY unit, lang),
  a AS (SELECT u, bool_or(lang = 'en') AS ic FROM y WHERE unit = 'token' GROUP BY u),
  g AS (SELECT lang, count(*) / (SELECT count(*) FROM a) AS share_of_vocab, sum(CASE WHEN NOT ic THEN cnt ELSE 0 END) / sum(cnt) AS share_mass_not_in_control,
    sum(CASE WHEN NOT regexp_matches(u, '\\p{{L}}') THEN cnt ELSE 0 END) / sum(cnt) AS share_fragment_mass FROM y JOIN a USING (u) WHERE unit = 'token' GROUP BY lang),
  t AS (SELECT g.*, k.ks_zipf AS tk, k.log_effective_vocab AS te, w.ks_zipf AS wk, w.log_effective_vocab AS we FROM g JOIN f k ON k.lang = g.lang AND k.unit = 'token' JOIN f w ON w.lang = g.lang AND w.unit = 'word'),
  l AS (SELECT 'H1' AS hypothesis, 'share_of_vocab' AS x, 'share_mass_not_in_control' AS y, share_of_vocab AS a, share_mass_not_in_control AS b FROM t
    UNION ALL SELECT 'H2', 'share_of_vocab', 'ks_zipf', share_of_vocab, tk FROM t UNION ALL SELECT 'H2', 'share_of_vocab', 'log_effective_vocab', share_of_vocab, te FROM t
    UNION ALL SELECT 'H2', 'share_fragment_mass', 'ks_zipf', share_fragment_mass, tk FROM t
    UNION ALL SELECT 'H3', 'share_of_vocab', 'ks_zipf less that of word', share_of_vocab, tk - wk FROM t UNION ALL SELECT 'H3', 'share_of_vocab', 'log_effective_vocab less that of word', share_of_vocab, te - we FROM t),
  k AS (SELECT hypothesis, x, y, (rank() OVER (PARTITION BY hypothesis, x, y ORDER BY a) + count(*) OVER (PARTITION BY hypothesis, x, y) + 1 - rank() OVER (PARTITION BY hypothesis, x, y ORDER BY a DESC)) / 2 AS ra,
    (rank() OVER (PARTITION BY hypothesis, x, y ORDER BY b) + count(*) OVER (PARTITION BY hypothesis, x, y) + 1 - rank() OVER (PARTITION BY hypothesis, x, y ORDER BY b DESC)) / 2 AS rb FROM l),
  n AS (SELECT hypothesis, x, y, count(*) AS n, CASE WHEN count(*) >= 4 THEN corr(ra, rb) END AS rho FROM k GROUP BY hypothesis, x, y)"""


@register(f"""WITH {_PROFILE}
  SELECT hypothesis, 'token' AS tokenizer, x, y, n, round(rho, 8) AS rho, round({_P}, 8) AS p, NULL::DOUBLE AS spread, coalesce(rho < 0 AND {_P} < 0.05, false) AS supported FROM n
  UNION ALL SELECT 'H4', tokenizer, 'language', 'ks_zipf', n, NULL, NULL, round(spread, 6), CASE WHEN tokenizer = 'word' THEN spread < (SELECT stddev_samp(ks_zipf) FROM f WHERE unit = 'token') END
    FROM (SELECT unit AS tokenizer, count(*) AS n, stddev_samp(ks_zipf) AS spread FROM f GROUP BY unit)""")
def study_hypotheses(spark, sf_dir):
    """H1 to H4 over pre-tokens, words as their baseline and as the tokenizer that should be fairer; mass without letters stands for fragments."""
    counts = {"token": stored(zipf.unit_counts(docs(spark, sf_dir), "pretok")), "word": stored(words_counted(spark, sf_dir))}  # the texts are read once each
    fits = None
    for name, c in counts.items():
        one = zipf.against_zipf(c).join(zipf.entropy(c), "lang").select("lang", F.lit(name).alias("unit"), "ks_zipf", F.col("entropy_nats").alias("log_effective_vocab"))
        fits = one if fits is None else fits.union(one)
    fits = stored(fits)  # a row per unit and language
    primary = fits.withColumn("tokenizer", F.lit("token"))
    other = fits.where("unit = 'word'").withColumn("unit", F.lit("token")).withColumn("tokenizer", F.lit("word"))
    reach = counts["token"].groupBy("unit").agg(F.max(F.col("lang") == "en").alias("in_control"))
    n = reach.agg(F.count("*").alias("n_vocab"))
    mass = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0)) / F.sum("cnt")
    rows = counts["token"].join(reach, "unit").groupBy("lang").agg(F.count("*").alias("types"), mass(~F.col("in_control")).alias("share_mass_not_in_control"), mass(~F.col("unit").rlike("\\p{L}")).alias("share_fragment_mass"))
    profile = stored(rows.crossJoin(F.broadcast(n)).withColumn("share_of_vocab", F.col("types") / F.col("n_vocab")))  # one row by a row per language
    got = hypotheses.evaluated(profile, primary.unionByName(other), "token", ("token",), "word")
    return got.where("y NOT LIKE '%grapheme'")


@register()
def rank_frequency_curve(spark, sf_dir):
    counts = words_counted(spark, sf_dir)
    return study.rank_frequency_curve(counts, zipf.fits(counts))


@register(COUNTS + """, b AS (SELECT lang, cnt, count(*) AS types FROM u GROUP BY lang, cnt), v AS (SELECT lang, sum(types) AS v, sum(types * cnt) AS n FROM b GROUP BY lang),
  h AS (SELECT lang, sum(1.0::DOUBLE / r) AS h FROM (SELECT lang, unnest(range(1, v::BIGINT + 1)) AS r FROM v) GROUP BY lang)
  SELECT lang, (coalesce(sum(types) OVER (PARTITION BY lang ORDER BY cnt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_rank, types, cnt,
    round(n / (coalesce(sum(types) OVER (PARTITION BY lang ORDER BY cnt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1) / h, 5) AS pure FROM b JOIN v USING (lang) JOIN h USING (lang)""")
def zipf_curve(spark, sf_dir):
    return study.pure_curve(words_counted(spark, sf_dir))


_FIRST = "SELECT rung, lang, digest, min(doc_id) AS doc_id, min(bytes) AS bytes FROM d GROUP BY rung, lang, digest"


def _rung_sql(k: int) -> str:
    before = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(k)) or "SELECT lang, rung, doc_id, bytes, digest FROM f WHERE false"
    return f"""g{k} AS MATERIALIZED (WITH taken AS ({before}), mine AS (SELECT f.* FROM f ANTI JOIN taken ON f.lang = taken.lang AND f.digest = taken.digest WHERE f.rung = {k}),
    run AS (SELECT *, sum(bytes) OVER (PARTITION BY lang ORDER BY doc_id) AS running FROM mine)
    SELECT lang, rung, doc_id, bytes, digest FROM run WHERE running <= {2 * BUDGET} - coalesce((SELECT sum(bytes) FROM taken WHERE taken.lang = run.lang), 0))"""


@register(f"""WITH d AS (SELECT lang, doc_id, CASE WHEN md5(source) < '55555555' THEN 0 WHEN md5(source) < 'aaaaaaaa' THEN 1 ELSE 2 END AS rung, strlen(text) AS bytes, sha256(text) AS digest FROM documents WHERE source IS NOT NULL),
  f AS MATERIALIZED ({_FIRST}), {_rung_sql(0)}, {_rung_sql(1)}, {_rung_sql(2)}
  SELECT lang, rung, doc_id, bytes FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)""")
def ladder_pull(spark, sf_dir):
    d = docs(spark, sf_dir)
    rungs = d.where("source IS NOT NULL").select("source").distinct().withColumn("rung", F.when(F.md5("source") < "55555555", 0).when(F.md5("source") < "aaaaaaaa", 1).otherwise(2))
    return pools.ladder(d, rungs, 2 * BUDGET)


TARGET, SHARD_BYTES = 400_000, 100_000
RUNNING = f"{SIZED}, r AS (SELECT lang, doc_id, bytes, sum(bytes) OVER (PARTITION BY lang ORDER BY doc_id) AS running, sum(bytes) OVER (PARTITION BY lang) AS pool FROM s)"


@register(f"""WITH {RUNNING}, p AS (SELECT *, unnest(range(0, ceil({TARGET} / pool)::BIGINT)) AS pass FROM r)
  SELECT lang, pass, doc_id, bytes FROM p WHERE pass * pool + running - bytes < {TARGET}""")
def unimax_passes(spark, sf_dir):
    sized = corpus.sized(docs(spark, sf_dir))
    return pools.tokenise_passes(sized, sized.select("lang").distinct().withColumn("target", F.lit(TARGET).cast("long")))


@register(f"""WITH u AS ({_sql["unimax_allocation"]})
  SELECT lang, round(least(allocated, bytes), 4) AS unique_bytes, round(CASE WHEN allocated >= bytes THEN bytes ELSE least(allocated * 1.1, bytes) END, 4) AS acquire_bytes,
    round(allocated / least(allocated, bytes), 9) AS passes_over_pool, round(allocated / sum(allocated) OVER (), 9) AS share FROM u""")
def pool_needs(spark, sf_dir):
    return pools.pool_needs(unimax_allocation(spark, sf_dir))


@register(f"""WITH n AS ({_sql["pool_needs"]}), p AS (SELECT lang, sum(strlen(text))::BIGINT AS bytes FROM documents SEMI JOIN labels USING (doc_id) GROUP BY lang),
  m AS (SELECT lang, ceil(acquire_bytes - coalesce(bytes, 0))::BIGINT AS missing_bytes FROM n LEFT JOIN p USING (lang)) SELECT * FROM m WHERE missing_bytes > 0""")
def pool_top_ups(spark, sf_dir):
    """What pools lack where the labelled documents are there already."""
    present = docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    return pools.top_up(pool_needs(spark, sf_dir), present.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")))


@register()
def mixture_summary(spark, sf_dir):
    return pools.summary(unimax_allocation(spark, sf_dir), "mixture")


@register(f"""WITH {RUNNING}, e AS (SELECT lang, min(running) AS stop FROM r WHERE running > 1.25 * {BUDGET} AND running > bytes GROUP BY lang)
  SELECT lang, doc_id, bytes FROM r LEFT JOIN e USING (lang) WHERE running - bytes < {BUDGET} AND (stop IS NULL OR running < stop)""")
def byte_sample(spark, sf_dir):
    return pools.byte_sample(corpus.sized(docs(spark, sf_dir)), BUDGET)


@register(f"""WITH b AS (SELECT lang, sum(strlen(text))::BIGINT AS n_bytes, sum(len(regexp_extract_all(text, '{PATTERN}')))::BIGINT AS n_tokens FROM documents GROUP BY lang)
  SELECT lang, n_bytes, n_tokens, round(n_bytes / n_tokens, 9) AS bytes_per_token FROM b""")
def bytes_per_token(spark, sf_dir):
    return pools.bytes_per_token(docs(spark, sf_dir))


@register("""WITH n AS (SELECT min(n) AS most FROM (SELECT count(*) AS n FROM documents GROUP BY lang)), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents)
  SELECT lang, doc_id FROM r, n WHERE i <= most""")
def equal_lines(spark, sf_dir):
    return pools.equal_lines(docs(spark, sf_dir))


@register(f"WITH {RUNNING} SELECT lang, doc_id, bytes, floor((running - bytes) / {SHARD_BYTES})::BIGINT AS shard FROM r")
def pool_shards(spark, sf_dir):
    return pools.shard_of(corpus.sized(docs(spark, sf_dir)), SHARD_BYTES)


@register(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r > {HOLDOUT}")
def train_without_holdout(spark, sf_dir):
    d = docs(spark, sf_dir)
    return pools.train_rows(d.select("lang", "doc_id"), corpus.holdout(d, HOLDOUT))


EXACT = 20_000


@register(f"""WITH l AS (SELECT lang, doc_id, rtrim(text, chr(13) || chr(10)) || chr(10) AS line FROM documents), r AS (SELECT *, {EXACT} - (sum(strlen(line)) OVER (PARTITION BY lang ORDER BY doc_id) - strlen(line)) AS room FROM l)
  SELECT lang, count(*) AS n_lines, sum(least(strlen(line), room))::BIGINT AS n_bytes, max(doc_id) AS last_doc FROM r WHERE room > 0 GROUP BY lang""")
def exact_language_files(spark, sf_dir):
    files = corpus.language_files(docs(spark, sf_dir), EXACT)
    return files.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"), F.max("doc_id").alias("last_doc"))


@register(f"""WITH r AS (SELECT {_RAW} AS raw FROM documents), c AS (SELECT {_S} AS s, raw FROM r)
  SELECT count(CASE WHEN raw <> '' AND (s IN ('mit', 'apache-2.0', 'apache2', 'apache-2', 'cc0', 'cc-0', 'cc0-1.0', 'odc-by', 'odc-by-1.0') OR (s LIKE 'cc-by%' AND s LIKE '%4%' AND s NOT LIKE '%sa%') OR (s LIKE 'cc-by-%' AND s NOT LIKE '%sa%')) THEN 1 END) AS n_permissive, count(CASE WHEN s = 'mit' THEN 1 END) AS n_mit FROM c""")
def permissive_documents(spark, sf_dir):
    raw = F.regexp_extract("text", r"(?i)licensed under (?:the )?([^.\n]+)", 1)
    return docs(spark, sf_dir).agg(F.count(F.when(corpus.is_permissive(raw), 1)).alias("n_permissive"), F.count(F.when(corpus.is_mit(raw), 1)).alias("n_mit"))


@register(COUNTS + """, t AS (SELECT unit, sum(cnt)::BIGINT AS cnt FROM u GROUP BY unit), a AS (SELECT CASE WHEN regexp_matches(unit, '\\p{Latin}') THEN 'Latin' WHEN regexp_matches(unit, '\\p{L}') THEN '<unknown_script>' ELSE '<no_letter>' END AS bucket, count(*) AS n_types, sum(cnt)::BIGINT AS n_tokens FROM t GROUP BY 1)
  SELECT *, round(n_types / sum(n_types) OVER (), 9) AS share FROM a""")
def script_shares(spark, sf_dir):
    return vocab.allocation_shares(words_counted(spark, sf_dir))


@register("""WITH p AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
  u AS (SELECT doc_id, i, length(s[i]) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM p) WHERE s[i] <> ''),
  c AS (SELECT doc_id, i, k, least(280, n - k * 280) AS n FROM (SELECT *, unnest(range(0, (n - 1) // 280 + 1)) AS k FROM u)),
  l AS (SELECT doc_id, list({'n': 1::BIGINT, 'w': n::BIGINT} ORDER BY i, k) AS l FROM c GROUP BY doc_id)
  SELECT doc_id, coalesce(list_reduce(l, lambda a, x: {'n': a.n + CASE WHEN a.w + 1 + x.w <= 280 THEN 0 ELSE 1 END, 'w': CASE WHEN a.w + 1 + x.w <= 280 THEN a.w + 1 + x.w ELSE x.w END}).n, 0)::INTEGER AS n_units FROM documents LEFT JOIN l USING (doc_id)""")
def packed_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(pools.sentences(F.coalesce("text", F.lit("")))).alias("n_units"))


UNITS = 200


@register(f"""WITH u AS ({_sql["packed_sentences"]}), r AS (SELECT lang, doc_id, n_units, sum(n_units) OVER (PARTITION BY lang ORDER BY doc_id) AS running FROM u JOIN documents USING (doc_id) WHERE n_units > 0)
  SELECT lang, count(*) AS docs_used, max(doc_id) AS last_doc, sum(least(n_units, {UNITS} - (running - n_units)))::BIGINT AS n_units FROM r WHERE running - n_units < {UNITS} GROUP BY lang""")
def first_sentence_units(spark, sf_dir):
    """The first units of each language, and the documents that they use up."""
    rows = pools.first_sentences(docs(spark, sf_dir), UNITS)
    return rows.groupBy("lang").agg(F.max("docs_used").alias("docs_used"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_units"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
