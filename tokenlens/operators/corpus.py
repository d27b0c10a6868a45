"""Corpus engineering: byte budgets, round robin, deduplication, hold-out, mixtures, calibration, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored


def running_sum(rows: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), tie: tuple[str, ...] = (), width: int | None = None, most: int = 1 << 16) -> DataFrame:
    """Adds `running`, the sum of `value` up to each row by `order` (a number), `tie` breaking ties.

    In two levels: sums of slices of `width` order values are accumulated, then each slice on its own, so that
    no task holds a whole key. By default slices hold about `most` rows, whether order values are dense or sparse. Null keys are a
    key like others; rows without an order value come last.
    """
    if width is None:
        low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
        width = max(1, int((high - low + 1) / max(16, n / most))) if n and low is not None else 1
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / width))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_slice"]
    sums = sums.select(*(F.col(c).alias(f"_of_{k}") for k, c in enumerate(names)), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*names).orderBy(*(F.asc_nulls_last(c) for c in (order, *tie))).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(names)]
    joined = sliced.withColumn("_inside", F.sum(value).over(inside)).join(sums, same)
    return joined.withColumn("running", F.col("_before") + F.col("_inside")).drop("_slice", "_before", "_inside", *(f"_of_{k}" for k in range(len(names))))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


def budget_prefix(docs: DataFrame, budget: int) -> DataFrame:
    """Whole documents of each language, in order, until `budget` bytes are reached (the last may overshoot)."""
    run = running_sum(sized(docs), "bytes", "doc_id", ("lang",))
    return run.where(F.col("running") - F.col("bytes") < budget).select("lang", "doc_id", "bytes")


def equal_bytes(docs: DataFrame) -> DataFrame:
    """The same number of bytes of every language: whole documents, the last one cut."""
    rows = sized(docs)
    budget = rows.groupBy("lang").agg(F.sum("bytes").alias("t")).agg(F.min("t").alias("budget"))
    run = running_sum(rows, "bytes", "doc_id", ("lang",)).crossJoin(F.broadcast(budget))  # one row
    return run.withColumn("used", F.least("bytes", F.col("budget") - (F.col("running") - F.col("bytes")))).where("used > 0").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("used").alias("n_bytes"), F.max("doc_id").alias("last_doc"))


def language_files(docs: DataFrame, budget: int) -> DataFrame:
    """(lang, doc_id, line, padding): lines of exactly `budget` bytes for each language of docs(lang, doc_id, text), in order of doc_id.

    A line has its line feed; the last one is cut at a whole character, and the one to three bytes that a cut character leaves are padded with
    line feeds (the padding is told). A language with fewer bytes is an error, as it would shift the mixture silently.
    """
    lines = docs.where("lang IS NOT NULL").select("lang", "doc_id", F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+\z", ""), F.lit("\n")).alias("line")).withColumn("bytes", F.octet_length("line").cast("long"))
    short = [f"{r.lang} ({r.n})" for r in lines.groupBy("lang").agg(F.sum("bytes").alias("n")).where(F.col("n") < budget).orderBy("lang").collect()]
    if short:
        raise ValueError(f"fewer than {budget} bytes: {', '.join(short)}")
    run = running_sum(lines, "bytes", "doc_id", ("lang",), ("line",)).withColumn("room", F.lit(budget) - (F.col("running") - F.col("bytes"))).where("room > 0")
    fitting = [F.try_validate_utf8(F.expr(f"substring(encode(line, 'utf-8'), 1, cast(room as int) - {k})").cast("string")) for k in range(4)]
    cut = F.when(F.col("bytes") <= F.col("room"), F.col("line")).otherwise(F.coalesce(*fitting, F.lit("")))
    rows = run.select("lang", "doc_id", "bytes", "room", cut.alias("cut"))
    padding = F.when(F.col("bytes") > F.col("room"), F.col("room") - F.octet_length("cut")).otherwise(0)
    return rows.select("lang", "doc_id", F.concat("cut", F.repeat(F.lit("\n"), padding.cast("int"))).alias("line"), padding.alias("padding"))


def equal_files(files: DataFrame, budget: int) -> DataFrame:
    """language_files() as they are, or an error where a language's lines don't have exactly `budget` bytes."""
    wrong = files.groupBy("lang").agg(F.sum(F.octet_length("line")).alias("n")).where(F.col("n") != budget).collect()
    if wrong:
        raise ValueError("languages differ from the budget: " + ", ".join(f"{r.lang} ({r.n})" for r in wrong))
    return files


def tier_budget(tiers: DataFrame, tier: str, languages: int, ceiling: int) -> int:
    """Bytes per language of a tier in tiers(tier, bytes_per_language, corpus_bytes); totals that disagree or exceed the ceiling are an error."""
    rows = tiers.where(F.col("tier") == tier).collect()
    if len(rows) != 1:
        raise KeyError(tier)
    budget, total = rows[0].bytes_per_language, rows[0].corpus_bytes
    if total != budget * languages:
        raise ValueError(f"tier {tier}: {total} bytes in all, but {languages} languages of {budget} make {budget * languages}")
    if total > ceiling:
        raise ValueError(f"tier {tier} needs {total} bytes, the most is {ceiling}")
    return budget


def round_robin(docs: DataFrame, target: int) -> DataFrame:
    """One document of each source in turn until `target` bytes; the last is cut."""
    one = sized(docs).withColumn("one", F.lit(1))
    turns = running_sum(one, "one", "doc_id", ("source",)).withColumnRenamed("running", "turn")
    run = running_sum(turns, "bytes", "turn", (), ("source",))
    return run.where(F.col("running") - F.col("bytes") < target).select("doc_id", "source", "turn", F.least("bytes", F.lit(target) - (F.col("running") - F.col("bytes"))).alias("used"))


def first_wins(docs: DataFrame) -> DataFrame:
    """Exact deduplication by SHA-256 of the text: the smallest doc_id stays. A hot text is combined before the shuffle."""
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def holdout(docs: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """The last k documents of each language (a limit that is the feature); the others are for training.

    `strict`: a language with k documents or fewer, which would leave none to train on, is an error.
    """
    if strict:
        short = [f"{r.lang} ({r.n})" for r in docs.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") <= k).orderBy("lang").collect()]
        if short:
            raise ValueError(f"no more than the {k} held out: {', '.join(short)}")
    last = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("doc_id")))
    return docs.select("lang", "doc_id", last.alias("r")).where(F.col("r") <= k).select("lang", "doc_id")


def unimax(available: DataFrame, budget: Column | float, cap: float) -> DataFrame:
    """UniMax shares of available(lang, bytes): uniform, but at most `cap` epochs of any language.

    A language is capped iff it and all smaller ones are below their uniform share of what those leave. A budget that is a number and
    more than all languages give at the cap is an error.
    """
    if not isinstance(budget, Column):
        most = available.agg(F.sum("bytes")).first()[0] or 0
        if budget > cap * most * (1 + 1e-12):
            raise ValueError(f"a budget of {budget} bytes can't be met: {cap} epochs of all languages are {cap * most}")
    ordered = Window.orderBy("bytes", "lang")  # one row per language
    rows = available.withColumn("i", F.row_number().over(ordered)).withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("budget", F.lit(budget) if not isinstance(budget, Column) else budget)
    before = F.coalesce(F.sum("bytes").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("fits", (F.col("budget") - cap * before) / (F.col("n") - F.col("i") + 1) > cap * F.col("bytes") + 1e-9)
    rows = rows.withColumn("capped", F.min(F.col("fits") & (F.col("bytes") < float("inf"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    used = F.sum(F.when(F.col("capped"), cap * F.col("bytes")).otherwise(0.0)).over(Window.partitionBy())
    free = F.sum(F.when(F.col("capped"), 0).otherwise(1)).over(Window.partitionBy())
    rows = rows.withColumn("allocated", F.when(F.col("capped"), cap * F.col("bytes")).otherwise((F.col("budget") - used) / F.nullif(free, F.lit(0))))
    return rows.select("lang", "bytes", F.round("allocated", 4).alias("allocated"), F.round(F.col("allocated") / F.col("bytes"), 9).alias("epochs"), "capped", F.round(F.col("allocated") / F.sum("allocated").over(Window.partitionBy()), 9).alias("share"), F.ceil(F.col("allocated") / F.col("bytes")).cast("long").alias("passes"))


def complete_arms(premiums: DataFrame) -> DataFrame:
    """premiums(arm, lang, premium) as they are, or an error where an arm lacks a language that another has, has it twice, or without a premium above 0."""
    rows = premiums.groupBy("arm", "lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("premium") > 0, 1)).alias("good"))
    arms = rows.select("arm").distinct().crossJoin(F.broadcast(rows.select("lang").distinct()))  # a row per language
    wrong = arms.join(rows, ["arm", "lang"], "left").where("n IS NULL OR n <> 1 OR good <> 1").orderBy("arm", "lang").collect()
    if wrong:
        raise ValueError("arms without one premium above 0: " + ", ".join(f"{r.arm} {r.lang}" for r in wrong))
    return premiums


def calibrated(premiums: DataFrame, damping: float = 0.5) -> DataFrame:
    """Target shares from the geometric mean of arms' premiums(arm, lang, premium), damped from uniform; see complete_arms()."""
    mean = premiums.groupBy("lang").agg(F.exp(F.avg(F.log("premium"))).alias("mean"))
    every = Window.partitionBy()
    target = F.col("mean") / F.sum("mean").over(every)
    rows = mean.withColumn("target", target).withColumn("prior", 1 / F.count("*").over(every))
    rows = rows.withColumn("damped", (1 - damping) * F.col("prior") + damping * F.col("target"))
    return rows.select("lang", F.round("mean", 8).alias("shared_premium"), F.round("target", 8).alias("target_share"), F.round("damped", 8).alias("damped_share"), F.round(F.max(F.abs(F.col("damped") - F.col("prior"))).over(every), 8).alias("max_delta"))


def license_class(raw: Column) -> Column:
    """A licence name in one spelling."""
    s = F.replace(F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("-")), F.lit("odc_by"), F.lit("odc-by"))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "unknown").when(s.isin("odc-by", "odc-by-1.0"), "odc-by-1.0").when(s == "odcby", s)
        .when(s.startswith("cc-by-sa"), F.when(s.contains("4"), "cc-by-sa-4.0").otherwise("cc-by-sa")).when(s == "mit", "mit").when(s.isin("apache-2.0", "apache2", "apache-2"), "apache-2.0")
        .when(s.isin("cc0", "cc-0", "cc0-1.0"), "cc0-1.0").when(s.startswith("cc-by") & ~s.contains("sa"), F.when(s.contains("4"), "cc-by-4.0").otherwise(s)).otherwise(s)
    )


def is_permissive(raw: Column) -> Column:
    """Licences that allow commercial use and changes without share-alike."""
    name = license_class(raw)
    return name.isin("mit", "apache-2.0", "cc0-1.0") | name.startswith("odc-by") | (name.startswith("cc-by-") & ~name.contains("sa"))


def is_mit(raw: Column) -> Column:
    return license_class(raw) == "mit"


def dataset_id(url: Column) -> Column:
    """owner/name of a dataset's address on the hub, else null."""
    got = F.regexp_extract(url, r"^https://huggingface\.co/datasets/([^/\s#]+/[^/\s#]+)", 1)
    return F.when(got != "", got)


def selected_sources(sources: DataFrame, permissive_only: bool) -> DataFrame:
    """sources(source_id, role, license, license_status, is_permissive_open) that may be trained on, with `selected` and the `reason` against."""
    open_ = F.coalesce(F.col("license_status").isin("mit", "permissive_open"), F.lit(False)) | F.coalesce("is_permissive_open", F.lit(False))
    alike = F.coalesce(F.col("license"), F.lit("unknown")).startswith("cc-by-sa")
    reason = F.when(alike | F.coalesce(~open_ & (F.col("license_status") == "copyleft_sharealike"), F.lit(False)), "cc_by_sa_excluded").when(~open_, F.coalesce("license_status", F.lit("not_permissive_open")))
    rows = sources.where("role = 'train_candidate'").withColumn("reason", reason if permissive_only else F.lit(None).cast("string"))
    return rows.withColumn("selected", F.col("reason").isNull())


def contaminated(docs: DataFrame, evaluation: DataFrame, n: int = 8) -> DataFrame:
    """Documents that share a word n-gram with the evaluation texts(text), and how many distinct ones.

    An n-gram is two 64-bit hashes of its words, so none is ever written out. The evaluation's are stored, so that Spark knows their size: where they
    are small they are broadcast and no n-gram of a document is shuffled that they lack. Only shared ones are made distinct: within the array of a
    text that would compare each with every other. Rows with one doc_id are one document.
    """

    def grams(df: DataFrame, *keep: str) -> DataFrame:
        rows = df.select(*keep, T.words(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        # A word's hash goes on from that of the word before it, so words are told apart.
        both = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("w", i, n)).alias("hash"), F.xxhash64(F.lit(n), F.slice("w", i, n)).alias("other")))
        return rows.select(*keep, F.explode(both).alias("gram")).select(*keep, "gram.hash", "gram.other")

    known = stored(grams(evaluation).distinct())
    return grams(docs, "doc_id").join(known, ["hash", "other"], "left_semi").distinct().groupBy("doc_id").agg(F.count("*").alias("n_shared"))


def cross_check(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Premiums(lang, token_premium) of two trainers side by side, and whether they agree."""
    rows = left.select("lang", F.col("token_premium").alias("a")).join(right.select("lang", F.col("token_premium").alias("b")), "lang", "full_outer")
    delta = F.abs(F.col("b") - F.col("a")) / F.nullif(F.abs("a"), F.lit(0.0))
    return rows.select("lang", "a", "b", F.round(delta, 8).alias("relative_delta"), F.coalesce(delta <= tolerance, F.lit(False)).alias("agrees"))
