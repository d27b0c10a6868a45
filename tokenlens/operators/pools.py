"""Pools for pre-training mixtures: source ladders, passes over pools, top-ups, samples for bytes per token, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import checkpointed, stored
from .corpus import running_sum


def ladder(docs: DataFrame, rungs: DataFrame, target: int) -> DataFrame:
    """Documents taken per language, rung by rung, up to `target` bytes.

    docs(doc_id, text, lang, source), rungs(source, rung) with a row per source. Of equal texts of a language one is taken; a text that
    a rung did not reach may be taken from a later one. A rung stops at its first new document that would overshoot what the rungs
    before it have left; later rungs may go on with smaller ones. Returns (lang, rung, doc_id, bytes).
    """
    rows = docs.join(rungs, "source").select("lang", "rung", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("lang", "rung", "digest").agg(F.min("doc_id").alias("doc_id"), F.min("bytes").alias("bytes")).persist()
    names = [r.rung for r in rungs.select("rung").distinct().orderBy("rung").collect()]
    taken, left = None, rows.select("lang").distinct().withColumn("left", F.lit(target).cast("long"))
    for rung in names:  # a ladder has a handful of rungs
        mine = first.where(F.col("rung") == rung)
        if taken is not None:
            mine = mine.join(taken.select("lang", "digest"), ["lang", "digest"], "left_anti")
        mine = running_sum(mine, "bytes", "doc_id", ("lang",)).join(left, "lang").where(F.col("running") <= F.col("left"))
        mine = checkpointed(mine.select("lang", "rung", "doc_id", "bytes", "digest"))
        taken = mine if taken is None else taken.union(mine)
        left = left.join(mine.groupBy("lang").agg(F.sum("bytes").alias("used")), "lang", "left").select("lang", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
    first.unpersist()
    return taken.drop("digest") if taken is not None else rows.drop("digest").limit(0)


def tokenise_passes(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(lang, pass, doc_id, bytes): sweeps over each pool, whole documents, until targets(lang, target) is reached.

    The last document may overshoot. Full sweeps are counted from the pool's size, so only passes that are needed are made.
    """
    pool = sized.groupBy("lang").agg(F.sum("bytes").alias("pool")).join(F.broadcast(targets), "lang").where("pool > 0 AND target > 0")
    run = running_sum(sized, "bytes", "doc_id", ("lang",)).join(F.broadcast(pool), "lang")  # a row per language
    sweeps = run.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("target") / F.col("pool")) - 1)))
    return sweeps.where(F.col("pass") * F.col("pool") + F.col("running") - F.col("bytes") < F.col("target")).select("lang", "pass", "doc_id", "bytes")


def pool_needs(allocated: DataFrame, headroom: float = 0.1) -> DataFrame:
    """Of allocated(lang, bytes, allocated): unique bytes used, bytes to acquire, passes over the pool, share."""
    unique, bound = F.least("allocated", "bytes"), F.col("allocated") >= F.col("bytes")
    acquire = F.when(bound, F.col("bytes")).otherwise(F.least(F.col("allocated") * (1 + headroom), F.col("bytes")))
    share = F.col("allocated") / F.sum("allocated").over(Window.partitionBy())  # a row per language
    return allocated.select("lang", F.round(unique, 4).alias("unique_bytes"), F.round(acquire, 4).alias("acquire_bytes"), F.round(F.col("allocated") / F.nullif(unique, F.lit(0.0)), 9).alias("passes_over_pool"), F.round(share, 9).alias("share"))


def top_up(needs: DataFrame, present: DataFrame) -> DataFrame:
    """(lang, missing_bytes) of needs(lang, acquire_bytes) that present(lang, bytes) lacks."""
    rows = needs.select("lang", "acquire_bytes").join(present.select("lang", "bytes"), "lang", "left")
    missing = F.ceil(F.col("acquire_bytes") - F.coalesce("bytes", F.lit(0)))
    return rows.select("lang", missing.cast("long").alias("missing_bytes")).where("missing_bytes > 0")


def byte_sample(sized: DataFrame, budget: int, slack: float = 1.25) -> DataFrame:
    """(lang, doc_id, bytes): whole documents until `budget`; a document that would pass slack * budget ends the sample unless it is the first."""
    run = running_sum(sized, "bytes", "doc_id", ("lang",))
    before = F.col("running") - F.col("bytes")
    ends = run.where((F.col("running") > slack * budget) & (before > 0)).groupBy("lang").agg(F.min(F.struct("running", "bytes", "doc_id")).alias("stop"))
    run = run.join(F.broadcast(ends), "lang", "left")  # a row per language
    allowed = F.col("stop").isNull() | (F.struct("running", "bytes", "doc_id") < F.col("stop"))
    return run.where((before < budget) & allowed).select("lang", "doc_id", "bytes")


def bytes_per_token(docs: DataFrame) -> DataFrame:
    """(lang, n_bytes, n_tokens, bytes_per_token) under pre-tokens."""
    text = F.coalesce("text", F.lit(""))
    sums = docs.groupBy("lang").agg(F.sum(F.octet_length(text)).alias("n_bytes"), F.sum(F.size(T.pretokens(text))).alias("n_tokens"))
    return sums.withColumn("bytes_per_token", F.round(F.col("n_bytes") / F.nullif(F.col("n_tokens"), F.lit(0)), 9))


def equal_lines(docs: DataFrame) -> DataFrame:
    """(lang, doc_id): the first N documents of each language, N being the smallest language's number."""
    n = docs.groupBy("lang").agg(F.count("*").alias("n")).agg(F.min("n").alias("most"))
    one = docs.select("lang", "doc_id").withColumn("one", F.lit(1))
    return running_sum(one, "one", "doc_id", ("lang",)).crossJoin(F.broadcast(n)).where(F.col("running") <= F.col("most")).select("lang", "doc_id")  # one row


def shard_of(sized: DataFrame, shard_bytes: int) -> DataFrame:
    """(lang, doc_id, bytes, shard): a shard closes behind the document that takes it to `shard_bytes`; documents are whole."""
    run = running_sum(sized, "bytes", "doc_id", ("lang",))
    return run.select("lang", "doc_id", "bytes", F.floor((F.col("running") - F.col("bytes")) / shard_bytes).alias("shard"))


def train_rows(docs: DataFrame, held: DataFrame) -> DataFrame:
    """`docs` without the rows whose (lang, doc_id) is in `held`."""
    return docs.join(held.select("lang", "doc_id"), ["lang", "doc_id"], "left_anti")


def sentences(text: Column, most: int = 280) -> Column:
    """Sentences of a text, neighbours joined up to `most` characters; longer ones are cut hard."""
    parts = F.filter(F.split(F.trim(text), r"(?<=[.!?。！？])\s+"), lambda s: s != "")
    cut = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda k: F.substring(s, k * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        fits = (a["open"] != "") & (F.length(a["open"]) + 1 + F.length(s) <= most)
        closed = F.when(fits | (a["open"] == ""), a["out"]).otherwise(F.concat(a["out"], F.array(a["open"])))
        return F.struct(closed.alias("out"), F.when(fits, F.concat(a["open"], F.lit(" "), s)).otherwise(s).alias("open"))

    return F.aggregate(cut, start, step, lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["open"]))))


def first_sentences(docs: DataFrame, n: int, most: int = 280) -> DataFrame:
    """(lang, place, unit, doc_id, docs_used): the first n sentence units of each language of docs(lang, doc_id, text), in order of doc_id.

    Units don't cross documents. docs_used counts the documents with a unit that the language's n units come from, so that these can be kept from
    training. Languages with fewer units are an error; documents without a language or a unit are left out.
    """
    rows = docs.where("lang IS NOT NULL").select("lang", "doc_id", sentences(F.coalesce("text", F.lit("")), most).alias("units")).withColumn("n", F.size("units").cast("long")).where("n > 0")
    rows = stored(rows)
    short = [f"{r.lang} ({r.n})" for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") < n).orderBy("lang").collect()]
    if short:
        raise ValueError(f"fewer than {n} units: {', '.join(short)}")
    run = running_sum(rows, "n", "doc_id", ("lang",)).withColumn("first", F.col("running") - F.col("n")).where(F.col("first") < n)
    used = run.groupBy("lang").agg(F.count("*").alias("docs_used"))
    each = run.select("lang", "doc_id", "first", F.posexplode("units").alias("at", "unit")).withColumn("place", F.col("first") + F.col("at")).where(F.col("place") < n)
    return each.join(F.broadcast(used), "lang").select("lang", "place", "unit", "doc_id", "docs_used")  # a row per language


def byte_matched_context(per_token: DataFrame, reference: str, context: int = 2048) -> DataFrame:
    """(arm, context) of per_token(arm, bytes_per_token): the context that holds as many bytes as the reference's; 1 at least."""
    base = per_token.where(F.col("arm") == reference).select(F.col("bytes_per_token").alias("base"))
    return per_token.crossJoin(F.broadcast(base)).select("arm", F.greatest(F.lit(1), F.bround(context * F.col("base") / F.col("bytes_per_token"))).cast("int").alias("context"))  # one row


def summary(allocated: DataFrame, kind: str) -> DataFrame:
    """One row (kind, n_languages, total, payload): the mixture as JSON, languages in order, infinite numbers as null."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    entry = F.struct("lang", *(finite(c).alias(c) for c in ("bytes", "allocated", "epochs", "share")), "capped")
    return allocated.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_languages"), F.round(F.sum("allocated"), 4).alias("total"), F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))  # a row per language
