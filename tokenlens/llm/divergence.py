"""Source divergence audit: how differently the sources of a language use its terms, counted and compared by DuckDB in shards.

Tasks count the terms of their documents by language and source, so that a frequent term leaves a task as one row a source. These rows
are dealt to shards by the hash of language and term; a shard's DuckDB adds them up, and keeps terms that enough documents of
the language hold. Spark adds up the kept counts of each group (language and source). Then the shards' kept counts, beside the groups of their
languages, give partial sums of |p - q| for each pair of sources and each shard's first terms of each group; Spark merges sums and ranks.

A pair's sum runs over cells only: for a term that neither source has, the difference is the same number, so it is taken times the
terms of the language and the cells add what differs from it. Each pair is summed once, for the source that sorts first. Sources are dealt in
blocks of BLOCK, so that a task's pairs are at most BLOCK times the sources of a language.

Defined cases: null text, lang and source are empty strings; a group without terms is there; a language with one source has no pairs,
one without kept terms has pairs of value 0 and no term rows; ties go to the item that sorts first by its bytes; repeated rows count each; very
long texts are counted in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table

LEAST_DOCUMENTS, SCALE, SMOOTHING, RANKS = 30, 1_000_000_000, 5, 50
#: Bytes of text per shard, kept cells per second shard, sources per block, distinct (language, source, term) that a task counts at a time.
SHARD_BYTES, SHARD_CELLS, BLOCK, HELD = 32 << 20, 500_000, 256, 200_000
#: Bytes of a text that are counted at a time, and rows that a shard takes in before it adds them up.
PIECE, WAITING = 1 << 22, 1 << 19
#: A-Z in lower case; all other ASCII characters but a-z are blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(raw: memoryview) -> Iterator[bytes]:
    """The text with blanks between terms, in pieces of about PIECE bytes that end behind a blank."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        part = bytes(raw[at:end]).translate(_TERMS)
        while end < len(raw) and not part.endswith(b" "):  # a term goes on
            cut = part.rfind(b" ") + 1
            if cut:
                part, end = part[:cut], at + cut
                break
            more = min(len(raw), end + PIECE)
            part, end = part + bytes(raw[end:more]).translate(_TERMS), more
        yield part
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of this task, some rows of a kind where there are many terms."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            both = [pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, *both], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in slices(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            own: Counter = Counter()
            for part in pieces(memoryview(text.as_buffer())):
                own.update(part.split())
            before = len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n) - before
        if held > HELD:
            yield from rows()
            held = 0
    yield from rows()


def _database() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def summed(least: int):
    """A shard's rows added up by DuckDB as they come in: kept terms' cells, and the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            db.execute("CREATE TABLE cells (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            waiting, settled = 0, 0
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO cells SELECT * FROM batch")
                db.unregister("batch")
                waiting += batch.num_rows
                if waiting > max(WAITING, settled):
                    db.execute("CREATE OR REPLACE TABLE cells AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM cells GROUP BY ALL")
                    waiting, settled = 0, db.sql("SELECT count(*) FROM cells").fetchall()[0][0]
            got = db.sql(f"""
                WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM cells GROUP BY ALL)
                SELECT lang, source, term, n FROM c QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}""")
            yield from got.to_arrow_reader(1 << 16)

    return run


def compared(ranks: int):
    """A shard's partial pair sums (part pair) and its first terms of each group (part term), from cells and the groups of its languages."""

    def run(key: tuple, cells: pa.Table, groups: pa.Table) -> pa.Table:
        block = key[1].as_py()
        with _database() as db:
            db.register("cells", cells)
            db.register("groups", groups)
            # p1: a cell's share; p0: the share of a term that the source lacks. // divides whole numbers exactly.
            db.execute(f"""CREATE TABLE c AS SELECT lang, source, term, c.n, g.block, 1 + {SCALE} * (c.n + {SMOOTHING})::HUGEINT // (g.n + {SMOOTHING} * g.v) AS p1, p0
                FROM cells c JOIN (SELECT *, 1 + {SCALE * SMOOTHING}::HUGEINT // (n + {SMOOTHING} * v) AS p0 FROM groups WHERE v > 0) g USING (lang, source)""")
            db.execute(f"CREATE TABLE g AS SELECT lang, source, block, 1 + {SCALE * SMOOTHING}::HUGEINT // (n + {SMOOTHING} * v) AS p0 FROM groups WHERE v > 0")
            # Cells of the block against all sources. A pair of two cells is met from both sides and counts from the first one.
            pairs = f"""SELECT least(c.source, g.source) AS source, greatest(c.source, g.source) AS item, c.lang,
                  sum(abs(c.p1 - coalesce(d.p1, g.p0)) - abs(c.p0 - g.p0))::BIGINT AS value
                FROM c JOIN g ON c.lang = g.lang AND c.source <> g.source LEFT JOIN c d ON d.lang = c.lang AND d.term = c.term AND d.source = g.source
                WHERE c.block = {block} AND (d.term IS NULL OR c.source < g.source) GROUP BY ALL"""
            terms = f"""WITH q AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), l AS (SELECT DISTINCT lang, total, v FROM groups),
                  f AS (SELECT c.lang, c.source, c.term AS item, (p1 - (1 + {SCALE} * (q.n + {SMOOTHING})::HUGEINT // (l.total + {SMOOTHING} * l.v)))::BIGINT AS value
                    FROM c JOIN q USING (lang, term) JOIN l USING (lang) WHERE c.block = {block})
                SELECT lang, source, item, value FROM f WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) <= {ranks}"""
            return db.sql(f"SELECT lang, source, 'pair' AS part, item, value FROM ({pairs}) UNION ALL SELECT lang, source, 'term', item, value FROM ({terms})").to_arrow_table()

    return run


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs(text, lang, source)."""
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    cells = rows.repartition(max(tasks, size // SHARD_BYTES + 1), "lang", "term").mapInArrow(summed(least), "lang string, source string, term string, n long")
    cells = stored(cells)
    # A row a group, those without terms as well; v counts the language's kept terms.
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = cells.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("v"))
    every = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    of_lang = Window.partitionBy("lang")  # a row a source
    groups = stored(
        every.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
        .withColumn("total", F.sum("n").over(of_lang))
        .withColumn("block", ((F.row_number().over(of_lang.orderBy("source")) - 1) / BLOCK).cast("int"))
    )
    n_cells, n_blocks = cells.count(), (groups.agg(F.max("block")).first()[0] or 0) + 1
    shards = max(min(tasks, n_cells // 5_000 + 1), n_cells // SHARD_CELLS + 1)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    dealt = cells.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")).withColumn("part_block", blocks)
    beside = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part_block", blocks)
    found = dealt.groupBy("shard", "part_block").cogroup(beside.groupBy("shard", "part_block")).applyInArrow(compared(ranks), "lang string, source string, part string, item string, value long")
    found = stored(found)
    # What a pair has where neither source has a term, for all terms of the language; then what its cells differ by.
    p0 = F.expr(f"1 + {SCALE * SMOOTHING} div (n + {SMOOTHING} * v)")
    a = groups.select("lang", "source", "v", F.when(F.col("v") > 0, p0).alias("p"))
    b = groups.select("lang", F.col("source").alias("item"), F.when(F.col("v") > 0, p0).alias("q"))
    bare = a.join(b, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * F.abs(F.col("p") - F.col("q")), F.lit(0)).alias("value"))
    half = found.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = bare.union(half).union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(found.where("part = 'term'").drop("part")).where(F.col("rank") <= ranks)  # each partition's first ones, then those of all
    both = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def op13_sql() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    share = lambda n, total: f"1 + {SCALE} * ({n} + {SMOOTHING})::HUGEINT // ({total} + {SMOOTHING} * v)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  o AS (SELECT r, lang, source, unnest(w) AS term FROM d), k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
  c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
  g AS (SELECT lang, source, coalesce(s.n, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)
    LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang)),
  p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, {share('coalesce(n, 0)', 'total')} AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  q AS (SELECT lang, term, {share('sum(n)', 'max(t)')} AS q FROM (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS t, v FROM p JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang)) GROUP BY lang, term, v),
  f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM f
  QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) <= {RANKS}"""
