"""Fill-in-middle: a text is cut at two ranks of its units and put together again with sentinels, so that a model learns to fill gaps.

A text stays where it is, as bytes of its Arrow batch. A first pass of a lazy matcher counts the units; a second one advances to both
ranks, and the ends of the matches there are where the text is cut. A match is STRIDE units or, near the end or a rank, one. No unit is
kept, so memory beyond the text and its result is constant however long the text is. Ranks and forms come from SHA-256 of the seed and the doc_id, so a rerun cuts alike.

Defined cases: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain; a null doc_id is hashed as an
empty string; repeated rows and equal doc_ids with equal texts are cut alike; very long texts are whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Sentinels before prefix, suffix and middle; texts (of a hundred) that are cut, and how many of these have the suffix first.
SENTINELS, CUT, SUFFIX_FIRST, SEED = ("<P>", "<S>", "<M>"), 90, 20, 1
STRIDE = 64
#: Patterns over UTF-8 bytes: every byte of a text is in exactly one unit.
UNITS = {
    "characters": rb"[^\x80-\xBF][\x80-\xBF]*",
    "words": rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\Z)?|[\x20\x09-\x0D]+\Z",
    "lines": rb"[^\n]*\n|[^\n]+\Z",
}


class Matcher:
    """Advances over the units of a text, STRIDE of them to a match while so many are left to go."""

    def __init__(self, unit: bytes):
        self.one, self.many = re.compile(unit, re.DOTALL), re.compile(b"(?:(?>%b)){%d}" % (unit, STRIDE), re.DOTALL)

    def advance(self, raw: memoryview | bytes, at: int = 0, most: int = sys.maxsize) -> tuple[int, int]:
        """(units passed, at most `most`; where the last of them ends), from `at` on."""
        n = 0
        while most - n >= STRIDE and (match := self.many.match(raw, at)):
            n, at = n + STRIDE, match.end()
        for match in islice(self.one.finditer(raw, at), most - n):
            n, at = n + 1, match.end()
        return n, at


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, units: str = "characters", sentinels: tuple[str, str, str] = SENTINELS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) for docs(doc_id, text): form is plain, psm or spm, n counts units.

    psm is prefix, suffix, middle, each behind its sentinel; spm is suffix, prefix, middle. The unit counts are null where the text is plain.
    """
    if units not in UNITS:
        raise ValueError(f"no such unit: {units}")
    if len(set(sentinels)) != 3 or any(not s or len(s) != len(sentinels[0]) or s[0] in s[1:] for s in sentinels) or len({s[0] for s in sentinels}) != 1:
        raise ValueError("three different sentinels of one length are needed, which share their first character and have it nowhere else")
    marks = [s.encode() for s in sentinels]
    unit, pattern = UNITS[units], b"|".join(map(re.escape, marks))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, held = Matcher(unit), re.compile(pattern)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            out = []
            for text, *h in zip(texts, *(batch.column(f"h{k}").to_pylist() for k in range(4))):
                raw = memoryview(text.as_buffer())
                n, _ = matcher.advance(raw)
                if not n or h[2] % 100 >= cut or held.search(raw):
                    out.append((n, "plain", None, None, raw))
                    continue
                low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                _, a = matcher.advance(raw, 0, low)
                _, b = matcher.advance(raw, a, high - low)
                prefix, middle, suffix = marks[0] + raw[:a], marks[2] + raw[a:b], marks[1] + raw[b:]
                spm = h[3] % 100 < suffix_first
                out.append((n, "spm" if spm else "psm", low, high - low, b"".join((suffix, prefix, middle) if spm else (prefix, suffix, middle))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns[:-1], columns[-1].cast(pa.string())], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text of an output and its form, by the places of the sentinels, which are nowhere else in it."""
    size = len(sentinels[0])
    p, s, m = (F.instr(output, x) for x in sentinels)
    between = lambda start, end: F.substring(output, start + size, end - start - size)
    middle = F.substring(output, m + size, F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transformed(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op11_sql() -> str:
    p, s, m = SENTINELS
    held = " OR ".join(f"contains(t, '{x}')" for x in SENTINELS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  n AS (SELECT doc_id, t, length(t) AS n, {', '.join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR {held} OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM n),
  p AS (SELECT *, '{p}' || substr(t, 1, a) AS p, '{m}' || substr(t, a + 1, b - a) AS m, '{s}' || substr(t, b + 1) AS s FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
