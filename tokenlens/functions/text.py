"""Text measures as columns: words, characters, graphemes, pre-tokens, NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The pre-token pattern (letters with an optional mark before, numbers of up to three digits, other runs, blanks).
PRETOKEN = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
#: The same without the lookahead, for engines that have none; equal where no run of blanks stands before a word.
PRETOKEN_PLAIN = PRETOKEN.replace(r"\s+(?!\S)|", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


#: Characters that may stand behind a cut between pre-tokens and yet belong to the cluster before it, or hold what follows: marks, format
#: characters, emoji modifiers, half-width voiced marks.
JOINING = r"[\p{M}\p{Cf}\x{1F3FB}-\x{1F3FF}\x{FF9E}\x{FF9F}]"


def healed_spans(text: str) -> list[str]:
    """A fold over pre-tokens: the open span ends with the first one that ends where a cluster does."""
    import regex

    cuts, out, open_, at = {m.end() for m in regex.finditer(r"\X", text)}, [], 0, 0
    for m in regex.finditer(PRETOKEN, text):
        if m.start() != at:
            raise ValueError(f"pre-tokens leave a gap at {at}")
        at = m.end()
        if at in cuts:
            out.append(text[open_:at])
            open_ = at
    if at != len(text):
        raise ValueError(f"pre-tokens leave a gap at {at}")
    return out


@F.pandas_udf(ArrayType(StringType()))
def _healed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else healed_spans(t))


def healed(text: Column) -> Column:
    """Pre-tokens, neighbours joined until every cut is one between grapheme clusters; a gap between them is an error.

    Only texts with a character that can join across a cut leave the JVM; in all others pre-tokens are whole clusters.
    """
    odd = text.rlike(JOINING)
    plain = pretokens(text)
    whole = F.when(F.array_join(plain, "") == text, plain).when(text.isNotNull(), F.raise_error(F.lit("pre-tokens leave a gap")).cast("array<string>"))
    return F.when(odd, _healed(F.when(odd, text))).otherwise(whole)


@F.pandas_udf(ArrayType(StringType()))
def _indic_graphemes(text: pd.Series) -> pd.Series:
    import regex

    return text.map(lambda t: None if t is None else regex.findall(r"\X", t))


def graphemes(text: Column) -> Column:
    """Grapheme clusters; Java's rules lack conjuncts, so texts with Indic letters take the slow way. See n_graphemes()."""
    plain = F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
    return F.when(text.rlike("[ऀ-෿]"), _indic_graphemes(F.when(text.rlike("[ऀ-෿]"), text))).otherwise(plain)


def n_graphemes(text: Column) -> Column:
    """The number of grapheme clusters: below U+0300 only a line feed joins, to a carriage return before it."""
    return F.when(~text.rlike(r"[\u0300-\x{10FFFF}]"), F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))).otherwise(F.size(graphemes(text)))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: Characters that NFKC may change or join with others: all from U+0300 on, and these below (fixed values of the Unicode standard).
UNSTABLE = r"[\u0300-\x{10FFFF}\u00A0\u00A8\u00AA\u00AF\u00B2-\u00B5\u00B8-\u00BA\u00BC-\u00BE\u0132\u0133\u013F\u0140\u0149\u017F\u01C4-\u01CC\u01F1-\u01F3\u02B0-\u02B8\u02D8-\u02DD\u02E0-\u02E4]"


def normal(text: Column) -> Column:
    """NFKC; only texts with a character that it may change leave the JVM."""
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(UNSTABLE)  # ASCII stays as it is
    return F.coalesce(nfkc(F.when(odd, text)), text)


def surface_length(token: Column) -> Column:
    """Length of a token's surface, 0 for blanks and for what is not whole characters (U+FFFD)."""
    return F.when(F.trim(F.regexp_replace(token, SPACE, "")) == "", 0).when(token.contains("\ufffd"), 0).otherwise(F.length(token))


def fit_utf8(raw: Column, size: int) -> Column:
    """The longest prefix of whole characters of UTF-8 bytes that has at most `size` bytes, as text."""
    cut = F.substring(raw, F.lit(1), F.lit(size))
    # A character has four bytes at most: its lead is one of the last three if it is cut.
    tails = [F.try_validate_utf8(F.substring(cut, F.lit(1), F.octet_length(cut) - k).cast("string")) for k in range(4)]
    return F.coalesce(*tails, F.lit(""))


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def first_text(*fields: str) -> Column:
    """The first of these columns that isn't blank, null if all are."""
    return F.coalesce(*(F.when(F.trim(F.regexp_replace(f, SPACE, " ")) != "", F.col(f)) for f in fields))


def utf8_window(raw: Column) -> Column:
    """(low, high) code points that a UTF-8 prefix can begin; null for tails and bytes that never lead."""
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10).cast("long"))

    def window(x: Column) -> Column:
        lead = x[0]
        size = F.when(lead < 0x80, 1).when(lead.between(0xC2, 0xDF), 2).when(lead.between(0xE0, 0xEF), 3).when(lead.between(0xF0, 0xF4), 4)
        first = lead - F.when(lead < 0x80, 0).when(lead < 0xE0, 0xC0).when(lead < 0xF0, 0xE0).otherwise(0xF0)
        value = F.aggregate(F.slice(x, F.lit(2), F.least(F.size(x), size) - 1), first, lambda a, b: a * 64 + (b - 0x80))
        room = F.pow(F.lit(64), F.greatest(size - F.size(x), F.lit(0))).cast("long")
        return F.when(size.isNotNull(), F.struct((value * room).alias("low"), (value * room + room - 1).alias("high")))

    return F.when(F.octet_length(raw) > 0, F.transform(F.array(numbers), window)[0])
