"""Column functions over text, written with regular expressions that mean the same in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = r"[^\p{L}\p{N}_]+"


def short_id(column: str | Column, width: int = 20) -> Column:
    """The part behind the last slash, other than letters and digits as `_`, cut to `width`, with six digits of the MD5 of the whole."""
    c = F.col(column) if isinstance(column, str) else column
    leaf = F.regexp_replace(F.substring_index(c, "/", -1), "[^a-zA-Z0-9]", "_")
    return F.concat_ws("_", F.substring(leaf, 1, width), F.substring(F.md5(c), 1, 6))


def plain_name(column: str | Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def without_hash(column: str | Column) -> Column:
    """Without a trailing underscore and six hexadecimal digits."""
    return F.regexp_replace(column, "_[0-9a-f]{6}$", "")


def without_link(column: str | Column) -> Column:
    """The text of a Markdown link, other text as it is."""
    return F.regexp_replace(column, r"^\s*\[([^\]]*)\]\([^)]*\)\s*$", "$1")


def size_number(column: str | Column) -> Column:
    """`118M`, `7.5B`, `12K` as a DOUBLE; null for anything else."""
    number = F.regexp_extract(column, r"^([0-9.]+)[KMB]$", 1).try_cast("double")
    unit = F.regexp_extract(column, r"([KMB])$", 1)
    return number * F.when(unit == "B", F.lit(1e9)).when(unit == "M", F.lit(1e6)).when(unit == "K", F.lit(1e3))


#: Blanks as a character class: those of ASCII and of Unicode.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def markdown_free(column: str | Column) -> Column:
    """Without bold, italic and heading marks, with at most one empty line in a row, trimmed. Marks may span lines."""
    c = F.regexp_replace(column, r"\*\*([^*]+)\*\*", "$1")
    c = F.regexp_replace(c, r"\*([^*]+)\*", "$1")
    c = F.regexp_replace(c, rf"(?md)^#{{1,6}}[{BLANKS}]+", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def word_tokens(column: str | Column, lower: bool = False) -> Column:
    """Runs of letters, digits and underscores, in order."""
    c = F.lower(column) if lower else (F.col(column) if isinstance(column, str) else column)
    return F.filter(F.split(F.regexp_replace(c, _NOT_WORD, " "), " "), lambda t: t != "")


def char_tokens(column: str | Column) -> Column:
    """Single characters other than blanks."""
    return F.filter(F.split(F.regexp_replace(column, r"[ \t\r\n]+", ""), ""), lambda t: t != "")


def word_ngrams(tokens: Column, n: int) -> Column:
    """Every n tokens in a row, joined by one blank; empty for fewer. tokens should be a column, not an expression."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def collapsed(column: str | Column) -> Column:
    """With one blank for every run of blanks and line ends."""
    return F.regexp_replace(column, r"[ \t\r\n]+", " ")


def char_ngrams(chars: Column, n: int) -> Column:
    """Every n characters in a row; empty for fewer. chars: an array column of single characters."""
    starts = F.sequence(F.lit(1), F.size(chars) - (n - 1))
    return F.when(F.size(chars) >= n, F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))).otherwise(F.array().cast("array<string>"))


def first_integer(column: str | Column, most: int) -> Column:
    """The first whole number in a text, at most `most`; 0 if there is none."""
    return F.least(F.lit(most).cast("long"), F.coalesce(F.regexp_extract(column, r"([0-9]{1,15})", 1).try_cast("long"), F.lit(0)))


def base_language(column: str | Column) -> Column:
    """The part of a language code before `-` or `_`, in lower case; three-letter codes of the usual languages as two."""
    base = F.regexp_extract(F.lower(column), r"^([a-z]+)", 1)
    return F.coalesce(F.create_map(*(F.lit(x) for p in {"jpn": "ja", "hin": "hi", "ita": "it", "eng": "en", "swa": "sw"}.items() for x in p))[base], base)
