"""Text functions: cleaning, tokens, perturbations.  Column in, Column out.

Word characters are ``[\\p{L}\\p{N}_]``: Java's plain ``\\w`` is ASCII only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BLANKS = " \t\n\x0b\f\r\xa0"  # what ``[\\s\\x{00a0}]`` matches


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends.

    Trimming equals the pattern and reads the ends only, except that ``$`` also
    stands before a last line separator that is no white space.
    """

    def ends(x: Column) -> Column:
        separated = x.endswith("\x85") | x.endswith("\u2028") | x.endswith("\u2029")
        return F.when(separated, F.regexp_replace(x, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", "")).otherwise(F.btrim(x, F.lit(BLANKS)))

    return once(c, ends)


def is_blank(c: Column) -> Column:
    """Nothing but white space of any kind."""
    return ~c.rlike(r"[^\s\x{00a0}]")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\x{00a0}]+$", "")


def words(c: Column) -> Column:
    """Non-blank pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def tokenize(c: Column) -> Column:
    """Lower-cased Unicode word tokens."""
    # plain letters first: they are most, and the classes take longer to test
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9_\p{L}\p{N}]+"), F.lit(0))


def clean_lines(c: Column) -> Column:
    """Trim every line, squeeze blanks, keep at most one blank line in a row."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    c = F.regexp_replace(c, r" {2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def excerpt(c: Column, limit: int, marker: str, *, trim: bool = True, one_line: bool = False) -> Column:
    """The text, or its first ``limit`` characters and ``marker`` when longer."""
    head = F.substring(c, 1, limit)
    if trim:
        head = rstrip(head)
    if one_line:
        head = F.regexp_replace(head, "\n", " ")
        c_out = F.regexp_replace(c, "\n", " ")
    else:
        c_out = c
    return F.when(F.length(c) > limit, F.concat(head, F.lit(marker))).otherwise(c_out)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition (NFC); Spark has no built-in for it."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def stem(c: Column) -> Column:
    """File name without folder and last suffix."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def _underscored(c: Column, outside: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, outside, "_"), r"^_+|_+$", "")


def safe_filename(c: Column) -> Column:
    """Stem with every run outside word characters, Arabic and dash as ``_``."""
    return F.concat(_underscored(stem(c), r"[^\p{L}\p{N}_\x{0600}-\x{06FF}\-]+"), F.lit(".txt"))


def document_key(c: Column) -> Column:
    """Composed stem with non-word runs as ``_``: joins chunk ids to files."""
    return _underscored(nfc(stem(c)), NOT_WORD + "+")


def attachment_key(c: Column) -> Column:
    """Text file name an attachment was extracted to (dashes are kept)."""
    return F.concat(_underscored(nfc(stem(c)), r"[^\p{L}\p{N}_\-]+"), F.lit(".txt"))


def slug(c: Column, limit: int = 80) -> Column:
    cleaned = _underscored(nfc(c), r"[^\p{L}\p{N}_\-]+")
    return F.substring(F.when(cleaned == "", F.lit("untitled")).otherwise(cleaned), 1, limit)


def url_slug(path: Column, query: Column, limit: int = 120) -> Column:
    """File stem of a page: its path and six hex digits for its query."""
    bare = F.regexp_replace(path, r"^/+|/+$", "")
    base = _underscored(nfc(F.when(bare == "", F.lit("_root")).otherwise(bare)), r"[^\p{L}\p{N}_\-]+")
    base = F.when(base == "", F.lit("_root")).otherwise(base)
    digest = F.concat(F.lit("_"), F.substring(F.sha1(query), 1, 6))
    return F.substring(F.concat(base, F.when(query == "", F.lit("")).otherwise(digest)), 1, limit)


def contains_ci(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def approx_tokens(c: Column) -> Column:
    """About four characters per token, floored."""
    return F.floor(F.length(c) / 4)


def page_estimate(c: Column) -> Column:
    """Blank-line breaks + 1."""
    return F.regexp_count(c, F.lit("\n\n")) + 1


def strip_wrapping_quotes(c: Column) -> Column:
    """Drop one pair of equal quotes around the text."""
    inner = strip(c.substr(F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))))
    first, last = c.substr(1, 1), F.right(c, F.lit(1))
    return F.when((first == last) & first.isin('"', "'"), inner).otherwise(c)


# --- perturbations of a query -------------------------------------------------


def lower_no_punct(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(c, r"\s+", " "))


def first_words(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def reversed_words(c: Column) -> Column:
    return F.array_join(F.reverse(words(c)), " ")


def typos(c: Column, seed: Column, rate: float = 0.07) -> Column:
    """Drop, swap or double about ``rate`` of the letters, the same on every run.

    Each letter draws from a hash of (seed, position), so the result depends on
    the row alone and not on how rows are spread over tasks.  A swap exchanges a
    letter with the letter after it; the letter swapped forward draws nothing.
    """
    chars = F.split(c, "")
    n = F.size(chars)

    def draw(i: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64(seed, i, F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0

    def char(i: Column) -> Column:
        return F.coalesce(F.get(chars, i), F.lit(""))

    def letter(i: Column) -> Column:
        return char(i).rlike(r"^\p{L}$")

    def step(acc: Column, i: Column) -> Column:
        op = draw(i, 2)
        mutate = letter(i) & (draw(i, 1) < rate)
        swap = mutate & (op >= 0.34) & (op < 0.67) & letter(i + 1)
        piece = (
            F.when(acc["skip"], F.lit(""))
            .when(~mutate, char(i))
            .when(op < 0.34, F.lit(""))
            .when(swap, F.concat(char(i + 1), char(i)))
            .otherwise(F.concat(char(i), char(i)))
        )
        return F.struct(
            F.concat(acc["out"], piece).alias("out"), (~acc["skip"] & swap).alias("skip")
        )

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("skip"))
    return F.when(
        n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])
    ).otherwise(c)


PERTURBATIONS = {
    "original": lambda text, seed: text,
    "lowercase_no_punct": lambda text, seed: lower_no_punct(text),
    "truncate_3": lambda text, seed: first_words(text, 3),
    "typos": typos,
    "reverse": lambda text, seed: reversed_words(text),
}


# --- redaction -----------------------------------------------------------------


def redact_secrets(c: Column) -> Column:
    """Hide credentials in URLs, known key shapes and ``key = value`` pairs."""
    # fixed values: the credential shapes
    c = F.regexp_replace(c, r"(?i)\b([a-z][a-z0-9+.\-]*)://[^\s/@]+:[^\s/@]+@", "$1://***:***@")
    c = F.regexp_replace(c, r"\b(sk|hf|gsk|xoxb|ghp|glpat)[-_][A-Za-z0-9\-_]{8,}", "***")
    return F.regexp_replace(
        c, r"(?i)\b(authorization|api[_-]?key|token|password|secret)\b\s*[:=]\s*\S+", "$1=***"
    )
