"""Citations inside composed answers.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import strip

# fixed values: the shape of a chunk id and of a citation group
CHUNK_ID = r"(?:chat|pdf|ext)_[\p{L}\p{N}_.\-]+"
GROUP = rf"\[\s*({CHUNK_ID}(?:\s*,\s*{CHUNK_ID})*)\s*\]"

# fixed values: phrases that mark a refusal
REFUSAL = (
    r"(?i)(?<![\p{L}\p{N}_])(?:"
    r"(?:do(?:n'?t| not)) have (?:any |specific )?(?:info(?:rmation)?|data|details|specifics|context)"
    r"|no (?:specific |particular )?(?:info(?:rmation)? )?(?:about|on|regarding) [a-z]"
    r"|(?:cou|ca)(?:l)?d(?:n'?t| not) find"
    r"|I (?:do(?:n'?t| not)) (?:see|have|know)"
    r"|not (?:in|present in|found in|provided in) the context"
    r"|outside (?:my |the bot's )?scope"
    r")(?![\p{L}\p{N}_])"
)


def is_refusal(answer: Column) -> Column:
    return answer.rlike(REFUSAL)


def citation_groups(answer: Column) -> Column:
    """Bracketed groups as written."""
    return F.regexp_extract_all(answer, F.lit(f"({GROUP})"), F.lit(1))


def _ids(group: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(group, r"^\[|\]$", ""), ","), strip)


def citation_ids(answer: Column) -> Column:
    """Cited ids in reading order, repeats kept."""
    return F.flatten(F.transform(citation_groups(answer), _ids))


def known_citations(answer: Column, known: Column) -> Column:
    """Distinct cited ids found in the array ``known``, by first appearance."""
    return F.array_distinct(F.filter(citation_ids(answer), lambda i: F.array_contains(known, i)))


# a comma or a joining word between two citation groups, each with a blank of its own
SEPARATORS = r"(?: *,| +(?:or|and) )"
TIDY = (
    (r"\s+", "  "),  # two blanks, so that neighbours need not share one
    (rf"(?i){SEPARATORS}+ *([.!?])", r"\1"),  # nothing is left to join before the end of a sentence
    (rf"(?i){SEPARATORS}* *,", ","),  # of several separators the last comma stays
    (r" +", " "),
    (r" ([.,;:!?])", r"\1"),
)


def scrub_citations(answer: Column) -> Column:
    """Remove citation groups and the separators that only stood between them."""
    out = F.regexp_replace(answer, GROUP, "")
    for pattern, kept in TIDY:
        out = F.regexp_replace(out, pattern, kept.replace("\\1", "$1"))
    return strip(out)


def renumber_citations(answer: Column, known: Column) -> Column:
    """Cited ids as [1], [2] ... in order of appearance; unknown ids stay.

    A refusal is scrubbed instead.  Equal groups render equally, so each
    distinct group is replaced once, all within the row.
    """
    order = known_citations(answer, known)

    def render(group: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.array_position(order, i)
            label = F.when(at > 0, at.cast("string")).otherwise(i)
            return F.concat(F.lit("["), label, F.lit("]"))

        return F.array_join(F.transform(_ids(group), one), " ")

    numbered = F.aggregate(
        F.array_distinct(citation_groups(answer)),
        answer,
        lambda text, group: F.replace(text, group, render(group)),
    )
    return F.when(is_refusal(answer), scrub_citations(answer)).otherwise(numbered)


def cited_sources(answer: Column, known: Column) -> Column:
    """Array of (number, id) of the sources to show; none for a refusal."""
    order = F.when(is_refusal(answer), F.array().cast("array<string>")).otherwise(
        known_citations(answer, known)
    )
    return F.transform(order, lambda i, n: F.struct((n + 1).alias("number"), i.alias("id")))
