"""Five language rules.  They differ on purpose; none stands for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import is_blank, once

# fixed values: French function words of the ratio rules
FRENCH_RATIO_WORDS = (
    "les des est pour dans une avec sur que qui nous vous pas sont cette aux par ont "
    "le la du ce se ne"
).split()
# fixed values: French words of the presence rule
FRENCH_PRESENCE_WORDS = (
    "bonjour merci les des est pour dans une avec sur que qui nous vous pas sont cette "
    "aux par ont"
).split()
# fixed values: scripts and diacritics
ARABIC = r"[\x{0600}-\x{06FF}]"
ARABIC_WIDE = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"
FRENCH_MARKS = "[àâäéèêëîïôöùûüçœÀÂÄÉÈÊËÎÏÔÖÙÛÜÇŒ]"
FRENCH_MARKS_SET = "[àâçéèêëîïôûùüÿœæÀÂÇÉÈÊËÎÏÔÛÙÜŸŒÆ]"
LATIN_WORDS = "[a-zA-ZÀ-ÿ]+"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def vocabulary_overlap(text: Column, vocabulary=FRENCH_PRESENCE_WORDS) -> Column:
    """Number of distinct blank-separated words found in ``vocabulary``."""
    return F.size(F.array_intersect(F.split(F.lower(text), r"\s+"), _strings(vocabulary)))


def lang_presence(text: Column) -> Column:
    """Any Arabic letter, else two French function words, else English."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
        .when(text.rlike(ARABIC), F.lit("Arabic"))
        .when(vocabulary_overlap(text) >= 2, F.lit("French"))
        .otherwise(F.lit("English"))
    )


def lang_ratio(
    text: Column,
    *,
    arabic_over: int = 30,
    french_over: float = 0.05,
    sample: int | None = None,
    labels: tuple[str, str, str, str] = ("ar", "fr", "en", "empty"),
) -> Column:
    """Script counts and the share of French function words.

    The whole text is read; ``sample`` asks for its first characters only.
    """
    arabic, french, english, none = (F.lit(v) for v in labels)
    head = F.coalesce(text if sample is None else F.substring(text, 1, sample), F.lit(""))
    n_arabic = F.regexp_count(head, F.lit(ARABIC))
    tokens = F.regexp_extract_all(F.lower(head), F.lit(LATIN_WORDS), F.lit(0))
    wordless = F.when(n_arabic > 0, arabic).otherwise(none)

    def by_words(found: Column) -> Column:
        hits = F.size(F.filter(found, lambda w: w.isin(FRENCH_RATIO_WORDS)))
        share = hits / F.greatest(F.size(found), F.lit(1))
        return F.when(F.size(found) > 0, F.when(share > french_over, french).otherwise(english))

    # the words are found once a text: a case expression finds them anew in each branch
    label = F.when(is_blank(head), F.lit("empty")).when(n_arabic > arabic_over, arabic).otherwise(once(tokens, by_words))
    return F.coalesce(label, wordless if labels[3] == "empty" else none)


def lang_ratio_document(text: Column, sample: int | None = None) -> Column:
    """The ratio rule for whole documents: more Arabic needed, long labels."""
    return lang_ratio(
        text,
        arabic_over=50,
        sample=sample,
        labels=("Arabic", "French", "English", "unknown"),
    )


def lang_script(text: Column) -> Column:
    return (
        F.when(text.rlike(ARABIC), F.lit("Arabic"))
        .when(text.rlike(FRENCH_MARKS), F.lit("French"))
        .otherwise(F.lit("English"))
    )


def is_non_english(text: Column) -> Column:
    return text.rlike(ARABIC) | text.rlike(FRENCH_MARKS)


def lang_flags(text: Column) -> dict[str, Column]:
    """Per text: shows Arabic, shows French, shows English (only if neither)."""
    ar, fr = text.rlike(ARABIC_WIDE), text.rlike(FRENCH_MARKS_SET)
    return {"ar": ar, "en": ~ar & ~fr & text.rlike("[A-Za-z]"), "fr": fr}


def lang_set(text: Column) -> Column:
    """Aggregate: the languages seen over a group of texts, sorted."""
    flags = lang_flags(text)
    seen = F.array(*[F.when(F.bool_or(c), F.lit(k)) for k, c in flags.items()])
    return F.filter(seen, lambda v: v.isNotNull())


def covers_all(seen: Column, required) -> Column:
    """True when every required value is in the array ``seen``."""
    return F.size(F.array_except(_strings(required), seen)) == 0
