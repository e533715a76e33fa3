"""Labels, tiers and number formats shown to readers.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column, other: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(other)).otherwise(c)


def quality_tier(length: Column, has_photo: Column, has_file: Column) -> Column:
    # fixed values: tier names
    return (
        F.when((length == 0) & (has_photo | has_file), F.lit("Media-only"))
        .when(length == 0, F.lit("Empty"))
        .when(length < 50, F.lit("Low (< 50 chars)"))
        .when(length < 200, F.lit("Medium (50–200)"))
        .otherwise(F.lit("High (>= 200 chars)"))
    )


TIER_ORDER = ["High (>= 200 chars)", "Medium (50–200)", "Low (< 50 chars)", "Media-only", "Empty"]


def confidence_tier(score: Column, high: float = 0.50, mid: float = 0.20) -> Column:
    return F.when(score >= high, "high").when(score >= mid, "mid").otherwise("low")


def length_bucket(length: Column) -> Column:
    return (
        F.when(length == 0, F.lit("0"))
        .when(length < 50, F.lit("1-49"))
        .when(length < 200, F.lit("50-199"))
        .otherwise(F.lit(">=200"))
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def freshness_band(ts: Column, now: Column) -> Column:
    days = seconds_between(now, ts) / 86400
    return (
        F.when(ts.isNull(), F.lit("never"))
        .when(days > 30, F.lit("stale"))
        .when(days > 7, F.lit("ageing"))
        .otherwise(F.lit("fresh"))
    )


def snapshot_stale(ts: Column, now: Column) -> Column:
    return seconds_between(now, ts) / 86400 > 1


def relative_age(ts: Column, now: Column) -> Column:
    sec = F.floor(seconds_between(now, ts))
    minute, hour, day = F.floor(sec / 60), F.floor(sec / 3600), F.floor(sec / 86400)
    month = F.floor(day / 30)

    def text(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(sec < 30, F.lit("just now"))
        .when(sec < 60, text(sec, "s ago"))
        .when(minute < 60, text(minute, " min ago"))
        .when(hour < 24, text(hour, " hr ago"))
        .when(day == 1, F.lit("1 day ago"))
        .when(day < 30, text(day, " days ago"))
        .when(month < 12, text(month, " mo ago"))
        .otherwise(text(F.floor(month / 12), " yr ago"))
    )


def member_for(joined: Column, now: Column) -> Column:
    days = F.floor(seconds_between(now, joined) / 86400)
    months = F.floor(days / 30)

    def plural(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(" " + unit), F.when(n == 1, "").otherwise("s"))

    return F.when(days < 60, plural(days, "day")).otherwise(plural(months, "month"))


def compact_tokens(n: Column) -> Column:
    """1.2M / 35k / 999."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6))
        .when(n >= 1_000, F.concat(F.bround(n / 1e3, 0).cast("bigint").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def compact_chars(n: Column) -> Column:
    """1.23M / 35.1k / 999, halves up."""

    def fixed(unit: int, places: int, suffix: str) -> Column:
        step = unit // 10**places
        rounded = F.floor((n + step // 2) / step)
        whole = F.floor(rounded / 10**places).cast("string")
        rest = F.lpad((rounded % 10**places).cast("string"), places, "0")
        return F.concat(whole, F.lit("."), rest, F.lit(suffix))

    return (
        F.when(n >= 1_000_000, fixed(1_000_000, 2, "M"))
        .when(n >= 1_000, fixed(1_000, 1, "k"))
        .otherwise(n.cast("string"))
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up, 0 when there is nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(F.lit(0)).cast("bigint")


def pretty_model(model: Column) -> Column:
    bare = F.regexp_replace(model, r"^[a-z]+/", "")
    return F.regexp_replace(bare, r"(?i)-(versatile|instant)$", "")


def display_name(first: Column, last: Column, username: Column, user_id: Column) -> Column:
    full = F.concat_ws(
        " ", F.when(first != "", first), F.when(last != "", last)
    )
    return (
        F.when(full != "", full)
        .when(F.coalesce(username, F.lit("")) != "", F.concat(F.lit("@"), username))
        .otherwise(F.concat(F.lit("user "), user_id.cast("string")))
    )


def source_label(m: dict[str, Column]) -> Column:
    """Header of a retrieved chunk.  Keys: source_type, topic, sender, date,
    pdf_file, chunk_index, site, title, url."""
    day = _blank(F.substring(m["date"], 1, 10), "?")
    title = F.when(F.coalesce(m["title"], F.lit("")) == "", _blank(m["url"], "?")).otherwise(m["title"])
    index = F.coalesce(m["chunk_index"].cast("string"), F.lit("?"))
    return (
        F.when(
            m["source_type"] == "chat",
            F.concat(F.lit("chat msg | topic: "), _blank(m["topic"], "no topic"),
                     F.lit(" | sender: "), _blank(m["sender"], "unknown"),
                     F.lit(" | posted: "), day),
        )
        .when(
            m["source_type"] == "pdf",
            F.concat(F.lit("PDF: "), _blank(m["pdf_file"], "?"), F.lit(" | chunk #"), index),
        )
        .when(
            m["source_type"] == "external",
            F.concat(F.lit("web page | site: "), _blank(m["site"], "?"), F.lit(" | title: "),
                     title, F.lit(" | last modified: "), day),
        )
        .otherwise(F.lit("unknown source"))
    )


def source_chip(m: dict[str, Column], own_id: Column) -> Column:
    """Short form of the label used in the read-only views."""
    day = _blank(F.substring(m["date"], 1, 10), "?")
    title = F.when(F.coalesce(m["title"], F.lit("")) == "", _blank(m["url"], "?")).otherwise(m["title"])
    number = F.when(
        m["chunk_index"].isNotNull(), F.concat(F.lit(" · #"), m["chunk_index"].cast("string"))
    ).otherwise("")
    return (
        F.when(m["source_type"] == "chat",
               F.concat_ws(" · ", F.lit("chat"), _blank(m["topic"], "no topic"),
                           _blank(m["sender"], "unknown"), day))
        .when(m["source_type"] == "pdf",
              F.concat(F.lit("PDF · "), _blank(m["pdf_file"], "?"), number))
        .when(m["source_type"] == "external",
              F.concat_ws(" · ", F.lit("web"), _blank(m["site"], "?"), title))
        .otherwise(own_id)
    )


def hit_location(m: dict[str, Column]) -> Column:
    """Location of a hit as the search tool prints it."""
    title = F.when(F.coalesce(m["title"], F.lit("")) == "", F.coalesce(m["url"], F.lit(""))).otherwise(m["title"])
    return (
        F.when(m["source_type"] == "chat",
               F.concat(F.lit("chat msg "), F.coalesce(m["message_id"].cast("string"), F.lit("None")),
                        F.lit(" | "), _blank(m["topic"], "(no topic)")))
        .when(m["source_type"] == "pdf",
              F.concat(F.lit("PDF "), F.coalesce(m["pdf_file"], F.lit("None")), F.lit(" | chunk "),
                       F.coalesce(m["chunk_index"].cast("string"), F.lit("None"))))
        .when(m["source_type"] == "external",
              F.concat(F.lit("web "), _blank(m["site"], "?"), F.lit(" | "), title))
        .otherwise(F.concat(F.lit("unknown source ("), F.coalesce(m["source_type"], F.lit("None")), F.lit(")")))
    )


def deep_link(base: str, chat_id: int, topic_id: Column, message_id: Column) -> Column:
    root = f"{base}/{chat_id}/"
    return F.when(
        topic_id.isNotNull() & (topic_id != 0),
        F.concat(F.lit(root), topic_id.cast("string"), F.lit("/"), message_id.cast("string")),
    ).otherwise(F.concat(F.lit(root), message_id.cast("string")))


def response_directive(query: Column) -> Column:
    from palaver.functions.lang import lang_script

    return F.concat(F.lit("Respond in "), lang_script(query), F.lit("."))
