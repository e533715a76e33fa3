"""Row predicates, counts and profiles over messages, turns, votes and logs.

All group sizes are unbounded in principle, so every aggregate here combines
map side; exact medians and quartiles go through ``order_stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import display, lang, web
from palaver.functions.text import strip
from palaver.plans.scale import order_stats, position_cont, scalar, spread

C = F.col


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


# --- predicates ------------------------------------------------------------------


def is_content() -> Column:
    return C("mtype") == "message"


def is_admin(names: Sequence[str]) -> Column:
    return C("sender").isin(*names)


def metadata_filter(**fields) -> Column:
    """All given fields equal; a missing field never matches."""
    cond = F.lit(True)
    for name, value in fields.items():
        if value is not None:
            cond = cond & F.coalesce(C(name) == value, F.lit(False))
    return cond


def photo_only(messages: DataFrame) -> DataFrame:
    """Content rows with a photo and a blank caption."""
    return messages.where(is_content() & C("has_photo") & (strip(F.coalesce("text", F.lit(""))) == ""))


def null_to_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(C(c), F.lit("")) for c in cols})


def addressed(inbox: DataFrame, messages: DataFrame, *, bot_name: str, bot_sender: str) -> DataFrame:
    """Messages meant for the bot.

    Direct chats always are; in groups the bot must be named (the name is then
    removed) or the message must reply to the bot.  Commands and blank texts
    are dropped.
    """
    mention = f"@{bot_name}"
    parents = messages.where(C("sender") == bot_sender).select(C("id").alias("reply_to"), F.lit(True).alias("_reply"))
    stripped = strip(C("text"))
    named = F.contains(stripped, F.lit(mention))
    rest = F.when(C("direct"), stripped).otherwise(strip(F.replace(stripped, F.lit(mention), F.lit(""))))
    return (
        inbox.where(~F.startswith(C("text"), F.lit("/")) & (stripped != ""))
        .join(parents, "reply_to", "left")
        .where(C("direct") | named | F.coalesce("_reply", F.lit(False)))
        .withColumn("text", rest)
        .where(C("text") != "")
        .drop("_reply")
    )


# fixed values: the commands with and without an argument
ARGUMENT_COMMANDS = ("ask", "deep")
BARE_COMMANDS = ("start", "help", "me", "reset")


def parse_commands(messages: DataFrame) -> DataFrame:
    """Rows that are a command, with its name and argument ('' if it takes none)."""
    at = r"(?:@[\p{L}\p{N}_]+)?"
    with_arg = rf"(?s)^/({'|'.join(ARGUMENT_COMMANDS)}){at}\s+(.+)$"
    bare = rf"^/({'|'.join(BARE_COMMANDS)}){at}$"
    name = F.regexp_extract("text", with_arg, 1)
    return (
        messages.withColumn("command", F.when(name != "", name).otherwise(F.regexp_extract("text", bare, 1)))
        .withColumn("argument", strip(F.regexp_extract("text", with_arg, 2)))
        .where(C("command") != "")
    )


# fixed values: levels kept and loggers whose warnings are known noise
KEPT_LEVELS = ("WARNING", "ERROR", "CRITICAL")
NOISY_LOGGERS = ("huggingface_hub", "urllib3", "httpx", "httpcore", "filelock")


def log_keep(ignore: Sequence[str] = NOISY_LOGGERS) -> Column:
    """Warnings and worse, unless the logger is, or is below, an ignored one."""
    name = F.coalesce(C("logger"), F.lit(""))
    noisy = F.lit(False)
    for prefix in ignore:
        noisy = noisy | (name == prefix) | F.startswith(name, F.lit(prefix + "."))
    return C("level").isin(*KEPT_LEVELS) & ~noisy


def rating_allowed(domain: Sequence[str] = ("useful", "not_useful", "report")) -> Column:
    return F.coalesce(C("rating").isin(*domain), F.lit(False))


def visible_turn() -> Column:
    """Neither cleared by a reset nor refused."""
    return C("cleared_at").isNull() & ~F.coalesce(C("refused"), F.lit(False))


def non_bot_users(users: DataFrame) -> DataFrame:
    return users.where(~F.coalesce("is_bot", F.lit(False)))


def users_by_activity(users: DataFrame) -> DataFrame:
    return users.orderBy(C("query_count").desc(), C("last_active_at").desc(), "user_id")


def default_user(users: DataFrame) -> DataFrame:
    return users_by_activity(non_bot_users(users)).limit(1)


# --- message profile ---------------------------------------------------------------


def share(df: DataFrame, by: Sequence[Column | str], total_name: str = "n") -> DataFrame:
    """Counts per group with their share of all rows; the window runs over the
    groups, not over the rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias(total_name))
    whole = scalar(counts, F.sum(total_name))
    return counts.withColumn("share", C(total_name) / whole)


def type_counts(messages: DataFrame) -> DataFrame:
    return share(messages, ["mtype"])


def value_counts(df: DataFrame, key: Column, name: str, default: str | None = None) -> DataFrame:
    """Counts per value, most common first; NULL stands as ``default``."""
    k = key if default is None else F.coalesce(key, F.lit(default))
    return df.groupBy(k.alias(name)).agg(F.count("*").alias("n")).orderBy(C("n").desc(), name)


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages per topic; the NULL topic row counts the unassigned ones."""
    return messages.groupBy("topic").agg(F.count("*").alias("messages"))


def topic_stats(messages: DataFrame) -> DataFrame:
    """Per topic: size, median length, media, links, reactions.

    Input: topic, text_length, has_photo, has_file, link_count, reaction_count.
    """
    assigned = messages.where(C("topic").isNotNull())
    sums = assigned.groupBy("topic").agg(
        F.count("*").alias("messages"),
        F.sum("text_length").alias("total_chars"),
        count_if(C("has_photo")).alias("photos"),
        count_if(C("has_file")).alias("files"),
        F.sum("link_count").alias("total_links"),
        F.bround(F.avg("reaction_count"), 1).alias("avg_reactions"),
    )
    medians = order_stats(assigned, "text_length", ["topic"], {"median": position_cont(0.5)})
    return (
        sums.join(medians.select("topic", C("median").cast("bigint").alias("median_length")), "topic")
        .withColumn("photo_pct", F.bround(C("photos") * 100.0 / C("messages"), 0).cast("bigint"))
    )


def thin_or_rich(df: DataFrame, key: str, thin: int = 5, rich: int = 20) -> DataFrame:
    """Groups below ``thin`` or at least ``rich`` rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("messages"))
    return counts.where((C("messages") < thin) | (C("messages") >= rich)).withColumn(
        "kind", F.when(C("messages") < thin, "thin").otherwise("rich")
    )


def media_heavy(stats: DataFrame) -> DataFrame:
    """Topics that are mostly photos or have no text at the median."""
    return stats.where((C("photo_pct") > 50) | (C("median_length") == 0)).select(
        "topic", "messages", "photos", "photo_pct", "median_length"
    )


def monthly_volume(df: DataFrame, ts: str) -> DataFrame:
    """Rows per month with first and last day; active months over all."""
    months = df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.to_date(F.min(ts)).alias("first_day"), F.to_date(F.max(ts)).alias("last_day")
    )
    return months.withColumn("active_months", scalar(months, F.count("*")))


# fixed values: calendar week
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def activity_heatmap(df: DataFrame, ts: str) -> DataFrame:
    """Weekday by hour counts, Monday first; a weekday without rows stays NULL."""
    spark = df.sparkSession
    week = spark.createDataFrame(list(enumerate(WEEKDAYS, 1)), "position int, weekday string")
    counts = (
        df.groupBy(F.date_format(ts, "EEEE").alias("weekday"))
        .agg(*[count_if(F.hour(ts) == h).alias(f"h{h:02d}") for h in range(24)])
    )
    return F.broadcast(week).join(counts, "weekday", "left")


def top_senders(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(C("n").desc(), key).limit(k)
    return top.withColumn("distinct_senders", scalar(counts, F.count("*")))


def admin_share(messages: DataFrame, names: Sequence[str]) -> DataFrame:
    flag = is_admin(names)
    return messages.agg(
        count_if(flag).alias("admin"),
        count_if(~flag).alias("community"),
        F.round(F.avg(flag.cast("double")), 6).alias("admin_share"),
        F.round(F.avg((~flag).cast("double")), 6).alias("community_share"),
    )


def length_histogram(df: DataFrame, length: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins over the non-empty lengths; the last bin is closed.

    The range comes from the data unless given; rows outside it are dropped.
    """
    rows = df.where(C(length) > 0)
    if high is not None:
        rows = rows.where(C(length) <= high)
    bounds = rows.agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    lo = F.lit(float(low)) if low is not None else bounds.select("lo").scalar().cast("double")
    hi = bounds.select("hi").scalar().cast("double")
    width = (C("_hi") - C("_lo")) / bins
    bin_ = F.when(C("_hi") == C("_lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((C(length) - C("_lo")) / width))
    )
    return (
        rows.select(length, lo.alias("_lo"), hi.alias("_hi"))
        .groupBy(bin_.cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


# fixed values: words left out of the frequency table
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may "
    "might shall can to of in for on with at by from as into through during before after above "
    "below between out off over under again further then once and but or nor not so than too very "
    "just about up it its this that these those i me my we our you your he him his she her they "
    "them their what which who whom how when where why all each every both few more most other "
    "some such no only own same if also "
    "le la les de des du un une et est en que qui dans pour par sur au aux avec ce se ne pas son "
    "sa ses il elle nous vous ils elles ou mais"
).split()


def word_frequency(df: DataFrame, text: str, k: int = 30) -> DataFrame:
    """Most common words of three or more Latin letters, stop words removed.

    Stop words drop out before the count, so the commonest keys never shuffle;
    the rest is counted map side first.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-ZÀ-ÿ]{3,})"), F.lit(1))
    return (
        spread(df.select(text)).select(F.explode_outer(found).alias("word"))
        .where(C("word").isNotNull() & ~C("word").isin(STOP_WORDS))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(C("n").desc(), "word")
        .limit(k)
    )


def link_domains(links: DataFrame, k: int = 15) -> DataFrame:
    """Top domains.  ``links`` has one row per (id, array of links)."""
    return (
        links.select(F.explode("links").alias("link"))
        .groupBy(web.link_domain(C("link")).alias("domain"))
        .agg(F.count("*").alias("n"))
        .orderBy(C("n").desc(), "domain")
        .limit(k)
    )


def link_totals(links: DataFrame) -> DataFrame:
    return links.agg(
        F.sum(F.size("links")).cast("bigint").alias("total_links"),
        count_if(F.size("links") > 0).alias("messages_with_links"),
    )


def file_inventory(messages: DataFrame) -> DataFrame:
    return messages.where("has_file").select(
        "id", "sender", "topic", F.length("text").alias("text_length"), (F.length("text") > 0).alias("has_caption")
    )


def photo_captions(messages: DataFrame) -> DataFrame:
    """Photos per topic, with and without a caption."""
    captioned = F.length("text") > 0
    return messages.where("has_photo").groupBy("topic").agg(
        F.count("*").alias("photos"), count_if(captioned).alias("with_caption"), count_if(~captioned).alias("photo_only")
    )


def reaction_describe(messages: DataFrame) -> DataFrame:
    """Spread of the reaction counts above zero, and the share of reacted rows."""
    stats = order_stats(
        messages.where("reaction_count > 0"),
        "reaction_count",
        [],
        {"q25": position_cont(0.25), "q50": position_cont(0.5), "q75": position_cont(0.75)},
        lo=F.min("reaction_count"),
        hi=F.max("reaction_count"),
    )
    reacted = F.when(C("reaction_count") > 0, C("reaction_count"))
    one = messages.agg(
        F.round(F.avg(reacted), 6).alias("mean"),
        F.round(F.stddev_samp(reacted), 6).alias("std"),
        F.round(count_if(C("reaction_count") > 0) / F.count("*"), 6).alias("reacted_share"),
    )
    cols = ["mean", "std", "reacted_share"]
    return stats.select("n", "lo", "q25", "q50", "q75", "hi", *[one.select(c).scalar().alias(c) for c in cols])


def reactions_per_topic(messages: DataFrame) -> DataFrame:
    return (
        messages.where(C("topic").isNotNull())
        .groupBy("topic")
        .agg(F.round(F.avg("reaction_count"), 6).alias("avg_reactions"))
        .orderBy("avg_reactions", "topic")
    )


def quality_distribution(messages: DataFrame) -> DataFrame:
    """Messages per tier in the fixed order; tiers without rows are absent."""
    tier = display.quality_tier(C("text_length"), C("has_photo"), C("has_file"))
    counts = messages.groupBy(tier.alias("quality")).agg(F.count("*").alias("n"))
    whole = scalar(counts, F.sum("n"))
    order = F.array_position(F.array(*[F.lit(x) for x in display.TIER_ORDER]), C("quality"))
    return counts.select(
        "quality", "n", order.alias("position"), F.bround(C("n") * 100.0 / whole, 0).cast("bigint").alias("pct")
    )


def quality_crosstab(messages: DataFrame) -> DataFrame:
    """Topic by tier counts with the row total."""
    tier = display.quality_tier(C("text_length"), C("has_photo"), C("has_file"))
    names = ["high", "medium", "low", "media_only", "empty"]
    return (
        messages.where(C("topic").isNotNull())
        .withColumn("_tier", tier)
        .groupBy("topic")
        .agg(
            *[count_if(C("_tier") == v).alias(n) for n, v in zip(names, display.TIER_ORDER)],
            F.count("*").alias("total"),
        )
    )


def readiness_report(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of totals and whole-number shares.  ``stats`` = ``topic_stats``."""
    tier = display.quality_tier(C("text_length"), C("has_photo"), C("has_file"))
    high, medium, low, media, empty = [count_if(C("_tier") == v) for v in display.TIER_ORDER]
    total = F.count("*")

    def pct(part: Column) -> Column:
        return F.bround(part * 100.0 / total, 0).cast("bigint")

    sizes = stats.agg(
        F.count("*").alias("topics"),
        count_if(C("messages") >= 10).alias("topics_10"),
        count_if(C("messages") < 5).alias("topics_thin"),
        count_if(C("photo_pct") > 50).alias("photo_heavy"),
    )
    row = messages.withColumn("_tier", tier).agg(
        total.alias("total"),
        (high + medium).alias("ready"),
        pct(high + medium).alias("ready_pct"),
        (low + empty).alias("noise"),
        pct(low + empty).alias("noise_pct"),
        media.alias("media_only"),
        count_if(C("topic").isNotNull()).alias("assigned"),
        pct(count_if(C("topic").isNotNull())).alias("assigned_pct"),
        count_if(C("has_photo")).alias("photos"),
        count_if(C("has_file")).alias("files"),
        F.sum("text_length").alias("chars"),
        F.floor(F.sum("text_length") / 5).alias("words_estimate"),
    )
    return row.select("*", *[sizes.select(c).scalar().alias(c) for c in sizes.columns])


def length_box_by_topic(df: DataFrame, topic: str, length: str, at_least: int = 5) -> DataFrame:
    """Five-number spread per topic with enough rows, longest median first."""
    stats = order_stats(
        df.where(C(topic).isNotNull()),
        length,
        [topic],
        {"q25": position_cont(0.25), "q50": position_cont(0.5), "q75": position_cont(0.75)},
        lo=F.min(length),
        hi=F.max(length),
    )
    return stats.where(C("n") >= at_least).orderBy(C("q50").desc(), topic)


def top_reacted(messages: DataFrame, k: int = 10) -> DataFrame:
    return (
        messages.orderBy(C("reaction_count").desc(), "id")
        .limit(k)
        .select("id", "sender", "reaction_count", F.concat(F.substring("text", 1, 120), F.lit("...")).alias("preview"))
    )


def most_common_k(df: DataFrame, key: str, position: str, k: int) -> DataFrame:
    """Most frequent values; ties go to the value seen first."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
        .orderBy(C("n").desc(), "first_seen")
        .limit(k)
    )


# --- sections of the status snapshot ------------------------------------------------


def chat_totals(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count("*").alias("total_messages"),
        count_if(C("mtype") == "message").alias("content_messages"),
        count_if(C("mtype") == "service").alias("service_messages"),
        F.min(F.when(is_content(), C("ts"))).alias("first_message"),
        F.max(F.when(is_content(), C("ts"))).alias("last_message"),
    )


def extraction_summary(docs: DataFrame) -> DataFrame:
    """Totals over documents (chars, words, pages, error) that parsed."""
    ok = C("error").isNull()
    return docs.agg(
        count_if(ok).alias("ok"),
        F.count("*").alias("total"),
        F.sum(F.when(ok, C("pages"))).alias("pages"),
        F.sum(F.when(ok, C("chars"))).alias("chars"),
        F.sum(F.when(ok, C("words"))).alias("words"),
    )


def chars_by_language(docs: DataFrame) -> DataFrame:
    sums = docs.where(C("error").isNull()).groupBy("language").agg(F.sum("chars").alias("chars"))
    whole = scalar(sums, F.sum("chars"))
    return sums.withColumn("pct", F.bround(C("chars") * 100.0 / whole, 0).cast("bigint"))


def ocr_by_topic(rows: DataFrame) -> DataFrame:
    """Recovered characters per topic for rows above 20 characters."""
    return (
        rows.where("char_count > 20")
        .groupBy(F.coalesce(F.when(C("topic") != "", C("topic")), F.lit("_unassigned")).alias("topic"))
        .agg(F.sum("char_count").alias("chars"), F.count("*").alias("photos"))
    )


def merge_audit(merged: DataFrame) -> DataFrame:
    """Counts over the result of ``corpus.ocr_merge``."""
    before = strip(F.coalesce("original_text", F.lit(""))) != ""
    after = strip(F.coalesce("text", F.lit(""))) != ""
    return merged.agg(
        count_if(C("text_source") == "ocr").alias("merged"),
        count_if(C("text_source") == "ocr_failed").alias("failed"),
        count_if(C("text_source") == "original").alias("untouched"),
        count_if(before).alias("texts_before"),
        count_if(after).alias("texts_after"),
        (count_if(after) - count_if(before)).alias("net_gain"),
    )


def docs_and_chars(docs: DataFrame, key: str, chars: str) -> DataFrame:
    return docs.groupBy(key).agg(F.count("*").alias("docs"), F.sum(chars).alias("chars"))


def document_section(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """File and character totals of both text families.  Inputs: (chars)."""
    n = native.agg(
        F.count("*").alias("files"), count_if(C("chars") > 0).alias("non_empty"), F.sum("chars").alias("total_chars")
    )
    o = ocr.agg(F.count("*").alias("ocr_files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("ocr_chars"))
    return n.select("*", *[o.select(c).scalar().alias(c) for c in o.columns])


def site_section(pages: DataFrame) -> DataFrame:
    """Totals, counts by language and kind as JSON, latest change.

    Input: language, kind, chars, modified.
    """

    def counted(key: str) -> Column:
        counts = pages.groupBy(key).agg(F.count("*").alias("n"))
        entries = F.array_sort(F.collect_list(F.struct(C(key), C("n"))))
        return counts.agg(F.to_json(F.map_from_entries(entries)).alias("m")).scalar()

    return pages.agg(
        F.count("*").alias("pages"), F.sum("chars").alias("total_chars"), F.max("modified").alias("last_modified")
    ).select("*", counted("language").alias("by_language"), counted("kind").alias("by_kind"))


def host_rollup(pages: DataFrame) -> DataFrame:
    """Per host: pages, chars, latest fetch, commonest backend (first seen wins).

    Input: host, chars, fetched_at, backend, position.  The backend count is
    taken per (host, backend) first, so a hot host never gathers its pages.
    """
    per = pages.groupBy("host", "backend").agg(
        F.count("*").alias("n"),
        F.sum("chars").alias("chars"),
        F.max("fetched_at").alias("fetched"),
        F.min("position").alias("first_pos"),
    )
    rank = F.when(C("backend").isNotNull(), F.struct(C("n"), -C("first_pos")))
    return per.groupBy("host").agg(
        F.sum("n").alias("pages"),
        F.sum("chars").alias("chars"),
        F.max("fetched").alias("last_fetched"),
        F.max_by("backend", rank).alias("backend"),
    ).orderBy(C("chars").desc(), "host")


def index_section(chunks: DataFrame, marker: str = "— Linked page:") -> DataFrame:
    """Chunks per source type and the number that carry a linked page."""
    return chunks.groupBy("source_type").agg(
        F.count("*").alias("chunks"),
        count_if(F.contains("text", F.lit(marker))).alias("enriched"),
        F.count_distinct(F.when(C("source_type") == "external", C("site"))).alias("external_sites"),
    )


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """Counts by source type and, separately, by language: one pass."""
    return (
        chunks.groupingSets([[C("source_type")], [C("language")]], C("source_type"), C("language"))
        .agg(F.count("*").alias("n"))
        .select("source_type", "language", "n")
    )


def host_crawl_summary(pages: DataFrame) -> DataFrame:
    """Pages and chars per host and a total row (host NULL)."""
    return pages.rollup("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


def corpus_share(chunks: DataFrame) -> DataFrame:
    """Items and chars per source family and the share of all chars; chat
    counts as 0 chars."""
    chars = F.when(C("source_type") == "chat", F.lit(0)).otherwise(C("n_chars"))
    sums = chunks.groupBy("source_type").agg(F.count("*").alias("items"), F.sum(chars).alias("chars"))
    whole, items = scalar(sums, F.sum("chars")), scalar(sums, F.sum("items"))
    return sums.select("*", display.percent(C("chars"), whole).alias("pct"), items.alias("total_items"))


def relative_bars(df: DataFrame, key: str, k: int = 8) -> DataFrame:
    """Top ``k`` groups, their length relative to the largest and their share."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(C("n").desc(), key).limit(k)
    largest, whole = scalar(counts, F.max("n")), scalar(counts, F.sum("n"))
    return top.select(
        key, "n", F.round(C("n") / largest, 6).alias("relative"), display.percent(C("n"), whole).alias("share_pct")
    )


# --- dashboards -----------------------------------------------------------------------


def rating_counts() -> list[Column]:
    return [count_if(C("rating") == r).alias(r) for r in ("useful", "not_useful", "report")]


def kpi_scalars(users: DataFrame, turns: DataFrame, now: Column) -> DataFrame:
    u = users.agg(
        F.count("*").alias("total_users"),
        count_if(C("last_active_at") > now - F.expr("INTERVAL 7 DAYS")).alias("active_7d"),
    )
    t = turns.agg(F.count("*").alias("total_messages"), count_if(C("role") == "user").alias("total_queries"))
    return u.select("*", *[t.select(c).scalar().alias(c) for c in t.columns])


def feedback_totals(feedback: DataFrame) -> DataFrame:
    row = feedback.agg(
        F.count("*").alias("total_rated"),
        *rating_counts(),
        count_if((C("rating") == "report") & C("reason").isNotNull()).alias("reports_with_reason"),
    )
    return row.withColumn("useful_pct", display.percent(C("useful"), C("total_rated")))


def queries_per_day(turns: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return (
        turns.where((C("role") == "user") & (C("ts") > now - F.expr(f"INTERVAL {int(days)} DAYS")))
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("n"))
    )


def health_summary(turns: DataFrame, oplog: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Errors, warnings, answers and latency of the last ``hours``."""
    since = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    logs = oplog.where(C("ts") > since).agg(
        count_if(C("level").isin("ERROR", "CRITICAL")).alias("errors"),
        count_if(C("level") == "WARNING").alias("warnings"),
    )
    answers = turns.where((C("role") == "assistant") & (C("ts") > since))
    sums = answers.agg(
        F.count("*").alias("answers"),
        F.max("latency_ms").alias("max_ms"),
        F.round(F.avg(F.when(C("model_used").isNotNull(), F.startswith("model_used", F.lit("gemini")).cast("double"))), 6).alias("primary_share"),
    )
    mids = order_stats(answers, "latency_ms", [], {"p50": position_cont(0.5), "p95": position_cont(0.95)})
    half_up = {f"{p}_ms": F.floor(mids.select(p).scalar() + 0.5) for p in ("p50", "p95")}
    return logs.select(
        "*",
        *[sums.select(c).scalar().alias(c) for c in sums.columns],
        *[c.alias(n) for n, c in half_up.items()],
    )


def user_stats(turns: DataFrame, now: Column) -> DataFrame:
    """Per user: counts over turns that were not refused.

    ``turns`` has ``sources``: array of structs with ``metadata.source_type``.
    """
    kept = ~F.coalesce(C("refused"), F.lit(False))
    asked = kept & (C("role") == "user")
    hour = F.hour("ts")
    backed = F.exists(C("sources"), lambda s: s["metadata"]["source_type"] == "pdf")
    return turns.groupBy("user_id").agg(
        count_if(asked).alias("total_q"),
        count_if(asked & (C("ts") >= now - F.expr("INTERVAL 7 DAYS"))).alias("week_q"),
        count_if(asked & C("rerank")).alias("deep_q"),
        count_if(asked & hour.between(0, 4)).alias("night_q"),
        count_if(asked & hour.between(5, 7)).alias("morn_q"),
        count_if(kept & (C("role") == "assistant") & F.coalesce(backed, F.lit(False))).alias("pdf_cited"),
        lang.lang_set(F.when(asked, C("content"))).alias("languages"),
    )


def helpful_votes(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("user_id").agg(count_if(C("rating") == "useful").alias("helpful_votes"))


def top_topics_per_user(turns: DataFrame, k: int = 3) -> DataFrame:
    """Most cited topics per user.  ``turns.sources`` is an array of structs.

    Counted per (user, topic) before ranking; the rank keeps k rows per user
    and is pruned before the shuffle.
    """
    counts = (
        turns.where(C("role") == "assistant")
        .select("user_id", F.explode("sources").alias("s"))
        .select("user_id", C("s.metadata.topic").alias("topic"))
        .where(F.coalesce(C("topic"), F.lit("")) != "")
        .groupBy("user_id", "topic")
        .agg(F.count("*").alias("n"))
    )
    w = W.partitionBy("user_id").orderBy(C("n").desc(), "topic")
    return counts.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


def feedback_per_turn(turns: DataFrame, feedback: DataFrame, user_id: int, limit: int = 100) -> DataFrame:
    """Newest turns of one user with their votes counted."""
    newest = turns.where(C("user_id") == user_id).orderBy(C("turn_idx").desc(), C("id").desc()).limit(limit)
    votes = (
        feedback.join(
            F.broadcast(newest.select("chat_id", C("tg_message_id").alias("message_id"))), ["chat_id", "message_id"], "left_semi"
        )
        .groupBy("chat_id", "message_id")
        .agg(*rating_counts())
        .select(C("chat_id"), C("message_id").alias("tg_message_id"), "useful", "not_useful", "report")
    )
    joined = newest.join(votes, ["chat_id", "tg_message_id"], "left").na.fill(0, ["useful", "not_useful", "report"])
    return joined.withColumn("feedback", F.to_json(F.struct("useful", "not_useful", "report"))).orderBy("chat_id", "turn_idx")


def recent_reports(feedback: DataFrame, turns: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Newest reports with the answer and the user; cut to k before joining."""
    newest = feedback.where(C("rating") == "report").orderBy(C("created_at").desc(), C("id").desc()).limit(k)
    answers = turns.where(C("tg_message_id").isNotNull()).select(
        "chat_id", C("tg_message_id").alias("message_id"), C("content").alias("assistant_content")
    )
    small = F.broadcast(newest)
    with_answer = small.join(
        answers.join(small.select("chat_id", "message_id").distinct(), ["chat_id", "message_id"], "left_semi"),
        ["chat_id", "message_id"], "left",
    )
    names = users.join(small.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "first_name")
    return with_answer.join(names, "user_id", "left").select(
        C("id").alias("feedback_id"), "chat_id", "message_id", "user_id", "reason", "created_at", "assistant_content", "first_name"
    )


def most_disliked(turns: DataFrame, feedback: DataFrame, k: int = 5) -> DataFrame:
    """Answers with the most not-useful votes; newest first on ties.

    Votes are counted per message before the join, so a message that drew a
    third of all votes is one row when it meets its turn.
    """
    votes = (
        feedback.where(C("rating") == "not_useful")
        .groupBy("chat_id", "message_id")
        .agg(F.count("*").alias("not_useful"))
    )
    answers = turns.where(C("role") == "assistant").select(
        "id", "chat_id", C("tg_message_id").alias("message_id"), "content", "ts", "user_id"
    )
    return (
        answers.join(votes, ["chat_id", "message_id"])
        .orderBy(C("not_useful").desc(), C("ts").desc(), "id")
        .limit(k)
        .select("id", "content", "not_useful", "ts", "user_id")
    )


def recent_events(oplog: DataFrame, limit: int = 100, level: str | None = None) -> DataFrame:
    rows = oplog if level is None else oplog.where(C("level") == level)
    return rows.orderBy(C("ts").desc(), C("id").desc()).limit(limit)


def one_by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(C(key) == value)
