"""Queries over messages, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import lang, web
from palaver.operators import activity as act
from palaver.plans import q_corpus as K
from palaver.plans import q_text as Q
from palaver.plans.registry import query

C = F.col
TIER = Q.TIER_SQL.format(n="text_length")
R6 = lambda name: F.round(name, 6).alias(name)


@query("A01_type_counts", "SELECT mtype, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM v_messages) AS DOUBLE), 6) AS share FROM v_messages GROUP BY mtype")
def _(t):
    return act.type_counts(t.messages).select("mtype", "n", R6("share"))


@query("A02_action_counts", "SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unknown') AS action, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return act.value_counts(t.events, F.when(C("event_type") != "view", C("event_type")), "action", default="unknown")


@query("A03_topic_counts", "SELECT topic, count(*) AS messages FROM v_frame GROUP BY topic")
def _(t):
    return act.topic_counts(t.frame)


STATS = """stats AS (SELECT topic, count(*) AS messages, CAST(floor(quantile_cont(text_length, 0.5)) AS BIGINT) AS median_length,
 CAST(sum(text_length) AS BIGINT) AS total_chars, count(*) FILTER (WHERE has_photo) AS photos, count(*) FILTER (WHERE has_file) AS files,
 CAST(sum(link_count) AS BIGINT) AS total_links, round_even(avg(reaction_count), 1) AS avg_reactions,
 CAST(round_even(count(*) FILTER (WHERE has_photo) * 100.0 / count(*), 0) AS BIGINT) AS photo_pct FROM v_frame WHERE topic IS NOT NULL GROUP BY topic)"""


@query("A04_topic_stats", f"WITH {STATS} SELECT * FROM stats")
def _(t):
    return act.topic_stats(t.frame)


@query("A05_thin_rich_topics", "SELECT source, count(*) AS messages, CASE WHEN count(*) < 48 THEN 'thin' ELSE 'rich' END AS kind FROM documents GROUP BY source HAVING count(*) < 48 OR count(*) >= 50")
def _(t):
    return act.thin_or_rich(t.documents, "source", thin=48, rich=50)


# a third of the topics consists of photos
@query("A06_media_heavy_topics", f"WITH mf AS (SELECT * REPLACE (conv_id % 3 = 0 AS has_photo) FROM v_frame), {STATS.replace('v_frame', 'mf')} SELECT topic, messages, photos, photo_pct, median_length FROM stats WHERE photo_pct > 50 OR median_length = 0")
def _(t):
    return act.media_heavy(act.topic_stats(t.frame.withColumn("has_photo", C("conv_id") % 3 == 0)))


@query("A07_monthly_volume", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
 (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders) AS active_months FROM orders GROUP BY 1""")
def _(t):
    return act.monthly_volume(t.orders, "o_orderdate")


@query("A08_activity_heatmap", "SELECT isodow(ts) AS position, dayname(ts) AS weekday, " + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM events GROUP BY 1, 2")
def _(t):
    return act.activity_heatmap(t.events, "ts")


@query("A09_top_senders", "SELECT user_id, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS distinct_senders FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    return act.top_senders(t.events, "user_id")


@query("A10_admin_share", """SELECT count(*) FILTER (WHERE sender = 'assistant') AS admin, count(*) FILTER (WHERE sender <> 'assistant') AS community,
 round(avg(CASE WHEN sender = 'assistant' THEN 1.0 ELSE 0.0 END), 6) AS admin_share, round(avg(CASE WHEN sender <> 'assistant' THEN 1.0 ELSE 0.0 END), 6) AS community_share FROM v_messages""")
def _(t):
    return act.admin_share(t.messages, ["assistant"])


def hist_sql(bins: int, where: str, lo: str) -> str:
    return f"""WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents WHERE {where}), b AS (SELECT {lo} AS lo, max(x) AS hi FROM d)
SELECT CAST(least({bins - 1}, floor((x - lo) / ((hi - lo) / {bins}))) AS BIGINT) AS bin, count(*) AS n FROM d, b GROUP BY 1"""


@query("A11_length_histogram", hist_sql(50, "n_chars > 0", "min(x)"))
def _(t):
    return act.length_histogram(t.documents, "n_chars", 50)


@query("A11b_short_length_histogram", hist_sql(40, "n_chars > 0 AND n_chars <= 200", "min(x)"))
def _(t):
    return act.length_histogram(t.documents, "n_chars", 40, high=200)


@query("A12_language_counts", f"""SELECT detected, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS share
FROM (SELECT {Q.ratio_sql('text', 30, ('ar', 'fr', 'en', 'empty'))} AS detected FROM documents) GROUP BY detected""")
def _(t):
    return act.share(t.documents, [lang.lang_ratio(C("text")).alias("detected")]).select("detected", "n", R6("share"))


STOP = "(" + ", ".join(f"'{w}'" for w in act.STOP_WORDS) + ")"


@query("A13_word_frequency", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-ZÀ-ÿ]{{3,}}')) AS word FROM documents) WHERE word NOT IN {STOP} GROUP BY word ORDER BY n DESC, word LIMIT 30")
def _(t):
    return act.word_frequency(t.documents, "text")


def page_hrefs(t):
    return t.pages.select("page_id", F.concat(F.array("url"), web.hrefs(C("html"))).alias("links"))


HREFS = r"""SELECT page_id, list_concat([url], list_transform(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["'']', 1), lambda h: """ + Q.strip_sql("h") + ")) AS links FROM pages"


@query("A14_link_domains", rf"""SELECT CASE WHEN d = '' THEN link ELSE d END AS domain, count(*) AS n FROM (SELECT link, regexp_extract(link, '^(?:https?://)?(?:www\.)?([^/]+)', 1) AS d
 FROM (SELECT unnest(links) AS link FROM ({HREFS}))) GROUP BY 1 ORDER BY n DESC, domain LIMIT 15""")
def _(t):
    return act.link_domains(page_hrefs(t))


@query("A14b_link_totals", f"SELECT CAST(sum(len(links)) AS BIGINT) AS total_links, count(*) FILTER (WHERE len(links) > 0) AS messages_with_links FROM ({HREFS})")
def _(t):
    return act.link_totals(page_hrefs(t))


@query("A15_file_inventory", "SELECT id, sender, topic, length(text) AS text_length, length(text) > 0 AS has_caption FROM v_frame WHERE has_file")
def _(t):
    return act.file_inventory(t.frame)


@query("A16_photo_captions", "SELECT topic, count(*) AS photos, count(*) FILTER (WHERE length(text) > 0) AS with_caption, count(*) FILTER (WHERE length(text) = 0) AS photo_only FROM v_frame WHERE has_photo GROUP BY topic")
def _(t):
    return act.photo_captions(t.frame)


@query("A17_reaction_describe", """SELECT count(*) FILTER (WHERE reaction_count > 0) AS n, min(reaction_count) FILTER (WHERE reaction_count > 0) AS lo,
 quantile_cont(reaction_count, 0.25) FILTER (WHERE reaction_count > 0) AS q25, quantile_cont(reaction_count, 0.5) FILTER (WHERE reaction_count > 0) AS q50,
 quantile_cont(reaction_count, 0.75) FILTER (WHERE reaction_count > 0) AS q75, max(reaction_count) AS hi,
 round(avg(reaction_count) FILTER (WHERE reaction_count > 0), 6) AS mean, round(stddev_samp(reaction_count) FILTER (WHERE reaction_count > 0), 6) AS std,
 round(count(*) FILTER (WHERE reaction_count > 0) / CAST(count(*) AS DOUBLE), 6) AS reacted_share FROM v_messages""")
def _(t):
    return act.reaction_describe(t.messages)


@query("A18_reactions_per_topic", "SELECT topic, round(avg(reaction_count), 6) AS avg_reactions FROM v_frame WHERE topic IS NOT NULL GROUP BY topic")
def _(t):
    return act.reactions_per_topic(t.frame)


@query("A19_quality_distribution", f"""SELECT quality, count(*) AS n, CASE quality WHEN 'High (>= 200 chars)' THEN 1 WHEN 'Medium (50–200)' THEN 2 WHEN 'Low (< 50 chars)' THEN 3 WHEN 'Media-only' THEN 4 ELSE 5 END AS position,
 CAST(round_even(count(*) * 100.0 / (SELECT count(*) FROM v_frame), 0) AS BIGINT) AS pct FROM (SELECT {TIER} AS quality FROM v_frame) GROUP BY quality""")
def _(t):
    return act.quality_distribution(t.frame)


@query("A20_quality_crosstab", f"""SELECT topic, count(*) FILTER (WHERE q = 'High (>= 200 chars)') AS high, count(*) FILTER (WHERE q = 'Medium (50–200)') AS medium,
 count(*) FILTER (WHERE q = 'Low (< 50 chars)') AS low, count(*) FILTER (WHERE q = 'Media-only') AS media_only, count(*) FILTER (WHERE q = 'Empty') AS empty, count(*) AS total
FROM (SELECT topic, {TIER} AS q FROM v_frame WHERE topic IS NOT NULL) GROUP BY topic""")
def _(t):
    return act.quality_crosstab(t.frame)


PCT = "CAST(round_even({e} * 100.0 / count(*), 0) AS BIGINT)"
READY, NOISE, ASSIGNED = (
    "count(*) FILTER (WHERE q IN ('High (>= 200 chars)', 'Medium (50–200)'))",
    "count(*) FILTER (WHERE q IN ('Low (< 50 chars)', 'Empty'))",
    "count(*) FILTER (WHERE topic IS NOT NULL)",
)


@query("A21_readiness_report", f"""WITH {STATS} SELECT count(*) AS total, {READY} AS ready, {PCT.format(e=READY)} AS ready_pct, {NOISE} AS noise, {PCT.format(e=NOISE)} AS noise_pct,
 count(*) FILTER (WHERE q = 'Media-only') AS media_only, {ASSIGNED} AS assigned, {PCT.format(e=ASSIGNED)} AS assigned_pct,
 count(*) FILTER (WHERE has_photo) AS photos, count(*) FILTER (WHERE has_file) AS files, CAST(sum(text_length) AS BIGINT) AS chars, CAST(sum(text_length) // 5 AS BIGINT) AS words_estimate,
 (SELECT count(*) FROM stats) AS topics, (SELECT count(*) FROM stats WHERE messages >= 10) AS topics_10, (SELECT count(*) FROM stats WHERE messages < 5) AS topics_thin,
 (SELECT count(*) FROM stats WHERE photo_pct > 50) AS photo_heavy FROM (SELECT *, {TIER} AS q FROM v_frame)""")
def _(t):
    return act.readiness_report(t.frame, act.topic_stats(t.frame))


EXTRACTED = r"""SELECT doc_id, lang AS language, n_chars AS chars, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '\n')) + 1 AS pages,
 CASE WHEN source = 'src3' THEN 'unreadable' END AS error FROM documents"""


def extracted(t):
    return t.documents.select(
        "doc_id", C("lang").alias("language"), C("n_chars").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).alias("words"),
        (F.regexp_count("text", F.lit("\n")) + 1).alias("pages"), F.when(C("source") == "src3", F.lit("unreadable")).alias("error"),
    )


@query("A22_extraction_summary", f"""SELECT count(*) FILTER (WHERE error IS NULL) AS ok, count(*) AS total, CAST(sum(pages) FILTER (WHERE error IS NULL) AS BIGINT) AS pages,
 CAST(sum(chars) FILTER (WHERE error IS NULL) AS BIGINT) AS chars, CAST(sum(words) FILTER (WHERE error IS NULL) AS BIGINT) AS words FROM ({EXTRACTED})""")
def _(t):
    return act.extraction_summary(extracted(t))


@query("A22b_chars_by_language", f"""SELECT language, CAST(sum(chars) AS BIGINT) AS chars, CAST(round_even(sum(chars) * 100.0 / (SELECT sum(chars) FROM ({EXTRACTED}) WHERE error IS NULL), 0) AS BIGINT) AS pct
FROM ({EXTRACTED}) WHERE error IS NULL GROUP BY language""")
def _(t):
    return act.chars_by_language(extracted(t))


@query("A23_ocr_by_topic", "SELECT coalesce(topic, '_unassigned') AS topic, CAST(sum(text_length) AS BIGINT) AS chars, count(*) AS photos FROM v_frame WHERE has_photo AND text_length > 20 GROUP BY 1")
def _(t):
    return act.ocr_by_topic(t.frame.where("has_photo").withColumn("char_count", C("text_length")))


@query("A25_site_by_language", "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def _(t):
    return act.docs_and_chars(t.documents, "lang", "n_chars")


@query("A26_chat_section", """SELECT count(*) AS total_messages, count(*) FILTER (WHERE mtype = 'message') AS content_messages, count(*) FILTER (WHERE mtype = 'service') AS service_messages,
 min(ts) FILTER (WHERE mtype = 'message') AS first_message, max(ts) FILTER (WHERE mtype = 'message') AS last_message FROM v_messages""")
def _(t):
    return act.chat_totals(t.messages)


DIRECT = f"""SELECT topic, count(*) AS n, min(id) AS first_seen FROM (SELECT m.id, coalesce(t.title, 'General') AS topic FROM v_messages m LEFT JOIN ({K.TOPICS}) t ON t.id = m.reply_to WHERE m.mtype = 'message')
 GROUP BY topic ORDER BY n DESC, first_seen LIMIT 8"""


@query("A26b_top_topics", DIRECT)
def _(t):
    from palaver.operators.threads import direct_topic

    return act.most_common_k(direct_topic(t.messages, K.topics(t)), "topic", "id", 8)


@query("A27_document_section", """SELECT (SELECT count(*) FROM documents WHERE lang <> 'de') AS files, (SELECT count(*) FROM documents WHERE lang <> 'de' AND n_chars > 0) AS non_empty,
 (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang <> 'de') AS total_chars, (SELECT count(*) FROM documents WHERE lang = 'de') AS ocr_files,
 (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang = 'de') AS ocr_chars""")
def _(t):
    docs = t.documents.select("lang", C("n_chars").alias("chars"))
    return act.document_section(docs.where("lang <> 'de'"), docs.where("lang = 'de'"))


def counts_json(key: str) -> str:
    return f"(SELECT '{{' || string_agg('\"' || {key} || '\":' || n, ',' ORDER BY {key}) || '}}' FROM (SELECT {key}, count(*) AS n FROM documents GROUP BY {key}))"


@query("A28_site_section", f"SELECT count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS total_chars, max(doc_id) AS last_modified, {counts_json('lang')} AS by_language, {counts_json('source')} AS by_kind FROM documents")
def _(t):
    return act.site_section(
        t.documents.select(C("lang").alias("language"), C("source").alias("kind"), C("n_chars").alias("chars"), C("doc_id").alias("modified"))
    )


def fetched(t):
    return t.pages.select(
        web.url_host(C("url")).alias("host"), F.length("html").alias("chars"), C("page_id").alias("fetched_at"), C("page_id").alias("position"),
        F.when(F.length("html") % 3 == 0, "browser").when(F.length("html") % 3 == 1, "plain").alias("backend"),
    )


FETCHED = f"SELECT {Q.host_sql('url')} AS host, length(html) AS chars, page_id AS fetched_at, page_id AS position, CASE length(html) % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'plain' END AS backend FROM pages"


@query("A29_host_rollup", f"""WITH p AS ({FETCHED}), b AS (SELECT host, backend, row_number() OVER (PARTITION BY host ORDER BY n DESC, pos) AS rn FROM (
 SELECT host, backend, count(*) AS n, min(position) AS pos FROM p WHERE backend IS NOT NULL GROUP BY host, backend))
SELECT p.host, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars, max(fetched_at) AS last_fetched, max(b.backend) AS backend FROM p LEFT JOIN b ON b.host = p.host AND b.rn = 1 GROUP BY p.host""")
def _(t):
    return act.host_rollup(fetched(t))


@query("A30_index_section", "SELECT source_type, count(*) AS chunks, count(*) FILTER (WHERE contains(text, ' the ')) AS enriched, count(DISTINCT CASE WHEN source_type = 'external' THEN site END) AS external_sites FROM v_corpus GROUP BY source_type")
def _(t):
    return act.index_section(t.corpus, marker=" the ")


@query("A31_chunk_profile", "SELECT source_type, language, count(*) AS n FROM v_corpus GROUP BY GROUPING SETS ((source_type), (language))")
def _(t):
    return act.chunk_profile(t.corpus)


@query("A52_host_crawl_summary", f"SELECT host, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars FROM ({FETCHED}) GROUP BY ROLLUP (host)")
def _(t):
    return act.host_crawl_summary(fetched(t))


@query("A54_corpus_share", """WITH s AS (SELECT source_type, count(*) AS items, CAST(sum(CASE WHEN source_type = 'chat' THEN 0 ELSE n_chars END) AS BIGINT) AS chars FROM v_corpus GROUP BY source_type)
SELECT *, CAST(floor(chars * 100.0 / (SELECT sum(chars) FROM s) + 0.5) AS BIGINT) AS pct, CAST((SELECT sum(items) FROM s) AS BIGINT) AS total_items FROM s""")
def _(t):
    return act.corpus_share(t.corpus)


@query("A55_relative_bars", """WITH c AS (SELECT site, count(*) AS n FROM v_corpus GROUP BY site)
SELECT site, n, round(n / CAST((SELECT max(n) FROM c) AS DOUBLE), 6) AS relative, CAST(floor(n * 100.0 / (SELECT sum(n) FROM c) + 0.5) AS BIGINT) AS share_pct FROM c ORDER BY n DESC, site LIMIT 8""")
def _(t):
    return act.relative_bars(t.corpus, "site")


@query("A56_length_box_by_topic", """SELECT source, count(*) AS n, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, min(n_chars) AS lo, max(n_chars) AS hi
FROM documents GROUP BY source HAVING count(*) >= 5""")
def _(t):
    return act.length_box_by_topic(t.documents, "source", "n_chars")


@query("T01_top_reacted", "SELECT id, sender, reaction_count, substring(text, 1, 120) || '...' AS preview FROM v_messages ORDER BY reaction_count DESC, id LIMIT 10")
def _(t):
    return act.top_reacted(t.messages)


@query("T04_most_common_k", "SELECT lang, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY lang ORDER BY n DESC, first_seen LIMIT 3")
def _(t):
    return act.most_common_k(t.documents, "lang", "doc_id", 3)


@query("W14_share_of_total", "SELECT source, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS share FROM documents GROUP BY source")
def _(t):
    return act.share(t.documents, ["source"]).select("source", "n", R6("share"))


@query("J21_dimension_lookup", "SELECT n.n_nationkey, n.n_name, r.r_name, r.r_regionkey IS NULL AS unknown FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') r ON r.r_regionkey = n.n_regionkey")
def _(t):
    regions = F.broadcast(t.region.where("r_name <> 'ASIA'"))  # a fixed dimension
    return t.nation.join(regions, C("n_regionkey") == C("r_regionkey"), "left").select(
        "n_nationkey", "n_name", "r_name", C("r_regionkey").isNull().alias("unknown")
    )
