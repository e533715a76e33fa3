"""Queries over scalar functions (F) and row predicates (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import citations as cite
from palaver.functions import display, lang, text, vectors, web
from palaver.operators import activity
from palaver.plans.registry import query
from palaver.plans.scale import order_stats, position_cont, position_exclusive, position_floor, position_round
from palaver.plans.tables import VIEWS
from palaver.sources import chat

C = F.col

RATIO = "(" + ", ".join(f"'{w}'" for w in lang.FRENCH_RATIO_WORDS) + ")"
PRESENCE = "(" + ", ".join(f"'{w}'" for w in lang.FRENCH_PRESENCE_WORDS) + ")"
AR = r"[\x{0600}-\x{06FF}]"
AR_WIDE = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"


def ratio_sql(col: str, arabic: int, labels) -> str:
    ar, fr, en, none = labels
    head = f"coalesce({col}, '')"
    toks = f"regexp_extract_all(lower({head}), '[a-zA-ZÀ-ÿ]+')"
    n_ar = f"len(regexp_extract_all({head}, '{AR}'))"
    wordless = f"CASE WHEN {n_ar} > 0 THEN '{ar}' ELSE '{none}' END" if none == "empty" else f"'{none}'"
    return f"""CASE WHEN {strip_sql(head)} = '' THEN 'empty' WHEN {n_ar} > {arabic} THEN '{ar}'
 WHEN len({toks}) = 0 THEN {wordless}
 WHEN CAST(len(list_filter({toks}, lambda w: w IN {RATIO})) AS DOUBLE) / len({toks}) > 0.05 THEN '{fr}'
 ELSE '{en}' END"""


PRESENCE_SQL = f"""CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN regexp_matches(text, '{AR}') THEN 'Arabic'
 WHEN len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w IN {PRESENCE}))) >= 2
 THEN 'French' ELSE 'English' END"""


@query("F01_flatten_text", "SELECT conv_id * 10000 + turn AS id, text FROM conversations")
def _(t):
    half = F.floor(F.length("text") / 2).cast("int")

    def quoted(c):
        js = F.to_json(F.array(c))
        return js.substr(F.lit(2), F.length(js) - 2)

    span = F.to_json(F.struct(F.lit("bold").alias("type"), C("text").substr(half + 1, F.length("text")).alias("text")))
    raw = F.when(C("turn") % 2 == 0, quoted(C("text"))).otherwise(
        F.concat(F.lit("["), quoted(C("text").substr(F.lit(1), half)), F.lit(","), span, F.lit("]"))
    )
    return t.conversations.select(
        (C("conv_id") * 10000 + C("turn")).alias("id"),
        chat.flatten_text(F.parse_json(raw)).alias("text"),
    )


@query("F02_lang_presence", f"SELECT doc_id, {PRESENCE_SQL} AS detected FROM documents")
def _(t):
    return t.documents.select("doc_id", lang.lang_presence(C("text")).alias("detected"))


@query("F03_lang_ratio", f"SELECT doc_id, {ratio_sql('text', 30, ('ar', 'fr', 'en', 'empty'))} AS detected FROM documents")
def _(t):
    return t.documents.select("doc_id", lang.lang_ratio(C("text")).alias("detected"))


@query("F04_lang_ratio_document", f"SELECT doc_id, {ratio_sql('text', 50, ('Arabic', 'French', 'English', 'unknown'))} AS detected FROM documents")
def _(t):
    return t.documents.select("doc_id", lang.lang_ratio_document(C("text")).alias("detected"))


@query("F05_lang_script", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{AR}') THEN 'Arabic'
  WHEN regexp_matches(text, '{lang.FRENCH_MARKS}') THEN 'French' ELSE 'English' END AS detected,
  regexp_matches(text, '{AR}') OR regexp_matches(text, '{lang.FRENCH_MARKS}') AS non_english FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", lang.lang_script(C("text")).alias("detected"), lang.is_non_english(C("text")).alias("non_english")
    )


@query("F06_lang_set", f"""
SELECT source, concat_ws(',', CASE WHEN bool_or(ar) THEN 'ar' END,
  CASE WHEN bool_or(NOT ar AND NOT fr AND en) THEN 'en' END, CASE WHEN bool_or(fr) THEN 'fr' END) AS languages
FROM (SELECT source, regexp_matches(text, '{AR_WIDE}') AS ar, regexp_matches(text, '{lang.FRENCH_MARKS_SET}') AS fr,
  regexp_matches(text, '[A-Za-z]') AS en FROM documents) GROUP BY source""")
def _(t):
    return t.documents.groupBy("source").agg(F.concat_ws(",", lang.lang_set(C("text"))).alias("languages"))


CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
 '[ \t]*\n[ \t]*', chr(10), 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')"""


@query("F07_clean_lines", f"SELECT doc_id, {CLEAN_SQL} AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", text.clean_lines(C("text")).alias("cleaned"))


NAME_SQL = r"regexp_replace(regexp_extract({e}, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"
STRIP_US = "regexp_replace({e}, '^_+|_+$', '', 'g')"


@query("F08_safe_filename", "SELECT page_id, " + STRIP_US.format(
    e=r"regexp_replace(" + NAME_SQL.format(e="url") + r", '[^\p{L}\p{N}_\x{0600}-\x{06FF}\-]+', '_', 'g')") + " || '.txt' AS file_name FROM pages")
def _(t):
    return t.pages.select("page_id", text.safe_filename(C("url")).alias("file_name"))


@query("F09_normalised_key", "SELECT page_id, " + STRIP_US.format(
    e=r"regexp_replace(nfc_normalize(" + NAME_SQL.format(e="url") + r"), '[^\p{L}\p{N}_]+', '_', 'g')") + " AS document_key, "
    + STRIP_US.format(e=r"regexp_replace(nfc_normalize(" + NAME_SQL.format(e="url") + r"), '[^\p{L}\p{N}_\-]+', '_', 'g')") + " || '.txt' AS attachment_key FROM pages")
def _(t):
    return t.pages.select(
        "page_id", text.document_key(C("url")).alias("document_key"), text.attachment_key(C("url")).alias("attachment_key")
    )


# --- URL pieces in SQL ---------------------------------------------------------
SCH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
HOST_SQL = r"lower(regexp_extract(regexp_extract({u}, '" + SCH + r"//([^/?#]*)', 1), '^(?:.*@)?([^:]*)', 1))"
PORT_SQL = r"regexp_extract(regexp_extract({u}, '" + SCH + r"//([^/?#]*)', 1), ':([0-9]+)$', 1)"
PATH_SQL = r"regexp_replace(regexp_extract({u}, '" + SCH + r"(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
QRY_SQL = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def canon_sql(u: str) -> str:
    v = rf"regexp_replace(regexp_replace(regexp_replace({u}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{206F}}]+$', ''), '[.,;:!?)\"'']+$', ''), '#.*$', '')"
    path = rf"regexp_replace(regexp_replace({PATH_SQL.format(u=v)}, '/+', '/', 'g'), '/$', '')"
    scheme = rf"lower(regexp_extract({v}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    port, qry = PORT_SQL.format(u=v), QRY_SQL.format(u=v)
    return (
        f"concat(CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END, '://', {HOST_SQL.format(u=v)}, "
        f"CASE WHEN {port} = '' THEN '' ELSE ':' || {port} END, CASE WHEN {path} = '' THEN '/' ELSE {path} END, "
        f"CASE WHEN {qry} = '' THEN '' ELSE '?' || {qry} END)"
    )


def host_sql(u: str) -> str:
    return rf"regexp_replace({HOST_SQL.format(u=u)}, '^www\.', '')"


def skip_sql(u: str) -> str:
    h, p = host_sql(u), f"lower({PATH_SQL.format(u=u)})"
    hosts = "(" + ", ".join(f"'{x}'" for x in web.SKIP_HOSTS) + ")"
    parts = [f"{h} IN {hosts}"]
    parts += [f"ends_with({h}, '.{x}')" for x in web.SKIP_HOSTS]
    parts += [f"ends_with({p}, '{x}')" for x in web.SKIP_EXTENSIONS]
    parts += [f"contains({p}, '{x}')" for x in web.SKIP_PATH_PARTS]
    return "(" + " OR ".join(parts) + ")"


def slug_sql(e: str) -> str:
    return STRIP_US.format(e=rf"regexp_replace(nfc_normalize({e}), '[^\p{{L}}\p{{N}}_\-]+', '_', 'g')")


@query("F10_slug", rf"""
SELECT page_id, substring(CASE WHEN {slug_sql('title')} = '' THEN 'untitled' ELSE {slug_sql('title')} END, 1, 80) AS title_slug,
 substring(CASE WHEN {slug_sql('bare')} = '' THEN '_root' ELSE {slug_sql('bare')} END
   || CASE WHEN q = '' THEN '' ELSE '_' || substring(sha1(q), 1, 6) END, 1, 120) AS page_slug
FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  CASE WHEN regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g') = '' THEN '_root'
   ELSE regexp_replace({PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g') END AS bare, {QRY_SQL.format(u='url')} AS q FROM pages)""")
def _(t):
    raw_title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return t.pages.select(
        "page_id",
        text.slug(raw_title).alias("title_slug"),
        text.url_slug(web.url_path(C("url")), web.url_query(C("url"))).alias("page_slug"),
    )


def unescape_sql(e: str) -> str:
    for name, char in web.COMMON_ENTITIES:
        lit = "chr(160)" if name == "&nbsp;" else "'" + char.replace("'", "''") + "'"
        e = f"replace({e}, '{name}', {lit})"
    return e


def html_sql(e: str, decode: int = 1) -> str:
    for tag in ("script", "style", "iframe", "noscript"):
        e = rf"regexp_replace({e}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    e = rf"regexp_replace({e}, '(?s)<!--.*?-->', '', 'g')"
    e = rf"regexp_replace({e}, '<[!/A-Za-z][^>]*>', chr(10), 'g')"
    for _ in range(decode):
        e = unescape_sql(e)
    e = rf"regexp_replace({e}, '\r\n?', chr(10), 'g')"
    e = rf"regexp_replace({e}, '[ \t\f\x{{00a0}}]+\n', chr(10), 'g')"
    e = rf"regexp_replace({e}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(e)


@query("F11_strip_html", f"SELECT page_id, {html_sql('html')} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", web.strip_html(C("html")).alias("body"))


@query("F12_html_unescape", f"SELECT page_id, {unescape_sql('html')} || ' université début — ℵ' AS decoded FROM pages")
def _(t):
    named = F.concat("html", F.lit(" universit&eacute; d&#233;but &#x2014; &alefsym;"))
    return t.pages.select("page_id", web.unescape_all(named).alias("decoded"))


TITLE_SQL = strip_sql(unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query("F13_html_title", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def _(t):
    return t.pages.select("page_id", web.html_title(C("html")).alias("title"))


URLS_SQL = r"regexp_extract_all(text, '(?i)https?://[^\s<>\"\)\]\}]+')"


@query("F14_extract_urls", f"SELECT id, len({URLS_SQL}) AS n_urls, array_to_string({URLS_SQL}, ' ') AS urls FROM v_link_messages")
def _(t):
    urls = web.extract_urls(C("text"))
    return t.link_messages.select("id", F.size(urls).alias("n_urls"), F.array_join(urls, " ").alias("urls"))


@query("F15_canonical_url", f"SELECT page_id, {canon_sql('url')} AS canonical FROM pages")
def _(t):
    return t.pages.select("page_id", web.canonical_url(C("url")).alias("canonical"))


@query("F16_url_host", f"SELECT page_id, {host_sql('url')} AS host, ltrim({HOST_SQL.format(u='url')}, 'w.') AS host_compat FROM pages")
def _(t):
    return t.pages.select(
        "page_id", web.url_host(C("url")).alias("host"), web.url_host(C("url"), strip_characters=True).alias("host_compat")
    )


def links_sql(source: str = "pages") -> str:
    site = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || regexp_extract(url, '" + SCH + r"//([^/?#]*)', 1)"
    folder = rf"CASE WHEN regexp_replace({PATH_SQL.format(u='url')}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({PATH_SQL.format(u='url')}, '[^/]*$', '') END"
    return rf"""
SELECT DISTINCT page_id, url, link FROM (
 SELECT page_id, url, {canon_sql('absolute')} AS link FROM (
  SELECT page_id, url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h
    WHEN starts_with(h, '//') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || ':' || h
    WHEN starts_with(h, '/') THEN {site} || h
    WHEN starts_with(h, '?') THEN {site} || {PATH_SQL.format(u='url')} || h
    ELSE {site} || {folder} || h END AS absolute
  FROM (SELECT page_id, url, {strip_sql('raw')} AS h FROM (
     SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["'']', 1)) AS raw FROM {source}))
  WHERE h <> '' AND NOT regexp_matches(h, '^(mailto:|tel:|javascript:|#)')))
WHERE {host_sql('link')} = {host_sql('url')} AND NOT {skip_sql('link')}"""


@query("F17_same_host_links", f"SELECT page_id, link FROM ({links_sql()})")
def _(t):
    return t.pages.select("page_id", F.explode(web.page_links(C("html"), C("url"))).alias("link"))


@query("F18_excerpt", r"""SELECT doc_id,
 CASE WHEN length(text) > 1200 THEN regexp_replace(substring(text, 1, 1200), '[\s\x{00a0}]+$', '') || ' […truncated]' ELSE text END AS excerpt,
 CASE WHEN length(text) > 160 THEN replace(substring(text, 1, 160), chr(10), ' ') || '…' ELSE replace(text, chr(10), ' ') END AS preview
FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id",
        text.excerpt(C("text"), 1200, " […truncated]").alias("excerpt"),
        text.excerpt(C("text"), 160, "…", trim=False, one_line=True).alias("preview"),
    )


REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace({e}, '(?i)\b([a-z][a-z0-9+.\-]*)://[^\s/@]+:[^\s/@]+@', '\1://***:***@', 'g'),
 '\b(sk|hf|gsk|xoxb|ghp|glpat)[-_][A-Za-z0-9\-_]{{8,}}', '***', 'g'),
 '(?i)\b(authorization|api[_-]?key|token|password|secret)\b\s*[:=]\s*\S+', '\1=***', 'g')"""


@query("F19_redact_secrets", "SELECT doc_id, " + REDACT_SQL.format(e="text") + " AS redacted, " + REDACT_SQL.format(e="text") + " <> text AS changed FROM documents")
def _(t):
    out = text.redact_secrets(C("text"))
    return t.documents.select("doc_id", out.alias("redacted"), (out != C("text")).alias("changed"))


CHUNK_ID = r"(?:chat|pdf|ext)_[\p{L}\p{N}_.\-]+"
GROUP_SQL = rf"\[\s*{CHUNK_ID}(?:\s*,\s*{CHUNK_ID})*\s*\]"


@query("F20_citation_ids", rf"""
SELECT answer_id, array_to_string(regexp_extract_all(array_to_string(regexp_extract_all(answer, '{GROUP_SQL}'), ' '), '{CHUNK_ID}'), ' ') AS cited
FROM v_answers""")
def _(t):
    return t.answers.select("answer_id", F.array_join(cite.citation_ids(C("answer")), " ").alias("cited"))


REFUSAL_SQL = cite.REFUSAL.replace(r"(?<![\p{L}\p{N}_])", r"\b").replace(r"(?![\p{L}\p{N}_])", r"\b").replace("'", "''")


@query("F21_is_refusal", f"SELECT doc_id, regexp_matches(text, '{REFUSAL_SQL}') AS plain, TRUE AS refused FROM documents")
def _(t):
    declined = F.concat(C("text"), F.lit(" Sorry, I don't have any details on that."))
    return t.documents.select(
        "doc_id", cite.is_refusal(C("text")).alias("plain"), cite.is_refusal(declined).alias("refused")
    )


def scrub_sql(e: str) -> str:
    e = f"regexp_replace({e}, '{cite.GROUP}', '', 'g')"
    for pattern, kept in cite.TIDY:
        e = f"regexp_replace({e}, '{pattern}', '{kept}', 'g')"
    return strip_sql(e)


@query("F22_scrub_citations", f"SELECT answer_id, {scrub_sql('answer')} AS scrubbed FROM v_answers")
def _(t):
    return t.answers.select("answer_id", cite.scrub_citations(C("answer")).alias("scrubbed"))


def _known(t):
    """Answers with their retrieved source ids; a retrieved list has at most k ids."""
    sources = t.answer_sources.groupBy("answer_id").agg(F.collect_list("id").alias("known"))
    return t.answers.join(sources, "answer_id")


@query("F23_renumber_citations", """
SELECT answer_id, replace(replace(replace(answer, concat('[', near, ']'), '[1]'), concat('[', own, ', pdf_unknown]'), '[2] [pdf_unknown]'),
  concat('[', own, ']'), '[2]') AS rewritten, concat(near, ' ', own) AS surfaced FROM v_answers""")
def _(t):
    return _known(t).select(
        "answer_id",
        cite.renumber_citations(C("answer"), C("known")).alias("rewritten"),
        F.array_join(F.transform(cite.cited_sources(C("answer"), C("known")), lambda s: s["id"]), " ").alias("surfaced"),
    )


INNER_SQL = strip_sql("substring(text, 2, greatest(length(text) - 2, 0))")


@query("F24_strip_wrapping_quotes", f"""
SELECT item_id, {strip_sql('text')} AS unquoted,
 CASE WHEN substring(text, 1, 1) = right(text, 1) AND right(text, 1) IN ('"', chr(39)) THEN {INNER_SQL} ELSE text END AS kept FROM benchmark""")
def _(t):
    quoted = F.concat(F.lit('"'), C("text"), F.lit('"'))
    return t.benchmark.select(
        "item_id", text.strip_wrapping_quotes(quoted).alias("unquoted"), text.strip_wrapping_quotes(C("text")).alias("kept")
    )


@query("F25_tokenize", r"""SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct, md5(array_to_string(toks, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM documents)""")
def _(t):
    return t.documents.select("doc_id", text.tokenize(C("text")).alias("toks")).select(
        "doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"),
        F.md5(F.array_join("toks", " ")).alias("digest"),
    )


WORDS_SQL = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def perturb_sql(c: str) -> dict[str, str]:
    low = strip_sql(rf"regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')")
    w = WORDS_SQL.replace("{c}", c)
    return {
        "original": c,
        "lowercase_no_punct": low,
        "truncate_3": f"array_to_string(list_slice({w}, 1, 3), ' ')",
        "reverse": f"array_to_string(list_reverse({w}), ' ')",
    }


@query("F26_perturb_text", "SELECT item_id, {lowercase_no_punct} AS lowered, {truncate_3} AS truncated, {reverse} AS reversed FROM benchmark".format(**perturb_sql("text")))
def _(t):
    c = C("text")
    return t.benchmark.select(
        "item_id", text.lower_no_punct(c).alias("lowered"), text.first_words(c).alias("truncated"), text.reversed_words(c).alias("reversed")
    )


@query("F27_perturb_typos")
def _(t):
    return t.benchmark.select("item_id", text.typos(C("text"), C("item_id") + 42).alias("mutated"))


@query("F28_contains_ci", "SELECT doc_id, contains(lower(text), lower('The')) AS has_the, contains(lower(text), lower(source)) AS has_source FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", text.contains_ci(C("text"), F.lit("The")).alias("has_the"), text.contains_ci(C("text"), C("source")).alias("has_source")
    )


@query("F29_calendar_parts", "SELECT event_id, strftime(ts, '%Y-%m') AS month, hour(ts) AS hour, dayname(ts) AS weekday, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(t):
    return t.events.select(
        "event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.hour("ts").alias("hour"),
        F.date_format("ts", "EEEE").alias("weekday"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query("F30_relative_age", """
SELECT event_id, CASE WHEN s < 30 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s // 60 < 60 THEN (s // 60) || ' min ago'
 WHEN s // 3600 < 24 THEN (s // 3600) || ' hr ago' WHEN s // 86400 = 1 THEN '1 day ago' WHEN s // 86400 < 30 THEN (s // 86400) || ' days ago'
 WHEN s // 86400 // 30 < 12 THEN (s // 86400 // 30) || ' mo ago' ELSE (s // 86400 // 30 // 12) || ' yr ago' END AS age
FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 1000000 AS s FROM events)""")
def _(t):
    now = t.events.agg(F.max("ts")).scalar()
    return t.events.select("event_id", display.relative_age(C("ts"), now).alias("age"))


@query("F31_compact_number", """
SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN printf('%.1fM', n_chars / 1e6) WHEN n_chars >= 1000 THEN CAST(CAST(round_even(n_chars / 1e3, 0) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(n_chars AS VARCHAR) END AS tokens,
 CASE WHEN n_chars >= 1000000 THEN ((n_chars + 5000) // 1000000) || '.' || lpad(CAST((n_chars + 5000) // 10000 % 100 AS VARCHAR), 2, '0') || 'M'
  WHEN n_chars >= 1000 THEN ((n_chars + 50) // 1000) || '.' || ((n_chars + 50) // 100 % 10) || 'k' ELSE CAST(n_chars AS VARCHAR) END AS chars,
 source AS model FROM documents""")
def _(t):
    model = F.concat(F.lit("groq/"), C("source"), F.lit("-versatile"))
    return t.documents.select(
        "doc_id", display.compact_tokens(C("n_chars")).alias("tokens"), display.compact_chars(C("n_chars")).alias("chars"),
        display.pretty_model(model).alias("model"),
    )


@query("F32_three_quantiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn,
   count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
x AS (SELECT event_type, max(n) AS n, max(0.25 * (n + 1) - 1) AS h1, max(0.75 * (n + 1) - 1) AS h3 FROM r GROUP BY event_type)
SELECT r.event_type, x.n,
 round(max(CASE WHEN rn = floor(h1) THEN value END) + (max(CASE WHEN rn = ceil(h1) THEN value END) - max(CASE WHEN rn = floor(h1) THEN value END)) * max(CAST(h1 - floor(h1) AS DOUBLE)), 6) AS q1_exclusive,
 round(max(CASE WHEN rn = floor(h3) THEN value END) + (max(CASE WHEN rn = ceil(h3) THEN value END) - max(CASE WHEN rn = floor(h3) THEN value END)) * max(CAST(h3 - floor(h3) AS DOUBLE)), 6) AS q3_exclusive,
 max(CASE WHEN rn = floor(0.25 * x.n) THEN value END) AS q1_floor,
 max(CASE WHEN rn = round_even(0.95 * (x.n - 1), 0) THEN value END) AS p95_round,
 round(quantile_cont(value, 0.95), 6) AS p95_cont
FROM r JOIN x ON r.event_type = x.event_type GROUP BY r.event_type, x.n""")
def _(t):
    stats = order_stats(
        t.events, "value", ["event_type"],
        {"q1_exclusive": position_exclusive(0.25), "q3_exclusive": position_exclusive(0.75), "q1_floor": position_floor(0.25),
         "p95_round": position_round(0.95), "p95_cont": position_cont(0.95)},
    )
    return stats.select(
        "event_type", "n", F.round("q1_exclusive", 6).alias("q1_exclusive"), F.round("q3_exclusive", 6).alias("q3_exclusive"),
        "q1_floor", "p95_round", F.round("p95_cont", 6).alias("p95_cont"),
    )


@query("F33_reaction_sum", "SELECT conv_id, turn, CAST(turn * (turn + 1) / 2 AS BIGINT) AS reactions FROM conversations")
def _(t):
    counts = F.transform(F.sequence(F.lit(0), C("turn").cast("int")), lambda n: F.struct(n.alias("count")))
    return t.conversations.select("conv_id", "turn", chat.reaction_sum(counts).alias("reactions"))


@query("F34_json_path_text", """SELECT event_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS k, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) > 50 AS high FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.alias("k"), (k.cast("int") > 50).alias("high"))


@query("F35_json_object_build", """
SELECT message_id, concat('{"useful":', count(*) FILTER (WHERE rating = 'useful'), ',"not_useful":', count(*) FILTER (WHERE rating = 'not_useful'),
 ',"report":', count(*) FILTER (WHERE rating = 'report'), '}') AS feedback FROM v_feedback GROUP BY message_id""")
def _(t):
    return t.feedback.groupBy("message_id").agg(F.to_json(F.struct(*activity.rating_counts())).alias("feedback"))


@query("F36_dot_product", """
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS squared, 1.0::DOUBLE AS unit FROM embeddings""")
def _(t):
    scaled = F.transform("embedding", lambda v: v.cast("double") * 3)
    return t.embeddings.select(
        "vec_id", F.round(vectors.dot_product(C("embedding"), C("embedding")), 6).alias("squared"),
        F.round(vectors.norm(vectors.l2_normalise(scaled)), 6).alias("unit"),
    )


@query("F37_member_for", """
SELECT user_id, CASE WHEN d < 60 THEN d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END
  ELSE (d // 30) || CASE WHEN d // 30 = 1 THEN ' month' ELSE ' months' END END AS member_for
FROM (SELECT user_id, (epoch_us((SELECT max(last_active_at) FROM v_users) + INTERVAL '35' DAY) - epoch_us(joined_at)) // 86400000000 AS d FROM v_users)""")
def _(t):
    now = t.users.agg(F.max("last_active_at") + F.expr("INTERVAL 35 DAYS")).scalar()
    return t.users.select("user_id", display.member_for(C("joined_at"), now).alias("member_for"))


@query("F38_approx_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.approx_tokens(C("text")).alias("tokens"))


@query("F39_page_estimate", r"SELECT doc_id, len(regexp_extract_all(text, '\n\n')) + 1 AS pages, len(regexp_extract_all(text, '\S+')) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", text.page_estimate(C("text")).alias("pages"), text.word_count(C("text")).alias("words"))


# --- predicates ----------------------------------------------------------------


@query("P01_content_service_split", "SELECT id, mtype = 'message' AS is_content FROM v_messages")
def _(t):
    return t.messages.select("id", activity.is_content().alias("is_content"))


@query("P02_min_length_filter", f"SELECT id, {strip_sql('text')} AS text FROM v_messages WHERE length({strip_sql('text')}) >= 20")
def _(t):
    return t.messages.select("id", text.strip(C("text")).alias("text")).where(F.length("text") >= 20)


@query("P03_presence_flags", """SELECT id, has_photo, has_file, reply_to IS NOT NULL AS is_reply FROM v_messages""")
def _(t):
    return t.messages.select("id", "has_photo", "has_file", C("reply_to").isNotNull().alias("is_reply"))


@query("P04_metadata_filter", "SELECT id, source_type, language FROM v_corpus WHERE source_type = 'pdf' AND language = 'fr'")
def _(t):
    return t.corpus.where(activity.metadata_filter(source_type="pdf", language="fr")).select("id", "source_type", "language")


@query("P05_crawl_skip_rule", f"SELECT page_id, {skip_sql('url')} AS skipped FROM pages")
def _(t):
    return t.pages.select("page_id", web.crawl_skip(C("url")).alias("skipped"))


@query("P06_photo_only_filter", f"""SELECT id FROM (SELECT id, mtype, has_photo, CASE WHEN turn = 5 THEN ' ' ELSE text END AS text FROM v_messages)
WHERE mtype = 'message' AND has_photo AND {strip_sql('text')} = ''""")
def _(t):
    blanked = t.messages.withColumn("text", F.when(C("turn") == 5, F.lit(" ")).otherwise(C("text")))
    return activity.photo_only(blanked).select("id")


@query("P07_null_to_empty", "SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, '') AS language FROM documents")
def _(t):
    return activity.null_to_empty(
        t.documents.select("doc_id", F.when(C("lang") != "en", C("lang")).alias("language")), ["language"]
    )


TIER_SQL = """CASE WHEN {n} = 0 AND (has_photo OR has_file) THEN 'Media-only' WHEN {n} = 0 THEN 'Empty' WHEN {n} < 50 THEN 'Low (< 50 chars)'
 WHEN {n} < 200 THEN 'Medium (50–200)' ELSE 'High (>= 200 chars)' END"""


@query("P08_quality_tier", f"SELECT id, {TIER_SQL.format(n='length(text)')} AS quality FROM v_messages")
def _(t):
    return t.messages.select("id", display.quality_tier(F.length("text"), C("has_photo"), C("has_file")).alias("quality"))


@query("P09_confidence_tier", """
SELECT vec_id, CASE WHEN s >= 0.50 THEN 'high' WHEN s >= 0.20 THEN 'mid' ELSE 'low' END AS tier
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS s FROM embeddings)""")
def _(t):
    return t.embeddings.select("vec_id", display.confidence_tier(F.get("embedding", F.lit(0)).cast("double") * 4).alias("tier"))


@query("P10_freshness_band", """
SELECT event_id, CASE WHEN age > 30 THEN 'stale' WHEN age > 7 THEN 'ageing' ELSE 'fresh' END AS band, age > 1 AS stale_snapshot
FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM events) + INTERVAL '5' DAY) - epoch_us(ts)) / 86400000000.0 AS age FROM events)""")
def _(t):
    now = t.events.agg(F.max("ts") + F.expr("INTERVAL 5 DAYS")).scalar()
    return t.events.select(
        "event_id", display.freshness_band(C("ts"), now).alias("band"), display.snapshot_stale(C("ts"), now).alias("stale_snapshot")
    )


@query("P11_length_bucket", "SELECT CASE WHEN n_chars = 0 THEN '0' WHEN n_chars < 50 THEN '1-49' WHEN n_chars < 200 THEN '50-199' ELSE '>=200' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(display.length_bucket(C("n_chars")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("P12_admin_flag", "SELECT id, sender IN ('assistant', 'system') AS is_admin FROM v_messages")
def _(t):
    return t.messages.select("id", activity.is_admin(["assistant", "system"]).alias("is_admin"))


INBOX = """SELECT m.id, m.reply_to, m.sender, m.conv_id % 3 = 0 AS direct,
 CASE WHEN m.turn = 1 THEN concat('/ask ', m.text) WHEN m.turn = 2 THEN concat(m.text, ' @helper ') WHEN m.turn = 5 THEN ' @helper ' ELSE m.text END AS text FROM v_messages m"""


@query("P13_addressed_filter", f"""
SELECT id, text FROM (SELECT i.id, i.direct, i.text LIKE '%@helper%' AS named, p.sender = 'assistant' AS answered,
  {strip_sql('i.text')} AS stripped, CASE WHEN i.direct THEN {strip_sql('i.text')} ELSE {strip_sql("replace(" + strip_sql('i.text') + ", '@helper', '')")} END AS text
 FROM ({INBOX}) i LEFT JOIN v_messages p ON p.id = i.reply_to)
WHERE NOT starts_with(stripped, '/') AND stripped <> '' AND text <> '' AND (direct OR named OR coalesce(answered, FALSE))""")
def _(t):
    return activity.addressed(t.sql(INBOX), t.messages, bot_name="helper", bot_sender="assistant").select("id", "text")


@query("P14_command_parse", f"""
SELECT id, lower(regexp_extract(text, '^/(ask|deep)(?:@[\\p{{L}}\\p{{N}}_]+)?\\s+', 1)) AS command, {strip_sql("regexp_extract(text, '(?s)^/(?:ask|deep)(?:@[\\p{L}\\p{N}_]+)?\\s+(.+)$', 1)")} AS argument
FROM (SELECT id, concat(CASE WHEN turn % 2 = 0 THEN '/ask@helper ' ELSE '/deep ' END, text) AS text FROM v_messages)""")
def _(t):
    typed = t.messages.select(
        "id", F.concat(F.when(C("turn") % 2 == 0, "/ask@helper ").otherwise("/deep "), C("text")).alias("text")
    )
    return activity.parse_commands(typed).select("id", "command", "argument")


@query("P15_log_keep_filter", """
SELECT id, level, logger FROM v_oplog WHERE level IN ('WARNING', 'ERROR', 'CRITICAL') AND NOT (logger = 'app.signup' OR starts_with(logger, 'app.signup.'))""")
def _(t):
    return t.oplog.where(activity.log_keep(ignore=["app.signup"])).select("id", "level", "logger")


@query("P16_thin_page_filter", f"SELECT page_id, n_chars FROM (SELECT page_id, length({html_sql('html')}) AS n_chars FROM pages) WHERE n_chars >= 300")
def _(t):
    return t.pages.select("page_id", F.length(web.strip_html(C("html"))).alias("n_chars")).where("n_chars >= 300")


@query("P17_display_name", """
SELECT user_id, CASE WHEN user_id % 3 = 0 AND coalesce(first_name, '') <> '' THEN first_name || ' ' || language_code
  WHEN user_id % 3 = 1 THEN '@u' || user_id ELSE 'user ' || user_id END AS shown FROM v_users""")
def _(t):
    third = C("user_id") % 3
    return t.users.select(
        "user_id",
        display.display_name(
            F.when(third == 0, C("first_name")), F.when(third == 0, C("language_code")).otherwise(""),
            F.when(third == 1, F.concat(F.lit("u"), C("user_id").cast("string"))), C("user_id"),
        ).alias("shown"),
    )


@query("P18_source_label", """
SELECT id, CASE source_type WHEN 'chat' THEN concat('chat msg | topic: ', site, ' | sender: unknown | posted: 2024-01-02')
  WHEN 'pdf' THEN concat('PDF: ', site, '.txt | chunk #', doc_id) ELSE concat('web page | site: ', site, ' | title: ?', ' | last modified: 2024-01-02') END AS label,
 CASE source_type WHEN 'chat' THEN concat('chat · ', site, ' · unknown · 2024-01-02') WHEN 'pdf' THEN concat('PDF · ', site, '.txt · #', doc_id)
  ELSE concat('web · ', site, ' · ?') END AS chip,
 CASE source_type WHEN 'chat' THEN concat('chat msg ', doc_id, ' | ', site) WHEN 'pdf' THEN concat('PDF ', site, '.txt | chunk ', doc_id)
  ELSE concat('web ', site, ' | ') END AS location FROM v_corpus""")
def _(t):
    none = F.lit(None).cast("string")
    m = {
        "source_type": C("source_type"), "topic": C("site"), "sender": none, "date": F.lit("2024-01-02T03:04:05"),
        "pdf_file": F.concat(C("site"), F.lit(".txt")), "chunk_index": C("doc_id"), "message_id": C("doc_id"),
        "site": C("site"), "title": F.lit(""), "url": none,
    }
    return t.corpus.select(
        "id", display.source_label(m).alias("label"), display.source_chip(m, C("id")).alias("chip"), display.hit_location(m).alias("location")
    )


@query("P20_non_bot_users", "SELECT user_id, query_count FROM v_users WHERE NOT is_bot")
def _(t):
    return activity.non_bot_users(t.users).select("user_id", "query_count")


@query("P20b_default_user", "SELECT user_id FROM v_users WHERE NOT is_bot ORDER BY query_count DESC, last_active_at DESC, user_id LIMIT 1")
def _(t):
    return activity.default_user(t.users).select("user_id")


@query("P21_rating_domain_check", "SELECT id, rating IN ('useful', 'not_useful') AS accepted FROM v_feedback")
def _(t):
    return t.feedback.select("id", activity.rating_allowed(["useful", "not_useful"]).alias("accepted"))


@query("P22_soft_delete_filter", "SELECT id FROM v_turns WHERE NOT refused AND NOT (turn_idx = 0)")
def _(t):
    cleared = t.turns.withColumn("cleared_at", F.when(C("turn_idx") == 0, C("ts")))
    return cleared.where(activity.visible_turn()).select("id")


@query("P23_length_reaction_pairs", "SELECT id, length(text) AS text_length, reaction_count FROM v_messages WHERE mtype = 'message'")
def _(t):
    return t.messages.where(activity.is_content()).select("id", F.length("text").alias("text_length"), "reaction_count")
