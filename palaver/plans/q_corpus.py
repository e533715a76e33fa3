"""Queries that build the corpus (J01-J08, J17, J18, R01-R04, R18, U, W09-W15, A51, S02-S05, S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import lang, text as tx, web
from palaver.operators import corpus, threads
from palaver.plans import q_text as Q
from palaver.plans.registry import query
from palaver.session import cut_lineage

C = F.col
NN = "chr(10) || chr(10)"

TOPICS = "SELECT id, concat('topic ', CAST(conv_id AS VARCHAR(20))) AS title FROM v_messages WHERE mtype = 'service' AND sender <> 'system'"


def topics(t):
    return t.sql(TOPICS)


CHAIN = f"""topics AS ({TOPICS}),
chain AS (SELECT id AS start, reply_to AS cur FROM v_messages WHERE reply_to IS NOT NULL
 UNION ALL SELECT c.start, m.reply_to FROM chain c JOIN v_messages m ON m.id = c.cur
 WHERE m.reply_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM topics t WHERE t.id = c.cur)),
resolved AS (SELECT c.start AS id, t.title AS topic FROM chain c JOIN topics t ON t.id = c.cur)"""


@query("J01_reply_chain_topic", f"WITH RECURSIVE {CHAIN} SELECT m.id, r.topic FROM v_messages m LEFT JOIN resolved r ON r.id = m.id WHERE m.mtype = 'message'")
def _(t):
    return threads.reply_chain_topic(t.messages, topics(t)).select("id", "topic")


@query("J02_direct_topic_default", f"WITH topics AS ({TOPICS}) SELECT m.id, coalesce(t.title, 'General') AS topic FROM v_messages m LEFT JOIN topics t ON t.id = m.reply_to WHERE m.mtype = 'message'")
def _(t):
    return threads.direct_topic(t.messages, topics(t)).select("id", "topic")


OCR = """SELECT m.id, CASE WHEN d.n_chars % 2 = 0 THEN d.text ELSE substring(d.text, 1, 19) END AS ocr_text
FROM (SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) * 100 + conv_id AS doc FROM v_messages WHERE has_photo) m
JOIN documents d ON d.doc_id = m.doc"""
MERGED = f"""merged AS (SELECT m.id, m.text AS original_text, CASE WHEN o.id IS NOT NULL AND length(o.ocr_text) >= 20 THEN o.ocr_text ELSE m.text END AS text,
 CASE WHEN o.id IS NULL THEN 'original' WHEN length(o.ocr_text) >= 20 THEN 'ocr' ELSE 'ocr_failed' END AS text_source
 FROM v_frame m LEFT JOIN ({OCR}) o ON o.id = m.id)"""


def merged(t):
    return corpus.ocr_merge(t.frame.select("id", "text"), t.sql(OCR))


@query("J03_ocr_merge", f"WITH {MERGED} SELECT * FROM merged")
def _(t):
    return merged(t)


@query("A24_merge_audit", f"""WITH {MERGED}, c AS (SELECT count(*) FILTER (WHERE text_source = 'ocr') AS merged, count(*) FILTER (WHERE text_source = 'ocr_failed') AS failed,
 count(*) FILTER (WHERE text_source = 'original') AS untouched, count(*) FILTER (WHERE {Q.strip_sql('original_text')} <> '') AS texts_before,
 count(*) FILTER (WHERE {Q.strip_sql('text')} <> '') AS texts_after FROM merged) SELECT *, texts_after - texts_before AS net_gain FROM c""")
def _(t):
    from palaver.operators import activity

    return activity.merge_audit(merged(t))


PAGES = f"""pidx AS (SELECT url, {Q.TITLE_SQL} AS title, {Q.html_sql('html')} AS body
 FROM (SELECT {Q.canon_sql('url')} AS url, max_by(html, page_id) AS html FROM pages GROUP BY 1))"""
FIRST_URL = r"regexp_extract(text, '(?i)https?://[^\s<>\"\)\]\}]+')"
EXCERPT = r"CASE WHEN length({b}) > 1200 THEN regexp_replace(substring({b}, 1, 1200), '[\s\x{{00a0}}]+$', '') || ' […truncated]' ELSE {b} END"
ENRICHED = f"""linked AS (SELECT id, text, conv_id, turn, sender, mtype, ts, {Q.canon_sql(FIRST_URL)} AS link FROM v_link_messages),
enriched AS (SELECT l.id, l.conv_id, l.turn, l.sender, l.mtype, l.ts, CASE WHEN p.body <> '' THEN 1 ELSE 0 END AS n_links,
 CASE WHEN p.body <> '' THEN concat(@BASE@, {NN}, '— Linked page: ', l.link, CASE WHEN p.title <> '' THEN ' — ' || p.title ELSE '' END, chr(10), {EXCERPT.format(b='p.body')})
 ELSE @BASE@ END AS text FROM linked l LEFT JOIN pidx p ON p.url = l.link)"""


@query("J04_link_enrich", f"WITH {PAGES}, {ENRICHED.replace('@BASE@', 'l.text')} SELECT id, text, n_links FROM enriched")
def _(t):
    return corpus.link_enrich(t.link_messages.select("id", "text"), corpus.page_index(t.pages))


FILES = """SELECT concat(source, ' n°', CAST(doc_id % 300 AS VARCHAR(10)), '.txt') AS file, doc_id, text, n_chars FROM documents"""
NATIVE = f"SELECT * FROM ({FILES}) WHERE n_chars > 1500"
SCANNED = f"SELECT concat(file, '') AS file, doc_id, text, n_chars FROM ({FILES}) WHERE n_chars <= 1500"
STEM_SQL = "nfc_normalize(" + Q.NAME_SQL.format(e="file") + ")"


@query("J05_source_precedence_dedup", f"""WITH n AS ({NATIVE}), o AS ({SCANNED}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {STEM_SQL} ORDER BY file, doc_id) AS rn FROM o) WHERE rn = 1)
SELECT file, 'original' AS text_source, count(*) AS n FROM n GROUP BY file
UNION ALL SELECT file, 'ocr' AS text_source, count(*) AS n FROM f WHERE {STEM_SQL} NOT IN (SELECT {STEM_SQL} FROM n) GROUP BY file""")
def _(t):
    both = corpus.source_precedence(t.sql(NATIVE), t.sql(SCANNED))
    return both.groupBy("file", "text_source").agg(F.count("*").alias("n"))


@query("J06_index_delta", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return corpus.index_delta(t.documents.select("doc_id"), t.labels, "doc_id")


CACHE = "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN n_chars ELSE 20 END AS char_count FROM documents WHERE source < 'src5'"


@query("J07_ocr_resume", f"""WITH c AS ({CACHE}) SELECT id, char_count, 'cached' AS state FROM c WHERE char_count > 20
UNION ALL SELECT doc_id AS id, NULL AS char_count, 'todo' AS state FROM documents WHERE doc_id NOT IN (SELECT id FROM c WHERE char_count > 20)""")
def _(t):
    return corpus.ocr_resume(t.documents.select(C("doc_id").alias("id")), t.sql(CACHE))


LISTED = "SELECT doc_id AS link, n_chars AS modified FROM documents WHERE lang <> 'de'"
STAMPS = "SELECT doc_id AS link, CASE WHEN source = 'src1' THEN n_chars + 1 ELSE n_chars END AS modified FROM documents WHERE source <> 'src2'"


@query("J08_modified_cache", f"""SELECT coalesce(l.link, c.link) AS link, CASE WHEN c.link IS NULL THEN 'new' WHEN l.link IS NULL THEN 'removed'
 WHEN l.modified = c.modified THEN 'unchanged' ELSE 'changed' END AS state FROM ({LISTED}) l FULL OUTER JOIN ({STAMPS}) c ON l.link = c.link""")
def _(t):
    return corpus.modified_cache(t.sql(LISTED), t.sql(STAMPS))


@query("J17_citation_sources", "SELECT answer_id, 1 AS number, near AS id FROM v_answers UNION ALL SELECT answer_id, 2 AS number, own AS id FROM v_answers")
def _(t):
    return corpus.citation_sources(t.answers, t.answer_sources)


@query("W07_citation_number", "SELECT answer_id, 1 AS number, near AS id FROM v_answers UNION ALL SELECT answer_id, 2 AS number, own AS id FROM v_answers")
def _(t):
    from palaver.functions import citations as cite

    known = t.answer_sources.groupBy("answer_id").agg(F.collect_list("id").alias("known"))
    return t.answers.join(known, "answer_id").select(
        "answer_id", F.explode(cite.cited_sources(C("answer"), C("known"))).alias("s")
    ).select("answer_id", "s.number", "s.id")


POSTED = "SELECT id, concat('files/Note ', CAST(conv_id % 40 AS VARCHAR(10)), ' (', sender, ').PDF') AS file FROM v_messages WHERE has_file"
TEXTS = "SELECT DISTINCT concat('Note_', CAST(doc_id % 60 AS VARCHAR(10)), '_user.txt') AS file FROM documents"


@query("J18_file_to_message", f"""WITH p AS (SELECT id, regexp_extract(file, '([^/]*)$', 1) AS original FROM ({POSTED})),
k AS (SELECT regexp_replace(regexp_replace(regexp_replace(original, '^(.+)\\.[^.]*$', '\\1'), '[^\\p{{L}}\\p{{N}}_\\-]+', '_', 'g'), '^_+|_+$', '', 'g') || '.txt' AS key, id, original FROM p)
SELECT t.file, max(k.id) AS message_id, max_by(k.original, k.id) AS original FROM ({TEXTS}) t JOIN k ON k.key = t.file GROUP BY t.file""")
def _(t):
    return corpus.file_to_message(t.sql(TEXTS), t.sql(POSTED)).select("file", "message_id", "original")


@query("P19_deep_link", f"""WITH RECURSIVE {CHAIN}, roots AS (SELECT c.start AS id, t.id AS topic_id FROM chain c JOIN topics t ON t.id = c.cur)
SELECT m.id, concat('https://chat.example/c/77/', CASE WHEN r.topic_id IS NOT NULL AND r.topic_id <> 0 THEN r.topic_id || '/' ELSE '' END, m.id) AS link
FROM v_messages m LEFT JOIN roots r ON r.id = m.id WHERE m.mtype = 'message'""")
def _(t):
    from palaver.functions.display import deep_link

    named = topics(t).select("id", C("id").alias("title"))
    return threads.reply_chain_topic(t.messages, named).select(
        "id", deep_link("https://chat.example/c", 77, C("topic"), C("id")).alias("link")
    )


# --- chunks -------------------------------------------------------------------------


def pack_sql(source: str, key: str, text: str) -> str:
    """CTEs that split ``source`` (key, text) into stitched chunks: ``chunks``."""
    return f"""pars AS (SELECT {key}, list_filter(list_transform(string_split({Q.strip_sql(text)}, {NN}), lambda p: {Q.strip_sql('p')}), lambda p: p <> '') AS ps FROM {source}),
fold AS (SELECT {key}, ps, 0 AS i, '' AS open, CAST([] AS VARCHAR[]) AS done FROM pars UNION ALL
 SELECT {key}, ps, i + 1 AS i,
  CASE WHEN length(p) > 2000 THEN '' WHEN open = '' THEN p WHEN length(open) + 2 + length(p) <= 2000 THEN open || {NN} || p ELSE p END AS open,
  CASE WHEN length(p) > 2000 THEN list_concat(CASE WHEN open = '' THEN done ELSE list_append(done, open) END,
     list_transform(range(0, CAST(ceil((length(p) - 2000) / 1750.0) AS BIGINT) + 1), lambda k: substring(p, k * 1750 + 1, 2000)))
   WHEN open = '' OR length(open) + 2 + length(p) <= 2000 THEN done ELSE list_append(done, open) END AS done
 FROM (SELECT *, ps[i + 1] AS p FROM fold WHERE i < len(ps))),
packed AS (SELECT {key}, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS c FROM fold WHERE i = len(ps)),
chunks AS (SELECT {key}, k - 1 AS chunk_index, CASE WHEN k = 1 THEN c[k] ELSE right(c[k - 1], 250) || {NN} || c[k] END AS text
 FROM (SELECT {key}, c, unnest(range(1, len(c) + 1)) AS k FROM packed))"""


@query("R01_chunk_text", f"WITH RECURSIVE {pack_sql('documents', 'doc_id', 'text')} SELECT doc_id, chunk_index, length(text) AS n_text, md5(text) AS digest FROM chunks")
def _(t):
    return corpus.chunk_text(t.documents.select("doc_id", "text")).select(
        "doc_id", "chunk_index", F.length("text").alias("n_text"), F.md5("text").alias("digest")
    )


@query("W10_chunk_overlap", f"WITH RECURSIVE {pack_sql('documents', 'doc_id', 'text')} SELECT doc_id, chunk_index, substring(text, 1, 252) AS head FROM chunks WHERE chunk_index > 0")
def _(t):
    rows = corpus.chunk_text(t.documents.select("doc_id", "text"))
    return rows.where("chunk_index > 0").select("doc_id", "chunk_index", F.substring("text", 1, 252).alias("head"))


DOCFILE = "SELECT doc_id, concat(source, ' n°', CAST(doc_id AS VARCHAR(20)), '.txt') AS file, text, CASE WHEN lang = 'de' THEN 'ocr' ELSE 'original' END AS text_source FROM documents"


R02_SQL = f"""WITH RECURSIVE df AS ({DOCFILE}), {pack_sql('df', 'doc_id', 'text')}
SELECT concat('pdf_', regexp_replace(regexp_replace(nfc_normalize(regexp_replace(df.file, '^(.+)\\.[^.]*$', '\\1')), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g'), '_', chunk_index) AS id,
 c.text, df.file AS pdf_file, {Q.ratio_sql('c.text', 30, ('ar', 'fr', 'en', 'empty'))} AS language, text_source, chunk_index FROM chunks c JOIN df ON df.doc_id = c.doc_id"""


def document_rows(t):
    return corpus.document_chunks(t.sql(DOCFILE).select("file", "text", "text_source"))


@query("R02_document_chunks", R02_SQL)
def _(t):
    return document_rows(t).select("id", "text", "metadata.pdf_file", "metadata.language", "metadata.text_source", "metadata.chunk_index")


LANG_ATTR = "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)"


def scraped(t):
    """Stored pages in the shape of scraped files: site, slug, headers, body."""
    attr = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    headers = F.create_map(
        F.lit("Source"), C("url"), F.lit("Title"), web.html_title(C("html")), F.lit("Language"), F.when(attr == "fr", attr).otherwise("")
    )
    stored = t.pages.select(
        web.url_host(C("url")).alias("site"),
        F.concat(tx.url_slug(web.url_path(C("url")), web.url_query(C("url"))), F.lit("-"), C("page_id").cast("string")).alias("slug"),
        headers.alias("headers"), web.strip_html(C("html")).alias("body"), "page_id",
    )
    return cut_lineage(stored)  # scraped pages are a stored table


PAGE_SLUG = f"""substring(CASE WHEN {Q.slug_sql('bare')} = '' THEN '_root' ELSE {Q.slug_sql('bare')} END || CASE WHEN q = '' THEN '' ELSE '_' || substring(sha1(q), 1, 6) END, 1, 120)"""
SCRAPED = f"""sp AS (SELECT page_id, {Q.host_sql('url')} AS site, url, {Q.TITLE_SQL} AS title, {LANG_ATTR} AS attr, {Q.html_sql('html')} AS body, {Q.QRY_SQL.format(u='url')} AS q,
 CASE WHEN regexp_replace({Q.PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g') = '' THEN '_root' ELSE regexp_replace({Q.PATH_SQL.format(u='url')}, '^/+|/+$', '', 'g') END AS bare FROM pages)"""


R03_SQL = f"""WITH RECURSIVE {SCRAPED}, {pack_sql('sp', 'page_id', 'body')}
SELECT concat('ext_', site, '_', {PAGE_SLUG}, '-', sp.page_id, '_', chunk_index) AS id, c.text, site, url, title,
 CASE WHEN attr = 'fr' THEN 'fr' ELSE {Q.ratio_sql('body', 30, ('ar', 'fr', 'en', 'empty'))} END AS language FROM chunks c JOIN sp ON sp.page_id = c.page_id"""


def web_rows(t):
    return corpus.web_chunks(scraped(t))


@query("R03_web_chunks", R03_SQL)
def _(t):
    return web_rows(t).select("id", "text", "metadata.site", "metadata.url", "metadata.title", "metadata.language")


def shared_messages(t):
    return t.link_messages.select(
        "id", "mtype", "text", "reply_to", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "sender", F.lit("original").alias("text_source")
    )


CHAT_CHUNKS = f"""{CHAIN}, {PAGES}, {ENRICHED.replace('@BASE@', Q.strip_sql('l.text'))}
SELECT concat('chat_', e.id) AS id, e.text, r.topic, {Q.ratio_sql('e.text', 30, ('ar', 'fr', 'en', 'empty'))} AS language, e.id AS message_id,
 strftime(e.ts, '%Y-%m-%dT%H:%M:%S') AS date, e.sender FROM enriched e JOIN v_link_messages m ON m.id = e.id LEFT JOIN resolved r ON r.id = e.id
 WHERE e.mtype = 'message' AND length({Q.strip_sql('m.text')}) >= 20"""


R04_SQL = f"WITH RECURSIVE {CHAT_CHUNKS}"


def chat_rows(t):
    return corpus.chat_chunks(shared_messages(t), topics(t), corpus.page_index(t.pages))


@query("R04_chat_chunks", R04_SQL)
def _(t):
    return chat_rows(t).select("id", "text", "metadata.topic", "metadata.language", "metadata.message_id", "metadata.date", "metadata.sender")


@query("U01_corpus_union", f"""WITH RECURSIVE df AS ({DOCFILE}), {pack_sql('df', 'doc_id', 'text')}, {SCRAPED}, {pack_sql('sp', 'page_id', 'body').replace('pars', 'wpars').replace('fold', 'wfold').replace('packed', 'wpacked').replace('chunks', 'wchunks')}
SELECT 'pdf' AS source_type, count(*) AS n FROM chunks UNION ALL SELECT 'external' AS source_type, count(*) AS n FROM wchunks
UNION ALL SELECT 'chat' AS source_type, count(*) AS n FROM v_link_messages WHERE mtype = 'message' AND length({Q.strip_sql('text')}) >= 20""")
def _(t):
    everything = corpus.corpus_union(chat_rows(t), document_rows(t), web_rows(t))
    return everything.groupBy("metadata.source_type").agg(F.count("*").alias("n"))


# --- links -----------------------------------------------------------------------------


@query("U02_distinct_seed_urls", f"SELECT DISTINCT url FROM (SELECT {Q.canon_sql(FIRST_URL)} AS url FROM v_link_messages WHERE mtype = 'message') WHERE starts_with(url, 'http') AND NOT {Q.skip_sql('url')}")
def _(t):
    from palaver.sources.files import seed_urls

    return seed_urls(t.link_messages.where("mtype = 'message'"))


USEFUL = f"useful AS (SELECT url, {Q.host_sql('url')} AS host, length(body) AS chars FROM pidx WHERE length(body) >= 300)"


@query("R18_link_frontier", f"""WITH {PAGES}, {USEFUL}, seeds AS (SELECT DISTINCT {Q.canon_sql(FIRST_URL)} AS url FROM v_link_messages)
SELECT u.url, host, chars, 0 AS depth FROM useful u JOIN seeds s ON s.url = u.url""")
def _(t):
    from palaver.sources.files import seed_urls

    stored = corpus.page_index(t.pages).select("url", F.length("body").alias("chars")).where("chars >= 300")
    found = threads.link_frontier(seed_urls(t.link_messages, skip=False), threads.link_edges(t.pages), stored, depth=0)
    return found.select("url", "host", "chars", "depth")


@query("R18b_link_frontier_depth", f"""WITH {PAGES}, {USEFUL}, seeds AS (SELECT DISTINCT {Q.canon_sql(FIRST_URL)} AS url FROM v_link_messages),
reach AS (SELECT url, 0 AS depth FROM seeds UNION ALL SELECT link AS url, 1 AS depth FROM (
  SELECT DISTINCT link FROM ({Q.links_sql()}) l WHERE {Q.canon_sql('l.url')} IN (SELECT url FROM seeds)) WHERE link NOT IN (SELECT url FROM seeds))
SELECT u.url, host, chars, r.depth FROM useful u JOIN reach r ON r.url = u.url""")
def _(t):
    from palaver.sources.files import seed_urls

    stored = corpus.page_index(t.pages).select("url", F.length("body").alias("chars")).where("chars >= 300")
    found = threads.link_frontier(seed_urls(t.link_messages, skip=False), threads.link_edges(t.pages), stored, depth=1)
    return found.select("url", "host", "chars", "depth")


@query("W13_per_host_cap", f"SELECT url, host, position FROM (SELECT url, {Q.host_sql('url')} AS host, row_number() OVER (PARTITION BY {Q.host_sql('url')} ORDER BY url, page_id) AS position FROM pages) WHERE position <= 30")
def _(t):
    hosts = t.pages.select("page_id", "url", web.url_host(C("url")).alias("host"))
    return threads.per_host_cap(hosts, 30, ("url", "page_id")).select("url", "host", "position")


# --- sets ------------------------------------------------------------------------------


@query("W09_keep_first_duplicate", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def _(t):
    return corpus.keep_first(t.documents.select("doc_id", F.md5("text").alias("digest")), C("digest"), "doc_id")


SEEN = f"SELECT source, CASE WHEN bool_or(regexp_matches(text, '{lang.FRENCH_MARKS_SET}')) THEN 1 ELSE 0 END AS fr, CASE WHEN bool_or(NOT regexp_matches(text, '{Q.AR_WIDE}') AND NOT regexp_matches(text, '{lang.FRENCH_MARKS_SET}') AND regexp_matches(text, '[A-Za-z]')) THEN 1 ELSE 0 END AS en, CASE WHEN bool_or(regexp_matches(text, '{Q.AR_WIDE}')) THEN 1 ELSE 0 END AS ar FROM documents GROUP BY source"


@query("U04_covers_all", f"SELECT source, fr = 1 AND en = 1 AS bilingual, fr = 1 AND en = 1 AND ar = 1 AS polyglot FROM ({SEEN})")
def _(t):
    seen = t.documents.groupBy("source").agg(lang.lang_set(C("text")).alias("seen"))
    return seen.select(
        "source", lang.covers_all(C("seen"), ["en", "fr"]).alias("bilingual"), lang.covers_all(C("seen"), ["en", "fr", "ar"]).alias("polyglot")
    )


@query("U05_vocabulary_overlap", f"SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w IN {Q.PRESENCE}))) AS overlap FROM documents")
def _(t):
    return t.documents.select("doc_id", lang.vocabulary_overlap(C("text")).alias("overlap"))


@query("U07_set_difference_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.select("doc_id").exceptAll(t.labels.where("quality = 1").select("doc_id"))


# --- lines -----------------------------------------------------------------------------

CARDS = "SELECT doc_id, concat('TEAM', chr(10), chr(10), ' ', source, chr(10), text, chr(10), 'TEAM ', chr(10), lang, chr(10), 'TEAM') AS text FROM documents"


@query("A51_card_roster", f"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM ({CARDS})),
s AS (SELECT doc_id, list_transform(ls, lambda x: {Q.strip_sql('x')}) AS ls FROM l),
n AS (SELECT doc_id, k, CASE WHEN ls[k + 1] <> '' THEN ls[k + 1] WHEN ls[k + 2] <> '' THEN ls[k + 2] WHEN ls[k + 3] <> '' THEN ls[k + 3] END AS name
 FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM s) WHERE ls[k] = 'TEAM')
SELECT doc_id, count(*) AS n, string_agg(name, ', ' ORDER BY k) AS names FROM n WHERE name IS NOT NULL GROUP BY doc_id""")
def _(t):
    return corpus.card_roster(t.sql(CARDS), "TEAM")


@query("W15_first_non_blank_after", f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: {Q.strip_sql('x')}) AS ls FROM ({CARDS}))
SELECT doc_id, CASE WHEN ls[2] <> '' THEN ls[2] WHEN ls[3] <> '' THEN ls[3] ELSE ls[4] END AS first_name FROM l WHERE ls[1] = 'TEAM'""")
def _(t):
    return corpus.card_roster(t.sql(CARDS), "TEAM").select("doc_id", F.split("names", ", ")[0].alias("first_name"))
