"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions import web
from palaver.operators import activity as act
from palaver.operators import corpus
from palaver.plans import q_evaluate as E
from palaver.plans import q_text as Q
from palaver.plans.registry import query
from palaver.session import scratch_table
from palaver.sources import chat, files, sinks

C = F.col


@query("S01_chat_export_source", "SELECT conv_id * 10000 + turn AS id, CASE WHEN turn = 0 THEN 'service' ELSE 'message' END AS type, text, role AS sender FROM conversations")
def _(t):
    message = F.struct(
        (C("conv_id") * 10000 + C("turn")).alias("id"), F.when(C("turn") == 0, "service").otherwise("message").alias("type"),
        "text", C("role").alias("from"),
    )
    # one export per conversation and thousand turns, so that no document is unbounded
    part = F.floor(C("turn") / 1000)
    exports = t.conversations.groupBy("conv_id", part.alias("part")).agg(F.collect_list(message).alias("messages"))
    document = F.to_json(F.struct(F.struct(F.array(F.struct("messages")).alias("list")).alias("chats")))
    path = scratch_table(t.spark, "exports")
    exports.select(document.alias("value")).write.text(path)
    rows = chat.read_export(t.spark, path, one_per_line=True)
    return rows.select("id", "type", chat.flatten_text(C("text")).alias("text"), C("from").alias("sender"))


@query("S02_document_text_source", "SELECT concat(source, ' n°', doc_id, '.txt') AS file, concat(source, ' n°', doc_id) AS stem, text FROM documents WHERE text <> ''")
def _(t):
    """Texts as files of a folder; beside each lies an empty file, which does not count."""
    path = F.concat(F.lit("/texts/"), C("source"), F.lit(" n°"), C("doc_id").cast("string"), F.lit(".txt"))
    empty = t.documents.select(F.concat(path, F.lit(".empty.txt")).alias("path"), F.lit("").alias("content"))
    return files.document_files(t.documents.select(path.alias("path"), C("text").alias("content")).unionByName(empty)).select("file", "stem", "text")


@query("S03_scraped_tree_source", f"""SELECT CASE WHEN page_id % 3 = 0 THEN 'chat_links' ELSE host END AS site, CASE WHEN page_id % 3 = 0 THEN concat(host, '__p.', page_id) ELSE concat('p.', page_id) END AS slug,
 url AS source, body FROM (SELECT page_id, url, {Q.host_sql('url')} AS host, {Q.html_sql('html')} AS body FROM pages) WHERE body <> ''""")
def _(t):
    """Pages as files below their host; those shared in chats lie one folder deeper; beside each lies a hidden copy, which does not count."""
    host, name = web.url_host(C("url")), F.concat(F.lit("p."), C("page_id").cast("string"), F.lit(".txt"))
    folder = F.when(C("page_id") % 3 == 0, F.concat(F.lit("chat_links/"), host)).otherwise(host)
    content = F.concat(F.lit("[Source: "), C("url"), F.lit("]\n\n"), web.strip_html(C("html")))
    tree = t.pages.select(F.explode(F.array(*[F.concat(F.lit("/data/web/"), folder, F.lit(f"/{mark}"), name) for mark in ("", "_")])).alias("path"), content.alias("content"))
    return files.scraped_files(tree, "/data/web").select("site", "slug", F.try_element_at("headers", F.lit("Source")).alias("source"), "body")


@query("S04_header_block_parse", f"SELECT page_id, url AS source, {Q.TITLE_SQL} AS title, {Q.html_sql('html')} AS body FROM pages")
def _(t):
    stored = F.concat(
        F.lit("[Source: "), C("url"), F.lit("]\n[Title: "), web.html_title(C("html")), F.lit("]\n\n"), web.strip_html(C("html"))
    )
    texts = t.pages.select("page_id", stored.alias("value"))
    headers, body = files.parse_header_block(C("value"))
    return texts.select("page_id", headers.alias("h"), body.alias("body")).select(
        "page_id", F.try_element_at("h", F.lit("Source")).alias("source"), F.try_element_at("h", F.lit("Title")).alias("title"), "body"
    )


@query("S05_manifest_source", f"SELECT {Q.canon_sql('url')} AS url, max_by(length(html), page_id) AS chars, max_by({Q.host_sql('url')}, page_id) AS host FROM pages GROUP BY 1")
def _(t):
    entry = F.to_json(F.struct(web.url_host(C("url")).alias("host"), F.length("html").alias("chars")))
    manifest = F.concat(F.lit('{"note":"x",'), F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2), F.lit(":"), entry, F.lit("}"))
    return files.manifest_rows(t.pages.select("page_id", manifest.alias("value")), order="page_id").select("url", "chars", "host")


@query("S06_summary_source", "SELECT doc_id AS file, lang AS language, n_chars AS chars FROM documents")
def _(t):
    """Summary rows written as JSON and read back; a missing summary adds none."""
    schema = "file bigint, language string, chars bigint"
    path = scratch_table(t.spark, "summary")
    t.documents.select(C("doc_id").alias("file"), C("lang").alias("language"), C("n_chars").alias("chars")).write.json(path)
    missing = files.read_summary(t.spark, path + "-none", schema)
    return files.read_summary(t.spark, path, schema, one_per_line=True).unionByName(missing)


@query("S08_incremental_message_ingest", "SELECT id FROM v_messages WHERE id > (SELECT coalesce(max(id), 0) FROM v_messages WHERE id > 0 AND sender = 'system')")
def _(t):
    return sinks.new_messages(t.messages, t.messages.where("sender = 'system'")).select("id")


RAW = """SELECT event_id AS id, CASE WHEN event_type IN ('signup', 'error') THEN 'service' ELSE 'message' END AS kind, ts, CASE WHEN user_id % 9 = 0 THEN 'channel' ELSE 'user' END AS peer_kind, user_id AS peer_id,
 concat('u', CAST(user_id AS VARCHAR(20))) AS peer_name, CASE event_type WHEN 'signup' THEN 'TopicCreate' WHEN 'error' THEN 'GameScore' END AS action_code, event_type AS title, props AS body,
 CASE WHEN event_type = 'click' THEN event_id - 1 ELSE 0 END AS reply_to_id, CASE WHEN event_type <> 'view' THEN user_id END AS reply_root_id,
 CASE event_type WHEN 'purchase' THEN 'photo' WHEN 'view' THEN 'document' END AS media_kind, concat(event_type, '.pdf') AS media_name, CASE WHEN user_id > 20 THEN 'application/pdf' END AS media_type FROM events"""


@query("S09_record_normalise", f"""SELECT id, kind AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS date_unixtime,
 CASE WHEN kind = 'message' THEN peer_name END AS "from", CASE WHEN kind = 'message' THEN concat(peer_kind, peer_id) END AS from_id, CASE WHEN kind = 'service' THEN peer_name END AS actor,
 CASE WHEN kind = 'service' THEN concat(peer_kind, peer_id) END AS actor_id, CASE WHEN kind = 'service' THEN 'topic_created' END AS action, CASE WHEN kind = 'service' THEN title END AS title,
 CASE WHEN kind = 'service' THEN '' ELSE body END AS text, CASE WHEN kind = 'message' THEN coalesce(CASE WHEN reply_to_id <> 0 THEN reply_to_id END, reply_root_id) END AS reply_to_message_id,
 CASE WHEN kind = 'message' AND media_kind = 'photo' THEN concat('photos/photo_', id, '@', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.jpg') END AS photo,
 CASE WHEN kind = 'message' AND media_kind = 'document' THEN 'files/' || media_name END AS file, CASE WHEN kind = 'message' AND media_kind = 'document' THEN media_name END AS file_name,
 CASE WHEN kind = 'message' AND media_kind = 'document' THEN coalesce(media_type, '') END AS mime_type FROM ({RAW}) WHERE kind = 'message' OR action_code = 'TopicCreate'""")
def _(t):
    raw = t.sql(RAW).withColumn("ts", C("ts").cast("timestamp"))
    return chat.normalise_records(raw)


@query("S10_entity_span_cover", """SELECT doc_id, CASE WHEN length(text) >= 30 THEN 'plain,bold,link,plain' ELSE 'short' END AS kinds, text FROM documents WHERE length(text) >= 30
UNION ALL SELECT doc_id, 'plain' AS kinds, text FROM documents WHERE length(text) < 30 AND text <> '' UNION ALL SELECT doc_id, '' AS kinds, text FROM documents WHERE text = ''""")
def _(t):
    def span(a, n, kind):
        return F.struct(F.lit(a).alias("offset"), F.lit(n).alias("length"), F.lit(kind).alias("type"))

    spans = F.array(span(12, 9, "link"), span(5, 4, "italic"), span(5, 7, "bold"), span(7, 2, "code"))
    none = F.array().cast("array<struct<offset:int,length:int,type:string>>")
    pieces = chat.cover_spans(C("text"), F.when(F.length("text") >= 30, spans).otherwise(none))
    return t.documents.select("doc_id", pieces.alias("p")).select(
        "doc_id", F.array_join(F.transform("p", lambda x: x["type"]), ",").alias("kinds"),
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"),
    )


@query("S11_chunk_index_write", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(t):
    """Writes half of the vectors, then all: the second write adds the rest."""
    path = scratch_table(t.spark, "index")
    chunks = t.embeddings.select(C("vec_id").cast("string").alias("id"), "embedding", "label")
    sinks.write_index(chunks.where("label < 5"), path)
    sinks.write_index(chunks, path)
    return t.spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


@query("S12_turn_append", "SELECT chat_id, user_id, CAST(row_number() OVER (PARTITION BY chat_id, user_id ORDER BY role = 'assistant', id) - 1 AS INT) AS turn_idx, role FROM v_turns WHERE role <> 'system'")
def _(t):
    """Appends the questions, then the answers, and reads the numbered table."""
    path = scratch_table(t.spark, "turns")
    for role in ("user", "assistant"):
        batch = t.turns.where(C("role") == role).select("chat_id", "user_id", C("id").alias("seq"), "role", "refused", "rerank")
        sinks.append_turns(batch, path)
    return t.spark.read.parquet(path).select("chat_id", "user_id", "turn_idx", "role")


@query("S14_write_if_changed", "SELECT count(*) AS rows, 'true,false,true' AS wrote FROM labels WHERE toxic = 0")
def _(t):
    """Three writes: new, unchanged (another row order), changed."""
    base = scratch_table(t.spark, "labels")
    first = sinks.write_if_changed(t.labels, base)
    second = sinks.write_if_changed(t.labels.orderBy(C("doc_id").desc()), base)
    third = sinks.write_if_changed(t.labels.where("toxic = 0"), base)
    wrote = F.array(F.lit(first), F.lit(second), F.lit(third))
    return sinks.read_current(t.spark, base).agg(F.count("*").alias("rows")).withColumn("wrote", F.array_join(wrote.cast("array<string>"), ","))


@query("S15_orphan_prune", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return sinks.prune_orphans(t.documents, t.labels.where("quality = 1"), "doc_id").select("doc_id")




@query("S16_last_known_good_guard", """WITH p AS (SELECT doc_id AS source, 'old' AS text FROM documents WHERE lang <> 'es'), f AS (SELECT doc_id AS source, text FROM documents)
SELECT f.source, CASE WHEN p.source IS NOT NULL AND len(regexp_extract_all(f.text, ' the ')) < 10 THEN 'previous' ELSE 'new' END AS version FROM f LEFT JOIN p ON p.source = f.source""")
def _(t):
    fresh = t.documents.select(C("doc_id").alias("source"), "text")
    before = t.documents.where("lang <> 'es'").select(C("doc_id").alias("source"), F.lit("old").alias("text"))
    return corpus.last_known_good(before, fresh, " the ", 10).select("source", "version")


@query("S17_status_snapshot_write")
def _(t):
    now = t.messages.agg(F.max("ts")).scalar()
    document = sinks.status_snapshot(
        now, chat=act.chat_totals(t.messages), topics=act.topic_counts(t.frame), index=act.index_section(t.corpus, " the "),
        languages=act.docs_and_chars(t.documents, "lang", "n_chars"),
    )
    path = scratch_table(t.spark, "status")
    document.write.text(path)
    return t.spark.read.text(path)


@query("S18_report_write")
def _(t):
    from palaver.operators import evaluate as ev
    from palaver.session import cut_lineage

    run = cut_lineage(E.run(t))
    lines = sinks.report_lines(
        "Retrieval", headline=ev.recall_overall(run), by_set=ev.recall_by(run, C("qset")), by_category=ev.recall_by(run, C("category")),
        positions=ev.first_hit_histogram(run), scores=ev.score_distribution(run),
        misses=run.where("NOT any_hit").select("qid", "qset", "category"),
        refusals=run.where("must_refuse").select("qid", "qset", F.round("top1_score", 3).alias("top1_score")),
        per_query=run.select("qid", "qset", "category", "first_hit", F.round("top1_score", 3).alias("top1_score")),
    )
    path = scratch_table(t.spark, "report")
    lines.select("line").write.text(path)
    return lines


@query("S19_ops_table_source", "SELECT event_id, user_id, event_type, ts FROM events")
def _(t):
    return sinks.read_ops_table(t.spark, f"{t.folder}/events.parquet", "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz")




@query("S20_page_text_source", f"SELECT page_id, {Q.TITLE_SQL} AS title, {Q.html_sql('html', 2)} AS body FROM pages")
def _(t):
    return files.page_text(t.pages).select("page_id", "title", "body")


@query("S21_freshness_rebuild_rule", """WITH m AS (SELECT event_type AS source, max(ts) AS modified FROM events GROUP BY event_type), i AS (SELECT max(ts) AS built FROM events WHERE event_type = 'click')
SELECT source, modified, modified > (SELECT built FROM i) AS newer, (SELECT bool_or(modified > (SELECT built FROM i)) FROM m) AS rebuild FROM m""")
def _(t):
    index_time = t.events.where("event_type = 'click'").agg(F.max("ts")).scalar()
    return sinks.must_rebuild(t.events.select(C("event_type").alias("source"), C("ts").alias("modified")), index_time)


@query("U08_link_union", r"""SELECT page_id, array_to_string(list_distinct_kept, ' ') AS links FROM (SELECT page_id, CASE WHEN list_contains(h, url) THEN h ELSE list_append(h, url) END AS list_distinct_kept FROM (
 SELECT page_id, url, list_filter(hs, lambda x, i: x <> '' AND list_position(hs, x) = i) AS h FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages)))""")
def _(t):
    """The links of a page as spans of an array text, its address as an entity."""
    def span(kind, href):
        return F.struct(F.lit(kind).alias("type"), href.alias("text"), href.alias("href"))

    found = F.regexp_extract_all("html", F.lit(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    spans = F.transform(found, lambda h: span("text_link", h))
    entities = F.array(span("link", C("url")), span("bold", C("url")))
    return t.pages.select(
        "page_id", F.array_join(chat.link_union(F.parse_json(F.to_json(spans)), entities), " ").alias("links")
    )
