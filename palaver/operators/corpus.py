"""From texts to chunks: merging, enriching, splitting, indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import lang, web
from palaver.functions import text as tx
from palaver.plans.scale import lookup, spread
from palaver.session import cut_lineage

C = F.col

# fixed values of the splitter
MAX_CHARS = 2000
OVERLAP = 250
LINK_EXCERPT = 1200
MIN_CHAT_CHARS = 20
OCR_MIN_CHARS = 20


# --- merging -------------------------------------------------------------------------


def ocr_merge(messages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Recognised text replaces the caption when long enough; the original is kept.

    ``ocr`` = (id, ocr_text), one row per message.
    """
    text = F.coalesce("ocr_text", F.lit(""))
    hit = C("_has").isNotNull()
    long_enough = F.length(text) >= OCR_MIN_CHARS
    joined = messages.join(ocr.select("id", "ocr_text", F.lit(1).alias("_has")), "id", "left")
    return (
        joined.withColumn("original_text", C("text"))
        .withColumn("text", F.when(hit & long_enough, text).otherwise(C("text")))
        .withColumn(
            "text_source",
            F.when(~hit, "original").when(long_enough, "ocr").otherwise("ocr_failed"),
        )
        .drop("ocr_text", "_has")
    )


def source_precedence(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native documents, and recognised ones whose composed stem is new.

    Inputs have ``file``.  Empty texts are dropped by the reader.  Of several
    recognised files with one stem the first by name stays.
    """
    by_stem = [d.withColumn("stem", tx.nfc(tx.stem(C("file")))) for d in (native, ocr)]
    w = W.partitionBy("stem").orderBy("file")
    first = by_stem[1].withColumn("_n", F.row_number().over(w)).where(C("_n") == 1).drop("_n")
    fresh = first.join(by_stem[0].select("stem").distinct(), "stem", "left_anti")
    return (
        by_stem[0].withColumn("text_source", F.lit("original"))
        .unionByName(fresh.withColumn("text_source", F.lit("ocr")))
    )


def index_delta(chunks: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """Chunks whose id is not stored yet."""
    return chunks.join(indexed.select(key), key, "left_anti")


def ocr_resume(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached rows above 20 characters and the targets still to do, by id."""
    done = cache.where("char_count > 20")
    todo = targets.join(done.select("id"), "id", "left_anti")
    return (
        done.select("id", "char_count", F.lit("cached").alias("state"))
        .unionByName(todo.select("id", F.lit(None).cast("bigint").alias("char_count"), F.lit("todo").alias("state")))
        .orderBy("id")
    )


def modified_cache(listed: DataFrame, cached: DataFrame) -> DataFrame:
    """Per link: unchanged, changed, new or removed.  Inputs = (link, modified)."""
    both = listed.select("link", C("modified").alias("now"), F.lit(1).alias("_l")).join(
        cached.select("link", C("modified").alias("before"), F.lit(1).alias("_c")), "link", "full_outer"
    )
    state = (
        F.when(C("_c").isNull(), "new")
        .when(C("_l").isNull(), "removed")
        .when(C("now").eqNullSafe(C("before")), "unchanged")
        .otherwise("changed")
    )
    return both.select("link", state.alias("state"))


def orphans(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is not in the new manifest."""
    return stored.join(expected.select(key), key, "left_anti")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """First row per key.  A minimum of structs combines map side, so a key
    with very many copies never gathers them."""
    cols = df.columns
    best = F.min_by(F.struct(*cols), C(order))
    return df.groupBy(key.alias("_k")).agg(best.alias("r")).select("r.*")


def last_known_good(previous: DataFrame, fresh: DataFrame, marker: str, at_least: int = 10) -> DataFrame:
    """Per source keep the previous version when the new one has too few markers.

    Inputs = (source, text).
    """
    from pyspark.sql.functions import regexp_count

    import re

    n = regexp_count(C("text"), F.lit(re.escape(marker)))
    new = fresh.select("source", C("text").alias("_new"), n.alias("_n"))
    old = previous.select("source", C("text").alias("_old"))
    keep_old = C("_old").isNotNull() & (F.coalesce("_n", F.lit(0)) < at_least)
    return new.join(old, "source", "full_outer").select(
        "source",
        F.when(keep_old, C("_old")).otherwise(C("_new")).alias("text"),
        F.when(keep_old, "previous").otherwise("new").alias("version"),
    )


# --- enriching -------------------------------------------------------------------------


def link_enrich(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """Append title and excerpt of every stored page a message links to.

    ``messages`` has (id, text); ``pages`` = (url, title, body), one row per
    canonical url.  Only ids and addresses go through the join; a popular
    address is a hot key and handled as such.
    """
    seen = F.array_distinct(F.transform(web.extract_urls(C("text")), web.canonical_url))
    mentions = (
        messages.select("id", F.posexplode_outer(seen).alias("pos", "url")).where(C("url").isNotNull())
    )
    title = F.trim(F.coalesce("title", F.lit("")))
    header = F.concat(
        F.lit("— Linked page: "), C("url"),
        F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(""),
    )
    pieces = pages.where(F.coalesce("body", F.lit("")) != "").select(
        "url", F.concat(F.lit("\n\n"), header, F.lit("\n"), tx.excerpt(C("body"), LINK_EXCERPT, " […truncated]")).alias("piece")
    )
    found = lookup(mentions, pieces, "url", how="inner")
    # a message has as many links as its text has room for
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    added = found.groupBy("id").agg(
        F.concat_ws("", F.transform(ordered, lambda p: p["piece"])).alias("_added"), F.count("*").alias("n_links")
    )
    return (
        messages.join(added, "id", "left")
        .withColumn("text", F.concat("text", F.coalesce("_added", F.lit(""))))
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        .drop("_added")
    )


def page_index(pages: DataFrame) -> DataFrame:
    """(url, title, body) per canonical address; the latest page wins.

    The extracted texts are written once: every user reads them several times.
    """
    canon = pages.select("page_id", web.canonical_url(C("url")).alias("url"), "html")
    latest = canon.groupBy("url").agg(F.max_by("html", "page_id").alias("html"))
    return cut_lineage(
        spread(latest).select("url", web.html_title(C("html")).alias("title"), web.strip_html(C("html")).alias("body"))
    )


# --- splitting -------------------------------------------------------------------------


def pack_paragraphs(text: Column, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed into pieces of at most ``limit`` characters.

    A longer paragraph closes the piece before it and is cut into windows that
    overlap.  Everything happens within the row.
    """
    texts = "array<string>"
    paragraphs = F.filter(F.transform(F.split(tx.strip(text), "\n\n"), tx.strip), lambda p: p != "")

    def windows(p: Column) -> Column:
        stride = limit - overlap
        last = F.ceil((F.length(p) - limit) / stride).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: p.substr(i * stride + 1, F.lit(limit))
        )

    def flushed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + 2 + F.length(p) <= limit

        def state(done: Column, opened: Column) -> Column:
            return F.struct(done.alias("done"), opened.alias("open"))

        return (
            F.when(F.length(p) > limit, state(F.concat(flushed(acc), windows(p)), F.lit("")))
            .when(acc["open"] == "", state(acc["done"], p))
            .when(fits, state(acc["done"], F.concat(acc["open"], F.lit("\n\n"), p)))
            .otherwise(state(flushed(acc), p))
        )

    start = F.struct(F.array().cast(texts).alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, start, step, flushed)


def stitch(pieces: Column, overlap: int = OVERLAP) -> Column:
    """Each piece but the first starts with the tail of the raw piece before it."""
    return F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.right(F.get(pieces, i - 1), F.lit(overlap)), F.lit("\n\n"), p)
        ),
    )


def chunk_text(df: DataFrame, text: str = "text", limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_index`` and the chunk."""
    others = [c for c in df.columns if c != text]
    # the pieces get their own projection: they are used twice by ``stitch``
    pieces = spread(df).select(*others, pack_paragraphs(C(text), limit, overlap).alias("_pieces"))
    return pieces.select(*others, F.posexplode_outer(stitch(C("_pieces"), overlap)).alias("chunk_index", "text")).where(
        C("text").isNotNull()
    )


def _metadata(**values: Column) -> Column:
    string, number = "string", "bigint"
    types = {
        "source_type": string, "topic": string, "language": string, "message_id": number, "pdf_file": string,
        "chunk_index": "int", "date": string, "sender": string, "text_source": string, "site": string,
        "url": string, "title": string,
    }
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]).alias("metadata")


def document_chunks(docs: DataFrame) -> DataFrame:
    """(id, text, metadata) of documents (file, text, text_source)."""
    chunks = chunk_text(docs.select("file", "text_source", tx.document_key(C("file")).alias("_key"), "text"))
    return chunks.select(
        F.concat(F.lit("pdf_"), C("_key"), F.lit("_"), C("chunk_index").cast("string")).alias("id"),
        "text",
        _metadata(
            source_type=F.lit("pdf"), language=lang.lang_ratio(C("text")), pdf_file=C("file"),
            chunk_index=C("chunk_index"), text_source=C("text_source"),
        ),
    )


def web_chunks(pages: DataFrame) -> DataFrame:
    """(id, text, metadata) of scraped pages (site, slug, headers, body).

    The language comes from the header, else from the body.
    """

    def header(name: str) -> Column:
        return F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))

    named = pages.where(C("body") != "").select(
        "site", "slug", C("body").alias("text"), header("Source").alias("url"), header("Title").alias("title"),
        header("Modified").alias("modified"),
        F.when(header("Language") != "", header("Language")).otherwise(lang.lang_ratio(C("body"))).alias("language"),
    )
    return chunk_text(named).select(
        F.concat_ws("_", F.lit("ext"), "site", "slug", C("chunk_index").cast("string")).alias("id"),
        "text",
        _metadata(
            source_type=F.lit("external"), language=C("language"), chunk_index=C("chunk_index"), date=C("modified"),
            text_source=F.lit("scraped"), site=C("site"), url=C("url"), title=C("title"),
        ),
    )


def chat_chunks(messages: DataFrame, topics: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, text, metadata): one chunk per long enough content message, with
    its topic and the pages it links to.

    ``messages`` = (id, mtype, text, reply_to, date, sender, text_source).
    """
    from palaver.operators.threads import resolve_topics

    content = (
        messages.where(C("mtype") == "message")
        .withColumn("text", tx.strip(C("text")))
        .where(F.length("text") >= MIN_CHAT_CHARS)
    )
    topic = resolve_topics(messages.select("id", "reply_to"), topics)
    return (
        link_enrich(content, pages)
        .join(topic, "id", "left")
        .select(
            F.concat(F.lit("chat_"), C("id").cast("string")).alias("id"),
            "text",
            _metadata(
                source_type=F.lit("chat"), topic=C("topic"), language=lang.lang_ratio(C("text")), message_id=C("id"),
                date=C("date"), sender=C("sender"), text_source=C("text_source"),
            ),
        )
    )


def corpus_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- matching files and citations ------------------------------------------------------------


def file_to_message(documents: DataFrame, messages: DataFrame) -> DataFrame:
    """Document (file) with the message that posted it (id, file); the later
    message wins when a name was posted twice."""
    posted = (
        messages.where(F.lower("file").endswith(".pdf"))
        .select("id", F.regexp_extract("file", r"([^/]*)$", 1).alias("original"))
        .withColumn("key", tx.nfc(tx.attachment_key(C("original"))))
        .groupBy("key")
        .agg(F.max("id").alias("message_id"), F.max_by("original", "id").alias("original"))
    )
    return documents.withColumn("key", tx.nfc(C("file"))).join(posted, "key")


def citation_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, number, id): cited ids that were retrieved, numbered by first
    appearance.  One answer cites what fits its text."""
    from palaver.functions.citations import citation_ids, is_refusal

    cited = (
        answers.where(~is_refusal(C("answer")))
        .select("answer_id", F.posexplode_outer(F.array_distinct(citation_ids(C("answer")))).alias("pos", "id"))
        .where(C("id").isNotNull())
    )
    known = cited.join(sources.select("answer_id", "id").distinct(), ["answer_id", "id"])
    w = W.partitionBy("answer_id").orderBy("pos")
    return known.select("answer_id", F.row_number().over(w).alias("number"), "id")


def card_roster(docs: DataFrame, marker: str, look_ahead: int = 3) -> DataFrame:
    """Names that follow a marker line: first non-blank of the next lines.

    Works inside each document: (doc_id, n, names).
    """
    lines = F.transform(F.split("text", "\r\n|\r|\n"), tx.strip)
    rows = docs.select("doc_id", lines.alias("_l"))

    def after(i: Column) -> Column:
        window = F.slice(C("_l"), i + 2, look_ahead)
        return F.get(F.filter(window, lambda v: v != ""), F.lit(0))

    names = F.filter(
        F.transform(C("_l"), lambda line, i: F.when(line == marker, after(i))), lambda n: n.isNotNull()
    )
    return rows.select("doc_id", names.alias("_n")).where(F.size("_n") > 0).select(
        "doc_id", F.size("_n").alias("n"), F.array_join("_n", ", ").alias("names")
    )
