"""Folders of text files, scraped trees, manifests and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions import web

C = F.col

HEADER_LINE = r"^\[([\p{L}\p{N}_\- ]+):\s*(.*?)\]$"

MANIFEST_SCHEMA = (
    "map<string,struct<host:string,file:string,title:string,chars:int,backend:string,fetched_at:string>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, stem, text) of the non-empty ``*.txt`` files of a folder; Spark
    hides names that start with ``_``.  One file is one row."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return document_files(raw.select(_decoded(C("_metadata.file_name")).alias("path"), C("value").alias("content")))


def document_files(files: DataFrame) -> DataFrame:
    """(file, stem, text) of files given as (path, content); empty ones are dropped."""
    named = files.where(C("content") != "").select(F.substring_index("path", "/", -1).alias("file"), C("content").alias("text"))
    return named.withColumn("stem", tx.nfc(tx.stem(C("file"))))


def _decoded(name: Column) -> Column:
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def parse_header_block(text: Column) -> tuple[Column, Column]:
    """(headers map, body): leading ``[Key: value]`` lines, then the rest.

    The block ends at the first blank line, which is consumed, or at the first
    other line, which is kept.  A repeated key keeps its last value.
    """
    lines = F.split(text, "\r\n|\r|\n")
    trimmed = F.transform(lines, tx.strip)
    is_header = F.transform(trimmed, lambda line: line.rlike(HEADER_LINE))
    n_all = F.size(lines)
    stop = F.array_position(is_header, F.lit(False)).cast("int")  # 0 when every line is a header
    n_head = F.when(stop == 0, n_all).otherwise(stop - 1)
    blank = F.coalesce(F.get(trimmed, n_head) == "", F.lit(False))
    head = F.slice(trimmed, F.lit(1), n_head)
    pairs = F.transform(
        head,
        lambda line: F.struct(
            tx.strip(F.regexp_extract(line, HEADER_LINE, 1)).alias("key"),
            tx.strip(F.regexp_extract(line, HEADER_LINE, 2)).alias("value"),
        ),
    )
    # last value wins: drop an earlier pair whose key comes again
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, n_all), lambda later: later["key"] == p["key"]),
    )
    rest = F.slice(lines, n_head + 1 + blank.cast("int"), n_all)
    return F.map_from_entries(last), tx.strip(F.array_join(rest, "\n"))


def read_scraped(spark: SparkSession, root: str) -> DataFrame:
    """(site, slug, headers, body) of a tree of scraped pages.

    The site is the first folder; below ``chat_links`` the second folder is the
    host, which then leads the slug so that equal stems do not collide.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace(C("_metadata.file_path"), r"^[a-z]+:/*", "/")
    return scraped_files(raw.select(_decoded(path).alias("path"), C("value").alias("content")), base)


def scraped_files(files: DataFrame, base: str) -> DataFrame:
    """``read_scraped`` on files given as (path, content) below the folder ``base``."""
    rel = F.split(F.replace("path", F.lit(base.rstrip("/") + "/"), F.lit("")), "/")
    headers, body = parse_header_block(C("content"))
    stem = tx.stem(F.element_at(rel, -1))
    return (
        files.where(~F.startswith(F.element_at(rel, -1), F.lit("_")))
        .select(
            rel[0].alias("site"),
            F.when((rel[0] == "chat_links") & (F.size(rel) >= 3), F.concat(rel[1], F.lit("__"), stem))
            .otherwise(stem)
            .alias("slug"),
            headers.alias("headers"),
            body.alias("body"),
        )
        .where(C("body") != "")
    )


def manifest_rows(raw: DataFrame, json: str = "value", order: str | None = None) -> DataFrame:
    """Rows of map-shaped manifests, one per canonical url; entries that are
    not objects are dropped, a later entry replaces an earlier one.  ``order``
    ranks several manifests."""
    loose = F.from_json(json, "map<string,string>")
    entry = F.from_json("text", MANIFEST_SCHEMA.replace("map<string,", "", 1)[:-1])
    rows = (
        raw.select((C(order) if order else F.lit(0)).alias("o"), F.posexplode(F.map_entries(loose)).alias("p", "e"))
        .select(F.struct("o", "p").alias("pos"), web.canonical_url(C("e.key")).alias("url"), C("e.value").alias("text"))
        .where(F.ltrim(F.coalesce("text", F.lit(""))).startswith("{"))
        .select("pos", "url", entry.alias("entry"))
    )
    return rows.groupBy("url").agg(F.max_by("entry", "pos").alias("entry")).select("url", "entry.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(spark.read.text(path, wholetext=True))


def read_summary(spark: SparkSession, path: str, schema: str, *, one_per_line: bool = False) -> DataFrame:
    """A JSON array of summary rows, or one row per line; a missing file gives
    no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path, multiLine=not one_per_line, schema=schema)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def seed_urls(messages: DataFrame, covered_hosts=(), *, entities: str | None = None, skip: bool = True) -> DataFrame:
    """Distinct canonical addresses found in texts and link entities."""
    urls = F.transform(web.extract_urls(C("text")), web.canonical_url)
    found = messages.select(F.explode_outer(urls).alias("url"))
    if entities:
        hrefs = F.filter(F.transform(entities, lambda e: e["href"]), lambda h: F.startswith(h, F.lit("http")))
        found = found.unionByName(messages.select(F.explode_outer(F.transform(hrefs, web.canonical_url)).alias("url")))
    kept = found.where(C("url").isNotNull()).distinct().where(F.startswith("url", F.lit("http")))
    return kept.where(~web.crawl_skip(C("url"), covered_hosts)) if skip else kept


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, body) of stored HTML, every entity decoded."""
    return pages.select(
        "page_id", "url", web.html_title(C("html"), unescape=web.unescape_all).alias("title"),
        web.strip_html(C("html"), unescape=lambda c: web.unescape_all(web.unescape_all(c))).alias("body"),
    )
