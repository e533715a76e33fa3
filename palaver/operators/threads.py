"""Reply chains and link graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import web
from palaver.plans.scale import lookup
from palaver.session import cut_lineage, scratch_table

C = F.col


def resolve_topics(messages: DataFrame, topics: DataFrame, *, max_rounds: int | None = None) -> DataFrame:
    """(id, topic) of every message whose chain of replies reaches a topic.

    ``messages`` = (id, reply_to), ``topics`` = (id, title).  Pointers double
    each round, so a chain of length n takes log2(n) joins.  Rows drop out as
    soon as they settle; chains that end or break vanish, and what is left
    after the last useful round lies on a cycle and stays without a topic.
    """
    titles = topics.select(C("id").alias("ptr"), F.struct(C("title").alias("v")).alias("_t"))
    edges = messages.where(C("reply_to").isNotNull()).select("id", C("reply_to").alias("ptr"))
    spark, path = messages.sparkSession, scratch_table(messages.sparkSession, "settled")
    state = cut_lineage(lookup(edges, titles, "ptr"))
    rounds = max_rounds
    for _ in range(64):
        # rows that have settled are written once and stay; only open ones move on
        state.where(C("_t").isNotNull()).select("id", "_t").write.mode("append").parquet(path)
        open_rows = state.where(C("_t").isNull()).drop("_t")
        left = open_rows.count()
        if left == 0 or rounds == 0:
            break
        if rounds is None:
            rounds = math.ceil(math.log2(left + 1)) + 1
        rounds -= 1
        settled = spark.read.parquet(path).select(C("id").alias("ptr"), F.lit(None).cast(open_rows.schema["ptr"].dataType).alias("_next"), C("_t").alias("_found"))
        step = settled.unionByName(open_rows.select(C("id").alias("ptr"), C("ptr").alias("_next"), F.lit(None).cast(settled.schema["_found"].dataType).alias("_found")))
        moved = lookup(open_rows, step, "ptr", how="inner").select("id", C("_next").alias("ptr"), C("_found").alias("_t"))
        state = cut_lineage(moved)
    return spark.read.schema(state.select("id", "_t").schema).parquet(path).select("id", C("_t.v").alias("topic"))


def reply_chain_topic(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Content messages with their topic, NULL where the chain finds none."""
    return messages.where(C("mtype") == "message").join(
        resolve_topics(messages.select("id", "reply_to"), topics), "id", "left"
    )


def direct_topic(messages: DataFrame, topics: DataFrame, default: str = "General") -> DataFrame:
    """Content messages with the title of their direct parent, else ``default``."""
    titles = topics.select(C("id").alias("reply_to"), C("title").alias("_title"))
    content = messages.where(C("mtype") == "message")
    return lookup(content, titles, "reply_to").withColumn("topic", F.coalesce("_title", F.lit(default))).drop("_title")


def per_host_cap(pages: DataFrame, cap: int = 30, order: tuple[str, ...] = ("depth", "url")) -> DataFrame:
    """At most ``cap`` pages per host; pruned to cap rows before the shuffle."""
    w = W.partitionBy("host").orderBy(*order)
    return pages.withColumn("position", F.row_number().over(w)).where(C("position") <= cap)


def link_edges(pages: DataFrame, covered_hosts=()) -> DataFrame:
    """(url, link): canonical address of a page and each same-host link on it."""
    found = pages.select(
        C("url").alias("page"), F.explode_outer(web.page_links(C("html"), C("url"), covered_hosts)).alias("link")
    )
    return found.where(C("link").isNotNull()).select(web.canonical_url(C("page")).alias("url"), "link")


def link_frontier(seeds: DataFrame, edges: DataFrame, stored: DataFrame, depth: int = 0, cap: int | None = None) -> DataFrame:
    """Stored, useful pages reached from the seeds in at most ``depth`` steps.

    ``seeds`` = (url), ``edges`` = (url, link), ``stored`` = (url, chars).  A
    page counts once, at its least depth; with ``cap`` a host yields that many pages.
    """
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for d in range(1, depth + 1):
        nxt = (
            edges.join(frontier.select("url"), "url", "left_semi")
            .select(C("link").alias("url"))
            .distinct()
            .join(reached.select("url"), "url", "left_anti")
            .withColumn("depth", F.lit(d))
        )
        frontier = cut_lineage(nxt)
        reached = reached.unionByName(frontier)
    useful = stored.join(reached, "url").withColumn("host", web.url_host(C("url")))
    return useful if cap is None else per_host_cap(useful, cap)
