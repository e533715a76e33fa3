"""Lexical and dense rankings, their fusion and diversification.

All queries are ranked in one job.  Columns: ``qid`` names a query, ``id`` a
document, both of any type that sorts.  A query of several wordings has one row
per (``qid``, ``variant``).  Only ids and scores travel; text is joined to the
final rows.  Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions.tasks import DEAD, LIVE, NAMED, Bm25, best_ranges, dense_scan, open_ranges, postings_scan
from palaver.functions.text import tokenize
from palaver.operators.activity import metadata_filter
from palaver.operators.postings import LexicalIndex, by_range
from palaver.plans.scale import checked_broadcast, scalar, spread
from palaver.session import cut_lineage, scratch_table

C = F.col

# fixed values of the search
PER_RANKER = 60
POOL = 30
RRF_K = 60
MAX_PER_DOC = 1
MAX_PER_SITE = 2
K1, B, NEGATIVE_IDF = 1.5, 0.75, 0.25
DIGITS = 9  # scores are compared at this precision, so sums may run in any order

QUERY_BLOCK = 4096  # query vectors held by one task at a time
BLOCK_CELLS = 8_000_000  # terms by queries held by one task at a time
SEEDS = 4  # ranges of a query that are scored first; what they reach is the floor for all others


# --- generic ranks -----------------------------------------------------------------


def query_keys(queries: DataFrame) -> list[str]:
    """The columns that name a ranking: the query and, if there, its wording."""
    return [c for c in ("qid", "variant") if c in queries.columns]


def hit_schema(queries: DataFrame, id_type: str) -> str:
    fields = [(c, queries.schema[c].dataType.simpleString()) for c in query_keys(queries)] + [("id", id_type)]
    return ", ".join(f"{c} {kind}" for c, kind in fields) + ", score double"


def rank_rows(scores: DataFrame, n: int | None = None, by: str | Sequence[str] = "qid", score: str = "score") -> DataFrame:
    """1-based rank per query, best first.  With ``n`` only the best n are kept,
    and Spark prunes to n rows per query before the shuffle."""
    w = W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(C(score).desc(), "id")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(C("rank") <= n)


# --- lexical side --------------------------------------------------------------------


def idf_table(vocab: DataFrame) -> DataFrame:
    """(term, idf).  Terms in more than half of the documents get a quarter of
    the mean idf instead of a negative weight."""
    n = vocab.where(C("term").isNull()).select("df").scalar()
    terms = vocab.where(C("term").isNotNull()).select(
        "term", (F.log(n - C("df") + 0.5) - F.log(C("df") + 0.5)).alias("raw")
    )
    mean = scalar(terms, F.avg("raw"))
    return terms.select("term", F.when(C("raw") < 0, mean * NEGATIVE_IDF).otherwise(C("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf), by wording if there are several: a repeated query term counts again."""
    keys = query_keys(queries)
    return (
        queries.select(*keys, F.explode_outer(tokenize(C("query"))).alias("term"))
        .where(C("term").isNotNull())
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_weights(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, term, weight): repeats of the term times its idf."""
    return terms.join(idf_table(vocab), "term").select(*query_keys(terms), "term", (C("qtf") * C("idf")).alias("weight"))


def _query_blocks(weights: DataFrame) -> Iterator[tuple[pd.DataFrame, list[str], np.ndarray]]:
    """Blocks of queries as (keys, terms, matrix), each of a bounded size.

    One row per query comes to the driver at a time; a block closes when its
    matrix of terms by queries would outgrow BLOCK_CELLS.
    """
    keys = query_keys(weights)
    per_query = weights.groupBy(*keys).agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    names: list[tuple] = []
    index: dict[str, int] = {}
    cells: list[tuple[int, int, float]] = []

    def block():
        matrix = np.zeros((len(index), len(names)))
        for t, q, w in cells:
            matrix[t, q] = w
        return pd.DataFrame(names, columns=keys), list(index), matrix

    for row in per_query.toLocalIterator(prefetchPartitions=True):
        grown = len(index) + sum(t.term not in index for t in row.w)
        if names and grown * (len(names) + 1) > BLOCK_CELLS:
            yield block()
            names, index, cells = [], {}, []
        cells += [(index.setdefault(t.term, len(index)), len(names), t.weight) for t in row.w]
        names.append(tuple(row[c] for c in keys))
    if names:
        yield block()


def _gathered(docs: DataFrame, schema: str, jobs: Iterator[Callable[[], DataFrame]]) -> DataFrame:
    """The hits of one block of queries after the other, each written before the next block is read."""
    spark, path = docs.sparkSession, scratch_table(docs.sparkSession, "hits")
    spark.createDataFrame([], schema).write.parquet(path)
    for job in jobs:
        job().write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bm25_search(index: LexicalIndex, queries: DataFrame, n: int = PER_RANKER, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) of the n best documents per query; no text is read.

    ``queries`` = (qid, query), or (qid, variant, query) to rank each wording on
    its own; ``allowed`` (id) limits the documents, not the statistics.

    Per block of queries the SEEDS ranges with the greatest reach of each query
    are scored first.  The n-th best score there is a floor, and only the lists
    of ranges that can reach the floor of some query are moved and scored.
    """
    spark, keys = queries.sparkSession, query_keys(queries)
    index.refresh()
    vocab = index.vocabulary()
    whole = vocab.where(C("term").isNull()).select("df", "dl").first()
    avgdl = whole.dl / whole.df if whole and whole.dl else 1.0
    schema = hit_schema(queries, index.id_type)
    path = scratch_table(spark, "hits")
    spark.createDataFrame([], schema).write.parquet(path)
    masks, place = _masks(index, allowed), ["range", "max_tf", "min_dl", "ids", "docs", "tfs", "dls"]
    named = index.ranges_of().select(*place, F.lit(NAMED).alias("tidx"))
    for names, terms, matrix in _query_blocks(bm25_weights(query_terms(queries), vocab)):
        model = Bm25(matrix, K1, B, avgdl)
        table = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, tidx int")
        lists = index.lists().join(F.broadcast(table), "term").select(*place, "tidx")

        def scored(floor, ranges=None, lists=lists, names=names, model=model):
            rows = lists.unionByName(named) if masks is None else lists.unionByName(named).unionByName(masks)
            rows = rows if ranges is None else rows.join(checked_broadcast(ranges), "range", "left_semi")
            return by_range(rows).mapInPandas(postings_scan(names, model, n, DIGITS, floor, allowed is not None), schema)

        if index.ranges <= 4 * SEEDS:  # the seeds would be most of them
            scored(np.zeros(len(names))).write.mode("append").parquet(path)
            continue
        reach = by_range(cut_lineage(lists.select("range", "tidx", "max_tf", "min_dl")))  # no list among them
        best = reach.mapInPandas(best_ranges(names, model, SEEDS), hit_schema(queries, "long"))
        seeds = cut_lineage(rank_rows(best, SEEDS, keys).select(C("id").alias("range")).distinct())
        first = rank_rows(scored(np.zeros(len(names)), seeds), n, keys)
        bar = first.where(C("rank") == n).toPandas()  # a row a query of the block
        floor = names.merge(bar, "left", keys)["score"].fillna(0.0).to_numpy()
        able = reach.mapInPandas(open_ranges(model, floor), "range long")
        scored(floor, cut_lineage(able)).write.mode("append").parquet(path)
    return rank_rows(spark.read.schema(schema).parquet(path), n, keys)


def _masks(index: LexicalIndex, allowed: DataFrame | None) -> DataFrame | None:
    """Rows beside the lists of a range that name dead documents, or the only ones allowed."""

    def named(rows: DataFrame, kind: int) -> DataFrame:
        lists = rows.groupBy("range").agg(F.collect_list("id").alias("ids"))  # a range is bounded
        none = [F.lit(None).cast("array<int>").alias(c) for c in ("docs", "tfs", "dls")]
        return lists.select("range", F.lit(0).cast("long").alias("max_tf"), F.lit(0).cast("long").alias("min_dl"), "ids", *none, F.lit(kind).alias("tidx"))

    parts = [named(index.dead(), DEAD)] if any(r["dead"] for r in index.commits()) else []
    if allowed is not None:
        parts.append(named(index.documents().join(allowed.select("id"), "id", "left_semi"), LIVE))
    if not parts:
        return None
    return cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def bm25_rank(
    docs: DataFrame,
    queries: DataFrame,
    n: int = PER_RANKER,
    *,
    index: LexicalIndex | None = None,
    filter_mode: str = "post",
    **filters,
) -> DataFrame:
    """(qid, id, score, rank) of the n best documents per query.

    ``docs`` = (id, text, filter columns).  By default the metadata filter
    applies after the cut to n, so fewer than n rows may remain;
    ``filter_mode='pre'`` cuts last.  ``index`` is the stored index of ``docs``;
    without one it is built for this call.
    """
    index = LexicalIndex.build(docs) if index is None else index
    filtered = any(v is not None for v in filters.values())
    allowed = docs.where(metadata_filter(**filters)).select("id")
    if filtered and filter_mode == "pre":
        return bm25_search(index, queries, n, allowed)
    cut = bm25_search(index, queries, n)
    if not filtered:
        return cut
    return rank_rows(cut.join(allowed, "id", "left_semi").drop("rank"), by=query_keys(queries))


# --- dense side ----------------------------------------------------------------------


def dense_rank(
    vectors: DataFrame,
    queries: DataFrame,
    n: int = PER_RANKER,
    *,
    skip: str | None = None,
    block: int = QUERY_BLOCK,
    **filters,
) -> DataFrame:
    """Exact nearest vectors: (qid, id, score, rank), by wording if there are several.

    ``vectors`` = (id, embedding), ``queries`` = (qid, embedding) or (qid,
    variant, embedding); unit vectors, so the dot product is the cosine.  Queries are taken in blocks of a fixed
    size, each block is multiplied with every partition of vectors where it
    lies, and only the n best per query and partition leave it: no pair is ever
    a row.  The filter applies before the cut.  ``skip`` names a query column
    with an id to leave out.
    """
    stored = spread(vectors.where(metadata_filter(**filters)).select("id", "embedding"))
    keys, schema = query_keys(queries), hit_schema(queries, vectors.schema["id"].dataType.simpleString())
    rows = queries.select(*keys, "embedding", *([skip] if skip else [])).toLocalIterator(prefetchPartitions=True)

    def jobs():
        while part := [r for _, r in zip(range(block), rows)]:
            names = pd.DataFrame([tuple(r[c] for c in keys) for r in part], columns=keys)
            matrix = np.array([r["embedding"] for r in part], dtype=np.float64)
            skipped = np.array([r[skip] for r in part]) if skip else None
            scan = dense_scan(names, matrix, n, skipped, DIGITS)
            yield lambda scan=scan: stored.mapInPandas(scan, schema)

    return rank_rows(_gathered(vectors, schema, jobs()), n, keys)


def lsh_planes(planes: int, tables: int, dim: int, seed: int = 7) -> np.ndarray:
    """tables x planes random normals of dim numbers."""
    return np.random.default_rng(seed).standard_normal((tables, planes, dim))


def lsh_buckets(vectors: DataFrame, planes: int, tables: int, dim: int, seed: int = 7) -> DataFrame:
    """(.., bucket): sign pattern of random projections, one row a table, in the JVM."""

    def side(normal) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in normal])
        dot = F.aggregate(
            F.zip_with("embedding", weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v
        )
        return F.when(dot >= 0, "1").otherwise("0")

    normals = lsh_planes(planes, tables, dim, seed)
    keys = F.array(*[F.concat(F.lit(f"{t}:"), *[side(p) for p in normals[t]]) for t in range(tables)])
    return vectors.withColumn("bucket", F.explode(keys))


def lsh_rank(vectors: DataFrame, queries: DataFrame, n: int = PER_RANKER, *, planes: int, tables: int, dim: int) -> DataFrame:
    """Approximate nearest vectors: candidates share a bucket with the query, and are scored exactly.

    The buckets of the vectors can be stored; a query meets them by an equi-join.
    ``dense_rank`` is the exact form that recall is measured against.
    """
    keys = query_keys(queries)
    stored = lsh_buckets(vectors.select("id", "embedding"), planes, tables, dim).select("id", "bucket")
    asked = lsh_buckets(queries.select(*keys, "embedding"), planes, tables, dim).select(*keys, "bucket")
    pairs = asked.join(stored, "bucket").select(*keys, "id").distinct()
    full = pairs.join(vectors.select("id", C("embedding").alias("_v")), "id").join(queries.select(*keys, C("embedding").alias("_q")), keys)
    dot = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return rank_rows(full.select(*keys, "id", F.round(dot, DIGITS).alias("score")), n, keys)


# --- fusion ----------------------------------------------------------------------------


def query_variants(queries: DataFrame, extras: Column) -> DataFrame:
    """(qid, variant, query): the query, then each new non-blank extra."""
    from palaver.functions.text import strip

    usable = F.filter(extras, lambda q: q.isNotNull() & (strip(q) != "") & (strip(q) != strip(C("query"))))
    variants = F.array_distinct(F.concat(F.array(C("query")), usable))
    return queries.select("qid", F.posexplode(variants).alias("variant", "query"))


def ranking_union(*rankings: tuple[str, DataFrame]) -> DataFrame:
    """All rankings as one bag (qid, ranker, id, rank)."""
    out: DataFrame | None = None
    for name, df in rankings:
        rows = df.select("qid", F.lit(name).alias("ranker"), "id", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def rrf_fuse(rankings: DataFrame, pool: int | None = POOL, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) per (query, id); the best ``pool`` per query."""
    fused = rankings.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (k + C("rank"))), 12).alias("score")
    )
    return rank_rows(fused, pool)


def max_dense_score(dense: DataFrame) -> DataFrame:
    """Strongest dense score per (query, id) over the variants of a query."""
    return dense.groupBy("qid", "id").agg(F.max("score").alias("dense_score"))


def materialise(pool: DataFrame, dense: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach dense score (0.0 if only lexical) and the corpus columns.

    The pool holds a fixed number of rows per query, so it is the small side;
    it is written once, which also tells its size.
    """
    scored = cut_lineage(pool.join(dense, ["qid", "id"], "left").withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0))))
    return corpus.join(checked_broadcast(scored), "id")


Scorer = Callable[[Column, Column], Column]


def term_coverage(query: Column, text: Column) -> Column:
    """Share of the distinct query terms found in the text."""
    wanted = F.array_distinct(tokenize(query))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokenize(text))) / F.size(wanted)).otherwise(0.0)


# pair scorers by name: Column functions or Arrow UDFs of (query, text)
SCORERS: dict[str, Scorer] = {"term_coverage": term_coverage}


def rescore(candidates: DataFrame, queries: DataFrame, scorer: str | Scorer = "term_coverage") -> DataFrame:
    """Replace the score of pools of two or more by that of a pair scorer."""
    pair = SCORERS[scorer] if isinstance(scorer, str) else scorer
    size = F.count(F.lit(1)).over(W.partitionBy("qid"))
    joined = candidates.join(checked_broadcast(queries.select("qid", "query")), "qid").withColumn("_size", size)
    new = F.when(C("_size") > 1, F.round(pair(C("query"), C("text")), DIGITS)).otherwise(C("score"))
    return rank_rows(joined.withColumn("score", new).drop("_size", "query", "rank"))


def diversify(
    candidates: DataFrame, k: int = 5, max_per_doc: int = MAX_PER_DOC, max_per_site: int = MAX_PER_SITE
) -> DataFrame:
    """Best k per query with at most so many rows per document and per site.

    ``doc_key`` and ``site`` cap only when not blank.  A document lies in one
    site, so ranking within documents, then within sites among the survivors,
    gives the same rows as walking down the list.
    """
    best = [C("score").desc(), C("id")]

    def capped(df: DataFrame, key: str, cap: int) -> DataFrame:
        keyed = F.trim(F.coalesce(C(key), F.lit("")))
        w = W.partitionBy("qid", keyed).orderBy(*best)
        return df.withColumn("_n", F.row_number().over(w)).where((keyed == "") | (C("_n") <= cap)).drop("_n")

    kept = capped(capped(candidates, "doc_key", max_per_doc), "site", max_per_site)
    return rank_rows(kept.drop("rank"), k)


def hybrid_search(
    corpus: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    k: int = 5,
    *,
    pool: int = POOL,
    rerank: bool | str | Scorer = False,
    variants: DataFrame | None = None,
    index: LexicalIndex | None = None,
    **filters,
) -> DataFrame:
    """Lexical and dense rankings fused, optionally rescored, then diversified.

    ``corpus`` = (id, text, doc_key, site, ...); ``vectors`` = (id, embedding)
    plus the filter columns; ``variants`` = (qid, variant, query) adds further
    wordings that are ranked and fused with the rest, and so does a ``variant``
    column of ``query_vectors`` on the dense side.  Until the last step rows
    have ids and scores only; texts join the k rows that stay.
    """
    n = max(PER_RANKER, pool, k)
    texts = queries.select("qid", "query")
    lexical = bm25_rank(corpus, texts if variants is None else variants, n, index=index, **filters)
    dense = dense_rank(vectors, query_vectors, n, **filters)
    # n rows per query, wording and ranker, read twice below
    ranked = cut_lineage(
        lexical.select("qid", F.lit("lexical").alias("ranker"), "id", "rank", "score").unionByName(
            dense.select("qid", F.lit("dense").alias("ranker"), "id", "rank", "score")
        )
    )
    strongest = max_dense_score(ranked.where("ranker = 'dense'"))
    hits = materialise(rrf_fuse(ranked, pool), strongest, corpus.drop("text"))
    if rerank:
        hits = cut_lineage(hits)  # bounded rows per query
        pair = pair_scores(hits, corpus, texts, "term_coverage" if rerank is True else rerank)
        hits = rank_rows(hits.join(pair, ["qid", "id"], "left").withColumn("score", F.coalesce("pair", "score")).drop("pair", "rank"))
    return corpus.select("id", "text").join(checked_broadcast(cut_lineage(diversify(hits, k))), "id")


def pair_scores(pool: DataFrame, corpus: DataFrame, queries: DataFrame, scorer: str | Scorer) -> DataFrame:
    """(qid, id, pair): the pair scorer on pools of two or more; texts stay where the corpus lies."""
    pair = SCORERS[scorer] if isinstance(scorer, str) else scorer
    size = F.count(F.lit(1)).over(W.partitionBy("qid"))
    wanted = pool.select("qid", "id").withColumn("_size", size).where(C("_size") > 1).join(queries, "qid").drop("_size")
    return corpus.select("id", "text").join(checked_broadcast(wanted), "id").select("qid", "id", F.round(pair(C("query"), C("text")), DIGITS).alias("pair"))


# --- presentation of the hits -------------------------------------------------------------


def context_block(hits: DataFrame, label: Column, limit: int = 1500) -> DataFrame:
    """One text per query: header and excerpt of each hit, in rank order.

    A query has at most k hits, which bounds the list.
    """
    from palaver.functions.text import excerpt

    part = F.concat(
        F.lit("["), C("id").cast("string"), F.lit("] ("), label, F.lit(")\n"), excerpt(C("text"), limit, " […truncated]")
    )
    parts = F.array_sort(F.collect_list(F.struct(C("rank"), part.alias("part"))))
    return hits.groupBy("qid").agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n---\n\n").alias("context")
    )


def format_sources(hits: DataFrame, preview: int = 160) -> DataFrame:
    from palaver.functions.text import excerpt

    return hits.select(
        "qid", "rank", "id", F.round("score", 4).alias("score"),
        excerpt(C("text"), preview, "…", trim=False, one_line=True).alias("preview"),
    )


def prompt_rows(queries: DataFrame, context: DataFrame, window: int) -> DataFrame:
    """User message per query: context, question, language directive, and how
    much of a context window it fills."""
    from palaver.functions.display import response_directive
    from palaver.functions.text import approx_tokens

    body = F.concat(
        F.lit("CONTEXT:\n"), F.coalesce("context", F.lit("(no relevant content found)")),
        F.lit("\n\nUSER MESSAGE: "), C("query"), F.lit("\n\n("), response_directive(C("query")), F.lit(")"),
    )
    return (
        queries.join(context, "qid", "left")
        .select("qid", response_directive(C("query")).alias("directive"), body.alias("message"))
        .withColumn("tokens", approx_tokens(C("message")))
        .withColumn("fill_pct", F.round(C("tokens") * 100.0 / window, 4))
    )


def top_margin(ranked: DataFrame) -> DataFrame:
    """Best score, second score and their difference per query."""
    best = F.max(F.when(C("rank") == 1, C("score")))
    second = F.max(F.when(C("rank") == 2, C("score")))
    return ranked.where(C("rank") <= 2).groupBy("qid").agg(
        best.alias("top1"), second.alias("top2"), F.round(best - second, 6).alias("margin")
    )
