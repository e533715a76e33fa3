"""Queries over retrieval operators (R, J14-J16, W04, W05, W11, T05, U06, D05, D06)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palaver.functions import text as tx
from palaver.operators import rank
from palaver.operators.cells import CellIndex, recall
from palaver.operators.corpus import index_delta
from palaver.operators.postings import LexicalIndex
from palaver.plans import q_corpus as K
from palaver.plans import sql_rank as S
from palaver.plans.registry import query
from palaver.session import cut_lineage

C = F.col


def corpus(t):
    """Documents as the corpus: several documents share a ``doc_key``."""
    return t.documents.select(
        C("doc_id").alias("id"), "text", "lang", C("source").alias("site"),
        F.concat("source", F.lit("/"), (C("n_chars") % 50).cast("string")).alias("doc_key"),
    )


def vectors(t):
    return t.doc_vectors.select(C("doc_id").alias("id"), "embedding")


def lexical(t, n=rank.PER_RANKER, **filters):
    return rank.bm25_rank(corpus(t), t.queries, n, index=t.lexical_index, **filters)


def dense(t, n=rank.PER_RANKER):
    return rank.dense_rank(vectors(t), t.item_vectors, n)


def both(t):
    return rank.ranking_union(("lexical", lexical(t)), ("dense", dense(t)))


def pool_hits(t):
    d = dense(t)
    fused = rank.rrf_fuse(rank.ranking_union(("lexical", lexical(t)), ("dense", d)))
    return rank.materialise(fused, rank.max_dense_score(d), corpus(t))


def search(t, **options):
    return rank.hybrid_search(corpus(t), t.queries, vectors(t), t.item_vectors, index=t.lexical_index, **options)


def ids(df, *cols):
    return df.withColumnRenamed("id", "doc_id").select(*cols)


@query("R05_bm25_rank", f"WITH {S.bm25()} SELECT qid, doc_id, rank, round(score, 6) AS score FROM bmr")
def _(t):
    return ids(lexical(t), "qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("R05b_bm25_filtered", f"""WITH {S.bm25()} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM bmr WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def _(t):
    return ids(lexical(t, lang="en"), "qid", "doc_id", "rank")


@query("J15_lexical_postings", f"WITH {S.bm25()} SELECT p.doc_id, p.term, p.tf, d.dl FROM post p JOIN dls d ON d.doc_id = p.doc_id WHERE p.term IN (SELECT term FROM qterms)")
def _(t):
    rows = t.lexical_index.postings(rank.query_terms(t.queries))
    return ids(rows, "doc_id", "term", "tf", "dl")


@query("J15b_extended_index", f"WITH {S.bm25()} SELECT qid, doc_id, rank, round(score, 6) AS score FROM bmr")
def _(t):
    """An index of the labelled documents, some in an older wording, and of others that go; then the delta."""
    docs = t.documents.select(C("doc_id").alias("id"), "text")
    old = docs.join(t.labels.select(C("doc_id").alias("id")), "id", "left_semi")
    older = old.withColumn("text", F.when(C("id") % 2 == 0, F.concat("text", F.lit(" "), "text")).otherwise(C("text")))
    leaving = old.select((-1 - C("id")).alias("id"), "text")
    index = LexicalIndex.build(older.unionByName(leaving))
    fresh = index_delta(docs, index.documents()).unionByName(old.where("id % 2 = 0"))
    index.extend(fresh, leaving)
    return ids(rank.bm25_search(index, t.queries), "qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("J14_dense_scan", """
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
 FROM v_item_vectors q CROSS JOIN embeddings v)) WHERE rank <= 60""")
def _(t):
    stored = t.embeddings.select(C("vec_id").alias("id"), "embedding")
    return rank.dense_rank(stored, t.item_vectors).select("qid", C("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("R06_dense_rank", """
SELECT qid, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
 FROM v_item_vectors q CROSS JOIN embeddings v WHERE v.label = 3)) WHERE rank <= 10""")
def _(t):
    stored = t.embeddings.select(C("vec_id").alias("id"), "embedding", "label")
    return rank.dense_rank(stored, t.item_vectors, 10, label=3).select("qid", C("id").alias("vec_id"), "rank")


def bucket_sql(planes: int, tables: int, dim: int) -> str:
    """The buckets of ``embedding`` as a list: the planes are drawn from a fixed seed."""
    side = lambda p: f"CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), {[float(x) for x in p]}) >= 0 THEN '1' ELSE '0' END"
    return "[" + ", ".join(f"concat('{i}:', {', '.join(map(side, t))})" for i, t in enumerate(rank.lsh_planes(planes, tables, dim))) + "]"


@query("R06b_lsh_buckets", f"SELECT bucket, count(*) AS n FROM (SELECT unnest({bucket_sql(8, 2, 64)}) AS bucket FROM embeddings) GROUP BY bucket")
def _(t):
    first = t.embeddings.select("vec_id", "embedding")
    return rank.lsh_buckets(first, planes=8, tables=2, dim=64).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


LSH_SQL = f"""lv AS (SELECT vec_id, unnest({bucket_sql(6, 8, 64)}) AS bucket FROM embeddings), lq AS (SELECT qid, unnest({bucket_sql(6, 8, 64)}) AS bucket FROM v_item_vectors),
lsh AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
 FROM (SELECT DISTINCT lq.qid, lv.vec_id FROM lq JOIN lv ON lv.bucket = lq.bucket) c JOIN v_item_vectors q ON q.qid = c.qid JOIN embeddings v ON v.vec_id = c.vec_id))"""


@query("R06c_lsh_search", f"WITH {LSH_SQL} SELECT qid, vec_id, rank FROM lsh WHERE rank <= 10")
def _(t):
    stored = t.embeddings.select(C("vec_id").alias("id"), "embedding")
    return rank.lsh_rank(stored, t.item_vectors, 10, planes=6, tables=8, dim=64).select("qid", C("id").alias("vec_id"), "rank")


def best_cells(t):
    """(found, exact): the best ten by cells and by the full scan."""
    stored, asked = t.embeddings.select(C("vec_id").alias("id"), "embedding"), t.item_vectors
    return cut_lineage(CellIndex.build(stored).search(asked, 10)), rank.dense_rank(stored, asked, 10)


@query("R06d_cell_search", """
SELECT qid, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
 FROM v_item_vectors q CROSS JOIN embeddings v)) WHERE rank <= 1""")
def _(t):
    """The best hit of every query: the vector itself is stored, so the nearest cell holds it."""
    found, _ = best_cells(t)
    return found.where("rank = 1").select("qid", C("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("R06e_cell_recall", """
SELECT count(DISTINCT qid) AS queries, count(*) AS wanted, true AS enough FROM (SELECT q.qid, row_number() OVER (PARTITION BY q.qid) AS rank
 FROM v_item_vectors q CROSS JOIN embeddings v) WHERE rank <= 10""")
def _(t):
    """Recall of the best ten against the full scan is 0.9 or more."""
    return recall(*best_cells(t)).select("queries", "wanted", (C("recall") >= 0.9).alias("enough"))


@query("W04_rank_per_ranker", f"WITH {S.bm25()}, {S.DENSE} SELECT 'lexical' AS ranker, qid, doc_id, rank FROM bmr UNION ALL SELECT 'dense' AS ranker, qid, doc_id, rank FROM dnr")
def _(t):
    return ids(both(t), "ranker", "qid", "doc_id", "rank")


@query("U06_ranking_union", f"""WITH {S.bm25()}, {S.DENSE} SELECT ranker, count(*) AS n, count(DISTINCT qid) AS queries FROM (
 SELECT 'lexical' AS ranker, qid FROM bmr UNION ALL SELECT 'dense' AS ranker, qid FROM dnr) GROUP BY ranker""")
def _(t):
    return both(t).groupBy("ranker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("queries"))


@query("T05_topk_per_query", f"WITH {S.bm25()} SELECT qid, doc_id, rank FROM bmr WHERE rank <= 10")
def _(t):
    return ids(lexical(t, 10), "qid", "doc_id", "rank")


@query("R07_rrf_fuse", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED} SELECT qid, doc_id, rank, round(score, 6) AS score FROM pool")
def _(t):
    return ids(rank.rrf_fuse(both(t)), "qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("R08_max_dense_score", f"""WITH wordings AS (SELECT qid * 2 AS qid, embedding FROM v_item_vectors UNION ALL SELECT qid * 2 + 1 AS qid, list_reverse(embedding) AS embedding FROM v_item_vectors),
{S.DENSE.replace('v_item_vectors', 'wordings')} SELECT qid // 2 AS qid, doc_id, round(max(score), 6) AS dense_score FROM dnr GROUP BY qid // 2, doc_id""")
def _(t):
    first = t.item_vectors.select("qid", F.lit(0).alias("variant"), "embedding")
    wordings = first.unionByName(t.item_vectors.select("qid", F.lit(1).alias("variant"), F.reverse("embedding").alias("embedding")))
    return ids(rank.max_dense_score(rank.dense_rank(vectors(t), wordings)), "qid", "doc_id", F.round("dense_score", 6).alias("dense_score"))


@query("R09_query_variants", r"""
SELECT qid, 0 AS variant, query FROM v_queries UNION ALL
SELECT qid, 1 AS variant, lower(query) AS query FROM v_queries
WHERE regexp_replace(lower(query), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g') <> regexp_replace(query, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')""")
def _(t):
    extras = F.array(F.lower("query"), F.lit("  "), F.concat(C("query"), F.lit(" ")), F.lower("query"))
    return rank.query_variants(t.queries, extras)


@query("J16_fused_materialise", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED} SELECT qid, doc_id, round(score, 6) AS score, round(dense_score, 6) AS dense_score, length(text) AS n_text FROM hits")
def _(t):
    return ids(
        pool_hits(t), "qid", "doc_id", F.round("score", 6).alias("score"), F.round("dense_score", 6).alias("dense_score"),
        F.length("text").alias("n_text"),
    )


COVERAGE = r"""
rescored AS (SELECT h.* EXCLUDE (score), round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))) / CAST(len(qt) AS DOUBLE) ELSE 0 END, 9) AS score
 FROM hits h JOIN (SELECT qid, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS qt FROM v_queries) q ON q.qid = h.qid)"""


@query("R10_rescore", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {COVERAGE} SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM rescored")
def _(t):
    return ids(rank.rescore(pool_hits(t), t.queries), "qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("R11_diversify", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {S.diversified('hits', 5)} SELECT qid, doc_id, rank, site FROM best")
def _(t):
    return ids(rank.diversify(pool_hits(t), 5), "qid", "doc_id", "rank", "site")


@query("W05_diversify_ranks", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {S.diversified('hits', 10)} SELECT qid, doc_id, rank FROM best")
def _(t):
    return ids(rank.diversify(pool_hits(t), 10), "qid", "doc_id", "rank")


FINAL = "qid, rank, doc_id, round(score, 6) AS score, round(dense_score, 6) AS dense_score, site"


def final(df):
    return ids(df, "qid", "rank", "doc_id", F.round("score", 6).alias("score"), F.round("dense_score", 6).alias("dense_score"), "site")


@query("R12_hybrid_search", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {S.diversified('hits')} SELECT {FINAL} FROM best")
def _(t):
    return final(search(t))


@query("D05_retriever_parameters", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {COVERAGE}, {S.diversified('rescored', 3)} SELECT {FINAL} FROM best")
def _(t):
    return final(search(t, k=3, rerank=True))


@F.pandas_udf(DoubleType())
def length_scorer(query, text):
    """A pair scorer as an Arrow UDF: how close the two lengths are."""
    return -(query.str.len() - text.str.len()).abs().astype("float64")


@query("D06_pluggable_scorer", f"""WITH {S.bm25()}, {S.DENSE}, {S.FUSED},
byl AS (SELECT h.* EXCLUDE (score), CAST(-abs(length(q.query) - length(h.text)) AS DOUBLE) AS score FROM hits h JOIN v_queries q ON q.qid = h.qid),
{S.diversified('byl')} SELECT {FINAL} FROM best""")
def _(t):
    return final(search(t, rerank=length_scorer))


PARTS = r"""concat('[', doc_id, '] (', site, ')', chr(10), CASE WHEN length(text) > 1500 THEN regexp_replace(substring(text, 1, 1500), '[\s\x{00a0}]+$', '') || ' […truncated]' ELSE text END)"""
CONTEXT = f"ctx AS (SELECT qid, string_agg({PARTS}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM best GROUP BY qid)"


@query("R13_context_block", f"WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {S.diversified('hits')}, {CONTEXT} SELECT qid, context FROM ctx")
def _(t):
    return rank.context_block(search(t), C("site"))


@query("R14_format_sources", f"""WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {S.diversified('hits')} SELECT qid, rank, doc_id, round(score, 4) AS score,
 CASE WHEN length(text) > 160 THEN replace(substring(text, 1, 160), chr(10), ' ') || '…' ELSE replace(text, chr(10), ' ') END AS preview FROM best""")
def _(t):
    return rank.format_sources(search(t)).withColumnRenamed("id", "doc_id")


FR_MARKS = "[àâäéèêëîïôöùûüçœÀÂÄÉÈÊËÎÏÔÖÙÛÜÇŒ]"
DIRECTIVE = rf"CASE WHEN regexp_matches(q.query, '[\x{{0600}}-\x{{06FF}}]') THEN 'Respond in Arabic.' WHEN regexp_matches(q.query, '{FR_MARKS}') THEN 'Respond in French.' ELSE 'Respond in English.' END"


@query("R15_response_directive", f"""WITH {S.bm25()}, {S.DENSE}, {S.FUSED}, {S.diversified('hits')}, {CONTEXT}
SELECT qid, directive, message, length(message) // 4 AS tokens, round((length(message) // 4) * 100.0 / 8192, 4) AS fill_pct FROM (
 SELECT q.qid, {DIRECTIVE} AS directive, concat('CONTEXT:', chr(10), coalesce(context, '(no relevant content found)'), chr(10), chr(10), 'USER MESSAGE: ', q.query,
  chr(10), chr(10), '(', {DIRECTIVE}, ')') AS message FROM v_queries q LEFT JOIN ctx ON ctx.qid = q.qid)""")
def _(t):
    return rank.prompt_rows(t.queries.select("qid", "query"), rank.context_block(search(t), C("site")), window=8192)


@query("R12b_search_with_variants", f"""WITH vq AS (SELECT qid * 1000 AS qid, query FROM v_queries UNION ALL SELECT qid * 1000 + 1 AS qid, array_to_string(list_reverse(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')), ' ') AS query FROM v_queries),
{S.bm25('vq')}, {S.DENSE}, {S.FUSED.replace('SELECT qid, doc_id, rank FROM bmr', 'SELECT qid // 1000 AS qid, doc_id, rank FROM bmr')}, {S.diversified('hits')} SELECT {FINAL} FROM best""")
def _(t):
    variants = rank.query_variants(t.queries, F.array(tx.reversed_words(C("query"))))
    return final(search(t, variants=variants))


# the chunks that the engine builds itself, with their string ids; a chunk gets a stored vector by its length
CHUNK_SQL = f"""ck AS (SELECT id AS doc_id, text, language, pdf_file AS doc_key, '' AS site FROM ({K.R02_SQL})
 UNION ALL SELECT id AS doc_id, text, language, url AS doc_key, site FROM ({K.R03_SQL})
 UNION ALL SELECT id AS doc_id, text, language, '' AS doc_key, '' AS site FROM ({K.R04_SQL})),
cv AS (SELECT k.doc_id, k.language, e.embedding FROM ck k JOIN embeddings e ON e.vec_id = length(k.text) % (SELECT count(*) FROM embeddings))"""
CHUNK_QUERIES = "SELECT concat('q', qid) AS qid, query FROM v_queries"
CHUNK_VECTORS = "SELECT concat('q', qid) AS qid, embedding FROM v_item_vectors"


def chunks(t):
    """(corpus, vectors) of document, page and chat chunks."""
    blank = F.lit("")
    documents = K.document_rows(t).select("id", "text", "metadata.language", C("metadata.pdf_file").alias("doc_key"), blank.alias("site"))
    pages = K.web_rows(t).select("id", "text", "metadata.language", C("metadata.url").alias("doc_key"), "metadata.site")
    said = K.chat_rows(t).select("id", "text", "metadata.language", blank.alias("doc_key"), blank.alias("site"))
    rows = cut_lineage(documents.unionByName(pages).unionByName(said))  # chunks are a stored table
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    keyed = rows.select("id", "language", (F.length("text") % n).alias("vec_id"))
    return rows, keyed.join(t.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def chunk_search_sql(lexical: str, dense: str, queries: str, vectors: str) -> str:
    bm = S.BM25.replace("documents", "ck").replace("{queries}", "cq")
    dn = S.DENSE.replace("v_item_vectors", "cqv").replace("v_doc_vectors", "cv")
    fused = S.FUSED.replace("documents c", "ck c").replace("c.source AS site,\n   concat(c.source, '/', c.n_chars % 50) AS doc_key, c.lang", "c.site, c.doc_key")
    fused = fused.replace("SELECT qid, doc_id, rank FROM bmr", lexical).replace("SELECT qid, doc_id, rank FROM dnr", dense)
    fused = fused.replace("LEFT JOIN dnr dn", "LEFT JOIN dbest dn")
    # blank keys never cap
    best = S.diversified("hits").replace("WHERE nd <= 1", "WHERE nd <= 1 OR doc_key = ''").replace("WHERE ns <= 2", "WHERE ns <= 2 OR site = ''")
    return f"""WITH RECURSIVE cq AS ({queries}), cqv AS ({vectors}), {CHUNK_SQL}, {bm}, {dn},
dbest AS (SELECT split_part(qid, '/', 1) AS qid, doc_id, max(score) AS score FROM dnr GROUP BY split_part(qid, '/', 1), doc_id), {fused}, {best}
SELECT qid, rank, doc_id, round(score, 6) AS score, round(dense_score, 6) AS dense_score, site FROM best"""


def chunk_queries(t):
    return t.queries.select(F.concat(F.lit("q"), C("qid").cast("string")).alias("qid"), "query")


def chunk_query_vectors(t):
    return t.item_vectors.select(F.concat(F.lit("q"), C("qid").cast("string")).alias("qid"), "embedding")


@query("R12c_chunk_search", chunk_search_sql(
    "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bmr WHERE doc_id IN (SELECT doc_id FROM ck WHERE language = 'fr')",
    "SELECT qid, doc_id, rank FROM dnr", CHUNK_QUERIES, CHUNK_VECTORS).replace("CROSS JOIN cv v", "JOIN cv v ON v.language = 'fr'"))
def _(t):
    rows, stored = chunks(t)
    return final(rank.hybrid_search(rows, chunk_queries(t), stored, chunk_query_vectors(t), language="fr"))


@query("R12d_chunk_search_variants", chunk_search_sql(
    "SELECT split_part(qid, '/', 1) AS qid, doc_id, rank FROM bmr", "SELECT split_part(qid, '/', 1) AS qid, doc_id, rank FROM dnr",
    CHUNK_QUERIES + r""" UNION ALL SELECT concat('q', qid, '/1') AS qid, array_to_string(list_reverse(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '')), ' ') AS query FROM v_queries""",
    CHUNK_VECTORS + " UNION ALL SELECT concat('q', qid, '/1') AS qid, list_reverse(embedding) AS embedding FROM v_item_vectors"))
def _(t):
    rows, stored = chunks(t)
    asked, own = chunk_queries(t), chunk_query_vectors(t)
    variants = asked.select("qid", F.lit(0).alias("variant"), "query").unionByName(asked.select("qid", F.lit(1).alias("variant"), tx.reversed_words(C("query")).alias("query")))
    vectors = own.select("qid", F.lit(0).alias("variant"), "embedding").unionByName(own.select("qid", F.lit(1).alias("variant"), F.reverse("embedding").alias("embedding")))
    return final(rank.hybrid_search(rows, asked, stored, vectors, variants=variants))


@query("W11_top_margin", f"WITH {S.DENSE} SELECT qid, round(max(score) FILTER (WHERE rank = 1), 6) AS top1, round(max(score) FILTER (WHERE rank = 2), 6) AS top2, round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6) AS margin FROM dnr GROUP BY qid")
def _(t):
    return rank.top_margin(dense(t)).select("qid", F.round("top1", 6).alias("top1"), F.round("top2", 6).alias("top2"), "margin")
