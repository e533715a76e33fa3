"""SQL twins of the ranking operators, as common table expressions."""

BM25 = r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
dls AS (SELECT doc_id, len(t) AS dl FROM toks),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf0 AS (SELECT term, ln(CAST((SELECT count(*) FROM toks) - df + 0.5 AS DOUBLE)) - ln(CAST(df + 0.5 AS DOUBLE)) AS idf FROM dfs),
idfs AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
qterms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM {queries}) GROUP BY qid, term),
bm AS (SELECT q.qid, p.doc_id, round(sum(CAST(qtf AS DOUBLE) * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM dls)))), 9) AS score
  FROM qterms q JOIN idfs i ON i.term = q.term JOIN post p ON p.term = q.term JOIN dls d ON d.doc_id = p.doc_id GROUP BY q.qid, p.doc_id),
bmr AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 60)"""


def bm25(queries: str = "v_queries") -> str:
    return BM25.replace("{queries}", queries)


DENSE = """
dn AS (SELECT q.qid, v.doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
  FROM v_item_vectors q CROSS JOIN v_doc_vectors v),
dnr AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM dn) WHERE rank <= 60)"""

FUSED = """
fused AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM
  (SELECT qid, doc_id, rank FROM bmr UNION ALL SELECT qid, doc_id, rank FROM dnr) GROUP BY qid, doc_id),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 30),
hits AS (SELECT p.qid, p.doc_id, p.score, coalesce(dn.score, 0.0) AS dense_score, c.text, c.source AS site,
   concat(c.source, '/', c.n_chars % 50) AS doc_key, c.lang FROM pool p LEFT JOIN dnr dn ON dn.qid = p.qid AND dn.doc_id = p.doc_id JOIN documents c ON c.doc_id = p.doc_id)"""


def diversified(source: str, k: int = 5) -> str:
    return f"""
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_key ORDER BY score DESC, doc_id) AS nd FROM {source}) WHERE nd <= 1),
d2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, site ORDER BY score DESC, doc_id) AS ns FROM d1) WHERE ns <= 2),
best AS (SELECT * FROM (SELECT * EXCLUDE (nd, ns), row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM d2) WHERE rank <= {k})"""
