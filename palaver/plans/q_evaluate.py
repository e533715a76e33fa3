"""Queries over retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import evaluate as ev
from palaver.operators import rank
from palaver.plans import q_rank as K
from palaver.plans import q_text as Q
from palaver.plans import sql_rank as S
from palaver.plans.registry import query
from palaver.plans.scale import checked_broadcast
from palaver.session import cut_lineage

C = F.col

# Dense evaluation: every text query is paired with a stored vector; its own
# vector is left out of the hits, and a hit is right when it has an expected label.
HITS = """hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.qid, v.vec_id, v.label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
 FROM v_item_vectors q JOIN embeddings v ON v.vec_id <> q.vec_id)) WHERE rank <= 20)"""


def run_sql(k: int, name: str = "run") -> str:
    return f"""{name} AS (SELECT q.qid, q.category, q.qset, q.must_refuse, q.label, t.score AS top1_score,
 CASE WHEN NOT q.must_refuse THEN m.f END AS first_hit, CASE WHEN NOT q.must_refuse THEN m.f IS NOT NULL END AS any_hit,
 CASE WHEN NOT q.must_refuse THEN coalesce(m.met, 0) = w.wanted END AS all_hit
 FROM (SELECT v.qid, v.category, v.qset, v.must_refuse, i.label FROM v_queries v JOIN v_item_vectors i ON i.qid = v.qid) q
 LEFT JOIN (SELECT e.qid, min(h.rank) AS f, count(DISTINCT e.exp_idx) AS met FROM v_expected e JOIN hits h ON h.qid = e.qid AND h.label = e.expected AND h.rank <= {k} GROUP BY e.qid) m ON m.qid = q.qid
 LEFT JOIN (SELECT qid, count(*) AS wanted FROM v_expected GROUP BY qid) w ON w.qid = q.qid
 LEFT JOIN hits t ON t.qid = q.qid AND t.rank = 1)"""


RUN5 = f"{HITS}, {run_sql(5)}"
RUN20 = f"{HITS}, {run_sql(20)}"
RECALL = """count(*) AS total, count(*) FILTER (WHERE any_hit) AS any_hits, count(*) FILTER (WHERE all_hit) AS all_hits,
 round(avg(CASE WHEN any_hit THEN 1.0 ELSE 0.0 END), 6) AS recall_any, round(avg(CASE WHEN all_hit THEN 1.0 ELSE 0.0 END), 6) AS recall_all"""


def dense_hits(t, n=20):
    stored = t.embeddings.select(C("vec_id").alias("id"), "embedding")
    found = rank.dense_rank(stored, t.item_vectors, n, skip="vec_id")
    labels = t.embeddings.select(C("vec_id").alias("id"), C("label").alias("ref"))
    return labels.join(found, "id").withColumn("kind", F.lit("label"))


def expected(t):
    return t.expected.select("qid", "exp_idx", F.lit("label").alias("kind"), C("expected").alias("ref"))


def eval_queries(t):
    labels = t.item_vectors.select("qid", "label")
    return t.queries.select("qid", "category", "qset", "must_refuse").join(labels, "qid")


def run(t, k=5):
    return ev.run_table(eval_queries(t), dense_hits(t), expected(t), k)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("S07_query_set_source", """SELECT qid, query, 'golden' AS qset FROM v_queries WHERE qset = 'golden' UNION ALL SELECT qid, query, 'validation' AS qset FROM v_queries WHERE qset = 'validation'""")
def _(t):
    golden = t.queries.where("qset = 'golden'").select("qid", "query")
    held_out = t.queries.where("qset = 'validation'").select("qid", "query")
    return ev.query_set(("golden", golden), ("validation", held_out))


@query("R16_eval_run", f"WITH {RUN5} SELECT qid, first_hit, any_hit, all_hit, round(top1_score, 6) AS top1_score FROM run")
def _(t):
    return r6(run(t), "top1_score").select("qid", "first_hit", "any_hit", "all_hit", "top1_score")


@query("J12_hit_expectation_match", f"""WITH {S.bm25()} SELECT b.qid, b.doc_id, b.rank FROM bmr b JOIN documents d ON d.doc_id = b.doc_id JOIN v_queries q ON q.qid = b.qid
WHERE b.rank <= 10 AND d.source = concat('src', b.qid % 20) AND contains(lower(d.text), lower(regexp_extract(q.query, '\\S+')))""")
def _(t):
    hits = K.corpus(t).join(K.lexical(t, 10), "id").select(
        "qid", "rank", "id", "text", F.lit("document").alias("kind"), tx.nfc(C("site")).alias("ref")
    )
    wanted = t.queries.select(
        "qid", F.lit(0).alias("exp_idx"), F.lit("document").alias("kind"), F.concat(F.lit("src"), (C("qid") % 20).cast("string")).alias("ref"),
        F.regexp_extract("query", r"\S+", 0).alias("must_contain"),
    )
    return ev.match_hits(hits, wanted).select("qid", C("id").alias("doc_id"), "rank")


@query("W06_first_hit_position", f"WITH {RUN20} SELECT qid, first_hit FROM run")
def _(t):
    return run(t, 20).select("qid", "first_hit")


@query("A39_recall_overall", f"WITH {RUN5} SELECT {RECALL} FROM run WHERE NOT must_refuse")
def _(t):
    return ev.recall_overall(run(t))


@query("A40_recall_by_bucket", f"WITH {RUN5} SELECT qset, category, label, {RECALL} FROM run WHERE NOT must_refuse GROUP BY GROUPING SETS ((qset), (category), (label))")
def _(t):
    return ev.recall_by_bucket(run(t), ["qset", "category", "label"])


@query("D04_bucket_key", f"WITH {RUN5} SELECT label % 2 = 0 AS bucket, {RECALL} FROM run WHERE NOT must_refuse GROUP BY 1")
def _(t):
    return ev.recall_by(run(t), C("label") % 2 == 0)


@query("A41_first_hit_histogram", f"WITH {RUN20} SELECT first_hit AS position, count(*) AS n FROM run WHERE NOT must_refuse GROUP BY 1")
def _(t):
    return ev.first_hit_histogram(run(t, 20))


@query("A41b_first_hit_bins", f"""WITH {RUN20}, b AS (SELECT CASE WHEN first_hit = 1 THEN '#1' WHEN first_hit <= 3 THEN '#2-3' WHEN first_hit <= 5 THEN '#4-5' WHEN first_hit <= 10 THEN '#6-10' WHEN first_hit <= 20 THEN '#11-20' ELSE 'miss' END AS bin
 FROM run WHERE NOT must_refuse) SELECT bin, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS share FROM b GROUP BY bin""")
def _(t):
    return ev.first_hit_bins(run(t, 20))


def at_sql(h: str) -> str:
    low = f"max(CASE WHEN rn = floor({h}) THEN x END)"
    return f"round({low} + (max(CASE WHEN rn = ceil({h}) THEN x END) - {low}) * max(CAST({h} - floor({h}) AS DOUBLE)), 6)"


H1, H3 = "greatest(0.0, least(0.25 * (n + 1) - 1, n - 1))", "greatest(0.0, least(0.75 * (n + 1) - 1, n - 1))"


@query("A42_score_distribution", f"""WITH {RUN5}, c AS (SELECT CASE WHEN must_refuse THEN 'must_refuse' WHEN any_hit THEN 'hit' ELSE 'miss' END AS class, top1_score AS x FROM run WHERE top1_score IS NOT NULL),
r AS (SELECT class, x, row_number() OVER (PARTITION BY class ORDER BY x) - 1 AS rn, count(*) OVER (PARTITION BY class) AS n FROM c)
SELECT class, max(n) AS n, round(min(x), 6) AS lo, round(max(x), 6) AS hi, CASE WHEN max(n) < 4 THEN round(min(x), 6) ELSE {at_sql(H1)} END AS q1, round(quantile_cont(x, 0.5), 6) AS median,
 CASE WHEN max(n) < 4 THEN round(max(x), 6) ELSE {at_sql(H3)} END AS q3 FROM r GROUP BY class""")
def _(t):
    out = ev.score_distribution(run(t))
    return r6(out, "lo", "hi", "q1", "median", "q3").select("class", "n", "lo", "hi", "q1", "median", "q3")


CURVE = """SELECT {g} k, hits, total, round(hits / CAST(total AS DOUBLE), 6) AS recall, round((hits / CAST(total AS DOUBLE) - first_value(hits / CAST(total AS DOUBLE)) OVER ({p} ORDER BY k)) * 100, 6) AS delta
FROM (SELECT {g} k, count(*) FILTER (WHERE first_hit <= k) AS hits, count(*) AS total FROM run, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE NOT must_refuse GROUP BY {g} k)"""


@query("A43_recall_curve", f"WITH {RUN20} {CURVE.format(g='', p='')}")
def _(t):
    return ev.recall_curve(run(t, 20))


@query("A43b_recall_curve_by_category", f"WITH {RUN20} {CURVE.format(g='category,', p='PARTITION BY category')}")
def _(t):
    return ev.recall_curve(run(t, 20), by=["category"])


@query("W12_delta_to_baseline", f"WITH {RUN20} SELECT k, delta FROM ({CURVE.format(g='', p='')})")
def _(t):
    return ev.recall_curve(run(t, 20)).select("k", "delta")


SPLIT = """sc AS (SELECT top1_score AS s, must_refuse AS neg FROM run WHERE top1_score IS NOT NULL AND (must_refuse OR any_hit)),
sweep AS (SELECT s AS threshold, round((SELECT count(*) FROM sc WHERE NOT neg AND sc.s >= c.s) / CAST((SELECT count(*) FROM sc WHERE NOT neg) AS DOUBLE), 9) AS tp_rate,
 round((SELECT count(*) FROM sc WHERE neg AND sc.s < c.s) / CAST((SELECT count(*) FROM sc WHERE neg) AS DOUBLE), 9) AS tn_rate FROM (SELECT DISTINCT s FROM sc) c)"""


@query("A44_threshold_sweep", f"""WITH {RUN5}, {SPLIT} SELECT round(threshold, 6) AS threshold, round(tp_rate, 6) AS tp_rate, round(tn_rate, 6) AS tn_rate, round((tp_rate + tn_rate) / 2, 6) AS balanced
FROM sweep ORDER BY round((tp_rate + tn_rate) / 2, 8) DESC, threshold LIMIT 1""")
def _(t):
    return r6(ev.threshold_sweep(run(t)), "threshold", "tp_rate", "tn_rate", "balanced")


@query("A44b_threshold_tradeoffs", f"""WITH {RUN5}, {SPLIT} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE NOT neg AND s >= t) AS kept, count(*) FILTER (WHERE NOT neg) AS answerable,
 count(*) FILTER (WHERE neg AND s < t) AS refused, count(*) FILTER (WHERE neg) AS must_refuse FROM sc, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5]) AS t) GROUP BY t""")
def _(t):
    return ev.threshold_tradeoffs(run(t))


# --- robustness: lexical search over four wordings; a query is right when one of
# its first five documents contains the whole original text ------------------------------

SQL_FORMS = ["original", "lowercase_no_punct", "truncate_3", "reverse"]


def stress(t, forms=None):
    wordings = ev.perturbed_queries(t.queries, forms)
    asked = wordings.where(~C("skipped")).select("qid", C("form_no").alias("variant"), "query")
    hits = cut_lineage(rank.bm25_rank(K.corpus(t), asked, 5, index=t.lexical_index))  # five rows a wording
    originals = t.queries.select("qid", C("query").alias("phrase"))
    judged = (
        K.corpus(t).select("id", "text").join(checked_broadcast(hits.join(originals, "qid")), "id")
        .select("qid", "variant", F.contains("text", C("phrase")).alias("found"), F.when(C("rank") == 1, C("score")).alias("top"))
        .groupBy("qid", C("variant").alias("form_no"))
        .agg(F.bool_or("found").alias("_hit"), F.max("top").alias("top1_score"))
    )
    refuse = t.queries.select("qid", "must_refuse")
    return (
        wordings.join(judged, ["qid", "form_no"], "left").join(refuse, "qid")
        .withColumn("hit_any", F.when(~C("must_refuse"), F.coalesce("_hit", F.lit(False))))
        .select("qid", "perturbation", "hit_any", "top1_score", "skipped")
    )


def sql_forms():
    return {n: tx.PERTURBATIONS[n] for n in SQL_FORMS}


FORMS_SQL = " UNION ALL ".join(f"SELECT qid * 1000 + {i} AS qid, {e} AS query FROM v_queries" for i, e in enumerate(Q.perturb_sql("query").values()))
STRESS = f"""forms AS (SELECT * FROM ({FORMS_SQL})), asked AS (SELECT * FROM forms WHERE {Q.strip_sql('query')} <> ''), {S.bm25('asked')},
res AS (SELECT f.qid // 1000 AS qid, CASE f.qid % 1000 WHEN 0 THEN 'original' WHEN 1 THEN 'lowercase_no_punct' WHEN 2 THEN 'truncate_3' ELSE 'reverse' END AS perturbation,
 CASE WHEN NOT o.must_refuse THEN coalesce(j.hit, FALSE) END AS hit_any, j.top1_score, {Q.strip_sql('f.query')} = '' AS skipped
 FROM forms f JOIN v_queries o ON o.qid = f.qid // 1000 LEFT JOIN (SELECT b.qid, bool_or(contains(d.text, q.query)) AS hit, max(CASE WHEN b.rank = 1 THEN b.score END) AS top1_score
  FROM bmr b JOIN documents d ON d.doc_id = b.doc_id JOIN v_queries q ON q.qid = b.qid // 1000 WHERE b.rank <= 5 GROUP BY b.qid) j ON j.qid = f.qid)"""


@query("R17_stress_run", f"WITH {STRESS} SELECT qid, perturbation, hit_any, round(top1_score, 6) AS top1_score, skipped FROM res")
def _(t):
    return r6(stress(t, sql_forms()), "top1_score")


@query("R17b_stress_with_typos")
def _(t):
    return ev.stress_recall(stress(t))


@query("D02_perturbation_registry", f"WITH {STRESS.replace('list_reverse', 'list_sort')} SELECT qid, perturbation, hit_any FROM res")
def _(t):
    forms = {**sql_forms(), "reverse": lambda q, seed: F.array_join(F.array_sort(tx.words(q)), " ")}
    return stress(t, forms).select("qid", "perturbation", "hit_any")


@query("A45_stress_recall", f"""WITH {STRESS}, s AS (SELECT perturbation, count(*) FILTER (WHERE hit_any) AS hits, count(*) FILTER (WHERE hit_any IS NOT NULL AND NOT skipped) AS total FROM res GROUP BY perturbation)
SELECT perturbation, hits, total, round(hits / CAST(total AS DOUBLE), 6) AS recall, round(hits / CAST(total AS DOUBLE) - (SELECT hits / CAST(total AS DOUBLE) FROM s WHERE perturbation = 'original'), 6) AS delta FROM s""")
def _(t):
    return ev.stress_recall(stress(t, sql_forms()))


@query("A46_brittle_robust", f"""WITH {STRESS}, g AS (SELECT qid, coalesce(bool_or(perturbation = 'original' AND hit_any), FALSE) AS base, coalesce(bool_and(hit_any), TRUE) AS robust,
 string_agg(CASE WHEN perturbation <> 'original' AND NOT hit_any THEN perturbation END, ', ' ORDER BY perturbation) AS failed FROM res GROUP BY qid)
SELECT qid, base AND failed IS NOT NULL AS brittle, robust, CASE WHEN base THEN coalesce(failed, '') ELSE '' END AS failed_under FROM g""")
def _(t):
    return ev.brittle_robust(stress(t, sql_forms()))


@query("A47_refusal_score_matrix", f"WITH {STRESS} SELECT qid, " + ", ".join(f"round(max(top1_score) FILTER (WHERE perturbation = '{n}'), 6) AS {n}" for n in SQL_FORMS) + " FROM res WHERE hit_any IS NULL GROUP BY qid")
def _(t):
    return ev.refusal_matrix(stress(t, sql_forms()), SQL_FORMS)


# --- strategies and latency ----------------------------------------------------------------

ABLATION = f"""{HITS}, {run_sql(5, 'dense5')}, {run_sql(10, 'dense10')},
ab AS (SELECT d.qid, h1.score AS top1, h2.score AS top2, d.any_hit AS dense_hit, r.any_hit AS rerank_hit, 0.1::DOUBLE + d.qid % 7 * 0.01::DOUBLE AS dense_lat, 1.1::DOUBLE + d.qid % 7 * 0.01::DOUBLE AS rerank_lat
 FROM dense5 d JOIN dense10 r ON r.qid = d.qid LEFT JOIN hits h1 ON h1.qid = d.qid AND h1.rank = 1 LEFT JOIN hits h2 ON h2.qid = d.qid AND h2.rank = 2 WHERE NOT d.must_refuse),
st AS (SELECT 'dense_only' AS strategy, * , TRUE AS skipped FROM ab UNION ALL SELECT 'rerank_always' AS strategy, *, FALSE AS skipped FROM ab
 {" ".join(f"UNION ALL SELECT 'threshold({a},{b})' AS strategy, *, top1 > {a}::DOUBLE AND top1 - top2 > {b}::DOUBLE AS skipped FROM ab" for a, b in ev.MARGINS)})"""


def ablation_rows(t):
    hits = dense_hits(t)
    both = [ev.run_table(eval_queries(t), hits, expected(t), k) for k in (5, 10)]
    tops = rank.top_margin(hits).select("qid", "top1", "top2")
    lat = C("qid") % 7 * 0.01
    return (
        both[0].where(~C("must_refuse")).select("qid", C("any_hit").alias("dense_hit"))
        .join(both[1].select("qid", C("any_hit").alias("rerank_hit")), "qid").join(tops, "qid")
        .withColumn("dense_lat", 0.1 + lat).withColumn("rerank_lat", 1.1 + lat)
    )


STRATEGY = """SELECT strategy, count(*) FILTER (WHERE h) AS correct, count(*) AS total, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(l), 6) AS mean_latency,
 round(avg(CASE WHEN skipped THEN 1.0 ELSE 0.0 END), 6) AS skip_rate, round(quantile_cont(l, 0.5), 6) AS p50_latency FROM (
 SELECT strategy, skipped, CASE WHEN skipped THEN dense_hit ELSE rerank_hit END AS h, CASE WHEN skipped THEN dense_lat ELSE rerank_lat END AS l FROM st) GROUP BY strategy"""


@query("A48_strategy_ablation", f"WITH {ABLATION} {STRATEGY}")
def _(t):
    return ev.strategy_ablation(ablation_rows(t))


@query("D03_strategy_registry", f"WITH {ABLATION.split('st AS')[0]} st AS (SELECT 'confident' AS strategy, *, top1 > 0.9::DOUBLE AS skipped FROM ab) {STRATEGY}")
def _(t):
    return ev.strategy_ablation(ablation_rows(t), {"confident": C("top1") > 0.9})


REQUESTS = """SELECT chat_id AS query_id, NOT refused AS ok, latency_ms / 1000.0::DOUBLE AS elapsed, CASE WHEN refused THEN 503 ELSE 200 END AS status,
 CASE WHEN refused THEN concat('busy ', chat_id % 4) END AS error, rerank AS refused, model_used, 'gemini/a' AS model, content AS answer, latency_ms FROM v_turns WHERE role = 'assistant'"""


def requests(t):
    spark_sql = REQUESTS.replace("1000.0::DOUBLE", "1000.0D")
    stage = F.create_map(F.lit("retrieval"), C("elapsed") * 0.25, F.lit("answer"), C("elapsed") * 0.75)
    return t.sql(spark_sql).withColumn("timings", stage)


NTH = "max(CASE WHEN rn = round_even({p} * (n - 1), 0) THEN elapsed END)"


@query("A49_load_report", f"""WITH q AS ({REQUESTS}), r AS (SELECT elapsed, row_number() OVER (ORDER BY elapsed) - 1 AS rn, count(*) OVER () AS n FROM q WHERE ok)
SELECT *, (SELECT {NTH.format(p=0.50)} FROM r) AS p50_s, (SELECT {NTH.format(p=0.95)} FROM r) AS p95_s, (SELECT {NTH.format(p=0.99)} FROM r) AS p99_s FROM (
 SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, min(elapsed) FILTER (WHERE ok) AS min_s, max(elapsed) FILTER (WHERE ok) AS max_s,
 round(avg(elapsed) FILTER (WHERE ok), 6) AS mean_s, round(count(*) FILTER (WHERE ok) / 60.0::DOUBLE, 6) AS throughput, count(*) FILTER (WHERE ok AND refused) AS soft_refusals FROM q)""")
def _(t):
    return ev.load_report(requests(t), 60.0)


@query("A49b_stage_means", f"""WITH q AS ({REQUESTS}) SELECT 'rewrite' AS stage, 0.0::DOUBLE AS mean_s UNION ALL SELECT 'retrieval' AS stage, round(avg(elapsed * 0.25::DOUBLE), 6) AS mean_s FROM q WHERE ok
UNION ALL SELECT 'answer' AS stage, round(avg(elapsed * 0.75::DOUBLE), 6) AS mean_s FROM q WHERE ok""")
def _(t):
    return ev.stage_means(requests(t))


@query("A49c_model_mix", f"WITH q AS ({REQUESTS}) SELECT model_used AS model, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM q WHERE ok), 6) AS pct FROM q WHERE ok GROUP BY 1")
def _(t):
    return ev.model_mix(requests(t))


@query("A49d_failures", f"SELECT status, error, count(*) AS n FROM ({REQUESTS}) WHERE NOT ok GROUP BY status, error ORDER BY n DESC, status, error LIMIT 10")
def _(t):
    return ev.failures(requests(t))


@query("A50_model_comparison", f"""WITH q AS (SELECT * REPLACE (model_used AS model) FROM ({REQUESTS}) WHERE ok), r AS (SELECT model, elapsed, row_number() OVER (PARTITION BY model ORDER BY elapsed) - 1 AS rn, count(*) OVER (PARTITION BY model) AS n FROM q)
SELECT q.model, count(*) AS answered, count(*) FILTER (WHERE refused) AS refused, count(*) FILTER (WHERE model_used = q.model) AS used_self, max(x.p50_s) AS p50_s, max(x.p95_s) AS p95_s
FROM q JOIN (SELECT model, {NTH.format(p=0.5)} AS p50_s, {NTH.format(p=0.95)} AS p95_s FROM r GROUP BY model) x ON x.model = q.model GROUP BY q.model""")
def _(t):
    return ev.model_comparison(requests(t).withColumn("model", C("model_used")))


@query("A50b_answer_lengths", f"""SELECT query_id, max(length(answer)) FILTER (WHERE model_used = 'gemini/a') AS "gemini/a", max(length(answer)) FILTER (WHERE model_used = 'groq/b') AS "groq/b" FROM ({REQUESTS}) GROUP BY query_id""")
def _(t):
    return ev.answer_lengths(requests(t).withColumn("model", C("model_used")), ["gemini/a", "groq/b"])


# --- the query set --------------------------------------------------------------------------

AUDIT_Q = "SELECT qid, must_refuse FROM v_queries"
AUDIT_E = """SELECT qid, CASE qid % 5 WHEN 0 THEN 'message' WHEN 4 THEN 'video' ELSE 'document' END AS kind,
 CASE qid % 5 WHEN 0 THEN CAST(qid * 10000 AS VARCHAR(20)) ELSE CAST(qid * 31 AS VARCHAR(20)) END AS ref, CASE WHEN qid % 5 = 2 THEN 'the' WHEN qid % 5 = 3 THEN 'no such phrase' END AS must_contain FROM v_queries WHERE must_refuse = FALSE OR qset = 'golden'"""


def audit(t):
    queries = t.queries.select("qid", "must_refuse", F.slice(tx.words(C("query")), 1, 2).alias("keywords"))
    messages = t.messages.select(C("id").cast("string").alias("ref"), "text")
    documents = t.documents.select(C("doc_id").cast("string").alias("ref"), "text")
    return queries, ev.expectation_audit(queries, t.sql(AUDIT_E), messages, documents)


AUDIT = f"""qq AS (SELECT qid, must_refuse, list_slice(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''), 1, 2) AS kw FROM v_queries), e AS ({AUDIT_E}),
w AS (SELECT e.*, q.kw FROM e JOIN qq q ON q.qid = e.qid WHERE NOT q.must_refuse), m AS (SELECT w.*, v.text FROM w LEFT JOIN v_messages v ON CAST(v.id AS VARCHAR(20)) = w.ref WHERE kind = 'message'),
d AS (SELECT w.*, v.text, v.doc_id FROM w LEFT JOIN documents v ON CAST(v.doc_id AS VARCHAR(20)) = w.ref WHERE kind = 'document'),
audit AS (SELECT q.qid, 'error' AS level, 'refusal with sources' AS problem, NULL AS ref FROM qq q WHERE must_refuse AND qid IN (SELECT qid FROM e)
 UNION ALL SELECT qid, 'warning', 'refusal with keywords', NULL FROM qq WHERE must_refuse AND len(kw) > 0
 UNION ALL SELECT qid, 'error', 'no sources', NULL FROM qq WHERE NOT must_refuse AND qid NOT IN (SELECT qid FROM e)
 UNION ALL SELECT qid, 'error', 'message not found', ref FROM m WHERE text IS NULL
 UNION ALL SELECT qid, 'warning', 'message is blank', ref FROM m WHERE text IS NOT NULL AND trim(text) = ''
 UNION ALL SELECT qid, 'warning', 'no keyword found', ref FROM m WHERE text IS NOT NULL AND trim(text) <> '' AND len(list_filter(kw, lambda k: contains(lower(text), lower(k)))) = 0
 UNION ALL SELECT qid, 'error', 'document not found', ref FROM d WHERE doc_id IS NULL
 UNION ALL SELECT qid, 'error', 'phrase not found', ref FROM d WHERE doc_id IS NOT NULL AND must_contain IS NOT NULL AND NOT contains(lower(text), lower(must_contain))
 UNION ALL SELECT qid, 'error', 'unknown kind', ref FROM w WHERE kind NOT IN ('message', 'document'))"""


@query("J13_expectation_audit", f"WITH {AUDIT} SELECT * FROM audit")
def _(t):
    return audit(t)[1]


@query("A53b_audit_summary", f"""WITH {AUDIT} SELECT (SELECT count(*) FROM qq) AS queries, (SELECT count(*) FROM qq WHERE qid NOT IN (SELECT qid FROM audit WHERE level = 'error')) AS clean,
 (SELECT count(*) FROM audit WHERE level = 'error') AS errors, (SELECT count(*) FROM audit WHERE level = 'warning') AS warnings""")
def _(t):
    return ev.audit_summary(*audit(t))


@query("A53_query_set_profile", "SELECT category, qset, must_refuse, count(*) AS n FROM v_queries GROUP BY GROUPING SETS ((category), (qset), (must_refuse))")
def _(t):
    return ev.query_set_profile(t.queries)
