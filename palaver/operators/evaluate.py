"""Retrieval quality: expectations, recall, thresholds, robustness, latency.

Hits are (qid, rank, id, score, kind, ref[, text]); expectations are (qid,
exp_idx, kind, ref[, must_contain]).  A query has at most k hits and a handful
of expectations, so everything per query is small; the number of queries is not
assumed to be.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators.activity import count_if
from palaver.plans.scale import order_stats, position_cont, position_exclusive, position_floor, position_round, running_sum, scalar
from palaver.session import cut_lineage

C = F.col


# --- matching ---------------------------------------------------------------------------


def match_hits(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, exp_idx, rank, id) of hits that satisfy an expectation: same kind
    and reference, and the required phrase, if any, in the text."""
    joined = hits.join(expected, ["qid", "kind", "ref"])
    if "must_contain" in expected.columns:
        joined = joined.where(C("must_contain").isNull() | tx.contains_ci(C("text"), C("must_contain")))
    return joined.select("qid", "exp_idx", "rank", "id")


def run_table(queries: DataFrame, hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row per query: first hit, any / all expectations met, top score.

    Queries that must be refused have no verdict.
    """
    top = hits.where(C("rank") <= k)
    matched = match_hits(top, expected)
    met = matched.groupBy("qid").agg(F.min("rank").alias("_first"), F.count_distinct("exp_idx").alias("_met"))
    wanted = expected.groupBy("qid").agg(F.count_distinct("exp_idx").alias("_wanted"))
    best = top.where(C("rank") == 1).select("qid", C("score").alias("top1_score"))
    answerable = ~C("must_refuse")
    return (
        queries.join(met, "qid", "left").join(wanted, "qid", "left").join(best, "qid", "left")
        .withColumn("first_hit", F.when(answerable, C("_first")))
        .withColumn("any_hit", F.when(answerable, C("_first").isNotNull()))
        .withColumn("all_hit", F.when(answerable, F.coalesce(C("_met"), F.lit(0)) == F.coalesce(C("_wanted"), F.lit(0))))
        .drop("_first", "_met", "_wanted")
    )


def _recall_aggs() -> list[Column]:
    return [
        F.count("*").alias("total"),
        count_if(C("any_hit")).alias("any_hits"),
        count_if(C("all_hit")).alias("all_hits"),
        F.round(F.avg(C("any_hit").cast("double")), 6).alias("recall_any"),
        F.round(F.avg(C("all_hit").cast("double")), 6).alias("recall_all"),
    ]


def recall_overall(run: DataFrame) -> DataFrame:
    return run.where(~C("must_refuse")).agg(*_recall_aggs())


def recall_by_bucket(run: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Recall per value of each bucket column, all in one pass."""
    sets = [[C(b)] for b in buckets]
    grouped = run.where(~C("must_refuse")).groupingSets(sets, *[C(b) for b in buckets]).agg(*_recall_aggs())
    return grouped


def recall_by(run: DataFrame, key: Column, name: str = "bucket") -> DataFrame:
    """Recall by any expression of the run row."""
    return run.where(~C("must_refuse")).groupBy(key.alias(name)).agg(*_recall_aggs())


def first_hit_histogram(run: DataFrame) -> DataFrame:
    """Queries per position of the first hit; misses have position NULL."""
    return run.where(~C("must_refuse")).groupBy(C("first_hit").alias("position")).agg(F.count("*").alias("n"))


# fixed values: position bins of the sweep
POSITION_BINS = ((1, 1), (2, 3), (4, 5), (6, 10), (11, 20))


def first_hit_bins(run: DataFrame, bins=POSITION_BINS) -> DataFrame:
    """Queries per bin of positions with their share; the last row is the misses."""
    label = F.lit("miss")
    for lo, hi in bins:
        name = f"#{lo}" if lo == hi else f"#{lo}-{hi}"
        label = F.when(C("first_hit").between(lo, hi), F.lit(name)).otherwise(label)
    answerable = run.where(~C("must_refuse"))
    counts = answerable.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))
    whole = scalar(counts, F.sum("n"))
    return counts.withColumn("share", F.round(C("n") / whole, 6))


def score_class() -> Column:
    return F.when(C("must_refuse"), "must_refuse").when(C("any_hit"), "hit").otherwise("miss")


def score_distribution(run: DataFrame) -> DataFrame:
    """Spread of the top score per class.

    Quartiles lie at (n + 1) p; below four values they are the least, the
    median and the greatest value.
    """
    rows = run.withColumn("class", score_class())
    stats = order_stats(
        rows, "top1_score", ["class"],
        {
            "q1": position_exclusive(0.25), "median": position_cont(0.5), "q3": position_exclusive(0.75),
            "floor_p25": position_floor(0.25), "floor_p75": position_floor(0.75),
        },
        lo=F.min("top1_score"), hi=F.max("top1_score"),
    )
    few = C("n") < 4
    return stats.withColumn("q1", F.when(few, C("lo")).otherwise(C("q1"))).withColumn(
        "q3", F.when(few, C("hi")).otherwise(C("q3"))
    )


def recall_curve(run: DataFrame, ks: Sequence[int] = (1, 2, 3, 4, 5), by: Sequence[str] = ()) -> DataFrame:
    """Recall at each k and its difference to the first k, from one run table."""
    answerable = run.where(~C("must_refuse"))
    per_k = answerable.select(*by, "first_hit", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    counts = per_k.groupBy(*by, "k").agg(
        count_if(C("first_hit") <= C("k")).alias("hits"), F.count("*").alias("total")
    )
    base = counts.where(C("k") == ks[0]).select(
        *[C(b).alias(f"_b_{b}") for b in by], (C("hits") / C("total")).alias("_base")
    )
    recall = C("hits") / C("total")
    if by:
        cond = F.lit(True)
        for b in by:
            cond = cond & C(b).eqNullSafe(C(f"_b_{b}"))
        joined = counts.join(base, cond).drop(*[f"_b_{b}" for b in by])
    else:
        joined = counts.withColumn("_base", base.select("_base").scalar())
    return joined.select(
        *by, "k", "hits", "total", F.round(recall, 6).alias("recall"), F.round((recall - C("_base")) * 100, 6).alias("delta")
    )


# --- thresholds ------------------------------------------------------------------------------


def _split_scores(run: DataFrame) -> DataFrame:
    """(score, pos, neg): counts of hits and of refusals per distinct score."""
    scored = run.where(C("top1_score").isNotNull() & (C("must_refuse") | C("any_hit")))
    return scored.groupBy(C("top1_score").alias("score")).agg(
        count_if(~C("must_refuse")).alias("pos"), count_if(C("must_refuse")).alias("neg")
    )


def threshold_sweep(run: DataFrame) -> DataFrame:
    """The threshold with the best balanced accuracy; the least one on ties.

    Every seen score is a candidate.  Running counts over the distinct scores
    give both rates, so candidates and scores are never paired.
    """
    # one row per distinct score; every later step reads it
    counts = cut_lineage(_split_scores(run).withColumn("_g", F.lit(0)))
    n_pos, n_neg = scalar(counts, F.sum("pos")), scalar(counts, F.sum("neg"))
    both = running_sum(running_sum(counts, ["_g"], ["score"], C("pos"), "_cp"), ["_g"], ["score"], C("neg"), "_cn")
    tp = (n_pos - (C("_cp") - C("pos"))) / n_pos
    tn = (C("_cn") - C("neg")) / n_neg
    return (
        both.select(C("score").alias("threshold"), F.round(tp, 9).alias("tp_rate"), F.round(tn, 9).alias("tn_rate"),
                    F.round((tp + tn) / 2, 9).alias("balanced"))
        .orderBy(C("balanced").desc(), "threshold")
        .limit(1)
    )


def threshold_tradeoffs(run: DataFrame, thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    counts = cut_lineage(_split_scores(run))
    at = counts.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    above = C("score") >= C("threshold")
    return at.groupBy("threshold").agg(
        F.sum(F.when(above, C("pos")).otherwise(0)).alias("kept"), F.sum("pos").alias("answerable"),
        F.sum(F.when(above, 0).otherwise(C("neg"))).alias("refused"), F.sum("neg").alias("must_refuse"),
    )


# --- robustness --------------------------------------------------------------------------------

Perturbation = Callable[[Column, Column], Column]


def perturbed_queries(queries: DataFrame, forms: Mapping[str, Perturbation] | None = None, seed: int = 42) -> DataFrame:
    """(qid, form_no, perturbation, query) for every wording, blank ones flagged."""
    forms = forms or tx.PERTURBATIONS
    seeds = C("qid") + seed
    made = F.array(
        *[F.struct(F.lit(i).alias("form_no"), F.lit(n).alias("perturbation"), f(C("query"), seeds).alias("wording"))
          for i, (n, f) in enumerate(forms.items())]
    )
    return queries.select("qid", F.explode(made).alias("p")).select(
        "qid", "p.form_no", "p.perturbation", C("p.wording").alias("query"), (tx.strip(C("p.wording")) == "").alias("skipped")
    )


def stress_recall(results: DataFrame, baseline: str = "original") -> DataFrame:
    """Recall per perturbation and its difference to the baseline.

    ``results`` = (qid, perturbation, hit_any, skipped); hit_any is NULL for
    queries that must be refused.
    """
    counted = C("hit_any").isNotNull() & ~C("skipped")
    rows = results.groupBy("perturbation").agg(
        count_if(C("hit_any")).alias("hits"), count_if(counted).alias("total")
    )
    recall = F.when(C("total") > 0, C("hits") / C("total")).otherwise(0.0)
    base = rows.where(C("perturbation") == baseline).select(recall.alias("r")).scalar()
    return rows.select("perturbation", "hits", "total", F.round(recall, 6).alias("recall"), F.round(recall - base, 6).alias("delta"))


def brittle_robust(results: DataFrame, baseline: str = "original") -> DataFrame:
    """Per query: passed the baseline but failed another; passed all seen."""
    failed = (C("perturbation") != baseline) & ~C("hit_any")
    per = results.groupBy("qid").agg(
        F.coalesce(F.bool_or((C("perturbation") == baseline) & C("hit_any")), F.lit(False)).alias("_base"),
        F.array_sort(F.collect_list(F.when(failed, C("perturbation")))).alias("_failed"),
        F.coalesce(F.bool_and("hit_any"), F.lit(True)).alias("robust"),
    )
    return per.select(
        "qid", (C("_base") & (F.size("_failed") > 0)).alias("brittle"), "robust",
        F.when(C("_base"), F.array_join("_failed", ", ")).otherwise("").alias("failed_under"),
    )


def refusal_matrix(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """Top score of each must-refuse query under each perturbation."""
    rows = results.where(C("hit_any").isNull())
    return rows.groupBy("qid").pivot("perturbation", list(names)).agg(F.round(F.max("top1_score"), 6))


# --- strategies and latency -----------------------------------------------------------------------

# fixed values: margins at which the second ranking step is skipped
MARGINS = ((0.75, 0.03), (0.80, 0.05), (0.85, 0.05), (0.85, 0.10))


def default_strategies() -> dict[str, Column]:
    """Name -> condition on (top1, top2) under which rescoring is skipped."""
    out = {"dense_only": F.lit(True), "rerank_always": F.lit(False)}
    for t1, t2 in MARGINS:
        skip = C("top2").isNotNull() & (C("top1") > t1) & (C("top1") - C("top2") > t2)
        out[f"threshold({t1},{t2})"] = F.coalesce(skip, F.lit(False))
    return out


def strategy_ablation(rows: DataFrame, strategies: Mapping[str, Column] | None = None) -> DataFrame:
    """Recall, latency and skip rate per strategy.

    ``rows`` = (qid, top1, top2, dense_hit, rerank_hit, dense_lat, rerank_lat).
    Each row fans out to one row per strategy, within its task.
    """
    chosen = strategies or default_strategies()
    fan = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("skipped")) for n, c in chosen.items()]))
    picked = rows.select("*", fan.alias("s")).select(
        C("s.strategy").alias("strategy"), C("s.skipped").alias("skipped"),
        F.when(C("s.skipped"), C("dense_hit")).otherwise(C("rerank_hit")).alias("hit"),
        F.when(C("s.skipped"), C("dense_lat")).otherwise(C("rerank_lat")).alias("latency"),
    )
    sums = picked.groupBy("strategy").agg(
        count_if(C("hit")).alias("correct"), F.count("*").alias("total"),
        F.round(F.avg(C("hit").cast("double")), 6).alias("recall"), F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.round(F.avg(C("skipped").cast("double")), 6).alias("skip_rate"),
    )
    mids = order_stats(picked, "latency", ["strategy"], {"p50": position_cont(0.5)})
    return sums.join(mids.select("strategy", F.round("p50", 6).alias("p50_latency")), "strategy")


def load_report(requests: DataFrame, wall_seconds: float) -> DataFrame:
    """Totals, throughput and latency of a load run.  Input: ok, elapsed, refused."""
    sums = requests.agg(
        F.count("*").alias("total"), count_if(C("ok")).alias("succeeded"), count_if(~C("ok")).alias("failed"),
        F.min(F.when(C("ok"), C("elapsed"))).alias("min_s"), F.max(F.when(C("ok"), C("elapsed"))).alias("max_s"),
        F.round(F.avg(F.when(C("ok"), C("elapsed"))), 6).alias("mean_s"),
        F.round(count_if(C("ok")) / F.lit(float(wall_seconds)), 6).alias("throughput"),
        count_if(C("ok") & C("refused")).alias("soft_refusals"),
    )
    stats = order_stats(
        requests.where("ok"), "elapsed", [],
        {"p50_s": position_round(0.50), "p95_s": position_round(0.95), "p99_s": position_round(0.99)},
    )
    return sums.select("*", *[stats.select(c).scalar().alias(c) for c in ("p50_s", "p95_s", "p99_s")])


def stage_means(requests: DataFrame, stages: Sequence[str] = ("rewrite", "retrieval", "answer")) -> DataFrame:
    """Mean seconds per stage over timed requests; a missing stage counts 0."""
    timed = requests.where(C("ok") & C("timings").isNotNull() & (F.size("timings") > 0))
    fan = F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.coalesce(F.try_element_at("timings", F.lit(s)), F.lit(0.0)).alias("v")) for s in stages
    ]))
    return timed.select(fan.alias("x")).groupBy("x.stage").agg(F.round(F.avg("x.v"), 6).alias("mean_s"))


def model_mix(requests: DataFrame) -> DataFrame:
    ok = requests.where("ok")
    counts = ok.groupBy(F.coalesce("model_used", F.lit("unknown")).alias("model")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(C("n") * 100.0 / scalar(counts, F.sum("n")), 6))


def failures(requests: DataFrame, k: int = 10) -> DataFrame:
    error = F.substring(F.coalesce("error", F.lit("")), 1, 60)
    return (
        requests.where(~C("ok")).groupBy("status", error.alias("error")).agg(F.count("*").alias("n"))
        .orderBy(C("n").desc(), "status", "error").limit(k)
    )


def model_comparison(results: DataFrame) -> DataFrame:
    """Per requested model: latency, refusals, answers given by itself."""
    ok = results.where("ok")
    sums = ok.groupBy("model").agg(
        F.count("*").alias("answered"), count_if(C("refused")).alias("refused"), count_if(C("model_used") == C("model")).alias("used_self")
    )
    stats = order_stats(ok, "elapsed", ["model"], {"p50_s": position_round(0.5), "p95_s": position_round(0.95)})
    return sums.join(stats.select("model", "p50_s", "p95_s"), "model")


def answer_lengths(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Answer length per query (rows) and model (columns)."""
    return results.groupBy("query_id").pivot("model", list(models)).agg(F.max(F.length(F.coalesce("answer", F.lit("")))))


# --- the query set itself ----------------------------------------------------------------------------


def query_set(*labelled: tuple[str, DataFrame]) -> DataFrame:
    """Several query sets as one, tagged with their label."""
    out: DataFrame | None = None
    for label, df in labelled:
        tagged = df.withColumn("qset", F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def query_set_profile(queries: DataFrame) -> DataFrame:
    return queries.groupingSets([[C("category")], [C("qset")], [C("must_refuse")]], C("category"), C("qset"), C("must_refuse")).agg(
        F.count("*").alias("n")
    )


def expectation_audit(queries: DataFrame, expected: DataFrame, messages: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, level, problem, ref) rows: what is wrong with the expectations.

    ``queries`` = (qid, must_refuse, keywords), ``expected`` = (qid, kind, ref
    string, must_contain), ``messages`` and ``documents`` = (ref, text).
    """
    refused = queries.where("must_refuse")
    answerable = queries.where(~C("must_refuse"))
    has = expected.select("qid").distinct()

    def problem(df: DataFrame, level: str, name: str) -> DataFrame:
        ref = C("ref") if "ref" in df.columns else F.lit(None).cast("string")
        return df.select("qid", F.lit(level).alias("level"), F.lit(name).alias("problem"), ref.alias("ref"))

    wanted = expected.join(answerable.select("qid", "keywords"), "qid")
    m = wanted.where("kind = 'message'").join(messages.select("ref", "text", F.lit(1).alias("_f")), "ref", "left")
    d = wanted.where("kind = 'document'").join(documents.select("ref", "text", F.lit(1).alias("_f")), "ref", "left")
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    named = F.exists("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))
    found = C("_f").isNotNull()
    lacks = C("must_contain").isNotNull() & ~tx.contains_ci(C("text"), C("must_contain"))
    parts = [
        problem(refused.join(has, "qid", "left_semi"), "error", "refusal with sources"),
        problem(refused.where(F.size("keywords") > 0), "warning", "refusal with keywords"),
        problem(answerable.join(has, "qid", "left_anti"), "error", "no sources"),
        problem(m.where(~found), "error", "message not found"),
        problem(m.where(found & blank), "warning", "message is blank"),
        problem(m.where(found & ~blank & ~F.coalesce(named, F.lit(False))), "warning", "no keyword found"),
        problem(d.where(~found), "error", "document not found"),
        problem(d.where(found & lacks), "error", "phrase not found"),
        problem(wanted.where(~C("kind").isin("message", "document")), "error", "unknown kind"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_summary(queries: DataFrame, audit: DataFrame) -> DataFrame:
    """Queries checked, clean ones, errors and warnings."""
    bad = audit.where("level = 'error'").select("qid").distinct()
    clean = queries.join(bad, "qid", "left_anti").agg(F.count("*").alias("n")).scalar()
    issues = audit.agg(count_if(C("level") == "error").alias("errors"), count_if(C("level") == "warning").alias("warnings"))
    return issues.select(scalar(queries, F.count("*")).alias("queries"), clean.alias("clean"), "errors", "warnings")
