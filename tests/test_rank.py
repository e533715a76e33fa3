"""Ranking properties and brute-force twins."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import cells, evaluate, postings, rank

C = F.col


def bm25_by_hand(docs, queries, n):
    toks = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    size, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(size - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    out = {}
    for q, text in queries:
        scores = {}
        for i, t in toks.items():
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall(r"\w+", text.lower()) if tf[w])
            if round(s, 9) > 0:
                scores[i] = round(s, 9)
        out[q] = sorted(scores, key=lambda i: (-scores[i], i))[:n]
    return out


def test_bm25(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["the"] * 20 + [f"w{i}" for i in range(60)] + ["été", "سؤال"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 40)))) for i in range(120)] + [(120, "")]
    queries = [(q, " ".join(rnd.choices(words, k=5)) + " the the!") for q in range(8)] + [(8, "unseen")]
    got = rank.bm25_rank(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "qid long, query string"), 10)
    want = {q: v for q, v in bm25_by_hand(docs, queries, 10).items() if v}

    def lists(ranked):
        found = {}
        for r in ranked.orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append(r.id)
        return found

    assert lists(got) == want
    frames = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "qid long, query string")
    monkeypatch.setattr(rank, "BLOCK_CELLS", 12)  # several blocks of queries
    assert lists(rank.bm25_rank(*frames, 10)) == want
    # ids and query names of any type, several wordings
    named = frames[0].withColumn("id", F.format_string("d%05d", "id"))
    asked = frames[1].select(F.concat(F.lit("q"), "qid").alias("qid"), F.lit(1000).alias("variant"), "query")
    found = rank.bm25_rank(named, asked, 10).select(F.substring("qid", 2, 9).cast("long").alias("qid"), "variant", F.substring("id", 2, 9).cast("long").alias("id"), "rank")
    assert lists(found) == want and {r.variant for r in found.collect()} == {1000}


def test_stored_index(spark, monkeypatch):
    """Many small ranges, deltas and masks give what a fresh count over the live documents gives."""
    monkeypatch.setattr(postings, "RANGE_TOKENS", 60)
    rnd = random.Random(3)
    words = ["the"] * 12 + [f"w{i}" for i in range(200)]
    text = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 30)))
    live = {f"d{i:04d}": text() for i in range(400)} | {"empty": "", "none": None}
    frame = lambda rows: spark.createDataFrame(list(rows), "id string, text string")
    queries = [(q, " ".join(rnd.choices(words, k=4))) for q in range(9)]
    asked = spark.createDataFrame(queries, "qid long, query string")

    def found(ranked):
        out = {}
        for r in ranked.orderBy("qid", "rank").collect():
            out.setdefault(r.qid, []).append((r.id, r.score))
        return out

    def want(n=7):
        return {q: v for q, v in bm25_by_hand([(i, t or "") for i, t in live.items()], queries, n).items() if v}

    index = postings.LexicalIndex.build(frame(live.items()))
    assert index.documents().select("range").distinct().count() > 20
    assert {q: [i for i, _ in v] for q, v in found(rank.bm25_search(index, asked, 7)).items()} == want()
    # the floor leaves ranges out; without it (all ranges are seeds) the result is the same
    for seeds in (1, 3, 1000):
        monkeypatch.setattr(rank, "SEEDS", seeds)
        assert {q: [i for i, _ in v] for q, v in found(rank.bm25_search(index, asked, 7)).items()} == want()
    monkeypatch.setattr(rank, "SEEDS", 2)
    for step in range(3):
        change = {i: text() for i in rnd.sample(sorted(live), 20)} | {f"n{step}-{i}": text() for i in range(30)}
        gone = [i for i in rnd.sample(sorted(live), 15) if i not in change]
        index.extend(frame(change.items()), frame((i, None) for i in [*gone, "unknown"]))
        live = {i: t for i, t in (live | change).items() if i not in gone}
    index.extend(removed=frame([("empty", None)]))
    live.pop("empty", None)
    assert sorted((r.id, r.dl) for r in index.documents().collect()) == sorted((i, len((t or "").split())) for i, t in live.items())
    df = Counter(w for t in live.values() for w in set((t or "").split()))
    assert {r.term: r.df for r in index.vocabulary().collect() if r.term} == df
    assert {q: [i for i, _ in v] for q, v in found(rank.bm25_search(index, asked, 7)).items()} == want()
    few = [i for i in live if i.endswith("7")]
    limited = found(rank.bm25_search(index, asked, 3, frame((i, None) for i in few)))
    every = found(rank.bm25_search(index, asked, 1000))
    assert limited == {q: [x for x in v if x[0] in few][:3] for q, v in every.items() if any(x[0] in few for x in v)}
    # a generation without its line in commits does not count
    before = found(rank.bm25_search(index, asked, 5))
    index._append("vocab", spark.createDataFrame([("the", 999, 0)], "term string, df long, dl long"), 77)
    again = postings.LexicalIndex(spark, index.path, "string")
    assert found(rank.bm25_search(again, asked, 5)) == before
    nothing = postings.LexicalIndex.build(frame([]))
    assert rank.bm25_search(nothing, asked).collect() == []


def test_a_search_reads_no_text(spark):
    index = postings.LexicalIndex.build(spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "id long, text string"))
    asked = spark.createDataFrame([(1, "word7 common")], "qid long, query string")
    assert [r.id for r in rank.bm25_search(index, asked, 2).orderBy("rank").collect()][0] == 7
    assert all(f.startswith("file:") and index.path.split("/")[-1] in f for f in index.lists().inputFiles())


def unit(rng, n, dim=8):
    v = rng.standard_normal((n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_dense_rank_in_blocks_with_ties(spark):
    rng = np.random.default_rng(0)
    store, asked = unit(rng, 300), unit(rng, 10)
    store[100:140] = store[5]  # ties are ordered by id
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(store)], "id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(q, v.tolist(), 7) for q, v in enumerate(asked)], "qid long, embedding array<float>, own long")
    scores = np.round(asked.astype(np.float64) @ store.T.astype(np.float64), rank.DIGITS)
    for block, skip in ((3, None), (100, "own")):
        got = {}
        for r in rank.dense_rank(vectors, queries, 12, block=block, skip=skip).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        for q in range(10):
            order = [i for i in sorted(range(300), key=lambda i: (-scores[q][i], i)) if not (skip and i == 7)]
            assert got[q] == order[:12]


def test_cells_find(spark):
    rng = np.random.default_rng(5)
    heart = unit(rng, 30, 16)
    kind = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 30, 3000))  # a third lies around one centre
    store = (heart[kind] + 0.15 * rng.standard_normal((3000, 16))).astype(np.float32)
    store /= np.linalg.norm(store, axis=1, keepdims=True)
    rows = [(f"v{i:04d}", v.tolist(), "fr" if i % 2 else "en") for i, v in enumerate(store)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>, lang string").repartition(4)
    asked = spark.createDataFrame([(q, store[q * 9].tolist(), f"v{q * 9:04d}") for q in range(60)], "qid long, embedding array<float>, own string")
    index = cells.CellIndex.build(vectors.where("id < 'v2800'"))
    index.extend(vectors.where("id >= 'v2800'"))
    assert index.vectors().count() == 3000 and index.probes_for(10) < len(index.centres) / 3
    lists = lambda df: sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())
    for options in ({}, {"skip": "own"}, {"lang": "fr"}):
        exact = rank.dense_rank(vectors, asked, 10, **options)
        assert lists(index.search(asked, 10, probes=10_000, block=7, **options)) == lists(exact)
        assert cells.recall(index.search(asked, 10, **options), exact).first().recall >= 0.9
    few = index.search(asked.limit(1), 10)
    assert few.count() == 10
    again = cells.CellIndex(spark, index.path, index.schema)
    assert again.probes == index.probes and lists(again.search(asked, 3)) == lists(index.search(asked, 3))
    assert cells.CellIndex.build(vectors.limit(0)).search(asked).collect() == []
    assert len(cells.CellIndex.build(vectors.limit(1)).search(asked, 5).collect()) == 60


def test_fusion_ignores_the_order_of_rankers(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid long, id long, rank int")
    x = rank.rrf_fuse(rank.ranking_union(("a", a), ("b", b))).orderBy("rank").collect()
    y = rank.rrf_fuse(rank.ranking_union(("b", b), ("a", a))).orderBy("rank").collect()
    assert x == y and x[0].id == 7


def diversify_by_hand(rows, k, per_doc, per_site):
    docs, sites, out = Counter(), Counter(), []
    for i, doc, site in rows:
        if (doc and docs[doc] >= per_doc) or (site and sites[site] >= per_site):
            continue
        docs[doc] += 1
        sites[site] += 1
        out.append(i)
        if len(out) == k:
            break
    return out


def test_diversify_equals_the_walk(spark):
    rnd = random.Random(4)
    rows = []
    for q in range(200):
        for i in range(30):
            site = rnd.choice(["", "s1", "s2", "s3"])
            doc = rnd.choice(["", f"{site}d1", f"{site}d2", f"{site}d{rnd.randint(3, 9)}"])
            rows.append((q, i, 1.0 - i / 100, doc, site))
    df = spark.createDataFrame(rows, "qid long, id long, score double, doc_key string, site string")
    got = {}
    for r in rank.diversify(df, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    for q in range(200):
        assert got[q] == diversify_by_hand([(r[1], r[3], r[4]) for r in rows if r[0] == q], 5, 1, 2)


def test_filter_before_or_after_the_cut(spark):
    docs = spark.createDataFrame([(i, f"u{i} " * 20 + "x " * max(0, 10 - i), "en" if i % 2 else "fr") for i in range(40)], "id long, text string, lang string")
    queries = spark.createDataFrame([(1, "x")], "qid long, query string")
    post = rank.bm25_rank(docs, queries, 4, lang="en").count()
    pre = rank.bm25_rank(docs, queries, 4, lang="en", filter_mode="pre").count()
    assert post < pre == 4


def test_similar_vectors_share_buckets(spark):
    rng = np.random.default_rng(1)
    v = unit(rng, 1, 16)[0]
    df = spark.createDataFrame([(1, v.tolist()), (2, (v * 2).tolist()), (3, (-v).tolist())], "id long, embedding array<float>")
    got = {}
    for r in rank.lsh_buckets(df, 6, 3, 16).collect():
        got.setdefault(r.id, set()).add(r.bucket)
    assert got[1] == got[2] and not got[1] & got[3]


def test_threshold_sweep_equals_the_plain_search(spark):
    rnd = random.Random(8)
    rows = [(i, i % 3 == 0, i % 3 == 1, round(rnd.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "qid long, must_refuse boolean, any_hit boolean, top1_score double")
    pos = [s for _, neg, hit, s in rows if not neg and hit]
    neg = [s for _, n, _, s in rows if n]
    best = max(sorted(set(pos + neg)), key=lambda t: round((sum(s >= t for s in pos) / len(pos) + sum(s < t for s in neg) / len(neg)) / 2, 9))
    assert evaluate.threshold_sweep(df).first().threshold == best


def test_recall_grows_with_k(spark):
    run = spark.createDataFrame([(i, False, (i % 7) + 1 if i % 7 < 5 else None) for i in range(50)], "qid long, must_refuse boolean, first_hit int")
    curve = [r.recall for r in evaluate.recall_curve(run).orderBy("k").collect()]
    assert curve == sorted(curve)


def test_ids_are_stored_once(spark, monkeypatch):
    """Lists hold places; the ids and lengths of a range are in one row, and lists are written where they are made."""
    monkeypatch.setattr(postings, "RANGE_TOKENS", 40)
    texts = {f"d{i:03d}": " ".join(f"w{(i * k) % 7}" for k in range(i % 6)) for i in range(90)} | {"none": None}
    index = postings.LexicalIndex.build(spark.createDataFrame(list(texts.items()), "id string, text string"))
    assert index.lists().where("ids IS NOT NULL OR dls IS NOT NULL").count() == 0
    assert index.ranges_of().selectExpr("sum(size(ids)) AS n").first().n == 91 and index.ranges > 3
    index.extend(spark.createDataFrame([("d005", "w1 w1 new")], "id string, text string"))
    texts["d005"] = "w1 w1 new"
    asked = spark.createDataFrame([("w1",), ("w3",), ("new",)], "term string")
    want = sorted((i, len(t.split()), w, t.split().count(w)) for i, t in texts.items() if t for w in ("w1", "w3", "new") if w in t.split())
    assert sorted((r.id, r.dl, r.term, r.tf) for r in index.postings(asked).collect()) == want


def test_lists_of_an_index_are_written_without_a_sort(spark):
    """The lists of a range leave the task as they are made: one sort, of the texts by id, none of the lists by folder."""
    from palaver.operators.postings import LexicalIndex, both_open

    docs = spark.createDataFrame([(i, f"word{i} common word{i % 7}") for i in range(50)], "id long, text string")
    seen, write = [], spark._jsparkSession.sessionState().conf()
    with both_open(spark):
        seen.append(write.maxConcurrentOutputFileWriters())
    assert seen == [2] and write.maxConcurrentOutputFileWriters() == 0  # the setting is that of the write alone
    index = LexicalIndex.build(docs)
    assert write.maxConcurrentOutputFileWriters() == 0
    assert index.documents().count() == 50 and index.lists().where("term = 'common'").agg({"n": "sum"}).first()[0] == 50
