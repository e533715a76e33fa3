"""Hot groups: sliced results equal plain windows, with forced small limits."""

import random
import statistics

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.operators import history
from palaver.plans import scale

C = F.col


def skewed(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = [(i, 0 if rnd.random() < 0.4 else rnd.randint(1, 30), rnd.randint(0, 600), rnd.randint(-3, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k int, t int, v int")


def test_groups_are_really_sliced(spark):
    df = scale.split_hot(skewed(spark), ["k"], C("t"), min_rows=200)
    slices = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert slices[0] >= 5 and all(n == 1 for k, n in slices.items() if k)
    spans = df.where("k = 0").groupBy("_slice").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_running_sum_numbers_and_previous(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("t", "id")
    want = {
        r.id: (r.s, r.n, r.p)
        for r in df.select(
            "id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("n"), F.lag("id").over(w).alias("p")
        ).collect()
    }
    out = scale.running_sum(df, ["k"], ["t", "id"], C("v"), "s", min_rows=200)
    out = scale.row_numbers(out, ["k"], ["t", "id"], "n", min_rows=200)
    out = scale.previous(out, ["k"], ["t", "id"], {"id": "p"}, min_rows=200)
    assert {r.id: (r.s, r.n, r.p) for r in out.collect()} == want


def test_order_stats_match_the_library(spark):
    df = skewed(spark)
    got = scale.order_stats(
        df, "t", ["k"],
        {"q1": scale.position_exclusive(0.25), "q2": scale.position_cont(0.5), "f": scale.position_floor(0.25), "r": scale.position_round(0.95)},
        min_rows=50,
    ).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r.t)
    assert len(got) == len(groups)
    for r in got:
        v = sorted(groups[r.k])
        assert r.n == len(v)
        assert abs(r.q1 - statistics.quantiles(v, n=4)[0]) < 1e-9
        assert r.q2 == statistics.median(v)
        assert r.f == v[int(len(v) * 0.25)] and r.r == v[round(0.95 * (len(v) - 1))]


def test_lookup_with_hot_keys(spark):
    df = skewed(spark)
    table = spark.createDataFrame([(k, f"n{k}") for k in range(0, 25)], "k int, name string")
    want = sorted((r.id, r.name) for r in df.join(table, "k", "left").select("id", F.coalesce("name", F.lit("")).alias("name")).collect())
    got = scale.lookup(df, table, "k", min_rows=200).select("id", F.coalesce("name", F.lit("")).alias("name")).collect()
    assert sorted((r.id, r.name) for r in got) == want


def cooldown_by_hand(rows, seconds):
    out, free = set(), {}
    for event_id, user, us in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if user not in free or us >= free[user]:
            out.add(event_id)
            free[user] = us + seconds * 1_000_000
    return out


def test_cooldown_blocks_equal_the_plain_walk(spark):
    rnd = random.Random(5)
    rows = [(i, 0 if rnd.random() < 0.5 else rnd.randint(1, 5), rnd.randint(0, 3_000) * 250_000) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    for seconds, min_rows in ((5, None), (5, 100), (60, 20), (1, 50)):
        got = history.cooldown_filter(df, seconds, min_rows=min_rows)
        assert {r.event_id for r in got.collect()} == cooldown_by_hand(rows, seconds)


def votes_by_hand(rows):
    state, out = {}, {}
    for vid, key, rating, at in sorted(rows, key=lambda r: (r[3], r[0])):
        if state.get(key) == rating:
            state[key], out[vid] = None, "removed"
        else:
            out[vid] = "updated" if state.get(key) else rating
            state[key] = rating
    return out, {k: v for k, v in state.items() if v}


def test_votes_equal_the_plain_walk(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 3), rnd.choice(["useful", "not_useful", "report"]), rnd.randint(0, 900)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, message_id long, rating string, at long").select(
        "id", F.lit(1).cast("long").alias("chat_id"), "message_id", F.lit(2).cast("long").alias("user_id"), "rating", F.timestamp_seconds("at").alias("created_at")
    )
    outcomes, final = votes_by_hand(rows)
    assert {r.id: r.outcome for r in history.feedback_outcomes(df).collect()} == outcomes
    assert {r.message_id: r.rating for r in history.feedback_state(df).collect()} == final


def reasons_by_hand(rows, minutes):
    out, opened = set(), {}
    for kind, rid, user, at in sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1])):
        stack = opened.setdefault(user, [])
        if kind == 0:
            stack.append((rid, at))
        else:
            while stack and stack[-1][1] < at - minutes * 60:
                stack.pop()
            if stack:
                out.add((stack.pop()[0], rid))
    return out


def test_report_reasons_equal_the_plain_walk(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), i, rnd.randint(0, 4), rnd.randint(0, 40_000)) for i in range(800)]
    df = spark.createDataFrame(rows, "kind int, id long, user_id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    reports = df.where("kind = 0").withColumnRenamed("ts", "created_at")
    got = history.attach_report_reason(reports, df.where("kind = 1").withColumn("text", F.lit("x" * 600)), ["user_id"], 10)
    rows_out = got.collect()
    assert {(r.report_id, r.message_id) for r in rows_out} == reasons_by_hand(rows, 10)
    assert all(len(r.reason) == 500 for r in rows_out)


def test_chains_equal_the_walk():
    import numpy as np

    from palaver.functions.tasks import accept_spaced, chains

    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 30, rng.integers(1, 6))
        group = np.repeat(np.arange(len(sizes)), sizes)
        us = np.concatenate([np.sort(rng.integers(0, 60, n)) for n in sizes])
        cooldown, free = int(rng.integers(1, 25)), rng.integers(0, 60, len(sizes))
        want, open_at = [], free.copy()
        for g, t in zip(group, us):
            want.append(t >= open_at[g])
            open_at[g] = t + cooldown if want[-1] else open_at[g]
        assert chains(group, us, cooldown, free).tolist() == want
    # a user's events cut into batches anywhere
    us = np.sort(rng.integers(0, 10**6, 3000))
    rows = pd.DataFrame({"event_id": range(3000), "user_id": np.repeat([1, 2], 1500), "slice": 0, "us": np.concatenate([us[::2], us[1::2]]), "last": pd.array([None] * 1500 + [int(us[1]) - 1] * 1500, "Int64")})
    whole = pd.concat(accept_spaced(5000)(iter([rows])))["event_id"].tolist()
    cuts = np.sort(rng.integers(0, 3000, 40))
    assert pd.concat(accept_spaced(5000)(iter(np.split(rows, cuts))))["event_id"].tolist() == whole and 200 < len(whole) < 450
