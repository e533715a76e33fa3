"""Streams over several files give what the batch operators give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palaver.functions import folds
from palaver.operators import history
from palaver.streaming import sinks, stateful, windows

C = F.col


@pytest.fixture()
def feed(spark, tmp_path):
    """Write rows as files in time order and read them back one per trigger."""

    def make(df, order, name):
        path = str(tmp_path / name)
        rows = df.orderBy(order).collect()
        step = max(1, len(rows) // 4)
        for i in range(0, len(rows), step):
            spark.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def events(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(1, 4), 10**6 + rnd.randint(0, 12 * 86400)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))


def test_cooldown_and_streak(spark, feed):
    df = events(spark)
    got = sinks.run_to_table(stateful.cooldown_stream(feed(df, "ts", "a"), 7200), "a")
    assert {r.event_id for r in got.collect()} == {r.event_id for r in history.cooldown_filter(df, 7200).collect()}
    days = sinks.run_to_table(stateful.streak_stream(feed(df, "ts", "b")), "b")
    stream = {r.user_id: (r.c, r.b) for r in days.groupBy("user_id").agg(F.max_by("current", "day").alias("c"), F.max("best").alias("b")).collect()}
    batch = {r.user_id: (r.current_streak, r.best_streak) for r in history.streaks(df).collect()}
    assert stream == batch


def test_votes(spark, feed):
    rnd = random.Random(2)
    df = spark.createDataFrame(
        [(i, 1, rnd.randint(1, 3), 5, rnd.choice(["useful", "report"]), i) for i in range(200)],
        "id long, chat_id long, message_id long, user_id long, rating string, s long",
    ).withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    got = sinks.run_to_table(stateful.toggle_stream(feed(df, "created_at", "v")), "v")
    assert {r.id: r.outcome for r in got.collect()} == {r.id: r.outcome for r in history.feedback_outcomes(df).collect()}


def test_votes_of_a_bucket_are_folded_together(spark, monkeypatch):
    """Few calls for many keys, and what a walk over each key's votes gives; a null rating is none."""
    rnd, calls = random.Random(5), 0

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    fold, state, held, want, got = folds.toggles(["created_at", "id"]), State(), {}, {}, {}
    for lap in range(4):
        rows = [(f"k{rnd.randint(0, 30)}", lap * 1000 + i, rnd.choice(["useful", "report", None]), lap * 1000 + rnd.randint(0, 99)) for i in range(200)]
        for key, vote, rating, _ in sorted(rows, key=lambda r: (r[3], r[1])):
            same = rating is not None and held.get(key) == rating
            want[vote] = "removed" if same else "updated" if held.get(key) else rating
            held[key] = None if same else rating
        frame = pd.DataFrame(rows, columns=["_key", "id", "rating", "created_at"])
        for out in fold((0,), iter([frame.iloc[:120], frame.iloc[120:]]), state):
            calls += 1
            got |= dict(zip(out["id"], out["outcome"]))
    assert got == want and calls == 4


def test_memory(spark, feed):
    rnd = random.Random(3)
    rows = [(i, 1, i % 2, i // 2, "user" if rnd.random() < 0.5 else "assistant", rnd.random() < 0.8, 10**6 + i * 9000) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, chat_id long, user_id long, turn_idx int, role string, visible boolean, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("reset", F.lit(False))
    got = sinks.run_to_table(stateful.memory_stream(feed(df, "ts", "t"), 2, 24), "t")
    turns = df.withColumn("refused", ~C("visible")).withColumn("cleared_at", F.lit(None).cast("timestamp"))
    want = {(r.question_id, r.id, r.back) for r in history.history_asof(turns, 2, 24).collect()}
    assert {(r.question_id, r.id, r.back) for r in got.collect()} == want and want


def test_reset_forgets(spark):
    turns = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 10)], "chat_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("cleared_at", F.lit(None).cast("timestamp"))
    resets = spark.createDataFrame([(1, 1, 15)], "chat_id long, user_id long, s long").select("chat_id", "user_id", F.timestamp_seconds("s").alias("reset_at"))
    assert history.reset_turns(turns, resets).where("cleared_at IS NOT NULL").count() == 1


def test_report_reasons(spark, feed):
    rnd = random.Random(4)
    rows = [(rnd.randint(1, 3), rnd.randint(0, 1), i, 10**6 + i * 97, f"m{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, kind int, id long, s long, text string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = sinks.run_to_table(stateful.report_stream(feed(df, "ts", "r")), "r")
    reports = df.where("kind = 0").withColumnRenamed("ts", "created_at")
    want = history.attach_report_reason(reports, df.where("kind = 1"), ["user_id"], 10)
    key = lambda r: (r.report_id, r.message_id, r.reason)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_state_expires(spark, feed):
    rows = [(i // 10, 0, i, i * 3600, f"m{i}") for i in range(80)]  # a new user every ten hours
    df = spark.createDataFrame(rows, "user_id long, kind int, id long, s long, text string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream = stateful.report_stream(feed(df, "ts", "x"), delay="1 minute")
    query = stream.writeStream.format("memory").queryName("reasons").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) < 8 and kept[-1] <= 3


def test_messages_and_votes_keep_late_rows(spark, feed):
    times = [0, 10, 20, 0, 30, 5]
    rows = [(i, d * 86400) for i, d in zip([1, 2, 3, 1, 5, 4], times)]
    df = spark.createDataFrame(rows, "id long, s long").withColumn("n", F.monotonically_increasing_id())
    assert sorted(r.id for r in sinks.message_table(feed(df, "n", "late")).collect()) == [1, 2, 3, 4, 5]
    answers = spark.createDataFrame([(1, i, (10 + i) * 86400) for i in range(6)], "chat_id long, message_id long, s long").select("chat_id", "message_id", F.timestamp_seconds("s").alias("ts"))
    votes = spark.createDataFrame([(1, 2, "useful", 13 * 86400), (1, 3, "useful", 40 * 86400)], "chat_id long, message_id long, rating string, s long")
    votes = votes.select("chat_id", "message_id", "rating", F.timestamp_seconds("s").alias("created_at"))
    got = sinks.answer_votes(feed(answers, "ts", "answers"), feed(votes, "created_at", "votes")).collect()
    assert sorted((r.message_id, r.rating) for r in got if r.rating) == [(2, "useful")] and len(got) == 6


def test_votes_join_as_streams(spark, feed):
    """Unvoted answers come out of the stream when their interval has passed, the state stays small, and nothing is lost at the end."""
    day = 86400
    answers = spark.createDataFrame([(i % 3, i, (9 + i) * day) for i in range(60)], "chat_id long, message_id long, s long").select("chat_id", "message_id", F.timestamp_seconds("s").alias("ts"))
    given = [(i % 3, i, f"r{k}", (9 + i + k * 2) * day) for i in range(0, 60, 4) for k in range(5)]  # the fifth vote is a day too late
    votes = spark.createDataFrame(given, "chat_id long, message_id long, rating string, s long").select("chat_id", "message_id", "rating", F.timestamp_seconds("s").alias("created_at"))
    joined = sinks.vote_stream(feed(answers, "ts", "a1"), feed(votes, "created_at", "v1"))
    query = joined.writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    early = spark.table("joined").collect()
    assert sum(r.rating is None for r in early) >= 20 and state[-1] < max(state)
    got = sinks.answer_votes(feed(answers, "ts", "a2"), feed(votes, "created_at", "v2")).collect()
    want = [(c, m, r) for c, m, r, s in given if s - (9 + m) * day <= 7 * day] + [(i % 3, i, None) for i in range(60) if i % 4]
    assert sorted((r.chat_id, r.message_id, r.rating or "") for r in got) == sorted((c, m, r or "") for c, m, r in want)
    nothing = sinks.answer_votes(sinks.replay(answers.limit(0), "a3"), sinks.replay(votes.limit(0), "v3"))
    assert nothing.collect() == [] and nothing.columns == ["chat_id", "message_id", "ts", "rating", "created_at"]


def test_late_rows_change_windows(spark, feed):
    rows = [(i, 10**6 + i * 1800, "ERROR" if i % 3 else "WARNING") for i in range(200)] + [(900 + i, 10**6 + 190 * 1800 - 3600 * i, "ERROR") for i in range(3)]
    df = spark.createDataFrame(rows, "n long, s long, level string").withColumn("ts", F.timestamp_seconds("s"))
    stream = windows.rolling_log_health(feed(df.drop("s"), "n", "late-logs"), "4 hours")
    got = {r.window_end: (r.errors, r.warnings, r.n) for r in sinks.latest_windows(stream, "window_end", "w").collect()}
    assert got == {r.window_end: (r.errors, r.warnings, r.n) for r in windows.rolling_log_health(df).collect()}


def test_retention_by_days(spark):
    import datetime as dt

    from palaver.sources.retention import DayTable

    start = dt.datetime(2024, 3, 1)
    frame = lambda ids: spark.createDataFrame([(i, start + dt.timedelta(hours=5 * i)) for i in ids], "id long, ts timestamp")
    table = DayTable.create(frame(range(60)))
    table.append(frame(range(60, 90)))
    table.append(spark.createDataFrame([(999, None)], "id long, ts timestamp"))
    cutoff = start + dt.timedelta(days=6, hours=11)
    before = {r["part"] for r in table._folders()}
    young = [i for i in range(90) if start + dt.timedelta(hours=5 * i) >= cutoff]
    assert table.prune(cutoff) == 90 - len(young)
    assert sorted(r.id for r in table.rows().collect()) == [*young, 999]
    after = {r["part"] for r in table._folders()}
    assert len(after - before) == 1 and {r.part for r in table.unreferenced().collect()} == before - after
    assert table.prune(cutoff) == 0 and table.rows().count() == len(young) + 1
    assert DayTable(spark, table.path, table.schema).rows().count() == len(young) + 1
    assert table.prune(start + dt.timedelta(days=400)) == len(young)
    assert [r.id for r in table.rows().collect()] == [999]


def test_folder_table_streams(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert sinks.run_to_table(sinks.stream_table(spark, str(tmp_path), "events"), "e").count() == 100
    with pytest.raises(Exception):
        sinks.stream_table(spark, str(tmp_path), "orders")


def test_registry_and_windows(spark, feed):
    df = events(spark)
    got = sinks.user_registry(feed(df.select("user_id", "ts"), "ts", "u"))
    want = df.groupBy("user_id").count()
    assert {r.user_id: r.query_count for r in got.collect()} == {r.user_id: r["count"] for r in want.collect()}
    asked = df.withColumn("role", F.lit("user"))
    stream = windows.daily_questions(feed(asked.select("ts", "role"), "ts", "w"), "1 minute")
    closed = {r.day: r.n for r in sinks.run_to_table(stream, "w").collect()}
    batch = {r.day: r.n for r in windows.daily_questions(asked).collect()}
    assert closed and all(batch[d] == n for d, n in closed.items()) and len(closed) >= len(batch) - 1
