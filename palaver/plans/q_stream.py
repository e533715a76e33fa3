"""Queries that run as streams over the given tables (X06, X11-X13, stream forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.plans import q_activity as A
from palaver.plans.registry import query
from palaver.streaming import sinks, stateful, windows

C = F.col


def events(t):
    return sinks.stream_table(t.spark, t.folder, "events").withColumn("ts", C("ts").cast("timestamp"))


@query("X06_user_registry", "SELECT user_id, count(*) AS query_count, min(ts) AS joined_at, max(ts) AS last_active_at FROM events GROUP BY user_id")
def _(t):
    return sinks.user_registry(events(t).select("user_id", "ts"))


@query("X11_badge_award", "SELECT user_id, 'curious' AS badge FROM events GROUP BY user_id UNION ALL SELECT DISTINCT user_id, 'buyer' AS badge FROM events WHERE event_type = 'purchase'")
def _(t):
    earned = F.when(C("event_type") == "purchase", F.array(F.lit("curious"), F.lit("buyer"))).otherwise(F.array(F.lit("curious")))
    profiles = events(t).select("user_id", C("ts").alias("at"), earned.alias("earned"))
    return sinks.run_to_table(stateful.award_stream(profiles), "awards")


@query("X12_message_stream", "SELECT event_id AS id, user_id FROM events")
def _(t):
    rows = events(t).select(C("event_id").alias("id"), "user_id", "ts")
    doubled = rows.unionByName(events(t).select(C("event_id").alias("id"), "user_id", "ts"))
    return sinks.message_table(doubled).select("id", "user_id")


@query("X13_answer_feedback_join", """SELECT a.user_id AS chat_id, a.event_id AS message_id, a.ts, CASE WHEN v.event_id IS NOT NULL THEN 'useful' END AS rating, v.ts AS created_at
FROM (SELECT * FROM events WHERE event_type = 'view') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') v
 ON v.user_id = a.user_id AND v.event_id = a.event_id + 1 AND v.ts >= a.ts AND v.ts <= a.ts + INTERVAL '7' DAY""")
def _(t):
    answers = events(t).where("event_type = 'view'").select(C("user_id").alias("chat_id"), C("event_id").alias("message_id"), "ts")
    votes = events(t).where("event_type = 'click'").select(
        C("user_id").alias("chat_id"), (C("event_id") - 1).alias("message_id"), F.lit("useful").alias("rating"), C("ts").alias("created_at")
    )
    return sinks.answer_votes(answers, votes)


@query("X08b_daily_questions_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def _(t):
    asked = events(t).where("event_type = 'click'").select("ts", F.lit("user").alias("role"))
    return sinks.latest_windows(windows.daily_questions(asked), "day", "days")


@query("X09b_rolling_health_stream", A.ROLLING)
def _(t):
    logs = sinks.replay(t.oplog.select(C("ts").cast("timestamp").alias("ts"), "level"), "logs")
    return sinks.latest_windows(windows.rolling_log_health(logs), "window_end", "hours")


@query("X09c_answer_health_stream", """SELECT CAST(hour AS TIMESTAMP) AS window_end, count(*) AS answers, max(latency_ms) AS max_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM (
 SELECT latency_ms, unnest(generate_series(date_trunc('hour', ts) + INTERVAL '1' HOUR, date_trunc('hour', ts) + INTERVAL '24' HOUR, INTERVAL '1' HOUR)) AS hour FROM v_turns WHERE role = 'assistant') GROUP BY 1""")
def _(t):
    turns = sinks.replay(t.turns.select(C("ts").cast("timestamp").alias("ts"), "role", "latency_ms"), "turns")
    return sinks.latest_windows(windows.rolling_answer_health(turns), "window_end", "answers")


@query("X01b_cooldown_stream", """WITH RECURSIVE acc AS (
 SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
 UNION ALL
 SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL '6' HOUR) AS ts FROM acc a WHERE a.ts IS NOT NULL)
SELECT e.event_id, e.user_id FROM events e JOIN acc a ON a.user_id = e.user_id AND a.ts = e.ts""")
def _(t):
    return sinks.run_to_table(stateful.cooldown_stream(events(t), 6 * 3600), "accepted").select("event_id", "user_id")


@query("X02c_feedback_toggle_stream", f"WITH RECURSIVE {A.FOLDED} SELECT id, outcome FROM folded")
def _(t):
    clicks = sinks.replay(t.sql(A.CLICKS), "clicks")
    return sinks.run_to_table(stateful.toggle_stream(clicks), "outcomes").select("id", "outcome")


@query("X04b_conversation_memory_stream", A.HISTORY)
def _(t):
    # a turn with index 0 resets the conversation
    turns = t.turns.withColumn("visible", ~C("refused")).withColumn("reset", C("turn_idx") == 0)
    return sinks.run_to_table(stateful.memory_stream(sinks.replay(turns, "turns"), 2, 24), "memory").select("question_id", "id", "back")


@query("X05b_pending_report_stream", A.REASONS)
def _(t):
    reports = t.sql(A.REPORTS).select("user_id", F.lit(0).alias("kind"), "id", C("created_at").alias("ts"), F.lit(None).cast("string").alias("text"))
    said = t.sql(A.INBOX).select("user_id", F.lit(1).alias("kind"), "id", "ts", "text")
    line = sinks.replay(reports.unionByName(said).withColumn("ts", C("ts").cast("timestamp")), "line")
    return sinks.run_to_table(stateful.report_stream(line, 1440), "reasons").select("report_id", "message_id", "reason")


@query("X03b_streak_stream", f"WITH {A.STREAKS} SELECT user_id, current_streak, best_streak FROM streak")
def _(t):
    days = sinks.run_to_table(stateful.streak_stream(events(t)), "streaks")
    return days.groupBy("user_id").agg(F.max_by("current", "day").alias("current_streak"), F.max("best").alias("best_streak"))


@query("X10b_log_stream", "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARNING' END AS level FROM events WHERE event_type IN ('error', 'signup')")
def _(t):
    level = F.when(C("event_type") == "error", "ERROR").when(C("event_type") == "signup", "WARNING").otherwise("INFO")
    logs = events(t).select(
        C("event_id").alias("id"), "ts", level.alias("level"), F.concat(F.lit("app."), "event_type").alias("logger"), C("props").alias("message")
    )
    return sinks.run_to_table(sinks.log_rows(logs), "oplog").select("id", "level")
