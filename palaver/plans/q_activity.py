"""Queries over turns, votes, users and logs (A32-A38, J09-J11, J19, J20, J22, R19, R20, S12, S13, T02, T03, T06, U03, W01-W03, W08, X in batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import lang
from palaver.operators import activity as act
from palaver.operators import badges, history
from palaver.plans import q_text as Q
from palaver.sources.retention import DayTable
from palaver.plans.registry import query

C = F.col

# turns with their cited sources: the answer cites the document of its own
# number, once as a document and once as a chat message on a topic
SOURCED = """SELECT t.*, CASE WHEN t.role = 'assistant' AND t.turn_idx % 2 = 1 THEN concat('topic ', CAST(t.chat_id % 7 AS VARCHAR(10))) ELSE '' END AS cited_topic,
 t.role = 'assistant' AND t.chat_id % 3 = 0 AS cites_pdf FROM v_turns t"""


def sourced(t):
    def source(kind, topic):
        return F.struct(F.struct(kind.alias("source_type"), topic.alias("topic")).alias("metadata"))

    kind = F.when(C("cites_pdf"), F.lit("pdf")).otherwise(F.lit("chat"))
    sources = F.when(C("role") == "assistant", F.array(source(F.lit("chat"), C("cited_topic")), source(kind, F.lit(None).cast("string"))))
    # stored as JSON text and read back, as the turns table keeps it
    typed = "array<struct<metadata:struct<source_type:string,topic:string>>>"
    return t.sql(SOURCED).withColumn("sources", F.from_json(F.to_json(sources), typed))


def cleared(t):
    return t.turns.withColumn("cleared_at", F.when(C("turn_idx") == 0, C("ts")))


NOW_TURNS = "(SELECT max(ts) FROM v_turns)"


def now_turns(t):
    return t.turns.agg(F.max("ts")).scalar()


@query("A32_kpi_scalars", """SELECT (SELECT count(*) FROM v_users) AS total_users, (SELECT count(*) FROM v_users WHERE last_active_at > (SELECT max(last_active_at) FROM v_users) + INTERVAL '6' DAY - INTERVAL '7' DAY) AS active_7d,
 (SELECT count(*) FROM v_turns) AS total_messages, (SELECT count(*) FROM v_turns WHERE role = 'user') AS total_queries""")
def _(t):
    now = t.users.agg(F.max("last_active_at") + F.expr("INTERVAL 6 DAYS")).scalar()
    return act.kpi_scalars(t.users, t.turns, now)


@query("A33_feedback_totals", """WITH s AS (SELECT count(*) AS total_rated, count(*) FILTER (WHERE rating = 'useful') AS useful, count(*) FILTER (WHERE rating = 'not_useful') AS not_useful,
 count(*) FILTER (WHERE rating = 'report') AS report, count(*) FILTER (WHERE rating = 'report' AND reason IS NOT NULL) AS reports_with_reason FROM v_feedback)
SELECT *, CAST(floor(useful * 100.0 / total_rated + 0.5) AS BIGINT) AS useful_pct FROM s""")
def _(t):
    return act.feedback_totals(t.feedback)


@query("A34_queries_per_day", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM v_turns WHERE role = 'user' AND ts > {NOW_TURNS} - INTERVAL '3' DAY GROUP BY 1")
def _(t):
    return act.queries_per_day(t.turns, now_turns(t), days=3)


RECENT = "(SELECT max(ts) FROM v_turns) - INTERVAL '24' HOUR"


@query("A35_health_summary", f"""WITH a AS (SELECT * FROM v_turns WHERE role = 'assistant' AND ts > {RECENT}), e AS (SELECT * FROM v_oplog WHERE ts > {RECENT})
SELECT (SELECT count(*) FROM e WHERE level IN ('ERROR', 'CRITICAL')) AS errors, (SELECT count(*) FROM e WHERE level = 'WARNING') AS warnings, (SELECT count(*) FROM a) AS answers,
 (SELECT max(latency_ms) FROM a) AS max_ms, (SELECT round(avg(CASE WHEN starts_with(model_used, 'gemini') THEN 1.0 ELSE 0.0 END), 6) FROM a WHERE model_used IS NOT NULL) AS primary_share,
 (SELECT CAST(floor(quantile_cont(latency_ms, 0.5) + 0.5) AS BIGINT) FROM a) AS p50_ms, (SELECT CAST(floor(quantile_cont(latency_ms, 0.95) + 0.5) AS BIGINT) FROM a) AS p95_ms""")
def _(t):
    return act.health_summary(t.turns, t.oplog, now_turns(t))


USER_STATS = f"""marked AS (SELECT user_id, CASE WHEN role = 'user' AND NOT refused THEN 1 ELSE 0 END AS asked, CASE WHEN cites_pdf AND NOT refused THEN 1 ELSE 0 END AS backed, rerank, hour(ts) AS h,
  ts + INTERVAL '7' DAY >= {NOW_TURNS} AS recent, regexp_matches(content, '{Q.AR_WIDE}') AS ar, regexp_matches(content, '{lang.FRENCH_MARKS_SET}') AS fr, regexp_matches(content, '[A-Za-z]') AS latin FROM ({SOURCED})),
ustats AS (SELECT user_id, CAST(sum(asked) AS BIGINT) AS total_q, CAST(sum(CASE WHEN recent THEN asked ELSE 0 END) AS BIGINT) AS week_q, CAST(sum(CASE WHEN rerank THEN asked ELSE 0 END) AS BIGINT) AS deep_q,
  CAST(sum(CASE WHEN h < 5 THEN asked ELSE 0 END) AS BIGINT) AS night_q, CAST(sum(CASE WHEN h IN (5, 6, 7) THEN asked ELSE 0 END) AS BIGINT) AS morn_q, CAST(sum(backed) AS BIGINT) AS pdf_cited,
  concat_ws(',', CASE WHEN max(CASE WHEN ar THEN asked ELSE 0 END) = 1 THEN 'ar' END, CASE WHEN max(CASE WHEN latin AND NOT ar AND NOT fr THEN asked ELSE 0 END) = 1 THEN 'en' END,
   CASE WHEN max(CASE WHEN fr THEN asked ELSE 0 END) = 1 THEN 'fr' END) AS languages FROM marked GROUP BY user_id)"""


@query("A36_user_stats", f"WITH {USER_STATS} SELECT * FROM ustats")
def _(t):
    return act.user_stats(sourced(t), now_turns(t)).withColumn("languages", F.concat_ws(",", "languages"))


@query("A37_helpful_votes", "SELECT user_id, count(*) FILTER (WHERE rating = 'useful') AS helpful_votes FROM v_feedback GROUP BY user_id")
def _(t):
    return act.helpful_votes(t.feedback)


TOP_TOPICS = f"""ttopics AS (SELECT * FROM (SELECT user_id, cited_topic AS topic, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, cited_topic) AS rank
 FROM ({SOURCED}) WHERE role = 'assistant' AND cited_topic <> '' GROUP BY user_id, cited_topic) WHERE rank <= 3)"""


@query("A38_top_topics_per_user", f"WITH {TOP_TOPICS} SELECT * FROM ttopics")
def _(t):
    return act.top_topics_per_user(sourced(t))


@query("J09_feedback_per_turn", """WITH votes AS (SELECT chat_id, message_id, sum(CAST(rating = 'useful' AS INT)) AS up, sum(CAST(rating = 'not_useful' AS INT)) AS down, sum(CAST(rating = 'report' AS INT)) AS flagged
 FROM v_feedback GROUP BY chat_id, message_id), placed AS (SELECT *, row_number() OVER (ORDER BY turn_idx DESC, id DESC) AS place FROM v_turns WHERE user_id = 7)
SELECT id, chat_id, turn_idx, role, format('{{"useful":{},"not_useful":{},"report":{}}}', CAST(coalesce(up, 0) AS BIGINT), CAST(coalesce(down, 0) AS BIGINT), CAST(coalesce(flagged, 0) AS BIGINT)) AS feedback
FROM placed LEFT JOIN votes USING (chat_id) WHERE place <= 100 AND (votes.message_id = tg_message_id) UNION ALL
SELECT id, chat_id, turn_idx, role, '{"useful":0,"not_useful":0,"report":0}' AS feedback FROM placed WHERE place <= 100 AND NOT EXISTS (SELECT 1 FROM votes WHERE votes.chat_id = placed.chat_id AND votes.message_id = placed.tg_message_id)""")
def _(t):
    return act.feedback_per_turn(t.turns, t.feedback, 7).select("id", "chat_id", "turn_idx", "role", "feedback")


@query("J10_recent_reports", """WITH latest AS (SELECT *, rank() OVER (ORDER BY created_at DESC, id DESC) AS age FROM v_feedback WHERE rating = 'report')
SELECT id AS feedback_id, chat_id, message_id, user_id, reason, created_at, (SELECT any_value(content) FROM v_turns said WHERE said.chat_id = latest.chat_id AND said.tg_message_id = latest.message_id) AS assistant_content,
 (SELECT any_value(first_name) FROM v_users who WHERE who.user_id = latest.user_id) AS first_name FROM latest WHERE age <= 10""")
def _(t):
    return act.recent_reports(t.feedback, t.turns, t.users)


@query("J11_most_disliked", """WITH down AS (SELECT chat_id, message_id, count(*) AS not_useful FROM v_feedback WHERE rating = 'not_useful' GROUP BY chat_id, message_id),
placed AS (SELECT said.id, said.content, not_useful, said.ts, said.user_id, row_number() OVER (ORDER BY not_useful DESC, said.ts DESC, said.id) AS place
 FROM down, v_turns said WHERE said.role = 'assistant' AND said.tg_message_id = message_id AND said.chat_id = down.chat_id) SELECT * EXCLUDE (place) FROM placed WHERE place <= 5""")
def _(t):
    return act.most_disliked(t.turns, t.feedback)


@query("T02_users_by_activity", "SELECT user_id, query_count, last_active_at FROM v_users")
def _(t):
    return act.users_by_activity(t.users).select("user_id", "query_count", "last_active_at")


@query("T03_recent_events", "SELECT id, ts, level, logger, message FROM v_oplog WHERE level = 'ERROR' ORDER BY ts DESC, id DESC LIMIT 100")
def _(t):
    return act.recent_events(t.oplog, 100, "ERROR")


@query("T06_one_by_key", "SELECT * FROM v_users WHERE user_id = 42")
def _(t):
    return act.one_by_key(t.users, "user_id", 42)


# --- windows over turns ------------------------------------------------------------------

BATCH = "SELECT chat_id, user_id, id AS seq, role, content FROM v_turns WHERE role <> 'system'"


@query("W01_next_turn_index", f"""SELECT b.chat_id, b.user_id, b.seq, CAST(m.mx + row_number() OVER (PARTITION BY b.chat_id, b.user_id ORDER BY b.seq) AS INT) AS turn_idx
FROM ({BATCH}) b JOIN (SELECT chat_id, user_id, max(turn_idx) AS mx FROM v_turns GROUP BY chat_id, user_id) m ON m.chat_id = b.chat_id AND m.user_id = b.user_id""")
def _(t):
    return history.number_turns(t.sql(BATCH), t.turns).select("chat_id", "user_id", "seq", "turn_idx")


VISIBLE = "NOT refused AND NOT (turn_idx = 0)"


@query("W02_last_n_turns", f"""SELECT id, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY turn_idx) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY turn_idx DESC) AS r FROM v_turns WHERE {VISIBLE}) WHERE r <= 4""")
def _(t):
    return history.last_n_turns(cleared(t), n=2).select("id", "position")


@query("W03_latest_transcript", "SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn_idx DESC, id DESC) AS r FROM v_turns) WHERE r <= 6")
def _(t):
    return history.latest_transcript(t.turns, 6).select("id", "user_id")


HISTORY = f"""SELECT question_id, id, back FROM (SELECT q.id AS question_id, h.id, row_number() OVER (PARTITION BY q.id ORDER BY h.turn_idx DESC) AS back
 FROM v_turns q JOIN v_turns h ON h.chat_id = q.chat_id AND h.user_id = q.user_id AND h.turn_idx < q.turn_idx AND h.ts >= q.ts - INTERVAL '24' HOUR
 WHERE q.role = 'user' AND NOT h.refused AND NOT (h.turn_idx = 0)) WHERE back <= 4"""


@query("J20_history_asof", HISTORY)
def _(t):
    return history.history_asof(cleared(t), n=2)


REPORTS = "SELECT id, user_id, created_at FROM v_feedback WHERE rating = 'report' AND reason IS NULL"
INBOX = "SELECT event_id AS id, user_id, ts, props AS text FROM events WHERE event_type = 'view'"


@query("J19_pending_report_asof", f"""SELECT user_id, message_id, report_id FROM (SELECT m.user_id, m.id AS message_id, r.id AS report_id, row_number() OVER (PARTITION BY m.id ORDER BY r.created_at DESC, r.id DESC) AS rn
 FROM ({INBOX}) m JOIN ({REPORTS}) r ON r.user_id = m.user_id AND r.created_at <= m.ts AND r.created_at >= m.ts - INTERVAL '1440' MINUTE) WHERE rn = 1""")
def _(t):
    return history.pending_report_asof(t.sql(REPORTS), t.sql(INBOX), ["user_id"], minutes=1440)


REASONS = f"""WITH line AS (SELECT user_id, created_at AS ts, 0 AS kind, id, NULL AS text FROM ({REPORTS}) UNION ALL SELECT user_id, ts, 1 AS kind, id, text FROM ({INBOX})),
s AS (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, kind, id) - CASE WHEN kind = 0 THEN 1 ELSE 0 END AS level FROM line),
p AS (SELECT *, lag(kind) OVER w AS pkind, lag(id) OVER w AS report_id, lag(ts) OVER w AS pts FROM s WINDOW w AS (PARTITION BY user_id, level ORDER BY ts, kind, id))
SELECT report_id, id AS message_id, substring(text, 1, 500) AS reason FROM p WHERE kind = 1 AND pkind = 0 AND pts >= ts - INTERVAL '1440' MINUTE"""


@query("J22_attach_report_reason", REASONS)
def _(t):
    return history.attach_report_reason(t.sql(REPORTS), t.sql(INBOX), ["user_id"], minutes=1440)


STREAKS = """runs AS (SELECT user_id, island, count(*) AS length, max(day) AS last_day FROM (
 SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)) GROUP BY user_id, island),
streak AS (SELECT user_id, max_by(length, last_day) AS current_streak, max(length) AS best_streak, max(last_day) AS last_streak_date FROM runs GROUP BY user_id)"""


@query("W08_streaks", f"WITH {STREAKS} SELECT * FROM streak")
def _(t):
    return history.streaks(t.events)


@query("X03_streak_state", f"WITH {STREAKS} SELECT user_id, current_streak, best_streak FROM streak")
def _(t):
    return history.streaks(t.events).select("user_id", "current_streak", "best_streak")


@query("X01_cooldown_filter", """WITH RECURSIVE acc AS (
 SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
 UNION ALL
 SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL '6' HOUR) AS ts FROM acc a WHERE a.ts IS NOT NULL)
SELECT e.event_id, e.user_id FROM events e JOIN acc a ON a.user_id = e.user_id AND a.ts = e.ts""")
def _(t):
    return history.cooldown_filter(t.events, 6 * 3600)


CLICKS = "SELECT id, chat_id, message_id, user_id % 5 AS user_id, rating, created_at FROM v_feedback"


FOLDED = f"""cl AS (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id, user_id ORDER BY created_at, id) AS rn FROM ({CLICKS})),
folded AS (SELECT chat_id, message_id, user_id, rn, id, created_at, rating, rating AS state, rating AS outcome FROM cl WHERE rn = 1
 UNION ALL SELECT c.chat_id, c.message_id, c.user_id, c.rn, c.id, c.created_at, c.rating, CASE WHEN f.state = c.rating THEN NULL ELSE c.rating END AS state,
  CASE WHEN f.state = c.rating THEN 'removed' WHEN f.state IS NOT NULL THEN 'updated' ELSE c.rating END AS outcome
 FROM folded f JOIN cl c ON c.chat_id = f.chat_id AND c.message_id = f.message_id AND c.user_id = f.user_id AND c.rn = f.rn + 1)"""


@query("X02_feedback_toggle", f"WITH RECURSIVE {FOLDED} SELECT id, outcome FROM folded")
def _(t):
    return history.feedback_outcomes(t.sql(CLICKS)).select("id", "outcome")


@query("X02b_feedback_state", f"WITH RECURSIVE {FOLDED} SELECT chat_id, message_id, user_id, rating, created_at FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id, user_id ORDER BY rn DESC) AS r FROM folded) WHERE r = 1 AND state IS NOT NULL")
def _(t):
    return history.feedback_state(t.sql(CLICKS))


@query("X04_conversation_memory", HISTORY)
def _(t):
    return history.history_asof(cleared(t), n=2)


@query("X05_pending_report", f"""SELECT user_id, message_id, report_id FROM (SELECT m.user_id, m.id AS message_id, r.id AS report_id, row_number() OVER (PARTITION BY m.id ORDER BY r.created_at DESC, r.id DESC) AS rn
 FROM ({INBOX}) m JOIN ({REPORTS}) r ON r.user_id = m.user_id AND r.created_at <= m.ts AND r.created_at >= m.ts - INTERVAL '10' MINUTE) WHERE rn = 1""")
def _(t):
    return history.pending_report_asof(t.sql(REPORTS), t.sql(INBOX), ["user_id"], minutes=10)


@query("X07_retention_prune", "SELECT count(*) FILTER (WHERE ts < (SELECT max(ts) FROM v_oplog) - INTERVAL '10' DAY) AS dropped, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM v_oplog) - INTERVAL '10' DAY) AS kept FROM v_oplog")
def _(t):
    table = DayTable.create(t.oplog)
    cutoff = t.oplog.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("cutoff")).first()["cutoff"]
    dropped = table.prune(cutoff)
    return table.rows().agg(F.lit(dropped).cast("bigint").alias("dropped"), F.count("*").alias("kept"))


@query("X07b_pruned_rows", "SELECT id, ts, level FROM v_oplog WHERE ts >= (SELECT max(ts) FROM v_oplog) - INTERVAL '10' DAY")
def _(t):
    """The log appended in two writes, pruned by days, read back."""
    table = DayTable.create(t.oplog.where("id % 2 = 0"))
    table.append(t.oplog.where("id % 2 <> 0"))
    table.prune(t.oplog.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("cutoff")).first()["cutoff"])
    return table.rows().select("id", "ts", "level")


@query("X07c_soft_reset", """SELECT v.id, CASE WHEN v.turn_idx = 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN v.ts <= r.reset_at THEN r.reset_at END AS cleared_at FROM v_turns v
 LEFT JOIN (SELECT chat_id, user_id, max(ts) AS reset_at FROM v_turns WHERE turn_idx = 2 GROUP BY ALL) r ON r.chat_id = v.chat_id AND r.user_id = v.user_id""")
def _(t):
    """Every conversation is reset at its third turn; what was cleared before keeps its stamp."""
    turns = t.turns.withColumn("cleared_at", F.when(C("turn_idx") == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cast(t.turns.schema["ts"].dataType))
    resets = t.turns.where("turn_idx = 2").select("chat_id", "user_id", C("ts").alias("reset_at"))
    return history.reset_turns(turns, resets).select("id", "cleared_at")


@query("X08_daily_questions", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def _(t):
    from palaver.streaming.windows import daily_questions

    asked = t.events.where("event_type = 'click'").select("ts", F.lit("user").alias("role"))
    return daily_questions(asked)


ROLLING = """SELECT CAST(hour AS TIMESTAMP) AS window_end, count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARNING') AS warnings, count(*) AS n FROM (
 SELECT level, unnest(generate_series(date_trunc('hour', ts) + INTERVAL '1' HOUR, date_trunc('hour', ts) + INTERVAL '24' HOUR, INTERVAL '1' HOUR)) AS hour FROM v_oplog) GROUP BY 1"""


@query("X09_rolling_health", ROLLING)
def _(t):
    from palaver.streaming.windows import rolling_log_health

    return rolling_log_health(t.oplog)


@query("X10_log_sink", "SELECT id, ts, substring(level, 1, 16) AS level, logger, message FROM v_oplog WHERE level IN ('WARNING', 'ERROR')")
def _(t):
    from palaver.streaming.sinks import log_rows

    return log_rows(t.oplog)


# --- users and badges -----------------------------------------------------------------------

STORED = "SELECT user_id, first_name, language_code, is_bot, last_active_at FROM v_users"
SEEN = "SELECT c_custkey AS user_id, CASE WHEN c_nationkey < 12 THEN c_name END AS first_name, c_mktsegment AS language_code, c_nationkey = 3 AS is_bot FROM customer"


@query("S13_user_upsert", f"""SELECT coalesce(s.user_id, u.user_id) AS user_id, coalesce(u.first_name, s.first_name) AS first_name, coalesce(u.language_code, s.language_code) AS language_code,
 CASE WHEN u.user_id IS NOT NULL THEN u.is_bot ELSE s.is_bot END AS is_bot, CASE WHEN u.user_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE s.last_active_at END AS last_active_at
FROM ({STORED}) s FULL OUTER JOIN ({SEEN}) u ON u.user_id = s.user_id""")
def _(t):
    return history.upsert_users(t.sql(STORED), t.sql(SEEN), F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))


PROFILE_USERS = "SELECT user_id, first_name, joined_at FROM v_users WHERE NOT is_bot"
PROFILE = f"""{USER_STATS}, {TOP_TOPICS}, {STREAKS}, votes AS (SELECT user_id, count(*) FILTER (WHERE rating = 'useful') AS helpful_votes FROM v_feedback GROUP BY user_id),
tops AS (SELECT user_id, count(DISTINCT topic) AS n_topics FROM ttopics GROUP BY user_id),
profile AS (SELECT u.user_id, coalesce(total_q, 0) AS total_q, coalesce(deep_q, 0) AS deep_q, coalesce(night_q, 0) AS night_q, coalesce(morn_q, 0) AS morn_q, coalesce(pdf_cited, 0) AS pdf_cited,
 coalesce(helpful_votes, 0) AS helpful_votes, coalesce(best_streak, 0) AS best_streak, coalesce(n_topics, 0) AS n_topics, coalesce(languages, '') AS languages
 FROM ({PROFILE_USERS}) u LEFT JOIN ustats s ON s.user_id = u.user_id LEFT JOIN votes v ON v.user_id = u.user_id LEFT JOIN streak k ON k.user_id = u.user_id LEFT JOIN tops p ON p.user_id = u.user_id),
flags AS (SELECT user_id, [total_q >= 1, total_q >= 25, total_q >= 100, total_q >= 500, languages = 'ar,en,fr', deep_q >= 5, night_q >= 10, morn_q >= 10, pdf_cited >= 10, helpful_votes >= 10, best_streak >= 7, n_topics >= 5] AS f,
 ['curious', 'scholar_25', 'scholar_100', 'scholar_500', 'polyglot', 'deep_diver', 'night_owl', 'early_bird', 'researcher', 'helper', 'on_fire', 'topic_explorer'] AS k FROM profile),
won AS (SELECT user_id, list_filter(k, lambda x: f[list_position(k, x)]) AS earned, list_filter(k, lambda x: NOT f[list_position(k, x)])[1] AS upcoming FROM flags)"""


def profile(t):
    return badges.user_profile(
        t.sql(PROFILE_USERS), act.user_stats(sourced(t), now_turns(t)), act.helpful_votes(t.feedback), history.streaks(t.events),
        act.top_topics_per_user(sourced(t)),
    )


@query("R19_badges", f"WITH {PROFILE} SELECT user_id, array_to_string(earned, ',') AS earned, upcoming FROM won")
def _(t):
    return badges.award(profile(t)).select("user_id", F.concat_ws(",", "earned").alias("earned"), "upcoming")


@query("U03_newly_earned", f"WITH {PROFILE} SELECT user_id, array_to_string(list_filter(earned, lambda x: x <> 'curious' AND x <> 'on_fire'), ',') AS fresh FROM won")
def _(t):
    held = F.array(F.lit("on_fire"), F.lit("curious"))
    return badges.award(profile(t).withColumn("held", held)).select("user_id", F.concat_ws(",", "fresh").alias("fresh"))


@query("D01_badge_registry", f"WITH {PROFILE} SELECT w.user_id, array_to_string(CASE WHEN p.helpful_votes >= 20 THEN list_append(earned, 'fan') ELSE earned END, ',') AS earned FROM won w JOIN profile p ON p.user_id = w.user_id")
def _(t):
    extended = [*badges.BADGES, badges.Badge("fan", "Fan", "Gave 20 helpful votes", "👏", badges.at_least("helpful_votes", 20))]
    return badges.award(profile(t), extended).select("user_id", F.concat_ws(",", "earned").alias("earned"))


def _marks(prefix: str, won: bool) -> list[str]:
    return [
        f"CASE WHEN {'' if won else 'NOT '}f[{i}] THEN '{prefix}{b.emoji} {b.name} ({b.text})' END" for i, b in enumerate(badges.BADGES, 1)
    ]


MEMBER_DAYS = f"CAST(floor((epoch_us({NOW_TURNS}) - epoch_us(u.joined_at)) / 86400000000.0) AS BIGINT)"
CARD_SQL = f"""WITH {PROFILE}, topics AS (SELECT user_id, string_agg(topic, ' | ' ORDER BY rank) AS shown FROM ttopics GROUP BY user_id),
facts AS (SELECT p.*, coalesce(s.week_q, 0) AS week_q, coalesce(k.current_streak, 0) AS current_streak, trim(u.first_name) AS first_name, u.joined_at, {MEMBER_DAYS} AS days, g.f, t.shown
 FROM profile p JOIN v_users u ON u.user_id = p.user_id JOIN flags g ON g.user_id = p.user_id LEFT JOIN ustats s ON s.user_id = p.user_id LEFT JOIN streak k ON k.user_id = p.user_id LEFT JOIN topics t ON t.user_id = p.user_id)
SELECT user_id, concat_ws(chr(10), CASE WHEN coalesce(first_name, '') = '' THEN 'member' ELSE first_name END, {', '.join(f"CASE WHEN {c} >= {least} THEN '{label}: ' || {c} END" for label, c, least in badges.CARD_NUMBERS)},
 'Here for: ' || CASE WHEN days < 60 THEN days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END ELSE CAST(floor(days / 30.0) AS BIGINT) || CASE WHEN floor(days / 30.0) = 1 THEN ' month' ELSE ' months' END END,
 'Topics: ' || shown, 'Badges: ' || len(list_filter(f, lambda x: x)) || ' of {len(badges.BADGES)}', {', '.join(_marks('', True))}, coalesce({', '.join(_marks('Next: ', False))})) AS card FROM facts"""


@query("R20_user_card", CARD_SQL)
def _(t):
    return badges.user_card(profile(t), now_turns(t))
