"""Turns, streaks, votes and cooldowns: per-key histories in batch form.

Any key may hold a large share of all rows.  Histories are therefore numbered,
summed and paired through ``palaver.plans.scale``, which slices hot keys, or
through time buckets; no operator needs all rows of a key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions.tasks import accept_spaced, slice_transitions, walk_slices
from palaver.operators.activity import visible_turn
from palaver.plans.scale import previous, python_tasks, row_numbers, running_sum, split_hot

C = F.col


# --- turns ----------------------------------------------------------------------------


def number_turns(batch: DataFrame, stored: DataFrame, order: str = "seq") -> DataFrame:
    """Give each new turn the next index of its (chat, user), starting at 0."""
    keys = ["chat_id", "user_id"]
    last = stored.groupBy(*keys).agg(F.max("turn_idx").alias("_last"))
    numbered = row_numbers(batch, keys, [order], "_pos")
    return (
        numbered.join(last, keys, "left")
        .withColumn("turn_idx", (F.coalesce("_last", F.lit(-1)) + C("_pos")).cast("int"))
        .drop("_last", "_pos")
    )


def last_n_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """Newest n exchanges (2n turns) per (chat, user), numbered oldest first.

    The descending rank is pruned to 2n rows per key before the shuffle.
    """
    keys = ["chat_id", "user_id"]
    newest = W.partitionBy(*keys).orderBy(C("turn_idx").desc())
    kept = turns.where(visible_turn()).withColumn("_r", F.row_number().over(newest)).where(C("_r") <= 2 * n)
    oldest = W.partitionBy(*keys).orderBy("turn_idx")
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_r")


def latest_transcript(turns: DataFrame, n: int = 100) -> DataFrame:
    """Newest n turns per user by index."""
    w = W.partitionBy("user_id").orderBy(C("turn_idx").desc(), C("id").desc())
    return turns.withColumn("_r", F.row_number().over(w)).where(C("_r") <= n).drop("_r").orderBy("user_id", "chat_id", "turn_idx")


def history_asof(turns: DataFrame, n: int = 5, hours: float = 24.0) -> DataFrame:
    """(question_id, id, back): up to 2n visible turns before each question.

    Visible turns get running numbers per (chat, user); a question asks for the
    2n numbers before its own, which is an equi-join on (chat, user, number)
    with a fixed fan-out.  Turn order and time order agree, so the age limit
    can be checked after the join.
    """
    keys = ["chat_id", "user_id"]
    seen = F.coalesce(visible_turn(), F.lit(False)).cast("bigint")
    numbered = running_sum(turns.withColumn("_vis", seen), keys, ["turn_idx"], C("_vis"), "_no")
    memory = numbered.where("_vis = 1").select(*keys, C("_no").alias("_want"), "id", "ts")
    asked = numbered.where(C("role") == "user").select(
        *keys,
        C("id").alias("question_id"),
        C("ts").alias("asked_at"),
        (C("_no") - C("_vis")).alias("_before"),
        F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))).alias("_i"),
    )
    wanted = asked.withColumn("_want", C("_before") - C("_i")).where(C("_want") > 0)
    cutoff = C("asked_at") - F.make_dt_interval(hours=F.lit(int(hours)))
    return (
        wanted.join(memory, [*keys, "_want"])
        .where(C("ts") >= cutoff)
        .select("question_id", "id", (C("_i") + 1).alias("back"))
    )


# --- reports and their reasons ------------------------------------------------------------


def pending_report_asof(reports: DataFrame, messages: DataFrame, keys: Sequence[str], minutes: int = 10) -> DataFrame:
    """For each message the latest open report of its key in the last minutes.

    ``reports`` = (id, created_at, keys), ``messages`` = (id, ts, keys).  Time
    is cut into buckets as wide as the limit; a report is placed into its own
    and the next bucket, so a message finds every candidate in one bucket.
    """
    width = minutes * 60
    bucket = F.floor(F.unix_micros(C("ts").cast("timestamp")) / (width * 1_000_000))
    left = reports.select(
        *keys, C("created_at").alias("ts"), F.lit(0).alias("_kind"), F.struct("id", "created_at").alias("_rep"),
        F.lit(None).cast("bigint").alias("message_id"),
    ).select("*", F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    right = messages.select(
        *keys, "ts", F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_rep"].dataType).alias("_rep"),
        C("id").alias("message_id"),
    ).select("*", bucket.alias("_b"))
    w = (
        W.partitionBy(*keys, "_b").orderBy("ts", "_kind", F.coalesce("_rep.id", "message_id"))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    both = left.unionByName(right).withColumn("_open", F.last("_rep", ignorenulls=True).over(w))
    fresh = C("_open.created_at") >= C("ts") - F.make_dt_interval(mins=F.lit(minutes))
    return both.where((C("_kind") == 1) & fresh).select(*keys, "message_id", C("_open.id").alias("report_id"))


def attach_report_reason(
    reports: DataFrame, messages: DataFrame, keys: Sequence[str], minutes: int = 10, limit: int = 500
) -> DataFrame:
    """(report_id, message_id, reason): each message becomes the reason of the
    latest report still without one, if that is recent enough.

    Reports open and messages close, latest first, so a message and its report
    sit next to each other among the rows of one nesting level.  An expired
    report can never match later, hence the age check comes last.
    """
    cols = [*keys, "ts", "kind", "id", "text"]
    opened = reports.select(*keys, C("created_at").alias("ts"), F.lit(0).alias("kind"), "id", F.lit(None).cast("string").alias("text"))
    closed = messages.select(*keys, "ts", F.lit(1).alias("kind"), "id", "text")
    line = opened.unionByName(closed).select(*cols)
    order = ["ts", "kind", "id"]
    summed = running_sum(line, keys, order, F.when(C("kind") == 0, 1).otherwise(-1), "_sum")
    levelled = summed.withColumn("_level", C("_sum") - F.when(C("kind") == 0, 1).otherwise(0)).drop("_sum")
    paired = previous(levelled, [*keys, "_level"], order, {"kind": "_pkind", "id": "report_id", "ts": "_pts"})
    fresh = C("_pts") >= C("ts") - F.make_dt_interval(mins=F.lit(minutes))
    return paired.where((C("kind") == 1) & (C("_pkind") == 0) & fresh).select(
        "report_id", C("id").alias("message_id"), F.substring("text", 1, limit).alias("reason")
    )


# --- votes ----------------------------------------------------------------------------------

VOTE = ["chat_id", "message_id", "user_id"]


def feedback_outcomes(clicks: DataFrame) -> DataFrame:
    """Outcome of every click: a rating (newly set), 'updated' or 'removed'.

    Repeating a rating takes it back, so inside a run of equal clicks set and
    removed alternate, and a run of odd length leaves its rating standing.
    What a click finds therefore follows from its place in its run and from the
    length of the run before.
    """
    order = ["created_at", "id"]
    lagged = previous(clicks, VOTE, order, {"rating": "_before"})
    starts = F.when(C("_before").eqNullSafe(C("rating")), 0).otherwise(1)
    runs = running_sum(lagged, VOTE, order, starts, "_run")
    placed = row_numbers(runs, [*VOTE, "_run"], order, "_place")
    sizes = placed.groupBy(*VOTE, "_run").agg(F.count("*").alias("_len"))
    prior = sizes.select(*VOTE, (C("_run") + 1).alias("_run"), C("_len").alias("_plen"))
    standing = (F.coalesce("_plen", F.lit(0)) % 2) == 1
    outcome = (
        F.when(C("_place") % 2 == 0, "removed")
        .when((C("_place") == 1) & standing, "updated")
        .otherwise(C("rating"))
    )
    return placed.join(prior, [*VOTE, "_run"], "left").select(*clicks.columns, outcome.alias("outcome"), "_run", "_place")


def feedback_state(clicks: DataFrame) -> DataFrame:
    """The votes that stand after all clicks.

    Only the last run of a key matters: its length decides.  Counts and the
    last click combine map side.
    """
    outcomes = feedback_outcomes(clicks)
    last = outcomes.groupBy(*VOTE).agg(
        F.max_by(F.struct("rating", "outcome", "created_at", "id"), F.struct("created_at", "id")).alias("r")
    )
    return last.where(C("r.outcome") != "removed").select(*VOTE, "r.rating", C("r.created_at").alias("created_at"))


# --- streaks -----------------------------------------------------------------------------------


def streaks(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Current and best run of consecutive days per user.

    Rows shrink to distinct (user, day) first: a user has as many as there are
    days, however many events.
    """
    days = events.select(C(user).alias("user_id"), F.to_date(ts).alias("day")).distinct()
    n = F.row_number().over(W.partitionBy("user_id").orderBy("day"))
    runs = (
        days.withColumn("island", F.date_sub("day", n))
        .groupBy("user_id", "island")
        .agg(F.count("*").alias("length"), F.max("day").alias("last_day"))
    )
    return runs.groupBy("user_id").agg(
        F.max_by("length", "last_day").alias("current_streak"),
        F.max("length").alias("best_streak"),
        F.max("last_day").alias("last_streak_date"),
    )


# --- cooldown ------------------------------------------------------------------------------------


def cooldown_filter(events: DataFrame, seconds: float, *, min_rows: int | None = None) -> DataFrame:
    """(event_id, user_id) of accepted events: at least ``seconds`` after the
    last accepted one of the user; a rejected one does not move the clock.

    Rows stream through the tasks in order of user and time, one row of state
    at a time.  A hot user is cut into time slices: each slice is summarised by
    where a chain that enters it must leave it (an entry can only lie in its
    first ``seconds``), the short summaries are walked per user, and then every
    slice is decided on its own, knowing the last event accepted before it.
    """
    cooldown = int(seconds * 1_000_000)
    us = F.unix_micros(C("ts").cast("timestamp"))
    rows = split_hot(events.select("event_id", "user_id", us.alias("us")), ["user_id"], C("us"), min_rows=min_rows)
    rows = rows.select("event_id", "user_id", "us", C("_slice").alias("slice"), "_hot")
    steps = (
        rows.where("_hot").groupBy("user_id", "slice")
        .applyInPandas(slice_transitions(cooldown), "user_id bigint, slice int, entry bigint, exit bigint, final bigint")
    )
    carried = steps.groupBy("user_id").applyInPandas(walk_slices(cooldown), "user_id bigint, slice int, last bigint")
    ordered = python_tasks(rows.drop("_hot").join(F.broadcast(carried), ["user_id", "slice"], "left"), "user_id", "slice")
    return ordered.sortWithinPartitions("user_id", "slice", "us", "event_id").mapInPandas(
        accept_spaced(cooldown), "event_id bigint, user_id bigint"
    )


# --- users ---------------------------------------------------------------------------------------


def upsert_users(stored: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Merge seen users into the stored table.

    New values win unless they are NULL; ``is_bot`` is always taken from the
    new row; the activity stamp of seen users is set.  ``seen`` has one row per
    user.
    """
    fields = [c for c in seen.columns if c not in ("user_id", "is_bot")]
    new = seen.select("user_id", *[C(c).alias(f"_n_{c}") for c in seen.columns if c != "user_id"], F.lit(True).alias("_seen"))
    both = stored.join(new, "user_id", "full_outer")
    touched = F.coalesce("_seen", F.lit(False))
    out = both.withColumns(
        {
            **{c: F.coalesce(C(f"_n_{c}"), C(c)) for c in fields},
            "is_bot": F.when(touched, F.coalesce("_n_is_bot", F.lit(False))).otherwise(C("is_bot")),
            "last_active_at": F.when(touched, now).otherwise(C("last_active_at")),
        }
    )
    return out.select(*stored.columns)


def reset_turns(turns: DataFrame, resets: DataFrame) -> DataFrame:
    """Stamp ``cleared_at`` on turns older than the reset of their (chat, user).

    ``resets`` = (chat_id, user_id, reset_at), the latest per key; turns cleared
    before keep their first stamp.
    """
    keys = ["chat_id", "user_id"]
    latest = resets.groupBy(*keys).agg(F.max("reset_at").alias("_at"))
    return (
        turns.join(latest, keys, "left")
        .withColumn("cleared_at", F.coalesce("cleared_at", F.when(C("ts") <= C("_at"), C("_at"))))
        .drop("_at")
    )
