"""Keyed state over streams of events, votes, turns and reports.

Each operator is the streaming form of a batch operator in
``palaver.operators.history``; fed with the same rows both give the same result.
State per key is small: one time, one rating, a handful of turns.  Rows of a key
must arrive in order from batch to batch; inside a batch they are sorted.

State that only looks back some hours expires: rows carry a watermark of DELAY,
and a key is forgotten when the watermark has passed its last row by that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from palaver.functions import folds

C = F.col


DELAY = "1 day"  # rows later than this are not waited for
BUCKETS = 4096  # of the keys of votes


def _apply(df: DataFrame, keys: Sequence[str], fold, order: list[str], out: str, time: str = "", seconds: float = 0, delay: str = DELAY) -> DataFrame:
    columns = [part.split()[0] for part in out.split(", ")]
    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [out])
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    rows = df.withWatermark(time, delay) if time else df
    return rows.groupBy(*keys).applyInPandasWithState(
        folds.grouped(fold, order, columns, list(keys), time, seconds), schema, "state string", "append", timeout
    )


def cooldown_stream(events: DataFrame, seconds: float) -> DataFrame:
    """(user_id, event_id, ts) of accepted events."""
    return _apply(events.select("user_id", "event_id", "ts"), ["user_id"], folds.cooldown(seconds), ["ts", "event_id"], "event_id bigint, ts timestamp", "ts", seconds)


def toggle_stream(clicks: DataFrame) -> DataFrame:
    """Outcome of every click: (chat_id, message_id, user_id, id, outcome).

    Most keys have one click or two, so state is kept by BUCKETS of keys, whose
    clicks are folded at once; a bucket holds the ratings in force.
    """
    keys = ["chat_id", "message_id", "user_id"]
    schema = ", ".join(f"{k} {kind}" for k, kind in clicks.select(*keys).dtypes)
    rows = clicks.select(F.to_json(F.struct(*keys)).alias("_key"), "id", "rating", "created_at")
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)))
    folded = dealt.groupBy("_bucket").applyInPandasWithState(
        folds.toggles(["created_at", "id"]), "_key string, id bigint, outcome string", "state string", "append", GroupStateTimeout.NoTimeout
    )
    return folded.select(F.from_json("_key", schema).alias("_key"), "id", "outcome").select("_key.*", "id", "outcome")


def streak_stream(events: DataFrame) -> DataFrame:
    """(user_id, day, current, best) on the first event of each day."""
    return _apply(events.select("user_id", "ts"), ["user_id"], folds.streak, ["ts"], "day date, current int, best int")


def memory_stream(turns: DataFrame, n: int = 5, hours: float = 24.0) -> DataFrame:
    """(chat_id, user_id, question_id, id, back).  ``turns`` has id, ts,
    turn_idx, role, visible and reset (true on a reset command)."""
    rows = turns.select("chat_id", "user_id", "id", "ts", "turn_idx", "role", "visible", "reset")
    return _apply(rows, ["chat_id", "user_id"], folds.memory(n, hours), ["turn_idx"], "question_id bigint, id bigint, back int", "ts", hours * 3600)


def report_stream(line: DataFrame, minutes: float = 10, limit: int = 500, delay: str = DELAY) -> DataFrame:
    """(user_id, report_id, message_id, reason).  ``line`` = (user_id, kind, id,
    ts, text) with kind 0 for reports and 1 for messages."""
    return _apply(line, ["user_id"], folds.pending(minutes, limit), ["ts", "kind", "id"], "report_id bigint, message_id bigint, reason string", "ts", minutes * 60, delay)


def award_stream(profiles: DataFrame) -> DataFrame:
    """(user_id, badge) once per user.  ``profiles`` = (user_id, at, earned)."""
    return _apply(profiles, ["user_id"], folds.awarded, ["at"], "badge string")
