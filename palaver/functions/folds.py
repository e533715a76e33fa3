"""Per-key folds that run inside stateful streams.  No Spark objects live here.

Each fold takes the key's state (None at first) and the new rows of the key in
order, and returns the new state and the rows to emit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd

Fold = Callable[[Any, pd.DataFrame], tuple[Any, list[tuple]]]


def cooldown(seconds: float) -> Fold:
    step = pd.Timedelta(seconds=seconds)

    def fold(state, rows):
        last = None if state is None else pd.Timestamp(state)
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"]):
            if last is None or ts >= last + step:
                last = ts
                out.append((int(event_id), ts))
        return (None if last is None else last.isoformat()), out

    return fold


def toggles(order: list[str]):
    """Votes: the same rating again removes it, another one replaces it.

    For ``applyInPandasWithState`` over buckets of keys.  Rows have ``_key``,
    ``id`` and ``rating``; all keys of a bucket are folded at once.  In a run of
    equal ratings of a key every second vote removes the one before it.  The
    state has the ratings in force; a null rating is none.
    """

    def run(bucket: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        held = pd.DataFrame(dict(zip(("_key", "rating"), json.loads(state.get[0]) if state.exists else ((), ()))), dtype=object)
        names, ratings = (np.concatenate([held[c], rows[c].astype(object)]) for c in ("_key", "rating"))
        key = pd.factorize(names)[0]
        at = np.argsort(key, kind="stable")  # what is held stands before the votes
        key, rating = key[at], pd.factorize(ratings)[0][at]  # -1: null
        first = np.diff(key, prepend=-1) != 0
        starts = first | (np.diff(rating, prepend=-2) != 0)
        run_start = np.flatnonzero(starts)
        place = np.arange(len(key)) - run_start[np.cumsum(starts) - 1]
        stands = (place % 2 == 0) & (rating >= 0)
        replaces = ~first & np.append(False, stands[:-1])
        outcome = np.where(stands | (rating < 0), np.where(replaces, "updated", ratings[at]), "removed")
        last = np.append(first[1:], True) & stands
        state.update((json.dumps([names[at][last].tolist(), ratings[at][last].tolist()]),))
        new = at >= len(held)
        yield pd.DataFrame({"_key": names[at][new], "id": rows["id"].to_numpy()[at[new] - len(held)], "outcome": outcome[new]})

    return run


def streak(state, rows):
    """(last day, current, best); at most one step per day."""
    last, current, best = json.loads(state) if state else (None, 0, 0)
    out = []
    for ts in rows["ts"]:
        day = ts.date()
        if last == day.isoformat():
            continue
        follows = last is not None and (day - pd.Timestamp(last).date()).days == 1
        current = current + 1 if follows else 1
        best = max(best, current)
        last = day.isoformat()
        out.append((day, current, best))
    return json.dumps([last, current, best]), out


def memory(n: int, hours: float) -> Fold:
    """Last n exchanges of the past hours; a question emits what it can see."""
    age = pd.Timedelta(hours=hours)

    def fold(state, rows):
        kept = [(int(i), pd.Timestamp(t)) for i, t in json.loads(state)] if state else []
        out = []
        for turn_id, ts, role, visible, reset in zip(rows["id"], rows["ts"], rows["role"], rows["visible"], rows["reset"]):
            kept = [] if reset else [(i, t) for i, t in kept if t >= ts - age]
            if role == "user":
                out += [(int(turn_id), i, back) for back, (i, _) in enumerate(reversed(kept[-2 * n:]), 1)]
            if visible and not reset:
                kept = (kept + [(int(turn_id), ts)])[-2 * n:]
        return json.dumps([(i, t.isoformat()) for i, t in kept]), out

    return fold


def pending(minutes: float, limit: int) -> Fold:
    """Open reports; a message becomes the reason of the latest recent one."""
    age = pd.Timedelta(minutes=minutes)

    def fold(state, rows):
        opened = [(int(i), pd.Timestamp(t)) for i, t in json.loads(state)] if state else []
        out = []
        for kind, row_id, ts, text in zip(rows["kind"], rows["id"], rows["ts"], rows["text"]):
            opened = [(i, t) for i, t in opened if t >= ts - age]
            if kind == 0:
                opened.append((int(row_id), ts))
            elif opened:
                report, _ = opened.pop()
                out.append((report, int(row_id), (text or "")[:limit]))
        return json.dumps([(i, t.isoformat()) for i, t in opened]), out

    return fold


def awarded(state, rows):
    """Badges not emitted before."""
    held = json.loads(state) if state else []
    out = []
    for earned in rows["earned"]:
        for key in earned:
            if key not in held:
                held.append(key)
                out.append((key,))
    return json.dumps(held), out


def grouped(fold: Fold, order: list[str], columns: list[str], keys: list[str], time: str = "", seconds: float = 0):
    """Adapt a fold to ``applyInPandasWithState``: the rows of a key in one
    micro-batch are put in order, folded, and the state is stored as text.

    With ``time``, a column, the state of a key goes once the watermark is so
    many seconds past its last row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        after, out = fold(state.get[0] if state.exists else None, rows)
        state.update((after or "",))
        if time:
            due = int((rows[time].max().timestamp() + seconds) * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            pdf = pd.DataFrame(out, columns=columns)
            for name, value in zip(keys, key):
                pdf[name] = value
            yield pdf[keys + columns]

    return run
