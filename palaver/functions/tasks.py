"""Numpy helpers that run inside tasks.  No Spark objects live here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def sortable(ids) -> np.ndarray:
    """Ids as numbers or as fixed-width strings, which sort by code point."""
    values = np.asarray(ids)
    return values.astype(str) if values.dtype == object else values


class TopRows:
    """The n best (id, score) seen so far for each query of a block; ``keys`` has a row per query.

    All queries are kept in three flat arrays and merged at once.
    """

    def __init__(self, keys: pd.DataFrame, n: int):
        self.keys, self.n = keys, n
        self.query = np.zeros(0, np.int64)
        self.ids: np.ndarray | None = None
        self.scores = np.zeros(0)

    def add_block(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Scores of queries (rows, all or those numbered ``queries``) for the same ids; -inf never enters."""
        if scores.shape[1] > self.n:
            floor = np.partition(scores, scores.shape[1] - self.n, axis=1)[:, scores.shape[1] - self.n]
        else:
            floor = np.full(len(scores), -np.inf)
        q, at = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        found, found_ids, value = q if queries is None else queries[q], ids[at], scores[q, at]
        if self.ids is not None:
            found, found_ids = np.concatenate([self.query, found]), np.concatenate([self.ids, found_ids])
            value = np.concatenate([self.scores, value])
        order = np.lexsort((found_ids, -value, found))
        found = found[order]
        first = np.flatnonzero(np.diff(found, prepend=-1))
        place = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
        keep = order[place < self.n]
        self.query, self.ids, self.scores = found[place < self.n], found_ids[keep], value[keep]

    def frames(self) -> Iterator[pd.DataFrame]:
        if len(self.query):
            out = self.keys.iloc[self.query].reset_index(drop=True)
            out["id"], out["score"] = self.ids, self.scores
            yield out


Frames = Iterator[pd.DataFrame]


def dense_scan(keys: pd.DataFrame, matrix: np.ndarray, n: int, skip: np.ndarray | None, digits: int) -> Callable[[Frames], Frames]:
    """Scores one partition of vectors (id, embedding) against a query block
    and keeps the n best per query; memory is bounded by n rows per query."""

    def run(batches: Frames) -> Frames:
        top = TopRows(keys, n)
        for pdf in batches:
            if pdf.empty:
                continue
            ids = sortable(pdf["id"])
            block = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            scores = np.round(matrix @ block.T, digits)
            if skip is not None:
                scores[ids[None, :] == skip[:, None]] = -np.inf
            top.add_block(ids, scores)
        yield from top.frames()

    return run


DEAD, LIVE, NAMED = -1, -2, -3  # in place of a term: documents to leave out, the only ones to take, all of the range


def _ranges(batches: Frames) -> Iterator[pd.DataFrame]:
    """The rows of one range of documents after the other; a range may go on in the next batch."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        cuts = [0, *(np.flatnonzero(np.diff(pdf["range"])) + 1)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pdf.iloc[a:b]
        held = pdf.iloc[cuts[-1] :].reset_index(drop=True)
    if held is not None:
        yield held


class Bm25:
    """Weights (terms x queries) and the saturation of term counts."""

    def __init__(self, weights: np.ndarray, k1: float, b: float, avgdl: float):
        self.weights, self.k1, self.b, self.avgdl = weights, k1, b, avgdl

    def saturated(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))

    def reach(self, lists: pd.DataFrame) -> np.ndarray:
        """What a document of the range can score at most, for every query."""
        most = self.saturated(lists["max_tf"].to_numpy(np.float64), lists["min_dl"].to_numpy(np.float64))
        return most @ np.maximum(self.weights[lists["tidx"].to_numpy()], 0) + 1e-9


def best_ranges(keys: pd.DataFrame, model: Bm25, n: int) -> Callable[[Frames], Frames]:
    """The n ranges with the greatest reach per query, from (range, tidx, max_tf, min_dl) in the order of ranges."""

    def run(batches: Frames) -> Frames:
        top = TopRows(keys, n)
        held: list[tuple[int, np.ndarray]] = []

        def merge() -> None:
            if held:
                scores = np.array([x for _, x in held]).T
                top.add_block(np.array([r for r, _ in held]), np.where(scores > 1e-9, scores, -np.inf))
                held.clear()

        for rows in _ranges(batches):
            held.append((int(rows["range"].iat[0]), model.reach(rows)))
            if len(held) >= 64:
                merge()
        merge()
        yield from top.frames()

    return run


def open_ranges(model: Bm25, floor: np.ndarray) -> Callable[[Frames], Frames]:
    """(range) of all ranges that can reach the floor of some query."""

    def run(batches: Frames) -> Frames:
        found = [int(rows["range"].iat[0]) for rows in _ranges(batches) if (model.reach(rows) >= floor).any()]
        yield pd.DataFrame({"range": np.array(found, np.int64)})

    return run


def postings_scan(keys: pd.DataFrame, model: Bm25, n: int, digits: int, floor: np.ndarray, only_live: bool, cells: int = 4_000_000) -> Callable[[Frames], Frames]:
    """Scores one task's lists (range, tidx, max_tf, min_dl, ids, docs, tfs, dls), in the order of ranges,
    and keeps the n best per query that reach its floor."""

    def score(rows: pd.DataFrame, top: TopRows) -> None:
        lists = rows[rows["tidx"] >= 0]
        if lists.empty:
            return
        asked = np.flatnonzero(model.reach(lists) >= floor)
        if not len(asked):
            return
        weights = model.weights[lists["tidx"].to_numpy()][:, asked]
        here = rows[rows["tidx"] == NAMED].iloc[0]
        ids, place = np.unique(sortable(here["ids"]), return_inverse=True)  # a repeated id is one hit of its range
        term = np.repeat(np.arange(len(lists)), lists["docs"].str.len())
        doc = np.concatenate(lists["docs"].to_list())
        part = model.saturated(np.concatenate(lists["tfs"].to_list()), here["dls"].astype(np.float64)[doc])
        doc = place[doc]
        usable = np.ones(len(ids), bool)
        for kind, inside in ((DEAD, False), (LIVE, True)):
            named = rows.loc[rows["tidx"] == kind, "ids"].to_list()
            if named:
                usable &= np.isin(ids, sortable(np.concatenate(named)), invert=not inside)
            elif kind == LIVE and only_live:
                return
        order = np.argsort(doc, kind="stable")
        doc, term, part = doc[order], term[order], part[order]
        step = max(1, cells // max(len(lists), len(asked)))
        for lo in range(0, len(ids), step):
            at = slice(*np.searchsorted(doc, [lo, lo + step]))
            block = np.zeros((min(step, len(ids) - lo), len(lists)))
            block[doc[at] - lo, term[at]] = part[at]
            scores = np.round(block @ weights, digits).T
            scores[(scores <= 0) | (scores < floor[asked][:, None])] = -np.inf
            scores[:, ~usable[lo : lo + step]] = -np.inf
            top.add_block(ids[lo : lo + step], scores, asked)

    def run(batches: Frames) -> Frames:
        top = TopRows(keys, n)
        for rows in _ranges(batches):
            score(rows, top)
        yield from top.frames()

    return run


def posting_rows(batches: Frames) -> Frames:
    """Lists (range, term, ids, docs, tfs, dls), in the order of ranges, as a row per document and term."""
    for rows in _ranges(batches):
        here = rows[rows["term"].isna()].iloc[0]
        ids, dls = np.asarray(here["ids"]), here["dls"].astype(np.int64)
        for _, one in rows[rows["term"].notna()].iterrows():
            yield pd.DataFrame({"id": ids[one["docs"]], "dl": dls[one["docs"]], "term": one["term"], "tf": one["tfs"].astype(np.int64), "range": one["range"]})


def slice_transitions(cooldown: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """First accepted event of a slice -> last accepted event of the slice, for
    every event that can be the first one; runs with a common exit keep their
    last entry."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["us"].to_numpy())
        after = np.searchsorted(ts, ts + cooldown, side="left")
        end = np.where(after < len(ts), after, np.arange(len(ts)))
        while not np.array_equal(end, end[end]):  # twice as far with every step
            end = end[end]
        leave = ts[end]
        # the last event accepted before the slice is older than its first event
        n = min(int(after[0]) + 1, len(ts))
        keep = np.append(leave[1:n] != leave[: n - 1], True)
        return pd.DataFrame(
            {
                "user_id": pdf["user_id"].iloc[0],
                "slice": pdf["slice"].iloc[0],
                "entry": ts[:n][keep],
                "exit": leave[:n][keep],
                "final": ts[-1],
            }
        )

    return run


def walk_slices(cooldown: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Time of the last accepted event before each slice of one user."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for number, rows in pdf.sort_values(["slice", "entry"]).groupby("slice", sort=True):
            out.append((pdf["user_id"].iloc[0], number, last))
            free = rows["entry"].iloc[0] if last is None else last + cooldown
            if free <= rows["final"].iloc[0]:
                at = int(rows["entry"].searchsorted(free, side="left"))
                last = int(rows["exit"].iloc[at])
        return pd.DataFrame(out, columns=["user_id", "slice", "last"]).astype({"last": "Int64"})

    return run


def _places(group: np.ndarray, us: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the first event of group ``of`` at or after time ``at``; len(us) where there is none.

    Events are sorted by group and time.
    """
    kind = np.repeat([0, 1], [len(at), len(us)])  # a time stands before the events of that time
    order = np.lexsort((kind, np.concatenate([at, us]), np.concatenate([of, group])))
    events = np.cumsum(kind[order])
    found = np.empty(len(at), np.int64)
    asked = order < len(at)
    found[order[asked]] = events[asked]
    inside = found < len(us)
    inside[inside] = group[found[inside]] == of[inside]
    return np.where(inside, found, len(us))


def chains(group: np.ndarray, us: np.ndarray, cooldown: int, free: np.ndarray) -> np.ndarray:
    """Marks the events that are accepted: per group the first at or after ``free``,
    then each first one that is ``cooldown`` later.

    The jump to the next accepted event is known for every event; tables of 1, 2,
    4, ... jumps mark all that the first one leads to.
    """
    n = len(us)
    tables = [np.append(_places(group, us, group, us + cooldown), n)]
    while (tables[-1] < n).any():
        tables.append(tables[-1][tables[-1]])
    marked = np.zeros(n + 1, bool)
    marked[_places(group, us, np.arange(len(free)), free)] = True
    for jump in reversed(tables):
        marked[jump[marked]] = True
    return marked[:n]


def accept_spaced(cooldown: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Accepted events of rows sorted by (user, slice, time); ``last`` is the
    last event accepted before the slice, if any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, free_held = None, 0  # the slice that the last batch ended in
        for pdf in batches:
            if pdf.empty:
                continue
            user, part, us = (pdf[c].to_numpy() for c in ("user_id", "slice", "us"))
            first = np.append(True, (user[1:] != user[:-1]) | (part[1:] != part[:-1]))
            starts, group = np.flatnonzero(first), np.cumsum(first) - 1
            last = pdf["last"].astype("Int64").iloc[starts]
            free = np.where(last.notna(), last.fillna(0).to_numpy(np.int64) + cooldown, us[starts])
            if held == (user[0], part[0]):
                free[0] = free_held
            keep = chains(group, us, cooldown, free)
            held, mine = (user[-1], part[-1]), np.flatnonzero(keep & (group == group[-1]))
            free_held = us[mine[-1]] + cooldown if len(mine) else free[-1]
            yield pdf.loc[keep, ["event_id", "user_id"]]

    return run
