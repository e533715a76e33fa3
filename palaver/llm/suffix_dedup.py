"""Removal of repeated 50-byte strings by bucket-pointer refinement.

A byte goes if a string of WINDOW bytes that covers it also starts in a document
with a smaller doc_id.  Sorting every suffix of the corpus would move many times
its bytes, so only some suffixes enter the buckets: every WINDOW-byte string is
represented by its minimiser, the q-gram of least hash in it, which is the same
wherever the string occurs.

1. The initial buckets are the q-grams at these anchors.  A bucket's identifier
   is a 64-bit hash of its q-gram, so identifiers need no global numbering.
2. A bucket is refined by the identifiers at later (and earlier) offsets: those
   of the five q-grams that cover all windows around the anchor make its
   context.  An anchor whose context also occurs in a smaller document is done:
   all its windows go.
3. What is left are anchors at the edges of a match.  Only if two documents have
   such an anchor in one bucket, the bucket is refined again, for each window
   around the anchor, by the bytes left and right of it.  The smallest document
   of each class keeps its window, all others lose it.
4. Buckets that many documents share with different contexts are too large for
   that.  There each window goes its own way, under the identifiers at its
   offsets 0, 20 and 30: two windows with the same three identifiers are equal.

Spark shuffles packets of anchors by bucket, verdicts by document, texts by
document, and packets of anchors by bucket or of windows by class.  Each task
first settles what it can by itself (equal contexts and windows among its own
documents), so a passage that a third of all documents share sends one record a
task; and a q-gram with many different contexts in one task sends two records
and spreads all its windows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.hashing import PIECE, Powers, byte_table, mix, utf8
from palaver.llm.shared import parts

WINDOW = 50
Q = 20  # bytes of a q-gram
SPAN = WINDOW - Q  # a window starts at most so far before its minimiser
LATER = (0, Q, SPAN)  # the q-grams at these offsets cover a window
CHUNK = 2_000_000  # anchors settled and sent together
CONTEXTS = 16  # different contexts of a bucket in one chunk, above which its windows are spread
TOGETHER = 10_000  # anchors of a bucket that are refined in one task at most
SLICE = 100_000  # anchors refined at a time
SETTLED, REFINE, SPREAD = 1, 0, 2  # what becomes of an anchor
LEVEL = 5  # of compression on the way; the disk that a shuffle takes is what limits this operator
NONE = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other

C = F.col
PACKET = "key long, payload binary"
STATE = "key long, kind int, doc_id long, uid long, data binary, payload binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Grams:
    """Bucket identifiers of q-grams, taken from running sums over pieces of the bytes."""

    def __init__(self) -> None:
        self.table, self.powers = byte_table(False), Powers()

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers.to(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * up[: len(data)], out=sums[1:])
        return sums, down

    def at(self, data: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Identifiers of the q-grams that start at the sorted positions ``where``."""
        out = np.empty(len(where), np.uint64)
        i = 0
        while i < len(where):
            low = int(where[i])
            j = int(np.searchsorted(where, low + PIECE))
            sums, down = self.sums(data[low : int(where[j - 1]) + Q])
            x = where[i:j] - low
            out[i:j] = mix((sums[x + Q] - sums[x]) * down[x])
            i = j
        return out


    def order(self, data: np.ndarray) -> np.ndarray:
        """What minimisers are chosen by, for each q-gram of a piece."""
        sums, down = self.sums(data)
        found = (sums[Q:] - sums[:-Q]) * down[: len(data) - Q + 1]
        return (found * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick (least or greatest) over SPAN + 1 neighbours, from each position on."""
    width = 1
    while 2 * width <= SPAN + 1:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = SPAN + 1 - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(grams: Grams, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, bucket, context) of the minimisers of all windows within the texts."""
    low, high = int(offsets[0]), int(offsets[-1])
    found = []
    for a in range(low, max(high - WINDOW + 1, low), PIECE):  # windows that start in [a, b)
        b = min(a + PIECE, high - WINDOW + 1)
        order = grams.order(data[a : b + WINDOW - 1])
        least = _slide(order, np.minimum)
        cut = offsets[(offsets > a) & (offsets < b + WINDOW)]
        inside = np.zeros(b - a + 1, np.int32)  # windows that run over the end of a text do not count
        np.add.at(inside, np.clip(cut - a - WINDOW + 1, 0, b - a), 1)
        np.add.at(inside, np.clip(cut - a, 0, b - a), -1)
        least[np.cumsum(inside[:-1]) > 0] = 0
        pad = np.zeros(SPAN, np.uint32)
        most = _slide(np.concatenate([pad, least, pad]), np.maximum)
        found.append(np.flatnonzero((most == order) & (most > 0)) + a)
    where = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    text = np.searchsorted(offsets, where, side="right") - 1
    first = np.maximum(where - SPAN, offsets[text])
    last = np.minimum(where + WINDOW, offsets[text + 1]) - Q
    bucket = grams.at(data, where)
    context = mix((where - first).astype(np.uint64) * np.uint64(64) + (last - where).astype(np.uint64))
    for spot in (first, np.maximum(first, where - Q), np.minimum(where + Q, last), last):
        context = mix(context ^ grams.at(data, spot))
    return where - offsets[text], text, bucket, context


def verdicts(bucket: np.ndarray, context: np.ndarray, doc: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(settled, to refine, of a bucket to spread, to send on) of each anchor.

    Settled: the context occurs in a smaller document.  To refine: the bucket
    has anchors of two documents or more that are not settled, or some chunk
    spreads it, whose other documents are not seen here.  ``many`` marks anchors
    that stand for a bucket that some chunk spreads; without it the anchors are
    a chunk, and buckets of more than CONTEXTS contexts are spread.
    """
    n = len(bucket)
    if not n:
        return (np.zeros(0, bool),) * 4
    order = np.lexsort((doc, context, bucket))
    v, c, d = bucket[order], context[order], doc[order]
    new_v = np.ones(n, bool)
    new_v[1:] = v[1:] != v[:-1]
    new_c = new_v.copy()
    new_c[1:] |= c[1:] != c[:-1]
    least = d[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
    settled = d > least
    starts, group = np.flatnonzero(new_v), np.cumsum(new_v) - 1
    low = np.minimum.reduceat(np.where(settled, NONE, d), starts)
    high = np.maximum.reduceat(np.where(settled, np.iinfo(np.int64).min, d), starts)
    shared = low != high
    if many is None:
        wide = np.add.reduceat(new_c.astype(np.int64), starts) > CONTEXTS
    else:
        told = np.maximum.reduceat(many[order].astype(np.int8), starts).astype(bool)
        wide = told | (np.diff(starts, append=n) > TOGETHER)
        shared |= told
    spread = wide[group]
    # of a bucket to spread, only the first anchors of its first and last open document are sent
    end = (d == low[group]) | (d == high[group])
    new_d = new_c.copy()
    new_d[1:] |= d[1:] != d[:-1]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    found = settled, ~settled & shared[group], spread, ~settled & (~spread | (end & new_d))
    return tuple(x[back] for x in found)


# -- packets ---------------------------------------------------------------------


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, plane by plane: even planes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_bytes(cell: memoryview, at: int, count: int, n: int) -> tuple[np.ndarray, int]:
    planes = np.zeros((count, 8), np.uint8)
    planes[:, :n] = np.frombuffer(cell, np.uint8, count * n, at).reshape(n, count).T
    return planes.reshape(-1).view("<u8"), at + count * n


def _packets(key: np.ndarray, groups: int, columns: list[tuple[np.ndarray, int]], docs: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, payload): records dealt by key in their order; each refers to a row of ``docs``, (doc_id, uid)."""
    order = np.argsort(key, kind="stable")
    ends = np.cumsum(np.bincount(key, minlength=groups)) if len(key) else np.zeros(groups, np.int64)
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        own = order[(ends[k - 1] if k else 0) : ends[k]]
        used, index = np.unique(row[own], return_inverse=True)
        head = np.array([len(own), len(used)], "<i8").tobytes() + docs[used].tobytes() + _low_bytes(index, 4)
        yield int(k), head + b"".join(_low_bytes(x[own], n) for x, n in columns)


def _open(cells: list, sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of all packets, and (doc_id, uid) of each record."""
    columns: list[list[np.ndarray]] = [[] for _ in sizes]
    docs = []
    for cell in cells:
        count, used = (int(x) for x in np.frombuffer(cell, "<i8", 2))
        at = 16
        table = np.frombuffer(cell, "<i8", 2 * used, at).reshape(-1, 2)
        index, at = _from_bytes(cell, at + 16 * used, count, 4)
        docs.append(table[index.astype(np.int64)])
        for column, n in zip(columns, sizes, strict=True):
            values, at = _from_bytes(cell, at, count, n)
            column.append(values)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return [join(c) for c in columns], np.concatenate([*docs, np.zeros((0, 2), np.int64)]).astype(np.int64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _cells(table, name: str, rows=None) -> list:
    column = table.column(name)
    return [column[i].as_buffer() for i in (range(len(column)) if rows is None else rows)]


def _results(uid: np.ndarray, columns: list[tuple[np.ndarray, int]], groups: int) -> Iterator[tuple[int, bytes]]:
    """Verdicts, the first column a position, dealt to groups of documents: (key -1 - group, payload)."""
    uids, row = np.unique(uid, return_inverse=True)
    order = np.lexsort((columns[0][0], row))
    row = row[order]
    table = np.stack([uids, uids], axis=1).astype("<i8")
    key = (uids.view(np.uint64) % np.uint64(groups)).astype(np.int64)[row]
    for g, payload in _packets(key, groups, [(x[order], n) for x, n in columns], table, row):
        yield -1 - g, payload


# -- tasks -----------------------------------------------------------------------


def _send_anchors(buckets: int, groups: int):
    """Texts to packets of anchors by bucket, and verdicts by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        held: list[tuple] = []
        docs: list[np.ndarray] = []
        n = texts = 0

        def flush() -> Iterator[pa.RecordBatch]:
            position, row, bucket, context = (np.concatenate(x) for x in zip(*held, strict=True))
            table = np.concatenate(docs)
            settled, _, spread, send = verdicts(bucket, context, table[row, 0])
            done = settled | spread  # a bucket to spread is refined whatever other chunks hold
            for item in _results(table[row[done], 1], [(position[done], 4), (np.where(settled[done], SETTLED, SPREAD), 1)], groups):
                yield _batch([item], PACKET)
            bucket = bucket[send]
            key = (bucket % np.uint64(buckets)).astype(np.int64)
            columns = [(bucket // np.uint64(buckets), 4), (context[send], 5), (position[send], 4), (spread[send], 1)]
            for item in _packets(key, buckets, columns, table, row[send]):
                yield _batch([item], PACKET)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype("<i8") for x in ("doc_id", "uid")], axis=1)
            row = 0
            while row < len(batch):  # so many texts that a chunk stays bounded
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 8 * PIECE, side="right")) - 1)
                position, text, bucket, context = anchors(grams, data, offsets[row : end + 1])
                held.append((position, text + texts, bucket, context))
                docs.append(ids[row:end])
                n, texts, row = n + len(position), texts + end - row, end
                if n >= CHUNK:
                    yield from flush()
                    held, docs, n, texts = [], [], 0, 0
        if n:
            yield from flush()

    return run


def _judge_anchors(groups: int):
    """The anchors of a bucket to verdicts by document; verdicts pass."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = table.column("key")[0].as_py()
        if key < 0:
            return table.select(["key", "payload"])
        (bucket, context, position, many), docs = _open(_cells(table, "payload"), [4, 5, 4, 1])
        settled, refine, spread, _ = verdicts(bucket, context, docs[:, 0], many)
        hit = settled | refine
        flag = np.where(settled, SETTLED, np.where(spread, SPREAD, REFINE))
        rows = list(_results(docs[hit, 1], [(position[hit], 4), (flag[hit], 1)], groups))
        return pa.Table.from_batches([_batch(rows, PACKET)])

    return run


def _mask(n: int, settled: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The bytes to remove: the contexts of settled anchors, and windows."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(settled - SPAN, 0), 1)
    np.add.at(edge, np.minimum(settled + WINDOW, n), -1)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _starts(n: int, where: np.ndarray) -> np.ndarray:
    """True at the windows that hold the q-gram of one of the anchors."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(where - SPAN, 0), 1)
    np.add.at(edge, np.minimum(where, n - WINDOW) + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _report(data: np.ndarray, gone: np.ndarray | None) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256."""
    if gone is None:
        return len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest()
    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def _of(uids: np.ndarray, uid: int) -> slice:
    return slice(int(np.searchsorted(uids, uid, side="left")), int(np.searchsorted(uids, uid, side="right")))


def _sorted_verdicts(cells: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, position, verdict of ``size`` bytes), by uid."""
    (position, verdict), docs = _open(cells, [4, size])
    order = np.argsort(docs[:, 1], kind="stable")
    return docs[order, 1], position[order].astype(np.int64), verdict[order]


def _open_windows(grams: Grams, data: np.ndarray, rest: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Windows whose minimiser is an anchor to refine and that hold no settled one."""
    found = []
    rest = np.sort(rest)
    for a in range(0, len(data) - WINDOW + 1, PIECE):
        b = min(a + PIECE, len(data) - WINDOW + 1)
        own = rest[np.searchsorted(rest, a) : np.searchsorted(rest, b + SPAN)] - a
        if len(own):
            order = grams.order(data[a : b + WINDOW - 1])
            only = np.full(len(order), np.iinfo(np.uint32).max, np.uint32)
            only[own] = order[own]
            found.append(np.flatnonzero(_slide(only, np.minimum) == _slide(order, np.minimum)) + a)
    windows = np.concatenate([*found, np.zeros(0, np.int64)])
    return windows[~_starts(len(data), settled)[windows]]


def _around(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes before, bytes after, the SPAN bytes on each side of the q-grams), padded with zeros."""
    padded = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(SPAN, np.uint8)])
    sides = [*range(SPAN), *range(SPAN + Q, WINDOW + SPAN)]
    return np.minimum(where, SPAN), np.minimum(len(data) - Q - where, SPAN), padded[where[:, None] + np.array(sides)]


def _refined(bucket: np.ndarray, before: np.ndarray, after: np.ndarray, sides: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each anchor, bit i set if the window that starts i bytes before it occurs in a smaller document.

    Anchors are sorted by bucket; those of a bucket have the same q-gram, so
    their windows are told apart by the bytes on its sides.
    """
    up, down = Powers().to(2 * SPAN + 1)
    sums = np.zeros((len(bucket), 2 * SPAN + 1), np.uint64)
    np.cumsum(byte_table(False)[sides] * up[: 2 * SPAN], axis=1, out=sums[:, 1:])
    gone = np.zeros(len(bucket), np.uint64)
    for i in range(SPAN + 1):
        fits = np.flatnonzero((before >= i) & (after >= SPAN - i))
        value = mix(mix((sums[fits, 2 * SPAN - i] - sums[fits, SPAN - i]) * down[SPAN - i]) ^ bucket[fits])
        order = np.lexsort((doc[fits], value))
        late = fits[order[_later(value[order], doc[fits][order])]]
        gone[late] |= np.uint64(1 << i)
    return gone


def _texts(groups: int):
    """Texts by group of documents, compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            uid = batch.column("uid").to_numpy(zero_copy_only=False).astype(np.int64)
            g = (uid.view(np.uint64) % np.uint64(groups)).astype(np.int64)
            for a in range(0, len(batch), 256):
                b = min(a + 256, len(batch))
                cells = [zlib.compress(data[offsets[i] : offsets[i + 1]], LEVEL) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[a:b]), batch.column("doc_id").slice(a, b - a), pa.array(uid[a:b]), pa.array(cells, pa.binary())], ["g", "doc_id", "uid", "data"]
                )

    return run


def _bytes(cell) -> np.ndarray:
    return np.frombuffer(zlib.decompress(cell), np.uint8)


def _send_windows(buckets: int, packets: bool):
    """Texts and verdicts of a group of documents to packets of anchors or windows, or else to open documents and finished rows."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        grams = Grams()
        texts, found = texts.combine_chunks(), found.combine_chunks()
        uids, positions, flags = _sorted_verdicts(_cells(found, "payload"), 1)
        rows: list[tuple] = []
        docs: list[tuple] = []
        spread: list[tuple] = []
        together: list[tuple] = []
        cells = _cells(texts, "data")
        for i, (g, doc_id, uid) in enumerate(zip(*(texts.column(x).to_pylist() for x in ("g", "doc_id", "uid")), strict=True)):
            own, at = _bytes(cells[i]), _of(uids, uid)
            settled, rest = positions[at][flags[at] == SETTLED], positions[at][flags[at] != SETTLED]
            windows = _open_windows(grams, own, rest, settled)
            if packets and not len(windows):
                continue
            if not len(windows):
                gone = _mask(len(own), settled, windows) if len(settled) else None
                rows.append((-1 - g, 3, doc_id, uid, None, None, *_report(own, gone)))
                continue
            if not packets:
                payload = np.array([len(settled)], "<i8").tobytes() + _low_bytes(settled, 4)
                rows.append((-1 - g, 2, doc_id, uid, cells[i].to_pybytes(), payload, None, None, None, None))
                continue
            # an anchor matters if it lies in an open window
            open_ = np.zeros(len(own) + 1, np.int64)
            open_[windows + 1] = 1
            open_ = np.cumsum(open_)
            for flag, out in ((SPREAD, spread), (REFINE, together)):
                where = np.unique(positions[at][flags[at] == flag])
                where = where[open_[np.minimum(where, len(own) - WINDOW) + 1] > open_[np.maximum(where - SPAN, 0)]]
                if flag == SPREAD and len(where):
                    windows = windows[_starts(len(own), where)[windows]]
                    ids = np.zeros(len(windows), np.uint64)
                    for step in LATER:
                        ids = mix(ids ^ grams.at(own, windows + step))
                    out.append((ids, windows, np.full(len(windows), len(docs))))
                elif len(where):
                    out.append((grams.at(own, where), where, np.full(len(where), len(docs)), *_around(own, where)))
            docs.append((NONE if doc_id is None else doc_id, uid))
        table = np.array(docs, "<i8").reshape(-1, 2)
        if spread:
            value, start, own = (np.concatenate(x) for x in zip(*spread, strict=True))
            # equal windows among these documents: one of the smallest document stands for all, and tells the others
            order = np.lexsort((table[own, 0], value))
            late = np.zeros(len(value), bool)
            late[order] = _later(value[order], table[own[order], 0])
            for k, payload in _results(table[own[late], 1], [(start[late], 4), (np.ones(int(late.sum())), 4)], 2 * buckets):
                rows.append((k, 0, None, None, None, payload, None, None, None, None))
            key = (value[~late] % np.uint64(buckets)).astype(np.int64)
            for k, payload in _packets(key, buckets, [(value[~late], 8), (start[~late], 4)], table, own[~late]):
                rows.append((2 * k, 0, None, None, None, payload, None, None, None, None))
        if together:
            bucket, where, own, before, after, sides = (np.concatenate(x) for x in zip(*together, strict=True))
            key = (bucket % np.uint64(buckets)).astype(np.int64)
            columns = [(bucket, 8), (where, 4), (before, 1), (after, 1)]
            order = np.argsort(key, kind="stable")  # as the packets take their records
            for k, payload in _packets(key, buckets, columns, table, own):
                mine = order[np.searchsorted(key[order], k) : np.searchsorted(key[order], k, side="right")]
                bytes_ = zlib.compress(np.ascontiguousarray(sides[mine]), LEVEL)
                rows.append((2 * k + 1, 0, None, None, bytes_, payload, None, None, None, None))
        return pa.Table.from_batches([_batch(rows, STATE)])

    return run


def _later(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted (value, document): True where a smaller document has the value."""
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    return doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(value) else new


def _judge_windows(groups: int):
    """The windows of a class, or the anchors of a bucket, to removals by document; all else passes.

    A removal is a position and a mask: bit i stands for the window that starts
    i bytes before the position.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, cells = table.column("key")[0].as_py(), _cells(table, "payload")
        if key < 0:
            return table
        if key % 2:
            (bucket, where, before, after), docs = _open(cells, [8, 4, 1, 1])
            sides = np.concatenate([_bytes(x).reshape(-1, 2 * SPAN) for x in _cells(table, "data")])
            order = np.argsort(bucket, kind="stable")
            masks = np.zeros(len(bucket), np.uint64)
            a = 0
            while a < len(order):  # slices end where a bucket ends
                b = int(np.searchsorted(bucket[order], bucket[order[min(a + SLICE, len(order)) - 1]], side="right"))
                own = order[a:b]
                masks[own] = _refined(bucket[own], before[own], after[own], sides[own], docs[own, 0])
                a = b
            gone = np.flatnonzero(masks)
            packs = _results(docs[gone, 1], [(where[gone], 4), (masks[gone], 4)], groups)
        else:
            (value, start), docs = _open(cells, [8, 4])
            order = np.lexsort((docs[:, 0], value))
            gone = order[_later(value[order], docs[order, 0])]
            packs = _results(docs[gone, 1], [(start[gone], 4), (np.ones(len(gone)), 4)], groups)
        return pa.Table.from_batches([_batch([(k, 0, None, None, None, p, None, None, None, None) for k, p in packs], STATE)])

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(table: pa.Table) -> pa.Table:
    """A group of documents: finished rows as they are, open documents with the removals found."""
    table = table.combine_chunks()
    kind = table.column("kind").to_numpy()
    uids, positions, masks = _sorted_verdicts(_cells(table, "payload", np.flatnonzero(kind == 0).tolist()), 4)
    names = [f.split()[0] for f in OUT.split(", ")]
    done = table.filter(pa.array(kind == 3)).select(names)
    rows = []
    for i in np.flatnonzero(kind == 2).tolist():
        payload = table.column("payload")[i].as_buffer()
        settled = _from_bytes(payload, 8, int(np.frombuffer(payload, "<i8", 1)[0]), 4)[0].astype(np.int64)
        data, at = _bytes(table.column("data")[i].as_buffer()), _of(uids, table.column("uid")[i].as_py())
        windows = [positions[at][(masks[at] >> np.uint64(k)) & np.uint64(1) == 1] - k for k in range(SPAN + 1)]
        gone = _mask(len(data), settled, np.concatenate(windows))
        rows.append((table.column("doc_id")[i].as_py(), *_report(data, gone)))
    return pa.concat_tables([done, pa.Table.from_batches([_batch(rows, OUT)])])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes and matches never cross documents.  A byte is removed
    if a string of 50 bytes that covers it also starts in a document with a
    smaller doc_id, judged on the input.

    Defined cases: null and empty texts, and texts below 50 bytes, lose nothing;
    a null doc_id counts as larger than all others; rows that share a doc_id
    take nothing from each other; an empty table gives no rows; other columns
    are ignored.  Texts of 4 GB and more are not supported.
    """
    buckets = parts(docs.sparkSession)
    groups = 2 * buckets
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    sent = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NONE)))).mapInArrow(_send_anchors(buckets, groups), PACKET)
    found = sent.groupBy("key").applyInArrow(_judge_anchors(groups), PACKET)
    texts = rows.mapInArrow(_texts(groups), "g long, doc_id long, uid long, data binary")
    found = found.select((-1 - C("key")).alias("g"), "payload")
    # the same shuffled rows twice: packets to be judged, and documents that wait for the removals found
    both = texts.groupBy("g").cogroup(found.groupBy("g"))
    sent = both.applyInArrow(_send_windows(buckets, True), STATE)
    judged = sent.groupBy("key").applyInArrow(_judge_windows(groups), STATE)
    waiting = both.applyInArrow(_send_windows(buckets, False), STATE)
    return judged.unionByName(waiting).groupBy("key").applyInArrow(_finish, OUT)
