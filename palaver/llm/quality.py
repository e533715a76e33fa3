"""A byte-level convolutional network for text quality, in numpy.

Bytes are embedded, learned filters slide over them, and the greatest response
of every filter is taken over chunks of CHUNK bytes that overlap by half and
cover the whole document.  Mean, maximum and minimum over the chunks go through
one hidden layer into one probability.

The filters start every STRIDE bytes and span several strides, so a pass is one
matrix product over the strides and a sum of shifted columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.hashing import ranges, utf8
from palaver.llm.shared import stored

TRAIN_ROWS = 4_000  # labelled documents the network is fitted on, the first by a hash of their id
TRAIN_BYTES = 16 << 20  # of text in them; a document above a quarter of this is not drawn
STRIDE = 4
SPAN = 3  # strides under one filter
CHUNK = 256
HALF = CHUNK // 2
EMBED = 8
FILTERS = 32
HIDDEN = 16
STEPS = 600  # of training
BATCH_BYTES = 1 << 17  # of text in a step, less where the sample has fewer than 20 times that
SCORE_BYTES = 1 << 20  # of text scored at a time
RATE = 4e-3
SEED = 7
THRESHOLD = 0.3

C = F.col


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    prior: float | None = None  # the score of every text where nothing could be learned


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with every text padded by zeros to whole halves, number of halves of each text).

    The padding is never shorter than what a filter reads beyond its first stride.
    """
    sizes = np.diff(offsets)
    halves = np.maximum(2, -(-(sizes + (SPAN - 1) * STRIDE) // HALF))
    out = np.zeros(int(halves.sum()) * HALF + SPAN * STRIDE, np.uint8)
    at = 0
    for a, n, h in zip(offsets[:-1], sizes, halves, strict=True):
        out[at : at + n] = data[a : a + n]
        at += int(h) * HALF
    return out, halves


def _responses(w: dict[str, np.ndarray], laid: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedded strides, responses of the filters at every stride).

    The last places of a text's padding would see the next text and respond with nothing.
    """
    x = w["embed"][laid].reshape(-1, STRIDE * EMBED)
    y = x @ w["filters"]
    n = len(x) - SPAN
    out = y[:n, :FILTERS] + w["bias"]
    for k in range(1, SPAN):
        out += y[k : k + n, k * FILTERS : (k + 1) * FILTERS]
    ends = np.cumsum(halves) * (HALF // STRIDE)
    for k in range(1, SPAN):
        out[ends - k] = -np.inf
    return x, out


def _chunks(pooled: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first half of every chunk, first chunk of every text)."""
    ends = np.cumsum(halves)
    first = np.ones(len(pooled), bool)
    first[ends - 1] = False  # a chunk begins at every half but the last of a text
    return np.flatnonzero(first), ends - halves - np.arange(len(halves))


def _features(chunk: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(starts, len(chunk)))[:, None].astype(np.float32)
    return np.concatenate([np.add.reduceat(chunk, starts) / n, np.maximum.reduceat(chunk, starts), np.minimum.reduceat(chunk, starts)], 1)


def _top(w: dict[str, np.ndarray], f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(f @ w["dense"] + w["dense_bias"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"], -30, 30)))


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of every text, given bytes and offsets."""
    if net.prior is not None:
        return np.full(len(offsets) - 1, net.prior)
    w = net.weights
    laid, halves = _laid_out(data, offsets)
    _, response = _responses(w, laid, halves)
    pooled = np.maximum(response.reshape(-1, HALF // STRIDE, FILTERS).max(axis=1), 0)
    at, starts = _chunks(pooled, halves)
    return _top(w, _features(np.maximum(pooled[at], pooled[at + 1]), starts))[1].astype(np.float64)


def _gradients(w: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    laid, halves = _laid_out(data, offsets)
    x, response = _responses(w, laid, halves)
    grid = response.reshape(-1, HALF // STRIDE, FILTERS)
    where = grid.argmax(axis=1)
    best = np.take_along_axis(grid, where[:, None], 1)[:, 0]
    pooled = np.maximum(best, 0)
    at, starts = _chunks(pooled, halves)
    left = pooled[at] >= pooled[at + 1]
    chunk = np.maximum(pooled[at], pooled[at + 1])
    f = _features(chunk, starts)
    hidden, p = _top(w, f)
    g, n = {}, len(label)
    d = ((p - label) * weight / n).astype(np.float32)
    g["out"], g["out_bias"] = hidden.T @ d, d.sum(keepdims=True)
    dh = d[:, None] * w["out"] * (hidden > 0)
    g["dense"], g["dense_bias"] = f.T @ dh, dh.sum(axis=0)
    df = dh @ w["dense"].T
    sizes = np.diff(np.append(starts, len(chunk)))
    mean, high, low = (np.repeat(df[:, k * FILTERS : (k + 1) * FILTERS], sizes, axis=0) for k in range(3))
    top, bottom = (np.repeat(f[:, k * FILTERS : (k + 1) * FILTERS], sizes, axis=0) for k in (1, 2))
    dc = mean / sizes.repeat(sizes)[:, None]
    for part, extreme in ((high, top), (low, bottom)):
        hit = chunk == extreme
        ties = np.add.reduceat(hit, starts, dtype=np.float32)
        dc = dc + part * hit / np.repeat(ties, sizes, axis=0)
    dp = np.zeros_like(pooled)
    dp[at] += dc * left
    dp[at + 1] += dc * ~left
    dp *= best > 0
    g["bias"] = dp.sum(axis=0)
    # only the stride with the greatest response of a half and filter passes its gradient on
    half, column = np.nonzero(dp)
    dy = np.zeros_like(response)
    dy[half * (HALF // STRIDE) + where[half, column], column] = dp[half, column]
    n, dx, shifts = len(dy), np.zeros_like(x), range(SPAN)
    g["filters"] = np.concatenate([x[k : k + n].T @ dy for k in shifts], 1)
    for k in shifts:
        dx[k : k + n] += dy @ w["filters"][:, k * FILTERS : (k + 1) * FILTERS].T
    used = np.flatnonzero(dx.any(axis=1))
    flat, byte = dx[used].reshape(-1, EMBED), laid.reshape(-1, STRIDE)[used].ravel()
    g["embed"] = np.stack([np.bincount(byte, flat[:, e], 256) for e in range(EMBED)], 1)
    return g


def fit(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Network:
    """Adam over shuffled runs of whole texts; both labels weigh the same in sum."""
    if not len(labels):
        return Network({}, 0.5)
    r = np.random.default_rng(seed)
    w = {
        "embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, (STRIDE * SPAN * EMBED) ** -0.5, (STRIDE * EMBED, SPAN * FILTERS)), "bias": np.zeros(FILTERS),
        "dense": r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)), "dense_bias": np.zeros(HIDDEN), "out": r.normal(0, HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    label = np.asarray(labels, np.float32)
    share = label.mean()
    if share in (0, 1):
        return Network({}, float(share))
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    sizes = np.array([len(t) for t in texts]) + HALF
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    size = min(BATCH_BYTES, max(1 << 14, int(sizes.sum()) // 20))
    while step < STEPS:
        order = r.permutation(len(texts))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // size)) + 1
        for rows in np.split(order, cuts):
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            g = _gradients(w, data, offsets, label[rows], weight[rows])
            step += 1
            rate = RATE * max(0.02, 1 - step / STEPS)
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                w[k] -= (rate / (1 - 0.9**step) * first[k] / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Network(w)


def held_out(doc_id: Column) -> Column:
    """True for the documents set aside: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """Fit on a bounded sample of the labelled documents that are not held out.

    The driver holds TRAIN_BYTES of text at most.  Of several labels of a
    document the greatest counts.
    """
    ids = labels.select(C("doc_id").cast("long").alias("doc_id"), C(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    ids = ids.where(~held_out(C("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # so many rows at most are broadcast
    texts = docs.select(C("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(C("text").cast("string"), F.lit("")), "utf-8").alias("text"))
    sample = stored(texts.where(F.length("text") <= TRAIN_BYTES // 4).join(F.broadcast(drawn), "doc_id"), "sample")
    sizes = sample.select(F.length("text").alias("size"), F.xxhash64("doc_id", "text").alias("rank")).orderBy("rank").limit(TRAIN_ROWS).collect()
    total, last = 0, None
    for r in sizes:
        total += r["size"]
        if total > TRAIN_BYTES:
            break
        last = r["rank"]
    if last is None:
        return Network({}, 0.5)
    rows = sample.where(F.xxhash64("doc_id", "text") <= last).orderBy(F.xxhash64("doc_id", "text")).limit(TRAIN_ROWS).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("label").to_numpy())


def _scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [score(net, data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]) for x, y in ranges(offsets, SCORE_BYTES)]
            value = np.concatenate([*found, np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value, pa.float64()), pa.array((value >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the score sees the whole text and nothing else.

    Defined cases: null and empty texts are scored as texts of no bytes; rows
    with a null id are judged and never learned from; repeated rows are judged
    each; without a label every score is 0.5, with labels of one kind that
    label; a very long text is scored by itself, in memory that grows with its
    length; an empty table gives no rows; other columns are ignored.
    """
    net = learn(docs, labels)
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), held_out(C("doc_id")).alias("held_out"), C("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(net), "doc_id long, held_out boolean, score double, predicted int")
