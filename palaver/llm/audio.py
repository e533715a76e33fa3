"""Chroma fingerprints of audio columns, and alignment of recordings by them.

A recording is cut into overlapping frames; the spectrum of a frame is folded
into twelve pitch classes.  Over the image (frames x pitch classes) sixteen
filters compare two rectangles each, whose sums come from an integral image; a
filter's log ratio is quantised to two bits in Gray code, and the sixteen codes
of a frame are packed into one 32-bit integer.

Two recordings align at an offset that equal integers vote for; the alignment
counts if the overlap holds a stretch with enough votes in which few of the
packed bits differ, whatever surrounds it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import scratch, stored

FRAME_SECONDS, HOPS = 0.125, 2  # length of a frame; a new one begins HOPS times in it
CLASSES = 12
WIDTH = 8  # frames that a filter looks at
EDGES = (-0.35, 0.0, 0.35)  # log ratios that part the two-bit codes
GRAY = (0, 1, 3, 2)
MIN_VOTES = 8  # equal integers that an offset needs
MIN_FRAMES = 24  # stretch of an alignment
MAX_ERROR = 0.15  # share of differing bits
TRIED_FRAMES = 2_000_000  # of overlaps compared at a time
BLOCK_INTS = 2_000_000  # of the query recordings that travel to the tasks at a time

C, L = F.col, F.lit


def filters() -> list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """Pairs of rectangles (first frame, end frame, first class, end class), by a rule.

    Filter i halves a band of 2 + 2 (i mod 4) classes that starts at class
    3 (i div 4) mod 8, in turn by class, by time, and by time in its upper half.
    """
    out = []
    for i in range(16):
        height = 2 + 2 * (i % 4)
        y = min(3 * (i // 4) % 8, CLASSES - height)
        if i % 3 == 0:
            out.append(((0, WIDTH, y, y + height // 2), (0, WIDTH, y + height // 2, y + height)))
        elif i % 3 == 1:
            out.append(((0, WIDTH // 2, y, y + height), (WIDTH // 2, WIDTH, y, y + height)))
        else:
            top = y + height // 2
            out.append(((0, WIDTH // 4, top, y + height), (WIDTH // 4, WIDTH // 2, top, y + height)))
    return out


def wave(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of unsigned 8-bit samples, one channel."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples.astype(np.uint8).tobytes()


def samples_of(media: bytes | None) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate) of a PCM WAV file of 8 or 16 bits; channels are averaged; anything else is empty."""
    nothing = np.zeros(0, np.float32), 1
    if media is None or len(media) < 44 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return nothing
    at, form = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and size >= 16 and at + 24 <= len(media):
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data" and form:
            code, channels, rate, _, _, bits = form
            if code != 1 or bits not in (8, 16) or not channels or not rate:
                return nothing
            step = channels * bits // 8
            body = media[at + 8 : at + 8 + size]
            body = body[: len(body) // step * step]
            raw = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128 if bits == 8 else np.frombuffer(body, "<i2").astype(np.float32) / 32768
            return raw.reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + size % 2
    return nothing


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x pitch classes, each frame scaled to a sum of one."""
    size = max(16, int(rate * FRAME_SECONDS))
    hop = size // HOPS
    n = max(0, (len(samples) - size) // hop + 1)
    pitch = np.arange(1, size // 2 + 1) * rate / size
    keep = (pitch >= 100) & (pitch <= 4000)
    fold = np.zeros((size // 2 + 1, CLASSES), np.float32)
    fold[1:][keep, np.round(12 * np.log2(pitch[keep] / 440)).astype(int) % CLASSES] = 1
    window = np.hanning(size).astype(np.float32)
    out = np.zeros((n, CLASSES), np.float32)
    for a in range(0, n, 4096):
        b = min(n, a + 4096)
        frames = np.lib.stride_tricks.sliding_window_view(samples[a * hop : (b - 1) * hop + size], size)[::hop]
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        out[a:b] = power.astype(np.float32) @ fold
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-6), 0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each frame from which WIDTH frames follow."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, CLASSES + 1))
    integral[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(r: tuple[int, int, int, int]) -> np.ndarray:
        a, b, low, high = r
        return integral[b : b + n, high] - integral[a : a + n, high] - integral[b : b + n, low] + integral[a : a + n, low]

    gray, out = np.array(GRAY, np.uint32), np.zeros(n, np.uint32)
    for x, y in filters():
        ratio = np.log((area(x) + 1) / (area(y) + 1))
        out = (out << np.uint32(2)) | gray[np.searchsorted(EDGES, ratio)]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ints = fingerprint(chroma(*samples_of(batch.column("media")[i].as_py()))).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rec_id").slice(i, 1), pa.array([len(ints) // 4], pa.int64()), pa.array([hashlib.blake2b(ints, digest_size=16).digest()], pa.binary()), pa.array([ints], pa.binary())],
                ["rec_id", "frames", "key", "ints"],
            )


def _changes(ints: np.ndarray) -> np.ndarray:
    """Where runs of equal integers begin: a held tone or silence votes once."""
    return np.flatnonzero(np.diff(ints.astype(np.int64), prepend=-1))


def _stretches(differ: np.ndarray, voted: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(overlap, first frame, end frame) of the best stretch of each overlap that has one.

    ``differ`` and ``voted`` hold the differing bits and the votes of the frames
    of all overlaps one after another, ``starts`` where each begins.  A stretch
    has MIN_FRAMES frames and MIN_VOTES votes at least and a bit error of
    MAX_ERROR at most; the one most bits below that error is the best.
    """
    n = len(differ)
    overlap = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    gain = np.concatenate([[0], np.cumsum(round(3200 * MAX_ERROR) - 100 * differ.astype(np.int64))])
    # the lowest sum from the start of the overlap on, and where it first occurs
    fall = np.int64(gain.max() - gain.min() + 1)
    sums = gain[:-1] - fall * overlap
    lowest = np.minimum.accumulate(sums)
    fresh = np.ones(n, bool)
    fresh[1:] = lowest[1:] < lowest[:-1]
    lowest_at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    # a stretch that ends before frame ``end`` begins at ``latest`` at the latest
    end = np.arange(1, n + 1)
    votes, vote_at = np.cumsum(voted), np.flatnonzero(voted)
    latest = np.where(votes >= MIN_VOTES, vote_at[np.maximum(votes - MIN_VOTES, 0)] if len(vote_at) else -1, -1)
    latest = np.minimum(latest, end - MIN_FRAMES)
    fits = np.flatnonzero(latest >= starts[overlap])
    first = lowest_at[latest[fits]]
    value = gain[end[fits]] - gain[first]
    first, end, value, own = (x[value >= 0] for x in (first, end[fits], value, overlap[fits]))
    order = np.lexsort((end, -value, own))
    best = order[np.diff(own[order], prepend=-1) != 0]
    return own[best], first[best], end[best]


class Block:
    """Fingerprints of some query recordings, searched by integer."""

    def __init__(self, ids: list[int], cells: list[bytes]) -> None:
        self.ids, prints = ids, [np.frombuffer(c, "<u4") for c in cells]
        self.prints, self.length = np.concatenate(prints), np.array([len(x) for x in prints])
        self.begin = np.cumsum(self.length) - self.length
        at = [_changes(x) for x in prints]
        ints = np.concatenate([x[p] for x, p in zip(prints, at, strict=True)])
        order = np.argsort(ints, kind="stable")
        self.ints = ints[order]
        self.owner = np.repeat(np.arange(len(ids)), [len(p) for p in at])[order]
        self.where = np.concatenate(at)[order]

    def aligned(self, ints: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(query id, offset in it, first frame in it, frames, votes, bit error) of the best stretch of each query that aligns."""
        at = _changes(ints)
        low = np.searchsorted(self.ints, ints[at], side="left")
        many = np.searchsorted(self.ints, ints[at], side="right") - low
        rows = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        span = 1 << 32
        where = self.where[rows]
        key, which, votes = np.unique(self.owner[rows] * span + where - np.repeat(at, many) + span // 2, return_inverse=True, return_counts=True)
        owner, offset = key // span, key % span - span // 2
        first = np.maximum(0, offset)
        size = np.minimum(self.length[owner], len(ints) + offset) - first
        tried = np.flatnonzero((votes >= MIN_VOTES) & (size >= MIN_FRAMES))
        if not len(tried):
            return
        order = np.argsort(which, kind="stable")
        hits, hit_ends = where[order], np.cumsum(votes)
        found = []
        block = (np.cumsum(size[tried]) - 1) // TRIED_FRAMES
        for own in np.split(tried, np.flatnonzero(np.diff(block)) + 1):
            n, starts = size[own], np.cumsum(size[own]) - size[own]
            frame = np.arange(int(n.sum())) + np.repeat(first[own] - starts, n)
            differ = np.bitwise_count(self.prints[frame + np.repeat(self.begin[owner[own]], n)] ^ ints[frame - np.repeat(offset[own], n)])
            voted = np.zeros(len(frame), bool)
            k = votes[own]
            mine = np.arange(int(k.sum())) + np.repeat(hit_ends[own] - np.cumsum(k), k)
            voted[hits[mine] + np.repeat(starts - first[own], k)] = True
            for i, a, b in zip(*_stretches(differ, voted, starts), strict=True):
                error = float(differ[a:b].sum(dtype=np.int64)) / (32 * int(b - a))
                found.append((int(owner[own[i]]), -int(voted[a:b].sum()), int(offset[own[i]]), int(frame[a]), int(b - a), error))
        best = -1
        for query, votes_, move, begin, frames, error in sorted(found):
            if query != best:
                best = query
                yield self.ids[query], move, begin, frames, -votes_, error


MATCH = "kind string, rec_id long, class_id long, offset long, begin long, frames long, votes long, bit_error double"


def _search(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rec_id, cell in zip(batch.column("rec_id").to_pylist(), batch.column("ints"), strict=True):
                ints = np.frombuffer(cell.as_buffer(), "<u4")
                rows += [("match", query, rec_id, *found) for query, *found in block.aligned(ints) if query != rec_id] if len(ints) else []
            if rows:
                kinds = [pa.string(), *[pa.int64()] * 6, pa.float64()]
                names = [f.split()[0] for f in MATCH.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def align(recordings: DataFrame, every: int = 50) -> DataFrame:
    """Search the recordings whose id is divisible by ``every`` among all (rec_id, media).

    Recordings with the same fingerprint form a class, named by its smallest
    rec_id.  Rows of kind ``member`` give the class of each recording and its
    frames; rows of kind ``match`` give, for the class of a query (rec_id), each
    other class (class_id) that aligns with it: the offset in frames at which it
    begins in the query, the best stretch of their overlap, by its first frame in
    the query (begin), its frames and its votes, and the share of bits that
    differ in it.  Every offset with MIN_VOTES votes is tried; of several that
    align the one with most votes in its stretch counts, then the smallest.

    The queries are a stated set; they are scanned in blocks of BLOCK_INTS
    integers, whose hits go to the shared folder.

    Defined cases: null media and what is no PCM WAV file have no frames and
    match nothing; a null rec_id is a member without a class of its own and is
    no query; equal rows are members each; an empty table gives no rows; other
    columns are ignored.
    """
    spark = recordings.sparkSession
    rows = recordings.select(C("rec_id").cast("long").alias("rec_id"), C("media").cast("binary").alias("media"))
    prints = stored(rows.mapInArrow(_fingerprints, "rec_id long, frames long, key binary, ints binary"), "prints")
    classes = stored(prints.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.max(C("rec_id") % every == 0).alias("query")), "classes")
    reps = prints.join(classes.where("query").select("key", C("class_id").alias("rec_id")), ["key", "rec_id"], "left_semi").dropDuplicates(["rec_id"])
    all_reps = prints.join(classes.select("key", C("class_id").alias("rec_id")), ["key", "rec_id"], "left_semi").dropDuplicates(["rec_id"])
    asked = stored(reps.where("frames > 0").select("rec_id", "frames", "ints"), "queries")
    others = stored(all_reps.where("frames > 0").select("rec_id", "ints"), "reps")
    path = scratch(spark, "matches")
    spark.createDataFrame([], MATCH).write.parquet(path)
    blocks = int((asked.agg(F.sum("frames")).first()[0] or 0) // BLOCK_INTS) + 1
    for i in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("rec_id"), L(blocks)) == i).orderBy("rec_id").toArrow()
        if table.num_rows:
            block = Block(table.column("rec_id").to_pylist(), table.column("ints").to_pylist())
            others.mapInArrow(_search(block), MATCH).write.mode("append").parquet(path)
    members = prints.join(classes, "key").select(
        L("member").alias("kind"), "rec_id", "class_id", L(None).cast("long").alias("offset"), L(None).cast("long").alias("begin"), "frames", L(None).cast("long").alias("votes"), L(None).cast("double").alias("bit_error")
    )
    return members.unionByName(spark.read.schema(MATCH).parquet(path))


# -- recordings made of texts, for tables without audio ---------------------------

RATE = 2048


def _notes() -> np.ndarray:
    """Two octaves of notes from 220 Hz, half a frame each."""
    n = int(RATE * FRAME_SECONDS) // HOPS
    t = np.arange(n) / RATE
    return np.stack([np.round(128 + 100 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) * np.hanning(n) ** 0.25) for k in range(24)]).astype(np.uint8)


def _sung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    notes = _notes()
    for batch in batches:
        for i in range(len(batch)):
            words = (batch.column("text")[i].as_py() or "").encode().split()
            tune = notes[[zlib.crc32(w) % 24 for w in words]].reshape(-1) if words else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rec_id").slice(i, 1), pa.array([wave(tune, RATE)], pa.binary())], ["rec_id", "media"])


def sung(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(rec_id, media): each conversation as a WAV file, one note a word, turns in order."""
    texts = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", L("")).alias("text")))).alias("t"))
    return texts.select(C("conv_id").alias("rec_id"), F.array_join(F.transform("t", lambda x: x.text), " ").alias("text")).mapInArrow(_sung, "rec_id long, media binary")
