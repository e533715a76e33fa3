"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words of a window that a fixed mask shows and ignores the
others, so a substituted word under a hidden position does not break the hit.
The masks below are chosen so that every stretch of 13 words with two
substitutions (12: two, 8 to 11: one) holds at least one seed without a
substitution under a shown position; a test proves it by enumeration.  Items
too short for a seed are found word for word, by a hash of their whole length.

The benchmark is a stated query set: it is scanned against all documents in
blocks of bounded size (a block travels to the tasks, its hits go to the shared
folder, then the next block follows), so no documents are shuffled.  Hits are
grouped by diagonal and verified word by word around the hit.  A run of equal
seeds, as repeated words make it, meets another as one range of diagonals.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.hashing import Words, mix, ranges, utf8
from palaver.llm.shared import scratch

MASKS = ("11001111", "1111011", "1111101", "1011111")
WINDOW = 13  # words that must agree but for WINDOW // 6 substitutions
SHORTEST = 8  # words of the shortest item that holds a seed; shorter ones match word for word
HITS = 1 << 20  # diagonals that are looked at together
BLOCK_BYTES = 16 << 20  # of benchmark text in one block

LEAK = "doc_id long, item_id long, doc_start long, n_words long, n_equal long, coverage double"


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each run of equal values; of a second column, values that follow each other."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    for k, x in enumerate(columns):
        step = x[1:] != x[:-1] + (1 if k == 1 else 0)
        new[1:] = step if k == 0 else new[1:] | step
    at = np.flatnonzero(new)
    return at, np.diff(at, append=n)


def tolerance(words: int) -> int:
    """Substitutions that a stretch of so many words may have."""
    return words // 6


class Seeds:
    """Hashes of the seeds of one block of items, searched by vectors of hashes."""

    def __init__(self, texts: pa.Array, ids: list[int | None]) -> None:
        data, offsets = utf8(texts)
        words = Words()
        parts = [words.of(data, offsets[a : b + 1]) for a, b in ranges(offsets)]
        self.items = [h[x:y] for h, first in parts for x, y in zip(first[:-1], first[1:], strict=True)]
        self.ids = ids
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]
        self.factors = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
        found = [np.zeros((4, 0), np.uint64)]
        for i, item in enumerate(self.items):
            if len(item) >= SHORTEST:
                for k, mask in enumerate(self.masks):
                    h = self.hashes(item, mask, k)
                    at, run = runs(h)
                    found.append(np.stack([h[at], np.full(len(at), i, np.uint64), at.astype(np.uint64), run.astype(np.uint64)]))
        seeds = np.concatenate(found, axis=1)
        seeds = seeds[:, np.argsort(seeds[0], kind="stable")]
        self.seed, (self.item, self.at, self.run) = seeds[0], seeds[1:].astype(np.int64)
        self.runs = np.concatenate([[0], np.cumsum(self.run)])
        self.bits = max(20, int(np.ceil(np.log2(16 * len(self.seed) + 1))))
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.seed >> np.uint64(64 - self.bits)] = True
        # (words, hashes in order, their items) of the short items of each length
        self.short = []
        for n in sorted({len(item) for item in self.items if 0 < len(item) < SHORTEST}):
            own = np.array([i for i, item in enumerate(self.items) if len(item) == n])
            h = np.array([self.hashes(self.items[i], np.arange(n), len(MASKS) + n)[0] for i in own])
            order = np.argsort(h, kind="stable")
            self.short.append((n, h[order], own[order]))

    def hashes(self, words: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
        n = max(len(words) - int(mask[-1]), 0)
        total = np.full(n, k + 1, dtype=np.uint64)
        for j in mask:
            total += words[j : j + n] * self.factors[j]
        return mix(total)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """(text, item, word of the text where the item would begin), distinct within each of the arrays."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for k, mask in enumerate(self.masks):
            h = self.hashes(words, mask, k)
            hit = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
            hit = hit[text[hit] == text[hit + mask[-1]]]  # a window stays within its text
            at, run = runs(h[hit], hit, text[hit])
            hit = hit[at]
            low = np.searchsorted(self.seed, h[hit], side="left")
            found.append(np.stack([hit, run, low, np.searchsorted(self.seed, h[hit], side="right") - low]))
        hit, run, low, many = np.concatenate(found, axis=1)
        # a run of s seeds meets one of r in r + s - 1 diagonals
        weight = self.runs[low + many] - self.runs[low] + many * (run - 1)
        block = np.cumsum(weight) // HITS
        for own in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(block)) + 1):
            n = many[own]
            q, s = np.repeat(hit[own], n), np.repeat(run[own], n)
            with_ = np.repeat(low[own] - np.cumsum(n) + n, n) + np.arange(len(q))
            r = self.run[with_]
            start, count = q - first[text[q]] - self.at[with_] - r + 1, r + s - 1
            start = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            t, item = np.repeat(text[q], count), np.repeat(self.item[with_], count)
            order = np.lexsort((start, item, t))
            rows = np.stack([t, item, start], axis=1)[order]
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            yield rows[fresh]

    def word_for_word(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first place, words) of the short items that a text holds."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, seeds, items in self.short:
            h = self.hashes(words, np.arange(n), len(MASKS) + n)
            low = np.searchsorted(seeds, h, side="left")
            hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == h)
            hit = hit[text[hit] == text[hit + n - 1]]
            hit = hit[np.lexsort((hit, low[hit], text[hit]))]
            fresh = np.ones(len(hit), dtype=bool)
            fresh[1:] = (text[hit[1:]] != text[hit[:-1]]) | (low[hit[1:]] != low[hit[:-1]])
            for q in hit[fresh]:
                for i in items[low[q] : np.searchsorted(seeds, h[q], side="right")]:
                    if np.array_equal(words[q : q + n], self.items[i]):
                        yield int(text[q]), int(i), int(q - first[text[q]]), n

    def leaks(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) -> (words that agree, -start, words of the stretch) of the best verified overlap."""
        best = {(t, i): (n, -start, n) for t, i, start, n in self.word_for_word(words, first)}
        for t, i, start in itertools.chain.from_iterable(map(np.ndarray.tolist, self.candidates(words, first))):
            item, doc = self.items[i], words[first[t] : first[t + 1]]
            low, high = max(0, -start), min(len(item), len(doc) - start)
            n = min(WINDOW, len(item))
            if high - low < n:
                continue
            same = doc[low + start : high + start] == item[low:high]
            sums = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(sums[n:] - sums[:-n] >= n - tolerance(n))
            if len(good):
                a, b = int(good[0]), int(good[-1]) + n
                found = (int(sums[b] - sums[a]), -int(low + start + a), b - a)
                best[t, i] = max(best.get((t, i), (-1, 0, 0)), found)
        return best


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """The items in blocks of about BLOCK_BYTES, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    for i in range(n):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").toArrow()
        if table.num_rows:
            yield Seeds(table.column("text").combine_chunks(), table.column("item_id").to_pylist())


def _find(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in ranges(offsets):
                rows = sorted(seeds.leaks(*words.of(data, offsets[a : b + 1])).items())
                if rows:
                    ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                    out = [(ids[t], seeds.ids[i], -start, n, same, same / len(seeds.items[i])) for (t, i), (same, start, n) in rows]
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                        ["doc_id", "item_id", "doc_start", "n_words", "n_equal", "coverage"],
                    )

    return run


def _drop(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keep = np.ones(len(batch), dtype=bool)
            for a, b in ranges(offsets):
                for t, _ in seeds.leaks(*words.of(data, offsets[a : b + 1])):
                    keep[a + t] = False
            yield batch.filter(pa.array(keep))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: where, how many words, how many agree.

    An overlap is a stretch of WINDOW words (the whole item, if shorter) in
    which all words but ``tolerance`` agree in order, A-Z lower-cased; the row
    reports the stretch between the first and the last such window of the best
    diagonal: the one with most equal words, then the earliest.  Clean documents
    have no row.

    Defined cases: null and empty texts match nothing; items of fewer than
    SHORTEST words match where all their words stand in order, and the first
    such place is reported; equal rows of either table are reported each;
    null ids are carried; an empty table on either side gives no rows; other
    columns are ignored.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "leaks")
    spark.createDataFrame([], LEAK).write.parquet(path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for seeds in _blocks(benchmark):
        texts.mapInArrow(_find(seeds), LEAK).write.mode("append").parquet(path)
    return spark.read.schema(LEAK).parquet(path)


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap with any item, all columns as they are.

    Defined cases: as in ``find_leaks``; null and empty texts and rows without an
    id stay if their own text shares nothing; an empty benchmark keeps all rows.
    """
    path = None
    for seeds in _blocks(benchmark):
        if path:  # one block is held at a time
            docs.write.parquet(path)
            docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
        docs = docs.mapInArrow(_drop(seeds), docs.schema)
        path = scratch(docs.sparkSession, "clean")
    return docs
