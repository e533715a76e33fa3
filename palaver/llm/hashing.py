"""Vectorised hashing of words and byte strings inside Spark tasks.

Texts are read straight from Arrow buffers.  A string of bytes b_0..b_m hashes
to the polynomial sum T[b_i] * M**i modulo 2**64 (T: a table of odd random
numbers, M odd), taken from running sums, then mixed.  Everything is numpy over
pieces of bounded size, so memory does not grow with the length of a text
beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes that are hashed at a time
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix generator, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(lower: bool) -> np.ndarray:
    """Random odd numbers per byte; with ``lower``, A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER)) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


class Powers:
    """Powers of the multiplier and of its inverse, up to the length asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, PIECE + 256)
            self.up, self.down = (np.full(n, m, dtype=np.uint64) for m in (MULTIPLIER, INVERSE))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down


def is_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(SPACES)] = True
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ranges(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts together stay below ``limit`` bytes, at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


class Words:
    """Hashes of the words (runs of bytes other than white space) of texts."""

    def __init__(self, lower: bool = True) -> None:
        self.table, self.space, self.powers = byte_table(lower), is_space(), Powers()

    def _piece(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the words; a word ends at white space and at ``breaks``."""
        word = ~self.space[data]
        if not len(data) or not word.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        end = word.copy()
        end[:-1] &= ~word[1:]
        cut = breaks[(breaks > 0) & (breaks < len(data))]
        begin[cut] |= word[cut]
        end[cut - 1] |= word[cut - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = self.powers.to(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, index of each text's first word and the end)."""
        if len(offsets) == 2 and offsets[1] - offsets[0] > PIECE:  # one long text, piece by piece
            parts, at, stop = [], int(offsets[0]), int(offsets[1])
            while at < stop:
                to = min(at + PIECE, stop)
                if to < stop:  # end at the last white space, or else at the next
                    gap = np.flatnonzero(self.space[data[at + 1 : to + 1]])
                    if len(gap):
                        to = at + 1 + int(gap[-1])
                    while not len(gap) and to < stop:
                        gap = np.flatnonzero(self.space[data[to : to + PIECE]])
                        to = to + int(gap[0]) if len(gap) else min(to + PIECE, stop)
                parts.append(self._piece(data[at:to], np.zeros(0, np.int64))[0])
                at = to
            hashes = np.concatenate(parts)
            return hashes, np.array([0, len(hashes)])
        low = offsets[0]
        hashes, starts = self._piece(data[low : offsets[-1]], offsets - low)
        return hashes, np.searchsorted(starts, offsets - low)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as signed numbers.

    A text with fewer words than ``size`` has its whole sequence as its one
    shingle; a text without words has none.
    """
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(len(hashes) - size + 1, 0)
    sums = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        sums += hashes[j : j + n] * factors[j]
    sums = mix(sums).view(np.int64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(sums[a : b - size + 1])
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(mix(np.array([short]))).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    """An array<long> column."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))
