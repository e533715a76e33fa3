"""Token ids as canonical Huffman files.

``write`` tokenises documents in ascending doc_id order and stores a folder of
two Parquet tables: ``codes`` (id, length), the canonical code of the whole
corpus, and ``segments``, each a run of documents with its bit stream.  A bit
stream is cut into blocks of BLOCK ids; the checkpoints are the bit offsets at
which blocks begin, so every block decodes on its own, and all blocks of a
segment are decoded side by side by table look-up.  ``read`` gives the ids back.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import parts, scratch, stored

MAX_BITS = 18  # length limit of a code; the decoding table has 2**MAX_BITS entries
BLOCK = 1024  # ids between two checkpoints
SEGMENT = 1 << 19  # ids after which a segment ends (it ends with a document)
CACHE = 1_200_000  # pieces of text whose ids a worker remembers: about 200 bytes each
LONGEST = 48  # characters of the longest piece remembered
END_ID = 0
# these never join a preceding letter or digit in one token; | and > end special tokens
TAIL = "!\"#$%&'()*+,-./:;<=?@[\\]^_`{}~"

C = F.col
SEGMENTS = "part int, seg int, start long, doc_ids array<long>, lengths array<long>, payload binary"


# -- tokenising ----------------------------------------------------------------


class Pieces(dict):
    """Ids of " " + piece as bytes, or None where the piece has white space at an edge.

    The byte-level pre-tokeniser never joins a character other than white space
    with white space that follows, nor a letter or digit with punctuation that
    follows.  Between such characters a text may be cut without changing its
    ids, so most words are looked up; those not yet seen that are all letters
    are one token of the pre-tokeniser and go straight to the merges.
    """

    def __init__(self, tokenizer, dtype: str) -> None:
        self.tokenizer, self.dtype, self.plain = tokenizer, dtype, {}
        self.merges, self.kind = tokenizer.model.tokenize, np.dtype(dtype).char
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letter = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def word(self, before: str, word: str) -> bytes:
        """Ids of a piece that need not be cut further."""
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            shown = word if word.isascii() else "".join(map(self.letter.__getitem__, word.encode()))
            head = self.letter[32] if before else ""
            return array(self.kind, [t.id for t in self.merges(head + shown)]).tobytes()
        return self.encode(before + word)

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) > CACHE:
            self.clear()
        if piece.isalpha():
            found = self.word(" ", piece)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            found = None
        else:
            found = self.cut(piece, " ")
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def cut(self, piece: str, before: str) -> bytes:
        left, line, right = piece.rpartition("\n")
        if left and right and not left[-1].isspace() and not right[0].isspace():
            return (self[left] if before else self.bare(left)) + self.bare("\n") + self.bare(right)
        core = piece.rstrip(TAIL)
        if core and len(core) < len(piece) and core[-1].isalnum():
            return (self[core] if before else self.bare(core)) + self.bare(piece[len(core) :])
        return self.word(before, piece)

    def bare(self, piece: str) -> bytes:
        """Ids of a piece as it stands."""
        found = self.plain.get(piece)
        if found is None:
            if len(self.plain) > CACHE // 4:
                self.plain.clear()
            found = self.cut(piece, "")
            if len(piece) <= LONGEST:
                self.plain[piece] = found
        return found


class Whole:
    """Any other tokenizer: whole texts, nothing remembered."""

    def __init__(self, tokenizer, dtype: str) -> None:
        self.tokenizer, self.dtype = tokenizer, dtype

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


CUT = re.compile(r"(?<=\S)(?= \S)")


def ids_of(text: str, pieces: Pieces | Whole) -> bytes:
    """Ids of a whole text, as little-endian numbers."""
    if isinstance(pieces, Whole):
        return pieces.ids(text)
    words = text.split(" ")
    head = words[0]
    try:
        if not head or head[-1].isspace():
            raise TypeError
        return pieces.bare(head) + b"".join(map(pieces.__getitem__, words[1:]))
    except TypeError:  # white space next to white space: cut where it is safe
        return b"".join(pieces.bare(x) if x[:1] != " " else pieces[x[1:]] or pieces.encode(x) for x in CUT.split(text) if x)


def _pieces(path: str, dtype: str) -> Pieces | Whole:
    """The worker's tokenizer with the pieces it remembers from earlier tasks."""
    held = sys.modules.setdefault("_palaver_pieces", types.ModuleType("_palaver_pieces"))
    if getattr(held, "key", None) != (path, dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        form = json.loads(tokenizer.to_str())
        first, model = form["pre_tokenizer"] or {}, form["model"]
        known = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        special = [t for t in form["added_tokens"] if re.search(r"\s", t["content"]) or t["content"][-1] in TAIL or t["content"][-1].isalnum() or t["lstrip"] or t["rstrip"]]
        known = known and model["type"] == "BPE" and not form["normalizer"] and not special
        held.key, held.pieces = (path, dtype), (Pieces if known else Whole)(tokenizer, dtype)
    return held.pieces


def _encode(path: str, dtype: str, end_id: int):
    """Sorted documents to runs of ids: (part, seg, before, n, doc_ids, lengths, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seg, before = _pieces(path, dtype), TaskContext.get().partitionId(), 0, 0
        end, width = np.array([end_id], dtype=dtype).tobytes(), np.dtype(dtype).itemsize
        docs: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        n = 0

        def flush() -> pa.RecordBatch:
            row = [[part], [seg], [before], [n], [docs], [lengths], [b"".join(held)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "seg", "before", "n", "doc_ids", "lengths", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py() or "", pieces) + end
                docs.append(doc_id)
                lengths.append(len(ids) // width)
                held.append(ids)
                n += lengths[-1]
                if n >= SEGMENT:
                    yield flush()
                    seg, before = seg + 1, before + n
                    docs, lengths, held, n = [], [], [], 0
        if docs:
            yield flush()

    return run


def _histogram(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column("ids"):
                counts = np.bincount(np.frombuffer(cell.as_buffer(), dtype=dtype))
                if len(counts) > len(total):
                    total = np.pad(total, (0, len(counts) - len(total)))
                total[: len(counts)] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "count"])

    return run


# -- the code --------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code above ``limit`` bits (package-merge)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n <= 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels, merged = [], weights
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        k = int(single[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol), each one more than the last, shifted to its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    sizes = lengths[order]
    top = int(sizes[-1]) if len(sizes) else 0
    step = np.int64(1) << (top - sizes)
    codes = np.empty(len(lengths), np.int64)
    codes[order] = (np.cumsum(step) - step) >> (top - sizes)
    return codes


def pack(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of each block, big-endian bit stream)."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = int(ends[-1]) if len(ends) else 0
    word = starts >> 5
    shifted = codes.astype(np.uint64) << (64 - (starts & 31) - lengths).astype(np.uint64)
    out = np.zeros(total // 32 + 3, np.uint64)
    if len(codes):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        at = word[first]
        out[at] += np.add.reduceat(shifted >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return starts[::BLOCK], out.astype(">u4").tobytes()[: (total + 7) // 8]


def unpack(stream: bytes, checkpoints: np.ndarray, n: int, symbols: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Decode all blocks side by side; ``symbols`` and ``sizes`` are indexed by the next ``bits`` bits."""
    data = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    blocks = len(checkpoints)
    out = np.zeros((BLOCK, blocks), np.uint32)
    at, last = checkpoints.astype(np.int64), n - (blocks - 1) * BLOCK
    for i in range(min(BLOCK, n)):
        if i == last:  # the last block is shorter
            at = at[:-1]
        peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[i, : len(at)] = symbols[peek]
        at = at + sizes[peek]
    return out.T.reshape(-1)[:n]


def _table(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The decoding table: (id, length) by the next bits of the stream."""
    bits = int(lengths.max())
    order = np.lexsort((np.arange(len(ids)), lengths))
    repeat = np.int64(1) << (bits - lengths[order])
    pad = (1 << bits) - int(repeat.sum())
    return (
        np.pad(np.repeat(ids[order].astype(np.uint32), repeat), (0, pad)),
        np.pad(np.repeat(lengths[order], repeat), (0, pad), constant_values=1),
        bits,
    )


def _compress(ids: np.ndarray, lengths: np.ndarray, starts: dict[int, int], dtype: str):
    top = int(ids.max(initial=0)) + 1
    code_of, size_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
    code_of[ids], size_of[ids] = canonical(lengths), lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                x = np.frombuffer(batch.column("ids")[row].as_buffer(), dtype=dtype)
                checkpoints, stream = pack(code_of[x], size_of[x])
                payload = np.array([BLOCK, len(x), len(checkpoints)], "<i8").tobytes() + checkpoints.astype("<i8").tobytes() + stream
                part = batch.column("part")[row].as_py()
                one = batch.slice(row, 1)
                start = starts[part] + batch.column("before")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [one.column("part"), one.column("seg"), pa.array([start], pa.int64()), one.column("doc_ids"), one.column("lengths"), pa.array([payload], pa.binary())],
                    ["part", "seg", "start", "doc_ids", "lengths", "payload"],
                )

    return run


def _vocabulary(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a stored code: at most 2**MAX_BITS rows."""
    table = codes.orderBy("id").toArrow()
    return table.column("id").to_numpy(), table.column("length").to_numpy()


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, dtype: str = "<u4") -> None:
    """Tokenise ``docs`` (doc_id, text) and store the folder described above.

    ``tokenizer`` is a file of the tokenizers library that every worker can
    open; ``dtype`` holds its ids ("<u2" below 65 536).  Documents lie in
    ascending doc_id order, null first, equal ids by text.
    """
    spark = docs.sparkSession
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, seg int, before long, n long, doc_ids array<long>, lengths array<long>, ids binary"
    path = scratch(spark, "ids")
    ordered.mapInArrow(_encode(tokenizer, dtype, end_id), schema).write.option("compression", "zstd").parquet(path)
    ids = spark.read.schema(schema).parquet(path)
    counts = ids.select("ids").mapInArrow(_histogram(dtype), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).orderBy("id").toArrow()
    symbols, lengths = counts.column("id").to_numpy(), code_lengths(counts.column("count").to_numpy())
    code = pa.table({"id": pa.array(symbols, pa.int64()), "length": pa.array(lengths, pa.int64())})
    spark.createDataFrame(code, "id long, length long").coalesce(1).write.parquet(f"{folder}/codes")
    starts, at = {}, 0
    for r in ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        starts[r["part"]], at = at, at + r["n"]
    ids.mapInArrow(_compress(symbols, lengths, starts, dtype), SEGMENTS).write.parquet(f"{folder}/segments")


def _decode(ids: np.ndarray, lengths: np.ndarray, each: Callable[[np.ndarray], dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ids, lengths) if len(ids) else None
        for batch in batches:
            for row in range(len(batch)):
                cell = batch.column("payload")[row].as_py()
                _, n, blocks = np.frombuffer(cell, "<i8", 3)
                checkpoints = np.frombuffer(cell, "<i8", blocks, 24)
                values = unpack(cell[24 + 8 * int(blocks) :], checkpoints, int(n), *table)
                docs, sizes = (batch.column(x)[row].values for x in ("doc_ids", "lengths"))
                ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
                starts = ends - sizes.to_numpy(zero_copy_only=False)
                first = batch.column("start")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(starts + first, pa.int64()), sizes, *each([values[a:b] for a, b in zip(starts, ends, strict=True)])],
                    ["doc_id", "start", "n_tokens", "value"],
                )

    return run


def _crc(runs: list[np.ndarray]) -> list[pa.Array]:
    import zlib

    return [pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in runs], pa.int64())]


def _lists(runs: list[np.ndarray]) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, runs)])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(runs).astype(np.int64)))]


def read(spark: SparkSession, folder: str, *, checksum: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder; with ``checksum`` ids_crc32 in place of the ids."""
    vocabulary = _vocabulary(spark.read.parquet(f"{folder}/codes"))
    kind, name = ("long", "ids_crc32") if checksum else ("array<long>", "ids")
    rows = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    out = rows.mapInArrow(_decode(*vocabulary, _crc if checksum else _lists), f"doc_id long, start long, n_tokens long, value {kind}")
    return out.withColumnRenamed("value", name)


def tokenised(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, dtype: str = "<u4") -> DataFrame:
    """Write ``docs`` into a fresh folder and read back doc_id, start, n_tokens, ids_crc32.

    Defined cases: a null text is an empty one and gives the end id alone; equal
    rows are encoded each; null ids come first; an empty table gives no rows;
    other columns are ignored.
    """
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer, end_id=end_id, dtype=dtype)
    return read(docs.sparkSession, folder, checksum=True)
