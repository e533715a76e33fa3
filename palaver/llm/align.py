"""Alignment of two tokenizers' tokens over the same bytes.

A batch of documents is one run of bytes: every token has a place there, and
``pandas.merge_asof``, keyed by document, gives for each token start of one
side the token of the other side that covers it.  Both directions together are
all pairs that overlap; places where tokens of both sides end cut the groups.

How often two ids are linked is counted over the corpus.  Documents lie in
blocks of bounded size that hold each distinct pair once, so counts travel per
block and pair, never per link, and go back to the blocks the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.hashing import ranges, utf8
from palaver.llm.shared import stored
from palaver.llm.tokens import Pieces, ids_of

BLOCK_BYTES = 6 << 20  # of text in a block; a longer document is a block of its own
BATCH_BYTES = 1 << 19  # of text that is aligned at a time
CACHE = 200_000  # words whose ids a worker remembers
LONGEST = 40  # characters of the longest word remembered
ID = "<u4"
SPACE = "▁"
# neither tokenizer joins a character other than white space with a blank that a visible character follows;
# a part stands for blank + part, the first one too
CUT = re.compile(rf"(?<=[^\s{SPACE}]) (?=[^\s{SPACE}])")

C = F.col
BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "links binary, pairs array<long>, counts array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Segments:
    """Ids by A and by B of blank + word, as far as a worker remembers them.

    A byte-level tokenizer with all 256 bytes in its vocabulary never changes a
    text; B's ids are None where its bytes differ from the word's.
    """

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_file)
        a.encode_special_tokens = True
        self.pieces, self.model = Pieces(a, ID), sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte_of = {c: b for b, c in self.pieces.letter.items()}
        vocab = json.loads(a.to_str())["model"]["vocab"]
        if not byte_of.keys() <= vocab.keys():
            raise ValueError(f"{a_file} is no complete byte-level vocabulary")
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)  # a piece crosses blanks: texts are not cut
        self.known: dict[str, bytes | None] = {}

    def learn(self, words: list[str]) -> None:
        table = self.b_bytes
        for word, ids in zip(words, self.model.encode(words, num_threads=1), strict=True):
            same = b"".join([table[i] for i in ids]) == b" " + word.encode()
            self.known[word] = array("I", ids).tobytes() if same else None

    def of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the ids of blank + text by A and of text by B; both empty for a text without tokens."""
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.pieces) > 2 * CACHE:
            self.pieces.clear()
            self.pieces.plain.clear()
        parts = [([t] if self.whole else CUT.split(t)) if t else [] for t in texts]
        here = set().union(*parts)
        self.learn(list(here.difference(self.known)))
        out, none = [], np.zeros(0, ID)
        for text, p in zip(texts, parts, strict=True):
            try:
                b = b"".join(map(self.known.__getitem__, p))
            except TypeError:  # None among them
                out.append((none, none))
                continue
            try:
                a = b"".join(map(self.pieces.__getitem__, p))
            except TypeError:  # white space at either end of the text
                a = ids_of(" " + text, self.pieces)
            out.append((np.frombuffer(a, ID), np.frombuffer(b, ID)))
        for x in here:
            if len(x) > LONGEST:
                del self.known[x]
        return out


def _segments(a_file: str, b_file: str) -> Segments:
    """The worker's tokenizers with the segments it remembers from earlier tasks."""
    held = sys.modules.setdefault("_palaver_segments", types.ModuleType("_palaver_segments"))
    if getattr(held, "key", None) != (a_file, b_file):
        held.key, held.segments = (a_file, b_file), Segments(a_file, b_file)
    return held.segments


def _sizes(table: list[bytes]) -> np.ndarray:
    return np.array(list(map(len, table)), np.int64)


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0..n-1, zero bytes after the last, one column more for a separator."""
    return np.array([str(i) for i in range(n)], f"S{len(str(n)) + 1}").view(np.uint8).reshape(n, -1).copy()


def overlaps(doc_a: np.ndarray, at_a: np.ndarray, doc_b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (of A, of B) of all tokens that overlap, given document and first byte of each.

    Every byte of a document belongs to one token of either side, so two tokens
    overlap where one covers the other's start.
    """
    a = pd.DataFrame({"doc": doc_a, "at": at_a, "a": np.arange(len(at_a)), "from_a": at_a})
    b = pd.DataFrame({"doc": doc_b, "at": at_b, "b": np.arange(len(at_b))})
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = pd.merge_asof(a[["doc", "at", "a"]], b, on="at", by="doc")
    two = pd.merge_asof(b, a, on="at", by="doc")
    two = two[(two["from_a"] != two["at"]).to_numpy()]  # equal starts are in the first already
    return np.concatenate([one["a"], two["a"]]).astype(np.int64), np.concatenate([one["b"], two["b"]]).astype(np.int64)


class Aligner:
    """Groups and links of batches of documents."""

    def __init__(self, segments: Segments) -> None:
        self.segments = segments
        self.a_size, self.b_size = _sizes(segments.a_bytes), _sizes(segments.b_bytes)
        self.a_digits, self.b_digits = _digits(len(self.a_size)), _digits(len(self.b_size))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(n_a, n_b, n_groups, n_links per document; hex digests of the groups; id pairs of the links, by document)."""
        docs = len(texts)
        ids = self.segments.of(texts)
        a, b = (np.concatenate([x[k] for x in ids] + [np.zeros(0, ID)]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
        # both sides have the same bytes, so running sums over the batch are places in one run of bytes
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        i, j = overlaps(doc_a, end_a - self.a_size[a], doc_b, end_b - self.b_size[b])
        marks = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 0), bool)
        marks[0, end_a] = marks[1, end_b] = True
        cut_a, cut_b = marks[1, end_a], marks[0, end_b]
        of_a, of_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b  # number of the group
        groups = int(cut_a.sum())
        size_a, size_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        place_a = np.arange(len(a)) + (ends_b - size_b)[of_a]
        place_b = np.arange(len(b)) + ends_a[of_b]
        width = max(self.a_digits.shape[1], self.b_digits.shape[1])
        shown = np.zeros((len(a) + len(b), width + 1), np.uint8)
        shown[place_a, : self.a_digits.shape[1]] = self.a_digits[a]
        shown[place_b, : self.b_digits.shape[1]] = self.b_digits[b]
        shown[place_a, width] = np.where(cut_a, ord("|"), ord(","))
        shown[place_b, width] = np.where(cut_b, ord(";"), ord(","))
        ends = np.cumsum(n_a + n_b)
        texts_of = (shown[x:y].tobytes().translate(None, b"\0")[:-1] for x, y in zip(ends - n_a - n_b, ends, strict=True))
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts_of]
        n_links = np.bincount(doc_a[i], minlength=docs)
        by_doc = np.argsort(doc_a[i], kind="stable")
        pairs = ((a[i] << 32) | b[j])[by_doc]
        return np.stack([n_a, n_b, np.bincount(doc_a[cut_a], minlength=docs), n_links], 1), digests, pairs


def _blocks(a_file: str, b_file: str):
    """Documents to blocks: figures of each, the distinct pairs with counts, links as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, number, size = Aligner(_segments(a_file, b_file)), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        figures: list[np.ndarray] = []
        digests: list[str] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            at, pairs = pd.factorize(np.concatenate(held))  # far fewer pairs than links
            order = np.argsort(pairs)
            place = np.empty(len(pairs), ID)
            place[order] = np.arange(len(pairs))
            pairs, counts = pairs[order], np.bincount(at, minlength=len(pairs))[order]
            links = pa.compress(place[at].tobytes(), codec="zstd", asbytes=True)
            lists = [doc_ids, *np.concatenate(figures).T, digests, links, pairs, counts]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            kinds = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.binary()] + [pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array([(part << 33) + number], pa.int64())] + [pa.array([x], k) for x, k in zip(lists, kinds, strict=True)], names)

        for batch in batches:
            texts, (_, offsets) = batch.column("text"), utf8(batch.column("text"))
            for x, y in ranges(offsets, BATCH_BYTES):
                n, names, pairs = aligner.batch(texts.slice(x, y - x).to_pylist())
                doc_ids += batch.column("doc_id").slice(x, y - x).to_pylist()
                figures.append(n)
                digests += names
                held.append(pairs)
                size += int(offsets[y] - offsets[x])
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, size = number + 1, 0
                    doc_ids, figures, digests, held = [], [], [], []
        if doc_ids:
            yield flush()

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs to one row a document."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        for row in range(len(batch)):

            def column(name: str, row: int = row, batch: pa.RecordBatch = batch) -> pa.Array:
                return batch.column(name)[row].values

            n_links = column("n_links").to_numpy()
            cell, total = batch.column("links")[row].as_py(), int(n_links.sum())
            at = np.frombuffer(pa.decompress(cell, 4 * total, codec="zstd") if total else b"", ID)
            known = batch.column("known")[row].values
            count = known.field("count").to_numpy() if total else np.zeros(0, np.int64)
            best = known.field("best").to_numpy(zero_copy_only=False) if total else np.zeros(0, bool)
            ends = np.cumsum(n_links)
            starts = ends - n_links
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, count)]
            out = [column(x) for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(s[ends] - s[starts], pa.int64()) for s in sums] + [column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(out, names)


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``a_file`` is a byte-level tokenizer of the tokenizers library, given a
    blank before the text; ``b_file`` a sentencepiece model that adds the blank
    itself; every worker can open both.  Special tokens' strings are plain text.

    Defined cases: null and empty texts, and texts that either tokenizer changes
    (joined bytes differ from blank + text), have no tokens: figures 0, digest
    ''.  Equal counts are all best.  Repeated rows and null ids are documents
    each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(a_file, b_file), BLOCKS), "blocks")
    pairs = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("block", C("x.pairs").alias("pair"), C("x.counts").alias("n"))
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", C("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "b").select("pair", "count", (C("count") == C("highest")).alias("best"))
    back = pairs.join(known, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))
    return blocks.drop("pairs", "counts").join(back, "block", "left").mapInArrow(_finish, RESULT)
