"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source is cut into shards of bounded size, each shard's documents are laid
out in a seeded order, and that line of words into blocks of a power of two
words, a thousandth of the shard at most, down to one word.  All blocks of one
size are given to their shards by the highest quotients target / (2 k + 1), so
each shard has an integer quota; a shard whose quota exceeds its blocks repeats
them.
Which blocks of a shard make up a partial pass is decided by a seeded
permutation that each document evaluates for its own blocks, so blocks are never
listed, ranked or shuffled.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.shared import stored
from palaver.plans.scale import checked_broadcast

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # times that a word may be taken
SHARD_WORDS = 8_000_000  # the driver sees one row a shard
LARGEST_BLOCK = 1024  # words
BLOCKS = 1000  # of a shard at least, unless it has fewer words
SEED = 20_240_229

C = F.col


def words(text: Column) -> Column:
    """Number of runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); equal quotients go to the earlier entry."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    out = [int(v * seats / total + 0.5) for v in votes]
    missing = seats - sum(out)
    if missing > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if v]
        heapq.heapify(heap)
        for _ in range(missing):
            i = heap[0][1]
            out[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif missing < 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if s]
        heapq.heapify(heap)
        for _ in range(-missing):
            i = -heap[0][1]
            out[i] -= 1
            heapq.heapreplace(heap, (votes[i] / (2 * out[i] - 1), -i)) if out[i] else heapq.heappop(heap)
    return out


def block_size(words: int) -> int:
    """Words in a block of a shard."""
    return min(LARGEST_BLOCK, 1 << max(0, (words // BLOCKS).bit_length() - 1))


def _permutation(source: int, shard: int, n: int) -> tuple[int, int]:
    """(a, b) of the seeded permutation j -> (a j + b) mod n."""
    h = zlib.crc32(f"{SEED}:{source}:{shard}".encode())
    a = h % n or 1
    while math.gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 0, (h * 2654435761 + 12345) % n


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> tuple[DataFrame, DataFrame] | None:
    """(sources, shards) as small tables, from docs with doc_id, source and size; None without words.

    One row a source and one a shard come to the driver: a shard has about
    SHARD_WORDS words, so there are total / SHARD_WORDS + sources of them.
    """
    spark = docs.sparkSession
    rows = docs.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    if not sum(r["size"] for r in rows):
        return None
    goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    counts = [max(1, -(-r["size"] // SHARD_WORDS)) for r in rows]
    sources = spark.createDataFrame(
        pa.table({
            "name": pa.array([r["source"] for r in rows], pa.string()), "src": pa.array(range(len(rows)), pa.int32()), "shards": pa.array(counts, pa.int64()),
            "source_size": pa.array([r["size"] for r in rows], pa.int64()), "target": pa.array(goal, pa.float64()),
        })
    )
    found = with_shard(docs, sources).where("size > 0").groupBy("src", "shard").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["src"], r["shard"]))
    votes = [goal[r["src"]] * r["size"] / rows[r["src"]]["size"] for r in found]
    blocks = [block_size(r["size"]) for r in found]
    quotas = [0] * len(found)
    for block in sorted(set(blocks)):
        of = [i for i, x in enumerate(blocks) if x == block]
        for i, q in zip(of, sainte_lague([votes[i] for i in of], round(sum(votes[i] for i in of) / block)), strict=True):
            quotas[i] = q
    out = []
    for r, q, block in zip(found, quotas, blocks, strict=True):
        n = round(r["size"] / block)
        q = min(q, MOST * n)
        out.append((r["src"], r["shard"], r["size"], n, q // n, q % n, *_permutation(r["src"], r["shard"], n)))
    names = ["src", "shard", "shard_size", "blocks", "passes", "part", "a", "b"]
    columns = list(zip(*out, strict=True))
    shards = spark.createDataFrame(pa.table({c: pa.array(v, pa.int32() if c == "src" else pa.int64()) for c, v in zip(names, columns, strict=True)}))
    return sources, shards


def with_shard(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Add src, shard, source_size and target."""
    return (
        docs.join(checked_broadcast(sources), C("source").eqNullSafe(C("name")), "left")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), C("shards")))
        .drop("name", "shards")
    )


TAKEN = """size * passes + aggregate(
    sequence(((before + 1) * blocks - 1) div shard_size, ((before + size) * blocks - 1) div shard_size), 0L,
    (sum, j) -> sum + if((a * j + b) % blocks < part,
        least(before + size, ((j + 1) * shard_size) div blocks) - greatest(before, (j * shard_size) div blocks), 0L))"""


def mix(docs: DataFrame, sizes: DataFrame | None = None, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Add source_size, target and taken to docs that have doc_id, source and size (words).

    ``taken`` is how many words of the document the mix takes, repeats counted.
    ``sizes`` may name a narrower table with the same doc_id, source and size.

    Defined cases: documents without words are taken 0 times; null is a source
    of its own, the last; equal rows lie next to each other and are taken each;
    an empty table gives no rows; other columns are carried.
    """
    made = plan(docs if sizes is None else sizes, weights)
    empty = {"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long")}
    if made is None:
        return docs.withColumns(empty)
    sources, shards = made
    keep = docs.columns
    own = with_shard(docs, sources)
    line = W.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id", "size")
    laid = own.where("size > 0").withColumn("before", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - C("size"))
    taken = laid.join(checked_broadcast(shards), ["src", "shard"]).withColumn("taken", F.expr(TAKEN))
    columns = [*keep, "source_size", "target", "taken"]
    none = own.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*columns).unionByName(none.select(*columns))


def mixed_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sizes = docs.select(C("doc_id").cast("long").alias("doc_id"), C("source").cast("string").alias("source"), words(C("text")).alias("size"))
    return mix(stored(sizes, "sizes"), weights=weights)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken: taken / size times, rounded by a seeded draw."""
    narrow = stored(docs.select("doc_id", "source", words(C("text")).alias("size")), "sizes")
    rows = docs.select("doc_id", "source", words(C("text")).alias("size"), F.struct(*docs.columns).alias("_row"))
    draw = F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(C("taken") / F.greatest(C("size"), F.lit(1)) + draw).cast("int")
    mixed = mix(rows, narrow, weights).withColumn("_times", times).where("_times > 0")
    return mixed.select(F.explode(F.array_repeat("_row", C("_times"))).alias("_row")).select("_row.*")
