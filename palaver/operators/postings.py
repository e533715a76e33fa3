"""A stored lexical index: written once, extended by deltas, searched without a text.

Documents lie in ranges, runs of documents in id order with a bounded number of
tokens.  A row of ``postings`` is the list of one term in one range (places of
documents and term counts side by side) with its greatest count and least
length, from which follows how much the term can add to a score there.  A row
without a term names the documents of the range by place, with their lengths, so
an id is stored once.  Lists of frequent terms are thus split, and a range none
of whose documents can reach the best n of any query is left out before its
lists are moved.  Lists are written by the task that makes them.

Generations are immutable and count once they are listed in ``commits``.  A
changed or removed document is noted in ``dead``, with its counts taken back
from the vocabulary by a later generation; its lists are masked when read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.tasks import posting_rows
from palaver.functions.text import tokenize
from palaver.plans.scale import checked_broadcast
from palaver.session import cut_lineage, scratch_table

C = F.col

NAMES = ["term", "range", "n", "max_tf", "min_dl", "tokens", "ids", "docs", "tfs", "dls"]
COMMITS = "gen int, postings long, vocab long, dead long"
RANGE_TOKENS = 1 << 21  # tokens after which a range ends (it ends with a document)
ROWS_OUT = 20_000  # lists handed over at a time


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, toks) in id order to rows (term, range, n, max_tf, min_dl, tokens, ids, docs, tfs, dls).

    The row without a term has the ids and lengths of the range's documents;
    ``docs`` of all others are places in it.
    """

    def rows(part: int, number: int, ids: pa.Array, lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        dl = np.concatenate([np.asarray(x.value_lengths()) for x in lists]).astype(np.int64)
        words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        del lists  # the tokens of a range are held once
        n = len(dl)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n
        code += np.repeat(np.arange(n), dl)
        code.sort()
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        code, tf = code[new], np.diff(np.append(new, len(code)))
        term, doc = code // n, code % n
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts[1:], len(term)) if len(starts) else starts
        where = (part << 20) + number

        whole = [pa.array([x], pa.int64()) for x in (where, n, 0, int(dl.min()), int(dl.sum()))]
        own = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), *[pa.nulls(1, pa.list_(pa.int32()))] * 2, pa.array([dl], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *whole, *own], NAMES)
        for a in range(0, len(starts), ROWS_OUT):
            s, e = starts[a : a + ROWS_OUT], ends[a : a + ROWS_OUT]
            some, cut = slice(s[0], e[-1]), s - s[0]
            at, lengths = pa.array(np.append(cut, e[-1] - s[0]), pa.int32()), dl[doc[some]]
            lists = [pa.ListArray.from_arrays(at, pa.array(v[some], pa.int32())) for v in (doc, tf)]
            figures = [np.full(len(s), where), e - s, np.maximum.reduceat(tf[some], cut), np.minimum.reduceat(lengths, cut), np.add.reduceat(lengths, cut)]
            names = words.dictionary.take(pa.array(term[s])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, *[pa.array(x, pa.int64()) for x in figures], pa.nulls(len(s), pa.list_(ids.type)), *lists, pa.nulls(len(s), pa.list_(pa.int32()))], NAMES)

    part, number, tokens = TaskContext.get().partitionId(), 0, 0
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        ids, lists = pa.concat_arrays([b.column("id") for b in held]), [b.column("toks") for b in held]
        held.clear()
        return rows(part, number, ids, lists)

    for batch in batches:
        sizes, at = np.cumsum(np.asarray(batch.column("toks").value_lengths()).astype(np.int64)), 0
        while at < len(batch):  # a batch is cut where the range is full
            before = int(sizes[at - 1]) if at else 0
            end = min(len(batch), int(np.searchsorted(sizes, before + RANGE_TOKENS - tokens)) + 1)
            held.append(batch.slice(at, end - at))
            tokens, at = tokens + int(sizes[end - 1]) - before, end
            if tokens >= RANGE_TOKENS:
                yield from flush()
                number, held, tokens = number + 1, [], 0
    if held:
        yield from flush()


def _schema(id_type: str) -> str:
    return f"term string, range long, n long, max_tf long, min_dl long, tokens long, ids array<{id_type}>, docs array<int>, tfs array<int>, dls array<int>"


def by_range(lists: DataFrame) -> DataFrame:
    """Whole ranges, one after the other in a task."""
    return lists.repartition("range").sortWithinPartitions("range")


@contextmanager
def both_open(spark: SparkSession) -> Iterator[None]:
    """A task writes to two folders side by side, so its lists need not be sorted by folder first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "2")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class LexicalIndex:
    """The index in the folder ``path``, a place that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, id_type: str) -> None:
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self._seen: list | None = None
        self._vocabulary: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> LexicalIndex:
        """Index ``docs`` (id, text) in a new folder."""
        spark = docs.sparkSession
        index = cls(spark, path or scratch_table(spark, "lexical"), docs.schema["id"].dataType.simpleString())
        spark.createDataFrame([], COMMITS).write.parquet(f"{index.path}/commits")
        index.extend(docs)
        return index

    def refresh(self) -> None:
        """Look for generations that others have added."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").orderBy("gen").collect()  # a line a delta
        if rows != self._seen:
            self._seen, self._vocabulary = rows, None

    def commits(self) -> list:
        """The generations that count, as last looked up."""
        if self._seen is None:
            self.refresh()
        return self._seen

    @property
    def ranges(self) -> int:
        return sum(r["postings"] for r in self.commits())

    def _read(self, table: str, schema: str) -> DataFrame:
        """The rows of ``table`` of all generations that count."""
        done = [r["gen"] for r in self.commits() if r[table]]
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, gen int").parquet(f"{self.path}/{table}").where(C("gen").isin(done))

    def lists(self) -> DataFrame:
        """The lists of all terms."""
        return self._read("postings", f"{_schema(self.id_type)}, bucket int").where("bucket >= 0")

    def dead(self) -> DataFrame:
        """(id, range) of documents that a later generation changed or removed."""
        return self._read("dead", f"id {self.id_type}, range long").select("id", "range")

    def ranges_of(self) -> DataFrame:
        """The rows without a term: ids and lengths of the documents of each range, dead ones among them."""
        return self._read("postings", f"{_schema(self.id_type)}, bucket int").where("bucket < 0")

    def documents(self) -> DataFrame:
        """(id, dl, range, doc) of the live documents; ``doc`` is the place in the range."""
        every = self.ranges_of().select("range", F.posexplode(F.arrays_zip("ids", "dls")).alias("doc", "x"))
        named = every.select(C("x.ids").alias("id"), C("x.dls").cast("long").alias("dl"), "range", "doc")
        return named.join(self.dead(), ["id", "range"], "left_anti")

    def vocabulary(self) -> DataFrame:
        """(term, df, dl): document frequencies; the row with a NULL term counts documents and tokens."""
        if self._vocabulary is None:
            parts = self._read("vocab", "term string, df long, dl long")
            self._vocabulary = cut_lineage(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df > 0"))
        return self._vocabulary

    def extend(self, docs: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Add a generation: ``docs`` (id, text) are new or changed, ``removed`` (id) go.

        Only the given texts are read; what their old versions counted is found
        in the lists of their own ranges.  A generation counts once its line in
        ``commits`` is written, so a failed attempt leaves the index as it was.
        """
        self.refresh()
        gen, counts = max([-1, *(r["gen"] for r in self.commits())]) + 1, {"postings": 0, "vocab": 0, "dead": 0}
        vocab = []
        gone = self._gone(docs, removed) if gen else None
        if gone is not None and (n := gone.count()):
            counts["dead"] = n
            self._append("dead", gone.select("id", "range"), gen)
            own = self.lists().join(checked_broadcast(gone.select("range").distinct()), "range", "left_semi")
            lost = own.select("term", "range", F.explode("docs").alias("doc")).join(gone.select("doc", "range"), ["doc", "range"], "left_semi")
            vocab.append(lost.groupBy("term").agg((-F.count("*")).alias("df"), F.lit(None).cast("long").alias("dl")))
            vocab.append(gone.agg((-F.count("*")).alias("df"), (-F.sum("dl")).alias("dl")).select(F.lit(None).cast("string").alias("term"), "df", "dl"))
        if docs is not None:
            added = self._lists_of(docs, gen)
            counts["postings"] = added.where("bucket < 0").count()  # ranges
            vocab.append(added.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.when(C("term").isNull(), C("tokens"))).alias("dl")))
        if vocab:
            counts["vocab"] = 1
            self._append("vocab", reduce(DataFrame.unionByName, vocab), gen)
        self.spark.createDataFrame([(gen, *counts.values())], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.refresh()

    def _append(self, table: str, rows: DataFrame, gen: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/gen={gen}")

    def _gone(self, docs: DataFrame | None, removed: DataFrame | None) -> DataFrame | None:
        """(id, dl, range, doc) of the live documents that a delta replaces or removes."""
        named = [x.select("id") for x in (docs, removed) if x is not None]
        if not named:
            return None
        ids = named[0] if len(named) == 1 else named[0].unionByName(named[1])
        return cut_lineage(self.documents().join(ids.distinct(), "id", "left_semi"))

    def _lists_of(self, docs: DataFrame, gen: int) -> DataFrame:
        toks = docs.select("id", "text").repartitionByRange("id").sortWithinPartitions("id").select("id", tokenize(C("text")).alias("toks"))
        rows = toks.mapInArrow(_encode, _schema(self.id_type)).withColumn("range", C("range") + F.lit(gen).cast("long") * (1 << 52))
        path = f"{self.path}/postings/gen={gen}"
        named = rows.withColumn("bucket", F.when(C("term").isNull(), -1).otherwise(0))
        with both_open(self.spark):
            named.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(f"{_schema(self.id_type)}, bucket int").parquet(path)

    def postings(self, terms: DataFrame) -> DataFrame:
        """(id, dl, term, tf) of the live documents for the given terms."""
        lists = self.lists().join(checked_broadcast(terms.select("term").distinct()), "term", "left_semi")
        columns = ["range", "term", "ids", "docs", "tfs", "dls"]
        rows = by_range(lists.select(*columns).unionByName(self.ranges_of().select(*columns)))
        found = rows.mapInPandas(posting_rows, f"id {self.id_type}, dl long, term string, tf long, range long")
        return found.join(self.dead(), ["id", "range"], "left_anti").drop("range")
