"""Approximate nearest vectors by a stored coarse quantiser.

K-means over a bounded sample cuts the unit sphere into cells; every vector is
stored under its nearest centre.  A query looks only into the cells nearest to
it and scores their vectors exactly.  How many cells the best n take is learned
from the sample, so that the wanted recall holds for data without clusters, too.
A filter that keeps one vector in s makes the best n lie as deep as n * s.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.tasks import Frames, TopRows, sortable
from palaver.operators.activity import metadata_filter
from palaver.operators.rank import DIGITS, PER_RANKER, QUERY_BLOCK, hit_schema, query_keys, rank_rows
from palaver.session import scratch_table

C = F.col

SAMPLE_ROWS = 50_000  # vectors that centres and probes are learned from, the first by a hash of the id
TUNE_ROWS = 200  # of them that are taken as queries
ROUNDS = 10  # of k-means
RECALL = 0.96  # wanted on the sample
DEPTHS = (10, 40, 160, 640)  # best n for which the number of cells is learned; deeper searches probe all
SHELVES = 32  # folders of neighbouring cell numbers
SLAB_ROWS = 200_000  # a cell is written by as many tasks as it has slabs of this size


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def centres(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """K-means on the unit sphere; a cell that runs empty keeps its centre."""
    rng = np.random.default_rng(seed)
    c = unit(x[rng.permutation(len(x))[:cells]])
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=len(c)) > 0
        c[full] = unit(sums[full])
    return c


def learned_probes(x: np.ndarray, c: np.ndarray, recall: float, n: int) -> int:
    """The least number of cells that hold ``recall`` of the best n of sample vectors taken as queries."""
    near = (x @ c.T).argmax(axis=1)
    own = np.unique(np.linspace(0, len(x) - 1, TUNE_ROWS).astype(int))
    scores = x[own] @ x.T
    scores[np.arange(len(own)), own] = -np.inf
    n = min(n, len(x) - 1)
    if n < 1:
        return len(c)
    best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    order = np.argsort(-(x[own] @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(own), 0), 1)
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel())  # cells before the one that holds each hit
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def _nearest(c: np.ndarray) -> Callable[[Frames], Frames]:
    def run(batches: Frames) -> Frames:
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, c.shape[1]))
            yield pdf.assign(cell=(x @ c.T).argmax(axis=1).astype(np.int32))

    return run


def _scan(keys: pd.DataFrame, matrix: np.ndarray, asks: np.ndarray, n: int, skip: np.ndarray | None) -> Callable[[Frames], Frames]:
    """Scores vectors (id, embedding, cell) against the queries that look into their cell (``asks``: queries x cells)."""

    def run(batches: Frames) -> Frames:
        top = TopRows(keys, n)
        for pdf in batches:
            if pdf.empty:
                continue
            ids, cell = sortable(pdf["id"]), pdf["cell"].to_numpy()
            block = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            order = np.argsort(cell, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                asked = np.flatnonzero(asks[:, cell[at[0]]])
                if not len(asked):
                    continue
                scores = np.round(matrix[asked] @ block[at].T, DIGITS)
                if skip is not None:
                    scores[ids[at][None, :] == skip[asked][:, None]] = -np.inf
                top.add_block(ids[at], scores, asked)
        yield from top.frames()

    return run


class CellIndex:
    """Vectors by cell in the folder ``path``, a place that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        rows = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # a row a cell
        self.centres = np.array([r["centre"] for r in rows], dtype=np.float64)
        self.probes = list(rows[0]["probes"]) if rows else []

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, *, cells: int | None = None, recall: float = RECALL) -> CellIndex:
        """Store ``vectors`` (id, embedding, filter columns).

        The driver sees SAMPLE_ROWS vectors; there are twice the root of their
        number of cells unless ``cells`` says otherwise.
        """
        spark = vectors.sparkSession
        path = path or scratch_table(spark, "cells")
        sample = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
        x = unit(np.stack(sample["embedding"].to_numpy()).astype(np.float64)) if len(sample) else np.zeros((0, 1))
        c = centres(x, min(len(x), cells or max(1, int(2 * len(x) ** 0.5)))) if len(x) else x
        probes = [learned_probes(x, c, recall, n) for n in DEPTHS] if len(x) else []
        spark.createDataFrame([(i, v.tolist(), probes) for i, v in enumerate(c)], "cell int, centre array<double>, probes array<int>").coalesce(1).write.parquet(f"{path}/cells")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        index = cls(spark, path, schema)
        index.extend(vectors)
        return index

    def extend(self, vectors: DataFrame) -> None:
        """Add vectors with new ids; the centres stay.  A cell of any size is dealt to several tasks."""
        if len(self.centres):
            placed = vectors.mapInPandas(_nearest(self.centres), f"{self.schema}, cell int")
            slabs = -(-vectors.count() // SLAB_ROWS)
            shelf = (C("cell") * SHELVES / len(self.centres)).cast("int")
            rows = placed.withColumn("shelf", shelf).repartition("shelf", F.pmod(F.xxhash64("id"), F.lit(max(1, slabs)))).sortWithinPartitions("shelf", "cell")
            rows.write.mode("append").partitionBy("shelf").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        if not len(self.centres):
            return self.spark.createDataFrame([], f"{self.schema}, cell int, shelf int")
        return self.spark.read.schema(f"{self.schema}, cell int, shelf int").parquet(f"{self.path}/vectors")

    def probes_for(self, n: float) -> int:
        """Cells that hold the best n with the wanted recall."""
        return next((p for depth, p in zip(DEPTHS, self.probes, strict=True) if depth >= n), len(self.centres)) if self.probes else 0

    def search(self, queries: DataFrame, n: int = PER_RANKER, *, probes: int | None = None, skip: str | None = None, block: int = QUERY_BLOCK, **filters) -> DataFrame:
        """(qid, id, score, rank) of the n best among the cells nearest to each query.

        ``probes`` is their number; by default what was learned for n, and for a
        filter by the share of vectors that pass it.

        Scores are exact; with all cells probed the result is that of
        ``rank.dense_rank``.  Per block of queries only the folders of cells that
        some query probes are read, and only n rows per query leave a task.  The
        filter applies before the cut; ``skip`` names a column with an id to leave out.
        """
        keys = query_keys(queries)
        id_type = next(f.dataType.simpleString() for f in self.vectors().schema if f.name == "id")
        schema, path = hit_schema(queries, id_type), scratch_table(self.spark, "hits")
        self.spark.createDataFrame([], schema).write.parquet(path)
        allowed = self.vectors().where(metadata_filter(**filters))
        if probes is None:
            share = 1.0
            if any(v is not None for v in filters.values()):
                kept, every = allowed.count(), self.vectors().count()
                share = kept / every if kept else 1.0
            probes = self.probes_for(n / share)
        probes = min(probes, len(self.centres))
        for names, matrix, skipped in _blocks(queries, keys, skip, block):
            if not probes:
                break
            near = np.argpartition(-(matrix @ self.centres.T), probes - 1, axis=1)[:, :probes]
            asks = np.zeros((len(names), len(self.centres)), bool)
            np.put_along_axis(asks, near, True, 1)
            shelves = sorted({int(cell * SHELVES / len(self.centres)) for cell in np.flatnonzero(asks.any(axis=0))})
            rows = allowed.where(C("shelf").isin(shelves)).select("id", "embedding", "cell")
            rows.mapInPandas(_scan(names, matrix, asks, n, skipped), schema).write.mode("append").parquet(path)
        return rank_rows(self.spark.read.schema(schema).parquet(path), n, keys)


def _blocks(queries: DataFrame, keys: list[str], skip: str | None, block: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray | None]]:
    """(keys, vectors, ids to skip) of a bounded number of queries at a time."""
    rows = queries.select(*keys, "embedding", *([skip] if skip else [])).toLocalIterator(prefetchPartitions=True)
    while part := [r for _, r in zip(range(block), rows)]:
        names = pd.DataFrame([tuple(r[c] for c in keys) for r in part], columns=keys)
        yield names, np.array([r["embedding"] for r in part], dtype=np.float64), np.array([r[skip] for r in part]) if skip else None


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): the share of the exact hits (qid, id) that a search found."""
    hits = exact.select("qid", "id").join(found.select("qid", "id").withColumn("_hit", F.lit(1)), ["qid", "id"], "left")
    counts = hits.agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("found"))
    return counts.withColumn("recall", C("found") / C("wanted"))
