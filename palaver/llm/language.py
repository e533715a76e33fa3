"""Language identification by mixtures of languages.

Per language, counts of byte trigrams of the normalised text (A-Z lower-cased,
other ASCII characters than letters to single blanks) are summed over all
labelled documents.  A document is a mixture: expectation-maximisation gives
the share of each language from the likelihoods of its trigrams.  Which
languages it really has is chosen by penalised likelihood alone among the nested
sets of its strongest languages, up to all of them, and against the empty set, in which all trigrams
are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.hashing import ranges, utf8

BUCKETS = 1 << 15
SMOOTHING = 0.05
ROUNDS = 12  # of expectation-maximisation over all languages, and per nested set
PENALTY = 2.0  # times log(trigrams) for each further language
CELLS = 2_000_000  # trigram times language cells worked on at a time

C = F.col


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    ascii_letter = ((table >= 97) & (table <= 122)) | (table >= 128)
    table[~ascii_letter] = 0x20
    return table


def trigrams(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of one normalised text."""
    b = table[data]
    blank = b == 0x20
    again = blank.copy()
    again[1:] &= blank[:-1]
    again[:1] = False
    b = b[~again].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, count) of a task; a few languages are held at a time."""
    table, held = _fold(), {}

    def rows():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            at = at if len(at) else np.zeros(1, np.int64)  # the language itself is known
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "count"]
            )
        held.clear()

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for i, lang in enumerate(langs):
            if lang not in held and len(held) >= 64:
                yield from rows()
            counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            grams = trigrams(data[offsets[i] : offsets[i + 1]], table)
            if len(grams):
                counts += np.bincount(grams, minlength=BUCKETS)
    yield from rows()


@dataclass
class Model:
    """Languages in code point order and the likelihood of each trigram bucket under each."""

    languages: list[str]
    likelihood: np.ndarray  # BUCKETS x languages


def learn(labelled: DataFrame) -> Model:
    """Fit on all rows (lang not null); what comes to the driver is languages x BUCKETS at most."""
    rows = labelled.select(C("lang").cast("string").alias("lang"), C("text").cast("string").alias("text")).where("lang IS NOT NULL")
    sums = rows.mapInArrow(_counts, "lang string, bucket long, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count")).toArrow()
    languages = sorted(set(sums.column("lang").to_pylist()), key=lambda x: x.encode("utf-32-be"))
    counts = np.zeros((BUCKETS, len(languages)))
    column = pc.index_in(sums.column("lang"), pa.array(languages, pa.string())).to_numpy() if languages else []
    counts[sums.column("bucket").to_numpy(), column] = sums.column("count").to_numpy()
    return Model(languages, ((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32))


def _sum_rows(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def mixtures(model: Model, buckets: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, number of languages chosen) of documents with one trigram at least.

    ``buckets`` and ``counts`` hold the documents' distinct trigrams one after
    another, ``ends`` where each document ends.
    """
    starts = np.concatenate([[0], ends[:-1]])
    size = np.diff(ends, prepend=0)
    p, c = model.likelihood[buckets], counts.astype(np.float32)
    n = _sum_rows(counts.astype(np.float64), starts)

    def maximise(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(ROUNDS):
            r = p * np.repeat(share, size, axis=0)
            r *= (c / r.sum(axis=1))[:, None]
            share = _sum_rows(r, starts)
            share /= share.sum(axis=1, keepdims=True)
        fit = np.log(np.maximum((p * np.repeat(share, size, axis=0)).sum(axis=1, dtype=np.float64), 1e-300))
        return share, _sum_rows(fit * counts, starts)

    docs, langs = len(ends), p.shape[1]
    share, _ = maximise(np.full((docs, langs), 1 / langs, np.float32))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    chosen, score = np.zeros(docs, np.int64), np.full(docs, -np.inf)
    for k in range(1, langs + 1):
        own = np.zeros_like(share)
        np.put_along_axis(own, order[:, :k], 1 / k, axis=1)
        own, fit = maximise(own)
        value = fit - PENALTY * (k - 1) * np.log(n + 1)
        better = value > score
        best[better], chosen[better], score[better] = own[better], k, value[better]
    chosen[score < -n * np.log(BUCKETS)] = 0
    return best, chosen


def _judge(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, list]]:
    """(first row, rows, [(language, score, languages, rejected)]) for runs of rows."""
    data, offsets = utf8(texts)
    table = _fold()
    strings = texts
    cells = max(1, CELLS // max(1, len(model.languages)))
    for a, b in ranges(offsets, cells):
        out: list = [None] * (b - a)
        rows, found = [], []
        for i in range(a, b):
            text = strings[i].as_py()
            if text is None or not any(map(str.isalpha, text)) or not model.languages:
                out[i - a] = ("und", 0.0, [], True)
                continue
            grams = trigrams(data[offsets[i] : offsets[i + 1]], table)
            if not len(grams):  # a letter or two: nothing to tell by
                out[i - a] = (model.languages[0], 1 / len(model.languages), [], False)
                continue
            counts = np.bincount(grams, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            rows.append(i - a)
            found.append((at, counts[at]))
        if rows:
            ends = np.cumsum([len(x) for x, _ in found])
            share, chosen = mixtures(model, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), ends)
            for row, s, k in zip(rows, share, chosen, strict=True):
                order = np.argsort(-s, kind="stable")
                out[row] = (model.languages[order[0]], float(min(1.0, s[order[0]])), [model.languages[j] for j in order[:k]], k == 0)
        yield a, b, out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, out in _judge(model, batch.column("text")):
                lang, score, langs, bad = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(a, b - a) for x in ("doc_id", "held_out")), pa.array(lang), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array([bool(x) for x in bad])],
                    ["doc_id", "held_out", "lang_pred", "score", "languages", "rejected"],
                )

    return run


def _keep(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not row[3] for _, _, out in _judge(model, batch.column("text")) for row in out]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def held_out(doc_id: Column) -> Column:
    """True for the documents set aside: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _learning(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(C("doc_id")) & C("doc_id").isNotNull())


def predict(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages, rejected.

    score is the share of lang_pred in the mixture of the chosen set;
    ``languages`` is that set, strongest first, empty where no language explains
    the text better than evenly spread trigrams.  ``rejected`` marks those and
    the texts without a letter.

    Defined cases: a null text or one without a letter is ``und`` with score 0;
    a text of letters too short for a trigram gets the first language and its
    even share; equal shares go to the smaller code point; rows with a null id
    are judged but never learned from; without labelled rows all are ``und``;
    an empty table gives no rows; other columns are ignored.
    """
    model = learn(_learning(docs))
    rows = docs.select(C("doc_id").cast("long").alias("doc_id"), held_out(C("doc_id")).alias("held_out"), C("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, rejected boolean")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns as they are."""
    return docs.mapInArrow(_keep(learn(_learning(docs))), docs.schema)
