"""Toxicity by a classifier chain: one linear model per category, each also fed the probabilities of the earlier ones.

The chain is fitted on at most ``SAMPLE_ROWS`` labelled documents, those with the lowest hashes of their ids. Words that
separate a category clearly there become features, each scaled by its smoothed log ratio of document shares, so
that telling words weigh more than common ones. While
training, a later category sees out-of-fold probabilities of the earlier ones, as it will see for unseen texts.

Defined cases: null and empty texts get the probabilities of a text without known words; a null label is no label for
that category; without both outcomes in the labels a category's probability is its label share (0 if there is none) and
rejects nothing; repeated rows count as often as they occur; other columns are left alone; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, forget, release, stored
from .shingles import blocks, words

BUCKETS, FEATURES = 1 << 18, 1024
SAMPLE_ROWS, FOLDS, L2, STEPS = 20_000, 4, 2.0, 300
LEAST_Z = 3.0  # standard errors between the shares of a word in both outcomes
PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() and c not in (9, 10, 11, 12, 13) else c for c in range(256))


def word_sets(texts: Iterable[bytes]) -> Iterator[list[np.ndarray]]:
    """Each text's distinct words as bucket numbers, one block of texts at a time."""
    for block in blocks(t.translate(PUNCTUATION) for t in texts):
        hashes, first = words(block)
        slot = (hashes % np.uint64(BUCKETS)).astype(np.int32)
        yield [np.unique(slot[first[i] : first[i + 1]]) for i in range(len(block))]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression on present features and dense columns, classes weighted equally, by accelerated gradient."""

    def __init__(self, scale: np.ndarray, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray):
        n, d = len(y), dense.shape[1]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
        w, v, b = np.zeros(FEATURES), np.zeros(d), 0.0
        g2 = np.full(FEATURES + d + 1, 1e-6)
        for _ in range(STEPS):
            p = sigmoid(np.bincount(rows, (w * scale)[cols], minlength=n) + dense @ v + b)
            e = weight * (p - y)
            g = np.concatenate([np.bincount(cols, e[rows], minlength=FEATURES) * scale + L2 * w, dense.T @ e + L2 * v, [e.sum()]])
            g2 += g * g
            step = 0.5 * g / np.sqrt(g2)
            w, v, b = w - step[:FEATURES], v - step[FEATURES:-1], b - step[-1]
        self.w, self.v, self.b = w * scale, v, b

    def __call__(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(rows, self.w[cols], minlength=len(dense)) + dense @ self.v + self.b)


class Chain:
    """Models of all categories in order, their features and thresholds."""

    def __init__(self, features: np.ndarray, scales: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, fold: np.ndarray):
        self.column = np.full(BUCKETS, -1, np.int64)
        self.column[features] = np.arange(len(features))
        rows, cols = self.flat(sets)
        dense = np.zeros((len(sets), 0))
        self.models, self.thresholds = [], []
        for k in range(labels.shape[1]):
            y = labels[:, k]
            known = ~np.isnan(y)
            share = float(np.nanmean(y)) if known.any() else 0.0
            if len(np.unique(y[known])) < 2:
                self.models.append(share)
                self.thresholds.append(2.0)
                dense = np.column_stack([dense, np.full(len(sets), share)])
                continue
            fit = lambda use: Linear(scales[k], *self.part(rows, cols, use), dense[use], y[use])  # noqa: B023, E731
            out = np.full(len(sets), share)
            for f in range(FOLDS):
                use = known & (fold != f)
                if (fold == f).any() and len(np.unique(y[use])) == 2:
                    out[fold == f] = fit(use)(*self.part(rows, cols, fold == f), dense[fold == f])
            order = np.argsort(-out[known], kind="stable")
            hit = np.cumsum(y[known][order])
            precision, recall = hit / np.arange(1, len(hit) + 1), hit / hit[-1]
            score = 1.25 * precision * recall / np.maximum(1e-12, 0.25 * precision + recall)  # precision counts twice
            ranked, best = out[known][order], int(score.argmax())
            below = ranked[best + 1] if best + 1 < len(ranked) else 0.0
            self.thresholds.append(max(0.5, float(ranked[best] + below) / 2))  # halfway to the next score
            self.models.append(fit(known))
            dense = np.column_stack([dense, out])

    @staticmethod
    def part(rows: np.ndarray, cols: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.cumsum(use) - 1
        keep = use[rows]
        return place[rows[keep]], cols[keep]

    def flat(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        cols = self.column[np.concatenate(sets)] if sets else np.zeros(0, np.int64)
        return rows[cols >= 0], cols[cols >= 0]

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        rows, cols = self.flat(sets)
        dense = np.zeros((len(sets), 0))
        for model in self.models:
            dense = np.column_stack([dense, model(rows, cols, dense) if isinstance(model, Linear) else np.full(len(sets), model)])
        return dense


def train(labelled: DataFrame, categories: list[str]) -> Chain:
    """A chain from (text, one 0/1 column per category)."""
    k = len(categories)
    read = labelled.select(F.col("text").cast("binary").alias("text"), *(F.col(c).cast("int").alias(c) for c in categories), F.xxhash64("text", *categories).alias("draw"))
    marks = ", ".join(f"{c} int" for c in categories) + ", draw long"

    def slim(batches):
        for batch in batches:
            words_of = [s.tobytes() for sets in word_sets(arrow_texts(batch.column(0))) for s in sets]
            release()
            yield pa.RecordBatch.from_arrays([pa.array(words_of, pa.binary()), *batch.columns[1:]], names=["words", *categories, "draw"])

    read = stored(read.mapInArrow(slim, "words binary, " + marks).orderBy("draw").limit(SAMPLE_ROWS))
    of = lambda column: [np.frombuffer(w, np.int32).astype(np.int64) for w in column.to_pylist()]

    def count(batches):
        seen = np.zeros((2 * k, BUCKETS), np.int64)
        for batch in batches:
            flags = [np.array([-1 if v is None else v for v in batch.column(1 + i).to_pylist()], np.int64) for i in range(k)]
            for at, s in enumerate(of(batch.column(0))):
                for i in range(k):
                    if flags[i][at] in (0, 1):
                        seen[2 * i + flags[i][at], s] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(seen[i, at]) for i in range(2 * k))], names=["bucket", *(f"n{i}" for i in range(2 * k))])

    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(2 * k)]
    counted = read.mapInArrow(count, "bucket long, " + ", ".join(f"n{i} long" for i in range(2 * k))).groupBy("bucket").agg(*sums)
    totals = read.agg(*(F.coalesce(F.sum((F.col(c) == v).cast("long")), F.lit(0)) for c in categories for v in (0, 1))).first()
    apart = F.lit(0.0)
    for i in range(k):
        n0, n1 = max(1, totals[2 * i]), max(1, totals[2 * i + 1])
        both = (F.col(f"n{2 * i}") + F.col(f"n{2 * i + 1}") + 1) / F.lit(n0 + n1)
        gap = F.abs(F.col(f"n{2 * i + 1}") / n1 - F.col(f"n{2 * i}") / n0) / F.sqrt(both * (1.0 / n0 + 1.0 / n1))
        apart = F.greatest(apart, gap)
    best = counted.withColumn("apart", apart).where(F.col("apart") >= LEAST_Z).orderBy(F.desc("apart"), "bucket").limit(FEATURES).collect()

    def sets(batches):
        for batch in batches:
            kept = [s[chosen[s]].astype(np.int32).tobytes() for s in of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), *(batch.column(1 + i) for i in range(k)), batch.column(k + 1)], names=["words", *categories, "draw"])

    chosen = np.zeros(BUCKETS, bool)
    chosen[[r.bucket for r in best]] = True
    rows = read.mapInArrow(sets, "words binary, " + marks).collect()  # at most SAMPLE_ROWS; as bytes, not as a Python number for each word
    forget(read)
    scales = np.zeros((k, FEATURES))
    for i in range(k):
        for j, r in enumerate(best):
            scales[i, j] = np.log((r[f"n{2 * i + 1}"] + 2) / (totals[2 * i + 1] + 4) / ((r[f"n{2 * i}"] + 2) / (totals[2 * i] + 4)))
    labels = np.array([[np.nan if r[c] not in (0, 1) else r[c] for c in categories] for r in rows], float).reshape(-1, k)
    fold = np.array([r.draw % FOLDS for r in rows], np.int64)
    return Chain(np.array([r.bucket for r in best], np.int64), scales, [np.frombuffer(r.words, np.int32).astype(np.int64) for r in rows], labels, fold)


def scored(docs: DataFrame, chain: Chain, categories: list[str]) -> DataFrame:
    """doc_id, p_<category>..., rejected per row; rejected by the last category's threshold."""
    limit = chain.thresholds[-1]

    def run(batches):
        for batch in batches:
            p = np.concatenate([np.zeros((0, len(categories))), *map(chain, word_sets(arrow_texts(batch.column(1))))])
            release()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, i]) for i in range(len(categories))), pa.array(p[:, -1] >= limit)],
                names=["doc_id", *(f"p_{c}" for c in categories), "rejected"],
            )

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + ", rejected boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are."""
    limit = chain.thresholds[-1]

    def run(batches):
        for batch in batches:
            texts = arrow_texts(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()))
            keep = np.concatenate([np.zeros(0, bool), *(chain(sets)[:, -1] < limit for sets in word_sets(texts))])
            release()
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


CATEGORIES = ["low_quality", "toxic"]


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, low_quality, toxic) of the labelled documents in the sample; its labels, SAMPLE_ROWS at most, are broadcast."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
