"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; one binary n-gram classifier per bit, learned from n-gram counts over all training rows,
predicts whether that bit is set. Decoding sums each codeword's logistic loss over the bits' margins and takes the
least; ``ambiguous`` marks texts whose two best codewords are nearly as close.

Defined cases: a null text and one without any letter are ``und`` with score 0; with no training row every text is ``und``;
of equal losses the first language in code point order wins; repeated rows count as often as they occur; rows with a
null language are not learned from; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

GRAMS, BUCKETS = (1, 2, 3), 1 << 15
BLOCK_CHARS = 1 << 18


def gram_counts(text: str) -> np.ndarray:
    """Bucket counts of all n-grams of the lower-cased text, white space runs as one space and one at each end.

    Blocks of n-gram starts are taken one after the other, each with the characters that its last n-grams reach into, so the counts
    are the whole text's whatever the block's size.
    """
    text = " " + " ".join(text.lower().split()) + " "
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), BLOCK_CHARS):
        code = np.frombuffer(text[at : at + BLOCK_CHARS + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for n in GRAMS:
            starts = max(0, min(BLOCK_CHARS, len(code) - n + 1))
            h = np.full(starts, n, np.uint64)
            for i in range(n):
                h = (h ^ code[i : i + starts]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            total += np.bincount(((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1: all two-sided splits for up to 6 languages, else 63 balanced seeded ones."""
    if n == 0:
        return np.zeros((0, 1), np.int64)
    if n <= 6:
        bits = [(1, *b) for b in itertools.product((1, -1), repeat=max(0, n - 1)) if -1 in b]
        return np.array(bits or [(1,)], np.int64).T
    random = np.random.default_rng(7)
    half = np.where(np.arange(n) < n // 2, 1, -1)
    return np.array([random.permutation(half) for _ in range(63)]).T


class Decoder:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.weights = np.empty((self.code.shape[1], BUCKETS))
        for b in range(self.code.shape[1]):
            on, off = share[self.code[:, b] == 1], share[self.code[:, b] == -1]
            self.weights[b] = np.log(on.mean(0) / off.mean(0)) if len(on) and len(off) else 0.0

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        n = gram_counts(text)
        used = np.flatnonzero(n)
        total = n[used].sum()
        margin = self.weights[:, used] @ n[used] / total * np.sqrt(min(total, 900)) / 3
        loss = np.logaddexp(0, -self.code * margin).sum(1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(loss.min() - loss)
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else 1.0
        return self.languages[order[0]], float(odds.max() / odds.sum()), bool(gap < 0.5)


def train(rows: DataFrame) -> Decoder:
    """A decoder from (text, lang); n-gram counts are summed per language on Spark, BUCKETS rows per language reach the driver."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                total[lang] = total.get(lang, 0) + gram_counts(text.as_py())
            release()
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    read = rows.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    summed = read.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(np.array(languages, object), summed["lang"].to_numpy(object)), summed["bucket"].to_numpy(int)] = summed["n"].to_numpy(float)
    return Decoder(languages, counts)


def predicted(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous per row; the text alone decides."""

    def run(batches):
        for batch in batches:
            found = [decoder(t.as_py()) for t in batch.column(2)]
            release()
            lang, score, unsure = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
