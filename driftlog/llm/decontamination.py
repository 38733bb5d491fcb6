"""Benchmark passages in documents by the q-gram lemma, verified by banded alignment.

Texts are compared lower-cased with white space runs as one space. A benchmark item is cut into overlapping windows of ``WINDOW``
characters (half a window apart; a shorter item is one window) with an edit budget of one per ``PER_EDIT`` characters. By the
q-gram lemma a passage within e edits of a window of n characters shares at least n - q + 1 - q e of its q-grams on
diagonals at most 2e apart, so documents' q-grams are counted per window in overlapping diagonal bands, and only bands
that reach the bound are aligned, inside the band. So every verbatim excerpt of WINDOW + WINDOW / 2 - 1 = 143 characters of a longer item is found.
Items shorter than ``Q`` are searched as they are, q being their length, where no letter or digit touches them.

Equal windows are one, whatever number of items hold them. A document goes through the index in segments that overlap by a
window. A q-gram of very many places is taken as met by the windows that hold it, which leaves the bound necessary; only windows of hardly any
others look it up. A segment whose q-grams still meet very many places of the index is halved, then taken one part of the index at a time, so that
memory stays bounded for texts and items of few letters too.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters, each sent whole to the tasks; every block meets every
document.

Defined cases: null and empty texts and items match nothing; repeated documents are each found; repeated items are each
named; a null id is carried; other columns are left alone; without hits there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix, powers

Q, WINDOW, PER_EDIT = 12, 96, 24
BLOCK_CHARS = 8 << 20
SEGMENT, ENTRIES = 1 << 16, 1 << 20  # characters of a document, and meetings of its q-grams with the index, at a time
COMMON = 1024  # places of the index from which a q-gram counts as met without a look
FOUND = "doc_id long, item_id long, item_start long, doc_start long, doc_end long, edits int"
BITS = 20
GOLD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Grams:
    """Hashes of the grams of any length at every position, from running sums."""

    def __init__(self, code: np.ndarray):
        power, self.inverse = powers(len(code) + 1)
        self.total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * GOLD * power[: len(code)], out=self.total[1:])

    def __call__(self, q: int) -> np.ndarray:
        n = len(self.total) - q
        return mix((self.total[q:] - self.total[:n]) * self.inverse[:n] + np.uint64(q)) if n > 0 else np.zeros(0, np.uint64)


def aligned(window: np.ndarray, code: np.ndarray, first: int, last: int, budget: int) -> tuple[int, int] | None:
    """(edits, end in the document) of the best place for the whole window on diagonals first to last - 1, or None over budget."""
    lead = max(0, -first)
    tail = max(0, last + len(window) - len(code))
    band = code[max(0, first) : last + len(window)].astype(np.int64)
    band = np.concatenate([np.full(lead, -1), band, np.full(tail, -1)])
    ramp = np.arange(last - first)
    row = np.zeros(last - first, np.int64)
    for i, c in enumerate(window):
        step = row + (band[i : i + len(row)] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
        if row.min() > budget:
            return None
    at = int(row.argmin())
    return int(row[at]), min(len(code), max(0, first + at + len(window)))


class Windows:
    """The q-gram index of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        held: dict[str, list[tuple[int, int]]] = {}
        short: dict[str, list[int]] = {}
        for item, text in items:
            text = plain(text)
            if 0 < len(text) < Q:
                short.setdefault(text, []).append(item)
            elif text:
                last = max(0, len(text) - WINDOW)
                for start in sorted({*range(0, last, WINDOW // 2), last}):
                    held.setdefault(text[start : start + WINDOW], []).append((item, start))
        self.owners = list(held.values())
        self.window = [codes(text) for text in held]
        self.budget = np.array([len(w) // PER_EDIT for w in self.window], np.int64)
        self.need = np.array([len(w) - Q + 1 for w in self.window], np.int64) - Q * self.budget
        hashes = [Grams(w)(Q) for w in self.window]
        joined = (
            np.concatenate([np.zeros(0, np.uint64), *hashes]),
            np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]),
            np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)]),
        )
        _, which, times = np.unique(joined[0], return_inverse=True, return_counts=True)
        common = times[which] > COMMON
        taken = np.bincount(joined[1][common], minlength=len(self.window))
        lean = self.need > taken  # these windows count their common grams as met, and need the fewer of the others
        self.need = np.where(lean, self.need - taken, self.need)
        order = np.argsort(joined[0], kind="stable")
        order = order[~(common & lean[joined[1]])[order]]
        self.hash, self.owner, self.at = (x[order] for x in joined)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.short: dict[int, dict[int, tuple[str, list[int]]]] = {}
        for text, ids in short.items():
            self.short.setdefault(len(text), {})[int(Grams(codes(text))(len(text))[0])] = (text, ids)

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, start in the item, start and end in the plain text, edits) of every window found, one for each stretch of the text."""
        text = plain(text)
        if not text or not (self.window or self.short):
            return []
        code = codes(text)
        found: dict[tuple[int, int, int, int], int] = {}
        lap = 2 * WINDOW
        for at in range(0, max(1, len(code) - lap), SEGMENT):
            self.segment(code, text, at, min(len(code), at + SEGMENT + lap), found)
        return [(*place, edits) for place, edits in sorted(found.items())]

    def segment(self, code: np.ndarray, text: str, begin: int, end: int, found: dict) -> None:
        part = Grams(code[begin:end])
        for length, known in self.short.items():
            h = part(length)
            for at in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))).tolist():
                item, ids = known[int(h[at])]
                a, b = begin + at, begin + at + length
                free = not (a and text[a - 1].isalnum() and item[0].isalnum()) and not (b < len(text) and text[b].isalnum() and item[-1].isalnum())
                if free and text[a:b] == item:
                    found.update({(i, 0, a, b): 0 for i in ids})
        h = part(Q)
        pos = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hash, h[pos], "left"), np.searchsorted(self.hash, h[pos], "right")
        met = high > low
        if met.any():
            self.meet(code, begin + pos[met], low[met], high[met], found)

    def meet(self, code: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, found: dict, share: tuple[int, int] = (0, 1)) -> None:
        """Aligns the bands that reach the bound; ``pos`` are the document's places whose q-grams have the index entries low to high."""
        n = high - low
        lap = 2 * WINDOW
        if n.sum() > ENTRIES and pos[-1] - pos[0] > 4 * lap:
            middle = (pos[0] + pos[-1]) // 2
            for use in (pos <= middle + lap, pos >= middle - lap):
                self.meet(code, pos[use], low[use], high[use], found, share)
            return
        if n.sum() > ENTRIES * share[1]:  # many windows hold these grams: one part of the windows at a time
            parts = int(n.sum() // ENTRIES) + 1
            for k in range(parts):
                self.meet(code, pos, low, high, found, (k, parts))
            return
        if share[1] == 1:
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc_at = np.repeat(pos, n)
        else:
            picked = [(lambda e: e[self.owner[e] % share[1] == share[0]])(np.arange(a, b)) for a, b in zip(low.tolist(), high.tolist())]
            entry, doc_at = np.concatenate(picked), np.repeat(pos, [len(e) for e in picked])
        win, at = self.owner[entry], self.at[entry]
        diagonal = doc_at - at + WINDOW
        half = 2 * self.budget[win] + 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            key = np.unique((win << 36 | band) * WINDOW + at) // WINDOW
            groups, count = np.unique(key, return_counts=True)
            w, b = groups >> 36, groups & ((1 << 36) - 1)
            reach = count >= self.need[w]
            for w, b in zip(w[reach].tolist(), b[reach].tolist()):
                half_w = int(2 * self.budget[w] + 1)
                first = b * 2 * half_w - shift * half_w - WINDOW
                spans.setdefault(w, []).append((first, first + 2 * half_w))
        for w, ranges in spans.items():
            ranges.sort()
            merged = [list(ranges[0])]
            for first, last in ranges[1:]:
                if first <= merged[-1][1]:
                    merged[-1][1] = max(last, merged[-1][1])
                else:
                    merged.append([first, last])
            for first, last in merged:
                hit = aligned(self.window[w], code, first, last, int(self.budget[w]))
                if hit:
                    for item, start in self.owners[w]:
                        found.setdefault((item, start, max(0, hit[1] - len(self.window[w])), hit[1]), hit[0])


def indexes(benchmark: DataFrame) -> Iterator[Windows]:
    """The benchmark's q-gram indexes, one per block of at most about BLOCK_CHARS characters."""
    sized = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = 1 + (sized.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0] // BLOCK_CHARS)
    for b in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Windows([(r.item_id, r.text) for r in part.collect()])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per benchmark window found in a document: doc_id, item_id, places and edits."""
    out = None
    for index in indexes(benchmark):

        def run(batches, index=index):
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in index.search(t.as_py())]
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "item_start", "doc_start", "doc_end", "edits"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns as they are."""
    for index in indexes(benchmark):

        def run(batches, index=index):
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not index.search(t.as_py()) for t in text], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, least_edits: the benchmark items of which a document holds a passage."""
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.count_distinct("item_start").alias("n_windows"), F.min("edits").alias("least_edits"))
