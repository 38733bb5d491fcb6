"""Runs of periodic words in texts by Kolpakov and Kucherov's way.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, TIMES * q)`` words that no neighbouring word
extends keeping period q. The Lempel-Ziv factors of a word sequence are read from its suffix automaton; Main's algorithm finds the runs that
cross or touch a factor's bounds, from the longest common extensions to both sides of the bound; the runs inside a factor are copied from its
earlier occurrence.

A run of these lengths holds a gram of ``gram_words()`` words that occurs again one period later, and such grams cover all its words. So only the
stretches that repeated grams cover go through the automaton; in most texts there is none, and finding that takes a sort of hashes.

Defined cases: null, empty and wordless texts have no runs; words are compared exactly, byte by byte; repeated rows and ids are each told; a null
id is carried; other columns are left alone; an empty table gives no rows. A text is one task's work and takes memory in proportion to its
words, a suffix automaton (about half a kilobyte a word) only for its repeating stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, release

LEAST, TIMES = 24, 3
FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93))


def gram_words(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words of a run that are also found one period later, over all periods."""
    return max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, by doubling."""
    out, done, level = None, 0, 0
    while k >> level:
        if k >> level & 1:
            piece = hashes[done:]
            out = piece if out is None else out[: len(piece)] * MULTIPLIERS[-1] + piece[: len(out)]
            done += 1 << level
        step = 1 << level
        hashes = hashes[: max(0, len(hashes) - step)] * MULTIPLIERS[level % 4] + hashes[step:]
        level += 1
    return out


def repeating(hashes: np.ndarray, k: int, least: int) -> Iterator[tuple[int, int]]:
    """The stretches of at least ``least`` words all of which lie in a gram of k words that occurs twice or more within the stretch."""
    todo = [(0, len(hashes))]
    while todo:
        begin, end = todo.pop()
        if end - begin < max(least, k + 1):
            continue
        grams = gram_hashes(hashes[begin:end], k)
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            continue
        steps = np.zeros(end - begin + 1, np.int64)
        again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        np.add.at(steps, again, 1)
        np.add.at(steps, again + k, -1)
        covered = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if (a, b) == (0, end - begin):
                yield begin, end
            else:
                todo.append((begin + a, begin + b))


def automaton(word: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of a sequence: transitions of each state and where the first occurrence of its members ends."""
    go: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for at, c in enumerate(word):
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        first.append(at)
        link.append(0)
        state = last
        while state >= 0 and c not in go[state]:
            go[state][c] = new
            state = link[state]
        if state >= 0:
            to = go[state][c]
            if length[to] == length[state] + 1:
                link[new] = to
            else:
                copy = len(go)
                go.append(dict(go[to]))
                length.append(length[state] + 1)
                first.append(first[to])
                link.append(link[to])
                link[to] = link[new] = copy
                while state >= 0 and go[state].get(c) == to:
                    go[state][c] = copy
                    state = link[state]
        last = new
    return go, first


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, source): each factor is the longest that also begins earlier, at ``source``, or a new symbol (source -1)."""
    go, first = automaton(word)
    out, at, n = [], 0, len(word)
    while at < n:
        state = size = 0
        while at + size < n:
            to = go[state][word[at + size]]
            if first[to] - size >= at:
                break
            state, size = to, size + 1
        out.append((at, at + size, first[state] - size + 1) if size else (at, at + 1, -1))
        at += size or 1
    return out


def extensions(word: list[int]) -> list[int]:
    """For each place the length of the longest prefix of the sequence that begins there."""
    n = len(word)
    out = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for at in range(1, n):
        size = 0
        if at < right:
            size = out[at - left]
            if size < right - at:
                out[at] = size
                continue
            size = right - at
        while at + size < n and word[size] == word[at + size]:
            size += 1
        out[at] = size
        left, right = at, at + size
    return out


def runs_at(word: list[int], low: int, bound: int, high: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs within ``low`` to ``high`` that cross or touch ``bound``."""
    left, right = word[low:bound], word[bound:high]
    back, around = left[::-1], word[low:high]
    m, k = len(left), len(right)
    suffix, prefix = extensions(back), extensions(right)
    behind = extensions([*back, -1, *around[::-1]])[m + 1 :]
    ahead = extensions([*right, -1, *around])[k + 1 :]
    found = [(bound - behind[k - p], bound + p + (prefix[p] if p < k else 0), p) for p in range(1, k + 1)]  # the word p after the bound belongs to the run
    found += [(bound - p - (suffix[p] if p < m else 0), bound + ahead[m - p], p) for p in range(1, m + 1)]
    for start, end, period in found:
        if end - start >= least and end - start >= times * period:
            longer = start == low > 0 and word[low - 1] == word[low - 1 + period]
            if not longer and not (end == high < len(word) and word[high] == word[high - period]):
                yield start, end, period


def runs(word: list[int], least: int = LEAST, times: int = TIMES) -> dict[tuple[int, int], int]:
    """All runs of a sequence of numbers from 0 on: (start, end) and the smallest period.

    A factor and the symbol after it do not occur earlier as they stand, so a run that crosses the bound behind it begins less than a period before
    the factor; with ``times`` periods in the run, that bounds how far to the left a bound's runs reach.
    """
    out: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[int]] = {}

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in out:
            by_start.setdefault(start, []).append(end)
            out[start, end] = period
        else:
            out[start, end] = min(period, out[start, end])

    before = 0
    for begin, end, source in [*factors(word), (len(word), len(word), -1)]:
        size = end - begin
        low = max(0, begin - (times * before + size) // (times - 1) - 1)
        if end - low >= least:
            for run in runs_at(word, low, begin, end, least, times):
                add(*run)
        shift = begin - source
        if source >= 0 and size > least and by_start:
            for start in range(begin + 1, end - least):
                for stop in by_start.get(start - shift, ()):
                    if stop + shift < end:
                        add(start, stop + shift, out[start - shift, stop])
        before = size
    return out


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs by start, then period."""
    k, found = gram_words(least, times), []
    if len(words) < max(least, k + 1):
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for begin, end in repeating(hashes, k, least):
        number: dict[bytes, int] = {}
        stretch = [number.setdefault(w, len(number)) for w in words[begin:end]]
        found += [(begin + a, b - a, q) for (a, b), q in runs(stretch, least, times).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def described(words: list[bytes]) -> tuple:
    """The fields of ``FOUND`` of one text."""
    found = word_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    if found:
        keep = np.ones(len(words), bool)
        for a, n, q in found:
            keep[a + q : a + n] = False
        words = list(compress(words, keep.tolist()))
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, sha256(told.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, repeats=None) -> DataFrame:
    """doc_id and the fields of ``FOUND`` of every row: how many runs, the one of greatest exponent, and digests of all runs and of the text without
    the words that a run repeats. ``repeats`` (doc_id, words) may change a text's words first."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), arrow_texts(batch.column(1))):
                words = text.split()
                rows.append(described(repeats(doc_id, words) if repeats else words))
            release()
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", *(c.split()[0] for c in FOUND.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {FOUND}")
