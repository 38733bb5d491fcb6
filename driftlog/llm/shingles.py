"""Vectorised words, word-shingle sets and their SetSketch registers, one block of texts at a time (NumPy inside tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 19
EDGE = re.compile(rb"[\x09-\x0d ]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
GOLD, MULT_A, MULT_B, BASE = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * MULT_A
    x = (x ^ (x >> U(27))) * MULT_B
    return x ^ (x >> U(31))


BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * GOLD)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_power[0]) < n:
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _power[i] = np.multiply.accumulate(steps)
    return _power


def blocks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BLOCK_BYTES each; a longer text is a run of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about BLOCK_BYTES, cut at white space only: no word is cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        if end < len(text):
            blank = EDGE.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block (A-Z lower-cased, split at ASCII white space), and where each text's words begin (one more entry at the end)."""
    if len(texts) == 1 and len(texts[0]) > 2 * BLOCK_BYTES:
        hashes = np.concatenate([hashed([part])[0] for part in pieces(texts[0])])
        return hashes, np.array([0, len(hashes)])
    return hashed(texts)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[raw]] * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def shingle_sets(texts: Iterable[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """Each text's set of distinct k-word shingles as sorted 64-bit hashes; the whole sequence is one shingle where it is shorter."""
    for block in blocks(texts):
        hashes, first = words(block)
        n = len(hashes)
        rolled = np.zeros(max(0, n - k + 1), np.uint64)
        if n >= k:
            for i in range(k):
                rolled = rolled * BASE + hashes[i : n - k + 1 + i]
            rolled = mix(rolled)
        for i in range(len(block)):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                whole = U(b - a)
                for h in hashes[a:b]:
                    whole = U((int(whole) * int(BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class SetSketch:
    """m one-byte registers K = floor(1 - log_b x), x the least of exponential values that each element draws for each register.

    An element visits the registers in an order of its own, one of m equal quantile ranges after the other, so
    that the first values are the smallest and the visits stop once every register holds one: about n + m log m
    visits instead of n * m. Registers of a union are the maxima of the registers.
    """

    def __init__(self, m: int = 384, b: float = 1.1, a: float = 20.0):
        self.m, self.b, self.a = m, b, a
        self.steps = np.array([s for s in range(1, m) if np.gcd(s, m) == 1], np.uint64)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        m, n = self.m, len(hashes)
        if not n:
            return np.zeros(m, np.uint8)
        seed = mix(hashes + GOLD)
        at, step = seed % U(m), self.steps[((seed >> U(40)) % U(len(self.steps))).astype(np.int64)]
        least, j = np.full(m, ~U(0)), 0
        while j < m and (least == ~U(0)).any():
            more = min(m - j, max(1, int(m * (np.log(m) + 1) / n)))
            turns = np.arange(j, j + more, dtype=np.uint64)[:, None]
            drawn = mix(hashes[None, :] + (turns + U(1)) * GOLD) >> U(10)
            np.minimum.at(least, ((at + turns * step) % U(m)).ravel().astype(np.int64), ((turns << U(54)) | drawn).ravel())
            j += more
        quantile = ((least >> U(54)).astype(float) + ((least & U((1 << 54) - 1)).astype(float) + 0.5) / 2.0**54) / m
        x = -np.log1p(-np.minimum(quantile, 1 - 1e-16)) / self.a
        return np.clip(np.floor(1 - np.log(x) / np.log(self.b)), 0, 255).astype(np.uint8)

    def jaccard(self, one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
        """Maximum-likelihood Jaccard similarity of pairs (rows) from the joint order of their registers and both set sizes."""
        more, less = (one > two).sum(1)[:, None], (one < two).sum(1)[:, None]
        same = self.m - more - less
        u = (n_one / np.maximum(1, n_one + n_two))[:, None]
        top = np.minimum(u / np.maximum(1e-12, 1 - u), (1 - u) / np.maximum(1e-12, u))
        j = np.linspace(0, 1, 101)[None, :] * top
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.b - 1) / self.b) / np.log(self.b)
        p_more, p_less = p(u - (1 - u) * j), p((1 - u) - u * j)
        fit = sum(c * np.log(np.maximum(q, 1e-9)) for c, q in ((more, p_more), (less, p_less), (same, 1 - p_more - p_less)))
        return j[np.arange(len(j)), fit.argmax(1)]
