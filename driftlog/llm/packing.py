"""Packing documents into sequences by length patterns fitted with non-negative least squares.

``token_pieces`` tokenises whole texts in tasks and cuts only documents longer than a sequence. ``placed`` places the
pieces: their length histogram (at most one row per length, so at most ``limit`` rows) comes to the driver, patterns of two or
three lengths that fill a sequence are fitted to it by non-negative least squares, repeat counts are rounded down, and
what is left is filled largest first. A plan is a list of patterns with repeat counts, never a list of pieces: each
piece finds its place from its rank among the pieces of its length. ``sequences`` joins the pieces' token ids in the order
of their places: its rows are what a training run reads, and ``packed`` takes every piece back out of them.

Defined cases: a null or empty text is the end id alone; repeated rows are packed once each; null ids are carried;
an empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import codecs
import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, settled, stored

LIMIT, END_ID = 4096, 1
END = np.array([END_ID], "<u4").tobytes()
MARK, GROUP_WORDS = "\x01", 1000
BLANK = re.compile(r"[\t\n\r]")
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Latin letters, digits, blanks and ASCII marks but the apostrophe, which begins parts of its own, and "<", which begins added tokens; their parts by PATTERN.
PLAIN = re.compile(r"[ \t\n\r0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff!-&(-/:;=-@\[-`{-~]*")
PART = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
SINGLE = r"([0-9]|[!-&(-/:;=-@\[-`{-~]+)"  # of PART, all but letters
BLOCK_BYTES = 1 << 21
RANK_ROWS = 1000  # pieces of one length that are ranked in one group
CACHE_WORDS, CACHE_CHARS = 1 << 18, 48
PLACES, BLOCKS = 1 << 21, 64  # rows of a broadcast block of places (about 100 MB in a task's executor), and blocks at most
PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACED = ("doc_id", "piece", "start", "length", "offset")


def byte_characters() -> str:
    """The character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


BYTE_CHARACTERS = byte_characters()


class WordCoder:
    """Token ids of whole texts as little-endian bytes, end id included, coding each word between ASCII blanks once.

    Right for tokenizers that drop white space and never join characters across it, as those with a word pattern and an
    end-of-word suffix do; ``token_pieces`` is tested against whole-text coding. Where the tokenizer's normalizer and pattern are those of
    ``NORMAL`` and ``PATTERN``, plain words fall into their lower-case parts, so that the tokenizer's model codes each part once,
    however it is written and followed. Words and parts of at most ``CACHE_CHARS`` characters are kept; the store is emptied when it holds
    ``CACHE_WORDS``.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = tokenizer, {}
        marks = tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None
        self.model = Tokenizer(tokenizer.model) if by_parts(tokenizer) else None
        if self.model:
            vocabulary, suffix = tokenizer.get_vocab(), tokenizer.model.end_of_word_suffix
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def split(self, text: str) -> list[str]:
        """The words of a text that is not plain; those that are, as their parts."""
        words = BLANK.sub(" ", text).split(" ")
        return [x for w in words for x in (PART.findall(w.lower()) if PLAIN.fullmatch(w) else [w])] if self.model else words

    def coded(self, words: list[str]) -> dict[str, bytes]:
        """Many parts go to the model as one list, told apart by their last tokens; words that are none go through ``marked``."""
        parts = [w for w in words if PART.fullmatch(w)] if self.model else []
        out = self.marked([w for w in words if not PART.fullmatch(w)] if self.model else words)
        groups = [parts[i : i + GROUP_WORDS] for i in range(0, len(parts), GROUP_WORDS)]
        written = [codecs.charmap_decode(" ".join(g).encode(), "strict", BYTE_CHARACTERS)[0].split(BYTE_CHARACTERS[32]) for g in groups]
        for group, found in zip(groups, self.model.encode_batch_fast(written, is_pretokenized=True, add_special_tokens=False) if groups else []):
            ids = np.array(found.ids, "<u4")
            ends, whole = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            if len(ends) == len(group) and ends[-1] == len(whole):
                out |= {w: whole[a:b] for w, a, b in zip(group, [0, *ends[:-1]], ends, strict=True)}
            else:  # a part that the model leaves without an end
                out |= self.marked(group)
        return out

    def marked(self, words: list[str]) -> dict[str, bytes]:
        """Many words go through the tokenizer as one text, told apart by the id of ``MARK``; words that hold it go alone."""
        alone = [w for w in words if self.mark is None or MARK in w]
        rest = [w for w in words if MARK not in w] if self.mark is not None else []
        out = {w: np.array(c.ids, "<u4").tobytes() for w, c in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False))}
        groups = [rest[i : i + GROUP_WORDS] for i in range(0, len(rest), GROUP_WORDS)]
        joined = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*g, ""]) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, joined):
            ids = np.array(found.ids, "<u4")
            ends, whole = np.flatnonzero(ids == self.mark) * 4, ids.tobytes()
            out |= {w: whole[a:b] for w, a, b in zip(group, [0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)}
        return out

    def found(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from the store where it has them."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, words
        self.known |= self.coded(new)
        out = [*map(self.known.__getitem__, words)]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Plain texts fall into their parts as Arrow columns, so that of all words only a block's distinct ones become Python strings."""
        plain = np.array([bool(self.model and PLAIN.fullmatch(t)) for t in texts], bool)
        spaced = pc.replace_substring_regex(pa.array([t.lower() for t, p in zip(texts, plain) if p], pa.string()), pattern=SINGLE, replacement=r" \1 ")
        lists = [pc.ascii_split_whitespace(spaced), pa.array([self.split(t) for t, p in zip(texts, plain) if not p], pa.list_(pa.string()))]
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        each = self.found(words.dictionary.to_pylist())
        size, at = np.array([len(x) // 4 for x in each], np.int64), words.indices.to_numpy()
        ends = np.r_[0, np.cumsum(size[at])]
        place = np.repeat((np.cumsum(size) - size)[at] - ends[:-1], size[at]) + np.arange(ends[-1])
        whole = np.frombuffer(b"".join(each), "<u4")[place].tobytes()
        cuts = (4 * ends[np.r_[0, np.cumsum(np.concatenate([x.value_lengths().to_numpy() for x in lists]))]]).tolist()
        out = [b""] * len(texts)
        for k, i in enumerate(np.argsort(~plain, kind="stable").tolist()):
            out[i] = whole[cuts[k] : cuts[k + 1]] + END
        return out


def by_parts(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, cuts words into parts by ``PATTERN`` and codes each part's bytes by itself."""
    parts = tokenizer.normalizer, tokenizer.pre_tokenizer
    if None in parts or tokenizer.post_processor is not None or not getattr(tokenizer.model, "end_of_word_suffix", None):
        return False
    normal, pattern = (json.loads(p.__getstate__()) for p in parts)
    return normal == NORMAL and pattern == PATTERN and all("<" in t.content for t in tokenizer.get_added_tokens_decoder().values())


@functools.lru_cache(1)
def word_coder(tokenizer_path: str) -> WordCoder:
    """One per Python worker, kept from task to task."""
    from tokenizers import Tokenizer

    return WordCoder(Tokenizer.from_file(tokenizer_path))


def narrow(ids: bytes) -> bytes:
    """Ids of 32 bits in 16 bits each where all fit, for the way to their places; ``wide`` tells by the length."""
    values = np.frombuffer(ids, "<u4")
    return values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else ids


def wide(ids: bytes, length: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * length else ids


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length and the token ids as of ``narrow``."""

    def run(batches):
        coder = word_coder(tokenizer_path)

        def rows(ids, texts):
            for doc_id, tokens in zip(ids, coder.ids(texts)):
                for k, at in enumerate(range(0, len(tokens), 4 * limit)):
                    part = tokens[at : at + 4 * limit]
                    yield doc_id, k, at // 4, len(part) // 4, narrow(part)

        def table(found):
            columns = list(zip(*found)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield table(rows(ids, texts))
                    ids, texts, size = [], [], 0
            yield table(rows(ids, texts))
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def fitted(patterns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: min |A x - counts| by accelerated projected gradient."""
    n = len(counts)
    x = np.zeros(len(patterns))
    used = np.zeros(n)
    np.add.at(used, patterns.ravel(), 1.0)
    used[0] = 0
    rate = 1.0 / max(1.0, float(used[patterns].sum(1).max()))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), np.repeat(y, patterns.shape[1]), minlength=n)
        off = made - counts
        off[0] = 0
        new = np.maximum(0, y - rate * off[patterns].sum(1))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


def few_length_patterns(counts: np.ndarray, limit: int) -> np.ndarray:
    """Pairs and triples of present lengths that fill a sequence exactly; a zero marks no third length."""
    have = np.flatnonzero(counts[:limit])
    have = have[have > 0]
    found = [(a, limit - a, 0) for a in have if a <= limit - a and counts[limit - a]]
    for a in have[have >= limit // 3]:
        b = have[(have <= a) & (have < limit - a)]
        b = b[(limit - a - b <= b) & (counts[limit - a - b] > 0)]
        found += [(a, v, limit - a - v) for v in b[np.argsort(-counts[b], kind="stable")][:4]]
    return np.array(sorted(set(map(tuple, found))), np.int64).reshape(-1, 3)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (repeats, [(length, how many), ...]) that use up the histogram."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    made: list[tuple[int, list[tuple[int, int]]]] = []

    def take(repeats: int, runs: list[tuple[int, int]]) -> None:
        for length, k in runs:
            counts[length] -= repeats * k
        made.append((int(repeats), [(int(length), int(k)) for length, k in runs]))

    if counts[limit]:
        take(counts[limit], [(limit, 1)])
    patterns = few_length_patterns(counts, limit)
    if len(patterns):
        x = fitted(patterns, counts.astype(float))
        for i in np.argsort(-x, kind="stable"):
            lengths, k = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            repeats = min(int(x[i]), int((counts[lengths] // k).min()))
            if repeats > 0:
                take(repeats, list(zip(lengths[::-1], k[::-1])))
    while counts.any():
        free, runs = limit, []
        while free:
            fits = np.flatnonzero(counts[: free + 1])
            fits = fits[fits < runs[-1][0]] if runs else fits
            if not len(fits):
                break
            length = int(fits[-1])
            k = min(free // length, int(counts[length]))
            runs.append((length, k))
            free -= k * length
        take(min(int(counts[length]) // k for length, k in runs), runs)
    return made


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """One row per run of a pattern, sorted by (length, first rank): length, first rank, how many per sequence, first sequence, offset."""
    rows, ranks, sequence = [], {}, 0
    for repeats, runs in made:
        offset = 0
        for length, k in runs:
            first = ranks.get(length, 0)
            rows.append((length, first, k, sequence, offset))
            ranks[length] = first + repeats * k
            offset += length * k
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces, ids included, with sequence_id and offset. ``pieces`` is stored under a row number; ids take no part in ranking.

    The pieces of one length are ranked in groups of about ``RANK_ROWS`` by a hash of the row number, so that neither a frequent
    length nor repeated rows make one task's work.
    """
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()))
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``limit`` rows
    table = places(plan({r.length: r.n for r in counted}, limit))
    parts = pieces.sparkSession.createDataFrame([(r.length, 1 + r.n // RANK_ROWS) for r in counted], "length long, parts long")
    key = table[:, 0] << 44 | table[:, 1]

    def put(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(key, length << 44 | rank, "right") - 1]
            turn = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(row[:, 3] + turn // row[:, 2]), pa.array(row[:, 4] + turn % row[:, 2] * length)], names=["row", "sequence_id", "offset"]
            )

    salted = pieces.select("row", "length").join(F.broadcast(parts), "length").select("row", "length", F.pmod(F.xxhash64("row"), "parts").alias("part"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "part").orderBy("row")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "part"]).select("row", "length", (F.col("first") + F.col("own")).alias("rank"))
    found = stored(ranked.mapInArrow(put, "row long, sequence_id long, offset long"))
    return beside(pieces, found).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def beside(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """``pieces`` joined with ``found`` by row. The stored pieces lie in row order, so blocks of rows meet broadcast blocks of at most about
    ``PLACES`` places and the ids are not shuffled for it; where that would take over ``BLOCKS`` blocks, both sides are shuffled."""
    sizes = sorted((r.p, r.n) for r in found.groupBy(F.shiftright("row", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # one row per task that wrote
    cuts, held = [0], 0
    for p, n in sizes:
        if held and held + n > PLACES:
            cuts.append(p << 33)
            held = 0
        held += n
    if len(cuts) > BLOCKS or any(n > 2 * PLACES for _, n in sizes):
        return pieces.join(found, "row")
    out = None
    for low, high in zip(cuts, [*cuts[1:], (1 << 63) - 1]):
        within = (F.col("row") >= low) & (F.col("row") < high)
        block = pieces.where(within).join(F.broadcast(found.where(within)), "row")
        out = block if out is None else out.unionByName(block)
    return out


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (the sequence's token ids as little-endian 32-bit bytes) and its pieces by offset; ``pieces`` come from ``placed``."""
    listed = f"array<struct<{', '.join(f'{c}: {dict(pieces.dtypes)[c]}' for c in PLACED)}>>"
    items = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))

    def run(batches):
        for batch in batches:
            parts = batch.column(1)
            flat, ends = parts.flatten(), np.r_[0, np.cumsum(parts.value_lengths().to_numpy())]
            ids = [*map(wide, flat.field("ids").to_pylist(), flat.field("length").to_pylist())]
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([flat.field(c) for c in PLACED], names=list(PLACED)))
            release()
            whole = pa.array([b"".join(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, pieces], names=["sequence_id", "ids", "pieces"])

    return pieces.groupBy("sequence_id").agg(items.alias("items")).mapInArrow(run, f"sequence_id long, ids binary, pieces {listed}")


def contents(rows: DataFrame) -> DataFrame:
    """Every piece of ``sequences`` with its place, its ids cut from the sequence, and their checksum."""
    one = rows.select("sequence_id", F.col("ids").alias("whole"), F.explode("pieces").alias("p")).select(
        "p.*", "sequence_id", F.expr("substring(whole, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))").alias("ids")
    )
    return one.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


@settled
def written(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The sequences of ``pieces`` as a table in the shared folder."""
    return sequences(placed(pieces, limit))


def packed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces with sequence_id and offset, read back from the sequences written."""
    return contents(written(pieces, limit))
