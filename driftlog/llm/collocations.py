"""Phrases of two to four words that occur together far more often than their parts apart.

Words are counted per language by an aggregation. Frequent ones get the slots of a minimal perfect hash, and texts become sequences of slots. Level by
level, the phrases of which all parts are candidates (no other can be frequent) are added up under their packed keys; keys that reach
``LEAST`` are the next candidates and get slots of their own, with the key stored beside for verification. A last pass counts words and phrases by
slot: tasks add into NumPy arrays with ``bincount``, and the arrays are summed in a tree of at most ``FAN`` at a time. Parts of a phrase are
phrases or words with slots, so both sides of every cut are read by slot. Scores are exact decimals.

A phrase of a language occurs within a piece (between ``BREAKS``), overlapping ones count each. A phrase's score is that of its lowest-scoring
cut, 2000000 * a / (l + r) rounded down. A phrase that stands inside a longer frequent one with at least ``COVER`` percent of its occurrences goes.
The first ``top`` of each language are told.

Defined cases: null and empty texts hold no words; a null language is ``und``; repeated rows count again; other columns are left alone; an
empty table, or one without a frequent phrase, gives no rows; ties in rank are broken by count, then by the phrase's bytes. Phrases and
words are strings of whole UTF-8 characters.

Scale: keys meet in aggregations that combine before the shuffle, so neither a common word nor a common phrase is one task's work. Slot tables are
made, sent and held in blocks of ``BLOCK_KEYS`` keys; counts go in chunks of ``CHUNK`` slots, of which a task holds ``LIVE`` at most before it passes them on.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, release, settled, stored
from .perfect_hash import Slots

LEAST, MOST_WORDS, COVER, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
CHUNK, LIVE, FAN = 1 << 16, 256, 32
WORDS_HELD, KEYS_HELD, IDS_HELD = 1 << 18, 1 << 21, 1 << 19  # different words, keys and word slots that a task gathers before it passes them on
RARE, BREAK = -1, -2
_from = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS
PLAIN = bytes.maketrans(_from, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS))
EDGE = re.compile(rb"[ \n]")
PART = 1 << 20


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text is not null")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, with a line feed as a word of its own at each break, in lists of bounded length."""
    text = text.translate(PLAIN)
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            edge = EDGE.search(text, end)
            end = edge.start() if edge else len(text)
        yield [w for w in text[at:end].replace(b"\n", b" \n ").split(b" ") if w]
        at = end


def word_key(lang: str, word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=lang.encode()[:64]).digest(), "little", signed=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """key, lang, word, n of all words, in parts: one row per word and time that a task passed it on."""

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0

        def passed():
            for lang, counted in held.items():
                counted.pop(b"\n", None)
                words, n = list(counted), list(counted.values())
                for i in range(0, len(words), 1 << 16):
                    some = words[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([word_key(lang, w) for w in some], pa.int64()), pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(n[i : i + len(some)], pa.int64())],
                        names=["key", "lang", "word", "n"],
                    )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counted = held.setdefault(lang.as_py(), Counter())
                size -= len(counted)
                for words in tokens(text.as_py()):
                    counted.update(words)
                size += len(counted)
                if size > WORDS_HELD:
                    yield from passed()
                    size = 0
            release()
        yield from passed()

    return texts.mapInArrow(run, "key long, lang string, word binary, n long")


def encoded(texts: DataFrame, words: Slots) -> DataFrame:
    """ids: sequences of word slots (32 bits each; RARE for a word without one, BREAK between pieces and texts), many texts in a row."""

    def run(batches):
        known: dict[str, dict[bytes, int]] = {}
        held: dict[str, list[bytes]] = {}
        ready: dict[str, list[np.ndarray]] = {}
        size = 0

        def numbered():
            if sum(map(len, known.values())) > WORDS_HELD:
                known.clear()
            for lang, some in held.items():
                mine = known.setdefault(lang, {b"\n": BREAK})
                new = list(set(some).difference(mine))
                mine.update(zip(new, words.find(np.array([word_key(lang, w) for w in new], np.int64)).tolist()))
                ready.setdefault(lang, []).append(np.fromiter(map(mine.__getitem__, some), np.int32, len(some)))
            held.clear()

        def passed():
            for ids in ready.values():
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary())], names=["ids"])
            ready.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                for some in tokens(text.as_py()):
                    held.setdefault(lang, []).extend(some)
                    size += len(some)
                    if size > IDS_HELD:
                        numbered()
                        size = 0
                held.setdefault(lang, []).append(b"\n")
                if ready:  # a row ends where a text ends
                    numbered()
                    yield from passed()
            release()
        numbered()
        yield from passed()

    return texts.mapInArrow(run, "ids binary")


def phrase_keys(ids: np.ndarray, levels: list[Slots]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 2, 3, ... words: their places in ``ids`` and packed keys, where both shorter phrases that make one up have slots; ``levels`` are the slots of 2 words and more."""
    before = ids.astype(np.int64)
    for level in range(2, len(levels) + 3):
        n = max(0, len(ids) - level + 1)
        at = np.flatnonzero((before[:n] >= 0) & (before[1 : n + 1] >= 0))
        keys = before[at] << 32 | ids[at + level - 1].astype(np.int64)
        yield at, keys
        if level < len(levels) + 2:
            few, which = np.unique(keys, return_inverse=True)
            now = np.full(len(ids), -1, np.int64)
            now[at] = levels[level - 2].find(few)[which]
            before = now


def key_sums(sequences: DataFrame, levels: list[Slots]) -> DataFrame:
    """key, n of the phrases one word longer than the last of ``levels``, in parts."""

    def run(batches):
        keys, counts, size = [], [], 0

        def passed():
            few, which = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(which, np.concatenate(counts), len(few)).astype(np.int64)
            for i in range(0, len(few), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(few[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], names=["key", "n"])

        for batch in batches:
            for row in batch.column(0):
                *_, (_, found) = phrase_keys(np.frombuffer(row.as_py(), np.int32), levels)
                few, n = np.unique(found, return_counts=True)
                keys.append(few)
                counts.append(n)
                size += len(few)
                if size > KEYS_HELD:
                    yield from passed()
                    keys, counts, size = [], [], 0
        if keys:
            yield from passed()

    return sequences.mapInArrow(run, "key long, n long")


def bases(words: Slots, levels: list[Slots]) -> list[int]:
    """Where each level's slots begin in the one count array of all levels."""
    return np.cumsum([0, words.size, *(s.size for s in levels)]).tolist()


def slot_counts(sequences: DataFrame, words: Slots, levels: list[Slots]) -> DataFrame:
    """chunk, lane, counts (64-bit each): occurrences by slot over all levels, in parts."""
    base = bases(words, levels)

    def run(batches):
        chunks: dict[int, np.ndarray] = {}
        turn = 0

        def passed():
            for c, counts in chunks.items():
                lane = int.from_bytes(hashlib.blake2b(f"{marker} {turn} {c}".encode(), digest_size=4).digest(), "little")
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([lane], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "lane", "counts"])

        from pyspark import TaskContext

        marker = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_py(), np.int32)
                found = [ids[ids >= 0].astype(np.int64)]
                for (_, keys), table, start in zip(phrase_keys(ids, levels[:-1]), levels, base[1:]):
                    slots = table.find(keys)
                    found.append(slots[slots >= 0] + start)
                slots = np.concatenate(found)
                which = slots // CHUNK
                order = np.argsort(which, kind="stable")
                edges = np.flatnonzero(np.diff(which[order])) + 1
                for part in np.split(slots[order], edges) if len(slots) else ():
                    c = int(part[0] // CHUNK)
                    if c not in chunks and len(chunks) >= LIVE:
                        yield from passed()
                        chunks, turn = {}, turn + 1
                    chunks.setdefault(c, np.zeros(CHUNK, np.int64))
                    chunks[c] += np.bincount(part - c * CHUNK, minlength=CHUNK)
        yield from passed()

    return sequences.mapInArrow(run, "chunk long, lane long, counts binary")


def tree_sum(parts: DataFrame) -> DataFrame:
    """chunk, counts: the sum of all parts of a chunk, about ``FAN`` arrays at a time."""
    most = parts.groupBy("chunk").count().agg(F.max("count")).first()[0] or 0

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for value in group.column("counts"):
            total += np.frombuffer(value.as_py(), np.int64)
        return pa.table({"chunk": group.column("chunk")[:1], "lane": group.column("lane")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    lanes = 1
    while lanes * FAN < most:
        lanes *= FAN
    while True:
        parts = parts.withColumn("lane", F.col("lane") % lanes).groupBy("chunk", "lane").applyInArrow(added, "chunk long, lane long, counts binary")
        if lanes == 1:
            return parts.select("chunk", "counts")
        lanes //= FAN


def slot_rows(sums: DataFrame) -> DataFrame:
    """slot, f of the slots that occur."""

    def run(batches):
        for batch in batches:
            for c, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(value.as_py(), np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at + c * CHUNK), pa.array(counts[at])], names=["slot", "f"])

    return sums.mapInArrow(run, "slot long, f long")


def word_slots(frequent: DataFrame, words: Slots) -> DataFrame:
    """slot, lang, word of the frequent words."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(words.find(batch.column(0).to_numpy())), batch.column(1), batch.column(2)], names=["slot", "lang", "word"])

    return frequent.select("key", "lang", "word").mapInArrow(run, "slot long, lang string, word binary")


def phrase_slots(candidates: DataFrame, level: int, words: Slots, levels: list[Slots]) -> DataFrame:
    """slot, w (slots of its words), cuts (k, l, r: slots of the first k words and of the rest), inner (slots of its shorter phrases) of the candidates of ``level`` words."""
    base = bases(words, levels)

    def run(batches):
        for batch in batches:
            slot = levels[level - 2].find(batch.column(0).to_numpy())
            word, rest = [None] * level, slot
            for n in range(level, 1, -1):
                key = levels[n - 2].keys(rest)
                word[n - 1], rest = key & 0xFFFFFFFF, key >> 32
            word[0] = rest
            part = {(i, i + 1): w for i, w in enumerate(word)}  # slots of a level, by first word and end
            for n in range(2, level + 1):
                for i in range(level - n + 1):
                    part[i, i + n] = levels[n - 2].find(part[i, i + n - 1] << 32 | word[i + n - 1])
            part = {at: s + base[at[1] - at[0] - 1] for at, s in part.items()}
            listed = lambda columns, kind: pa.FixedSizeListArray.from_arrays(pa.array(np.stack(columns, 1).ravel(), kind), len(columns)).cast(pa.list_(kind))
            cuts = range(1, level)
            inner = [s for (i, j), s in part.items() if 1 < j - i < level]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0, level]), listed(word, pa.int64()), listed([part[0, k] for k in cuts], pa.int64()), listed([part[k, level] for k in cuts], pa.int64()), listed(inner, pa.int64()) if inner else pa.array([[]] * len(slot), pa.list_(pa.int64()))],
                names=["slot", "w", "firsts", "rests", "inner"],
            )

    return candidates.select("key").mapInArrow(run, "slot long, w array<long>, firsts array<long>, rests array<long>, inner array<long>")


@settled
def collocations(docs: DataFrame, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; see the module's text."""
    spark = docs.sparkSession
    texts = texts_of(docs, text_col, lang_col)
    counted = stored(word_counts(texts).groupBy("key", "lang", "word").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(counted.where(F.col("n") >= LEAST))
    words = Slots(frequent)
    sequences = stored(encoded(texts, words))
    levels: list[Slots] = []
    candidates: list[DataFrame] = []
    for _ in range(2, MOST_WORDS + 1):
        sums = key_sums(sequences, levels).groupBy("key").agg(F.sum("n").alias("n"))
        candidates.append(stored(sums.where(F.col("n") >= LEAST).select("key")))
        levels.append(Slots(candidates[-1]))
    counts = stored(slot_rows(tree_sum(stored(slot_counts(sequences, words, levels)))))
    size = words.size + sum(s.size for s in levels)
    phrases = None
    for level, keys in enumerate(candidates, 2):
        some = phrase_slots(keys, level, words, levels)
        phrases = some if phrases is None else phrases.unionByName(some)
    phrases = stored(phrases.join(counts, "slot").where(F.col("f") >= LEAST).withColumnRenamed("f", "a"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    inside = phrases.select("a", F.explode("inner").alias("slot")).groupBy("slot").agg(F.max("a").alias("longer"))
    alone = phrases.join(inside, "slot", "left").where(F.col("longer").isNull() | (100 * exact("longer") < COVER * exact("a"))).drop("longer", "inner")

    cuts = alone.select("slot", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut")).select("slot", "a", "k", "cut.*")
    for side, name in (("firsts", "l"), ("rests", "r")):
        cuts = dealt(cuts, counts.toDF(side, name), [side], size, F.col("slot"))
    scored = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = scored.groupBy("slot", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("slot", "a", "best.l", "best.r", "best.score")

    named = dealt(alone.select("slot", F.posexplode("w").alias("at", "word_slot")), word_slots(frequent, words).toDF("word_slot", "lang", "word"), ["word_slot"], words.size, F.col("slot"))
    spelled = named.groupBy("slot").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", F.decode("word", "UTF-8").alias("word")))).alias("words"))
    spelled = spelled.select("slot", "lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase"))
    ordered = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.join(spelled, "slot").withColumn("_part", F.pmod("slot", F.lit(FAN)))
    leading = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*ordered))).where(F.col("_nth") <= top)  # at most FAN * top rows of a language go on
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*ordered))).where(F.col("rank") <= top)
    out = stored(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))
    for table in (words, *levels):
        table.unpersist()
    return out
