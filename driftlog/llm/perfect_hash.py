"""A minimal perfect hash over 64-bit keys with the keys stored by slot, in blocks of bounded size that tasks make one at a time and hold a few of."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .shingles import mix

BLOCK_KEYS = 1 << 18  # keys of a block on an average: 2.4 MB in a task that reads it and on its way through the driver, tens of MB in the task that makes it
HELD = 16  # blocks that a worker holds at a time
ROOM = 2.0  # bits per key still without a slot, at each level
U = np.uint64


def placed(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of ``size`` that a key names at a level."""
    return (mix(keys ^ mix(np.full(1, level + 1, U))) % U(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys. Level by level a key takes the bit that its hash names if no other key names it; its slot is the
    bit's rank. ``find`` compares the key stored in the slot, so that a strange key gets -1."""

    def __init__(self, keys: np.ndarray):
        keys = rest = np.asarray(keys).astype(np.int64).view(U)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        taken = 0
        while len(rest):
            size = int(ROOM * len(rest)) + 64
            place = placed(rest, len(self.levels), size)
            lone = np.bincount(place, minlength=size) == 1
            words = np.packbits(np.concatenate([lone, np.zeros(-size % 64, bool)]), bitorder="little").view("<u8")
            held = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, np.cumsum(held) - held, taken))
            taken += int(held.sum())
            rest = rest[~lone[place]]
            if len(self.levels) > 200:
                raise ValueError("keys must be distinct")
        self.stored = np.zeros(taken, U)
        self.stored[self.slots(keys)] = keys

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, before, base) in enumerate(self.levels):
            if not len(left):
                break
            at = placed(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            rank = np.bitwise_count(word & ((U(1) << bit) - U(1)))
            out[left[hit]] = base + before[at[hit] >> 6] + rank[hit]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(U)
        out = self.slots(keys)
        out[out >= 0] = np.where(self.stored[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    keys = keys.astype(np.int64)
    return ((keys ^ (keys >> 32)) & 0x7FFFFFFF) % blocks


def made(group: pa.Table) -> pa.Table:
    """A block's number, size and pickled hash, as one row."""
    table = PerfectHash(group.column("key").to_numpy())
    return pa.table({"block": group.column("block")[:1], "size": pa.array([len(table.stored)], pa.int64()), "table": pa.array([pickle.dumps(table, protocol=5)], pa.binary())})


class Slots:
    """The slots of a table's keys: one perfect hash per block of keys, made in a task. The driver passes them on to a broadcast one after the other, as bytes
    that it doesn't look into. A worker holds ``HELD`` blocks at most."""

    def __init__(self, keys: DataFrame, block_keys: int | None = None):
        spark, n = keys.sparkSession, keys.count()
        self.blocks = 1 + n // (block_keys or BLOCK_KEYS)
        self.shared, self.first, self.size = [], [], 0
        dealt = keys.select("key", ((F.col("key").bitwiseXOR(F.shiftright("key", 32)).bitwiseAND(0x7FFFFFFF)) % self.blocks).cast("int").alias("block"))
        tables = stored(dealt.repartition(self.blocks, "block").groupBy("block").applyInArrow(made, "block int, size long, table binary"))
        sizes = {r.block: r.size for r in tables.select("block", "size").collect()}  # one row per block
        empty = pickle.dumps(PerfectHash(np.zeros(0, np.int64)), protocol=5)
        for b in range(self.blocks):
            table = bytes(tables.where(F.col("block") == b).select("table").first()[0]) if b in sizes else empty
            self.shared.append(spark.sparkContext.broadcast(table))
            self.first.append(self.size)
            self.size += sizes.get(b, 0)
        forget(tables)
        self.held: dict[int, PerfectHash] = {}

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    def block(self, b: int) -> PerfectHash:
        if b not in self.held:
            if len(self.held) >= HELD:
                del self.held[next(iter(self.held))]
            self.held[b] = pickle.loads(self.shared[b].value)
            if hasattr(self.shared[b], "_value"):
                del self.shared[b]._value  # read again from the local copy when needed
        return self.held[b]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are none."""
        if self.blocks == 1:
            return self.block(0).find(keys)
        out, which = np.full(len(keys), -1, np.int64), block_of(keys, self.blocks)
        for b in np.unique(which):
            at = np.flatnonzero(which == b)
            found = self.block(b).find(keys[at])
            out[at] = np.where(found >= 0, found + self.first[b], -1)
        return out

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """The key stored in each slot."""
        out, which = np.zeros(len(slots), np.int64), np.searchsorted(self.first, slots, "right") - 1
        for b in np.unique(which):
            at = np.flatnonzero(which == b)
            out[at] = self.block(b).stored[slots[at] - self.first[b]].view(np.int64)
        return out

    def unpersist(self) -> None:
        for table in self.shared:
            table.destroy()
