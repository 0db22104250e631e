"""Rows that can have no partner in another table are told by bits, before anything is dealt out.

Hashes of one table's keys set bits in a table of bits that goes to every task; a row of the other table passes if all bits of its hash are set. None that has a partner is
held back, and few others pass; those are left to the join. The bits are set where the keys are, a chunk of them is put together in one task, and their number is bounded:
with more keys than they are made for more rows pass, and the join is as right as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Bits made for a key, and how many of them a key sets; the least and most bits (128 MB); bits of a chunk; places that a task holds before it sends them on.
BITS_A_KEY, PROBES = 16, 3
LEAST, MOST, CHUNK = 1 << 16, 1 << 30, 1 << 16
HELD = 1 << 21


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred, so that some of them can stand for all."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    at = mixed(h)
    return at + np.uint64(k) * (at >> np.uint64(32) | np.uint64(1)) & np.uint64(bits - 1)


class Sieve(NamedTuple):
    bits: int
    shared: Broadcast

    def passing(self, h: np.ndarray) -> np.ndarray:
        """The places in h (uint64) of hashes that may be among the keys."""
        held, at = self.shared.value, np.arange(len(h))
        for k in range(PROBES):  # the first leaves few to look at again
            place = _place(h[at], k, self.bits)
            at = at[held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0]
        return at


def _parts(places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Chunks of bits: the places in a chunk, or all of its bits where that is shorter."""
    place = np.unique(np.concatenate(places))
    chunk = (place // CHUNK).astype(np.int64)
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    parts = []
    for inside in np.split((place % CHUNK).astype(np.uint16), first[1:]):
        parts.append(inside.tobytes() if 2 * len(inside) < CHUNK // 8 else _packed(inside).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(parts, pa.binary())], names=["chunk", "part"])


def _packed(inside: np.ndarray) -> np.ndarray:
    bits = np.zeros(CHUNK, np.uint8)
    bits[inside] = 1
    return np.packbits(bits, bitorder="little")


def of(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], keys: int) -> Sieve:
    """The sieve of all hashes (uint64) that ``hashes`` gives for the batches of df; keys: about how many there are."""
    bits = min(MOST, max(LEAST, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length()))

    def marked(batches):
        held, n = [], 0
        for b in batches:
            for h in hashes(b):
                if len(h):
                    held += [_place(h, k, bits) for k in range(PROBES)]
                    n += PROBES * len(h)
                if n >= HELD:
                    yield from _parts(held)
                    held, n = [], 0
        if held:
            yield from _parts(held)

    def merged(batches):
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(part, np.uint8) if len(part) == CHUNK // 8 else _packed(np.frombuffer(part, np.uint16))
                chunks[chunk] = chunks[chunk] | new if chunk in chunks else new
        for chunk, x in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "part"])

    kind = "chunk long, part binary"
    held = np.zeros(bits // 8, np.uint8)
    for r in df.mapInArrow(marked, kind).repartition("chunk").mapInArrow(merged, kind).toLocalIterator():
        held[r.chunk * (CHUNK // 8) : (r.chunk + 1) * (CHUNK // 8)] = np.frombuffer(r.part, np.uint8)
    return Sieve(bits, df.sparkSession.sparkContext.broadcast(held))
