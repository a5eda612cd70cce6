"""Rolling hashes, content-defined anchors and a merged count-min sketch.

A window of fixed length is represented by its *anchor*: the shorter piece inside it whose hash is
smallest, leftmost on ties.  Which piece that is depends on the window's content alone, so equal windows
have equal anchors at equal offsets, and a window occurs at most as often as its anchor.  Counting the
anchors, a few for a hundred windows, in a count-min sketch therefore overestimates the counts of all
windows: no repeated window is missed, whatever the sketch's load.

Sketches of all partitions are added cell by cell in range-sized pieces on the executors.  Only whether a
cell was hit twice comes to the driver, a bit a cell, and the numbers of the few cells hit more than ``hot`` times.
The number of cells follows from the bytes of text, SPARSE cells for each anchor, up to 2**MOST_BITS a row
(256 MB in all); beyond that more windows are estimated repeated than are, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import tidy

DEPTH, RANGE_BITS = 2, 16
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Cells of a row for each value expected, and the most bits that number them.
SPARSE, MOST_BITS = 8, 30
#: Values that are sketched together before they are sent.
AT_ONCE = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 5
_random = np.random.Generator(np.random.PCG64(20240229))
LETTERS = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n, kept and grown by doubling."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, size, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which any piece's hash follows; data: uint8."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(len(data))[0], out=out[1:])
    return out


def pieces(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each pair; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours the place of the smallest hash (its upper half), leftmost on ties."""
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < width:
        key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def cells(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each value in each row of a sketch of 2**bits cells a row, as int64."""
    mixed = ((values * np.uint64(m)) ^ (values >> np.uint64(29)) for m in MULTIPLIERS)
    return [(x >> np.uint64(64 - bits)).astype(np.int64) + (row << bits) for row, x in enumerate(mixed)]


class Seen:
    """Which cells were hit twice at least, as a bitmap, and which more than ``hot`` times, as a sorted list."""

    def __init__(self, bits: int, ranges: list[tuple[int, bytes, bytes]]):
        self.bits, step = bits, 1 << (RANGE_BITS - 3)
        self.twice = np.zeros(DEPTH << (bits - 3), np.uint8)
        hot = [np.zeros(0, np.int64)]
        for k, twice, much in ranges:
            self.twice[k * step : (k + 1) * step] = np.frombuffer(twice, np.uint8)
            hot.append(np.frombuffer(much, "<u2").astype(np.int64) + (k << RANGE_BITS))
        self.hot = np.sort(np.concatenate(hot))

    def repeated(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for c in cells(values, self.bits):
            out &= (self.twice[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out

    def frequent(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for c in cells(values, self.bits):
            at = np.minimum(np.searchsorted(self.hot, c), max(len(self.hot) - 1, 0))
            out &= self.hot[at] == c if len(self.hot) else False
        return out


def size_of(rows: DataFrame, spacing: int) -> int:
    """Bits that number the cells of a row for the texts of ``rows``, with a value every ``spacing`` bytes or so."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(ceil(log2(max(total / spacing, 1) * SPARSE)), RANGE_BITS), MOST_BITS)


def together(found: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same values, AT_ONCE or somewhat more at a time."""
    held: list[np.ndarray] = []
    for x in found:
        held.append(x)
        if sum(map(len, held)) >= AT_ONCE:
            yield np.concatenate(held)
            held = []
    if sum(map(len, held)):
        yield np.concatenate(held)


def sketched(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], hot: int, spacing: int) -> Broadcast:
    """Count-min sketch of ``values`` over all batches of ``rows``, as a broadcast ``Seen``.

    Every so many values, or a partition, send their own sketch sparsely, one row for each range of 65,536 cells it hits: the cells as
    16-bit numbers, once for each hit up to ``hot`` + 1.  A range is then summed in one counter array.
    """
    bits = size_of(rows, spacing)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in together(map(values, batches)):
            hit, times = np.unique(np.concatenate(cells(found, bits)), return_counts=True)
            hit = np.repeat(hit, np.minimum(times, hot + 1))
            at = hit >> RANGE_BITS
            cut = np.flatnonzero(np.diff(at)) + 1
            low = (hit & ((1 << RANGE_BITS) - 1)).astype("<u2")
            firsts = np.concatenate([[0], cut])
            sent = [pa.array(at[firsts], pa.int32()), pa.array([x.tobytes() for x in np.split(low, cut)], pa.binary())]
            yield pa.RecordBatch.from_arrays(sent, ["range", "hits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(1 << RANGE_BITS, np.int64)

        def summed() -> pa.RecordBatch:
            much = np.flatnonzero(counts > hot).astype("<u2").tobytes()
            made = [pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary()), pa.array([much], pa.binary())]
            return pa.RecordBatch.from_arrays(made, ["range", "twice", "hot"])

        for batch in batches:
            for k, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield summed()
                    now = k
                    counts[:] = 0
                counts += np.bincount(np.frombuffer(hits, "<u2"), minlength=1 << RANGE_BITS)
        if now is not None:
            yield summed()

    sent = rows.mapInArrow(tidy(partial), "range int, hits binary").repartition("range").sortWithinPartitions("range")
    merged = sent.mapInArrow(tidy(merge), "range int, twice binary, hot binary")
    seen = Seen(bits, [(r[0], bytes(r[1]), bytes(r[2])) for r in merged.collect()])
    return rows.sparkSession.sparkContext.broadcast(seen)
