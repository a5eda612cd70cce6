"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints within ``RADIUS`` bits of each other differ in at most RADIUS blocks of bits, so of B blocks they
agree in B - RADIUS at least.  Each distinct fingerprint goes to one *segment* for each choice of so many blocks:
all fingerprints with the same leading bits there.  How many blocks, and how many of their bits name a segment,
follows from the number of fingerprints, so that a segment holds about SEGMENT of them at any size.

In a segment fingerprints are sorted by their rank in the reflected Gray code, where neighbours share long
runs of bits.  Over the sorted list stands a hierarchy: each node keeps the bits that all fingerprints below
it share, as a mask and a pattern.  Two nodes whose shared patterns differ in more than RADIUS places are
pruned with everything below them; the rest is followed down to single fingerprints.  Nodes whose
fingerprints are all known to be connected are skipped, so a dense cluster is not compared pair by pair.  What is
sent on is a star for each component of a segment, so that joining the segments takes few rounds.

A segment of more than CHUNK fingerprints is cut into chunks, and every pair of chunks is a task of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, documents, near, tidy
from lectern.llm.components import components

RADIUS = 3
#: Numbers of blocks, each with the bits that RADIUS of them leave at least.
BLOCKS = ((4, 16), (5, 25), (6, 31))
#: Fingerprints of a segment on average, and those beyond which it is cut.
SEGMENT, CHUNK = 512, 2048
#: Crowded segments up to which they are broadcast.
BROADCAST = 1 << 18
#: Fingerprints below one node of the lowest level, and nodes below one node of a higher one.
LEAF, FAN = 4, 8
#: Node pairs that are looked at together.
PAIRS = 1 << 16
#: Words of a text whose shingles are hashed at a time.
STRIDE = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if it is set in over half the XXH64 values of the text's shingles, repeats included."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.array([len(w) + 1 for w in words])) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(len(words) - shingle + 1, 1)
    last = min(shingle, len(words)) - 1
    totals = np.zeros(64, np.int64)
    for at in range(0, n, STRIDE):
        to = min(at + STRIDE, n)
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:to], ends[at + last : to + last], strict=True)], dtype=">u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits); null texts are empty and have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class Forest:
    """Union-find over places; ``links`` are the unions that joined something."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        one, two = self.find(a), self.find(b)
        if one != two:
            self.parent[max(one, two)] = min(one, two)
            self.links.append((a, b))

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.parent))])


def grouped(x: np.ndarray, size: int, how) -> np.ndarray:
    return how.reduceat(x, np.arange(0, len(x), size))


class Index:
    """The hierarchy over fingerprints in Gray order: for each level, from single ones up, (mask, pattern)."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.pruned, self.met = fps, 0, 0
        self.levels = [(np.full(len(fps), ~np.uint64(0)), fps)]
        self.sizes = [1]
        while len(self.levels[-1][1]) > 1:
            size = LEAF if len(self.levels) == 1 else FAN
            mask, pattern = self.levels[-1]
            ones, zeros = grouped(pattern & mask, size, np.bitwise_and), grouped(~pattern & mask, size, np.bitwise_and)
            self.levels.append((ones | zeros, ones))
            self.sizes.append(size)

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of all pairs within RADIUS, as pairs of places."""
        forest = Forest(len(self.fps))
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        labels, known = np.arange(len(self.fps)), 0
        single: dict[int, np.ndarray] = {}
        while stack:
            level, a, b = stack.pop()
            if len(forest.links) > known:
                known, labels, single = len(forest.links), forest.labels(), {}
            if level == 0:
                new = labels[a] != labels[b]
                for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
                    forest.union(x, y)
                continue
            size, below = self.sizes[level], len(self.levels[level - 1][1])
            steps = np.arange(size)
            x = np.repeat((a[:, None] * size + steps), size, axis=1).ravel()
            y = np.tile((b[:, None] * size + steps), (1, size)).ravel()
            keep = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
            x, y = x[keep], y[keep]
            mask, pattern = self.levels[level - 1]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= RADIUS
            self.met += len(x)
            x, y = x[near], y[near]
            if level > 1:
                self.pruned += len(near) - len(x)
            if known:
                if level - 1 not in single:
                    spans = int(np.prod(self.sizes[1:level])) if level > 1 else 1
                    low, high = grouped(labels, spans, np.minimum), grouped(labels, spans, np.maximum)
                    single[level - 1] = np.where(low == high, low, -1)
                s = single[level - 1]
                apart = (s[x] < 0) | (s[x] != s[y])
                x, y = x[apart], y[apart]
            if level == 1:
                # nearest in Gray order first: they connect most of a cluster
                order = np.argsort(y - x, kind="stable")
                x, y = x[order], y[order]
            for at in range(0, len(x), PAIRS >> 6):
                stack.append((level - 1, x[at : at + (PAIRS >> 6)], y[at : at + (PAIRS >> 6)]))
        return forest.links


def segment_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints, as places."""
    order = np.argsort(gray_rank(fps))
    found = order[np.array(Index(fps[order]).links(), dtype=np.int64).reshape(-1, 2)]
    return found[:, 0], found[:, 1]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as nodes at most that connect the same fingerprints, each node straight to one of its component."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True):
        forest.union(x, y)
    roots = forest.labels() if len(nodes) else np.zeros(0, np.int64)
    leaves = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[leaves], nodes[roots[leaves]]


def layout(n: int) -> tuple[int, int]:
    """(blocks, bits that name a segment) for ``n`` fingerprints."""
    wanted = max(0, ceil(log2(max(n, 1) / SEGMENT)))
    blocks, most = next((x for x in BLOCKS if wanted <= x[1]), BLOCKS[-1])
    return blocks, min(wanted, most)


def segments(fp: str, n: int) -> Column:
    """The segments of a fingerprint: for each choice of blocks, its number and the leading bits of these blocks."""
    blocks, width = layout(n)
    if not width:
        return F.array(F.lit(0).cast("long"))
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        value, bits = F.lit(0).cast("long"), 0
        for k in chosen:
            size = edges[k + 1] - edges[k]
            part = F.shiftrightunsigned(fp, edges[k]).bitwiseAND((1 << size) - 1)
            value, bits = F.shiftleft(value, size).bitwiseOR(part), bits + size
        out.append(F.lit(i << 32).cast("long") + F.shiftrightunsigned(value, bits - width))
    return F.array(*out)


def fingerprint_links(distinct: DataFrame, name: str = "fp") -> DataFrame:
    """(a, b), some of them several times: links among distinct fingerprints (column fp) that connect all within RADIUS bits.

    Ends are told by the column ``name``, a long that is different for each fingerprint.
    """
    given = distinct.select("fp", F.col(name).alias("name"))
    keyed = given.select("fp", "name", F.explode(segments("fp", given.count())).alias("segment"))
    counts = keyed.groupBy("segment").count().filter(F.col("count") > CHUNK)
    crowded = near(cut(counts.select("segment", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))), BROADCAST)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks").cast("long")).cast("int")
    dealt = keyed.join(crowded, "segment", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    last = F.coalesce("chunks", F.lit(1)) - 1
    met = dealt.select("fp", "name", "segment", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    pairs = met.select("segment", low, high, "fp", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            if rest is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(rest, columns, strict=True)]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in columns[:3]], axis=0)) + 1
            if len(change):
                at = change[-1]
                parts = [np.split(x[:at], change[:-1]) for x in columns[3:]]
                yield linked(list(zip(*parts, strict=True)))
                columns = [x[at:] for x in columns]
            rest = columns
        if rest is not None:
            yield linked([(rest[3], rest[4])])

    def linked(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = [np.zeros((2, 0), np.int64)]
        for fps, names in parts:
            if len(fps) > 1:
                a, b = segment_links(fps.view(np.uint64))
                ends.append(np.stack(stars(names[a], names[b])))
        a, b = np.concatenate(ends, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = pairs.repartition("segment", "low", "high").sortWithinPartitions("segment", "low", "high")
    return met.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Documents are linked if their fingerprints differ in at most RADIUS bits; component_id is the smallest
    doc_id that links reach.  Texts of equal fingerprint are one node, so copies cost nothing more.  Null and
    empty texts have fingerprint 0; texts of fewer words than a shingle are one shingle; a null id is in a
    component like any other but cannot name one unless all its members are null; repeated rows and ties share
    a component; an empty table gives an empty result; other columns are ignored.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(fingerprint_links(distinct.select("fp")))
    # the least fingerprint names a component; its least document takes over
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
