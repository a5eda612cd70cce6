"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced k-means over a bounded sample: an overfull cluster repels further members.
Every vector is indexed: it goes to the posting list of its nearest centroid and, if it lies near a border, is
replicated to further lists whose centroids are at most (1 + CLOSURE) times as far, unless such a centroid is
closer to one already taken than to the vector.  Nearest centroids are found by a best-first walk over a
graph of the centroids that every worker holds in memory.  A query reads the lists whose centroids are at
most (1 + PRUNE) times as far as the nearest, PROBES at most, and further lists, nearest first, until they hold
ENOUGH entries for each result wanted: a vector that has a centroid to itself has no use for distance ratios.
If all near lists hold too few, all lists are read.

A list of any length is cut into pieces that are searched apart, each giving its best few, so no list is one
task's burden; queries meet lists through a join, and the exact cosine in double precision on original
vectors ranks what is found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, pick, tidy

#: Vectors in the sample that centroids are fitted on, about; centroids at most, and vectors a centroid.
SAMPLE, MOST_LISTS, PER_LIST = 20_000, 1024, 64
ROUNDS, PRESSURE = 12, 0.35
REPLICAS, CLOSURE = 6, 0.25
PROBES, PRUNE = 48, 0.6
#: Entries, replicas included, that the lists of a query hold for each of its k results; more than REPLICAS * 2.
ENOUGH = 100
#: Neighbours in the centroid graph, and candidates that a walk keeps open.
DEGREE, OPEN = 24, 96
#: Different lengths of vectors in a table at most; each has an index of its own.
LENGTHS = 16
#: Vectors in a piece of a posting list.
PIECE = 4096


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Graph:
    """Centroids on the unit sphere, and for each one its neighbours in the graph."""

    centroids: np.ndarray
    neighbours: np.ndarray
    start: int

    def nearest(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first, by best-first search from the most central one."""
        keep = max(count, OPEN)
        far = lambda ids: 2 - 2 * (self.centroids[ids] @ x)
        seen = np.zeros(len(self.centroids), bool)
        seen[self.start] = True
        first = float(far([self.start])[0])
        ahead, best = [(first, self.start)], [(-first, self.start)]
        while ahead:
            d, at = heapq.heappop(ahead)
            if len(best) >= keep and d > -best[0][0]:
                break
            new = self.neighbours[at]
            new = new[~seen[new]]
            seen[new] = True
            for d, i in zip(far(new).tolist(), new.tolist(), strict=True):
                if len(best) < keep or d < -best[0][0]:
                    heapq.heappush(ahead, (d, i))
                    heapq.heappush(best, (-d, i))
                    if len(best) > keep:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)[:count]
        return np.array([i for _, i in found]), np.maximum(np.array([d for d, _ in found]), 0)


def fit(sample: np.ndarray, lists: int, seed: int = 11) -> Graph:
    """Balanced k-means on unit vectors, and the graph of its centroids."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    counts = np.zeros(lists)
    for _ in range(ROUNDS):
        # a cluster's surplus over its fair share counts as distance
        surplus = PRESSURE * np.maximum(counts * lists / len(sample) - 1, 0)
        own = np.concatenate([(2 - 2 * part @ centroids.T + surplus).argmin(axis=1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        counts = np.bincount(own, minlength=lists).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = counts == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, : DEGREE + 1]
    links = [set(map(int, row)) - {i} for i, row in enumerate(near)]
    for i, row in enumerate(near):
        for j in row[1:]:
            links[int(j)].add(i)
    # a ring through all of them keeps the graph in one piece
    for i in range(lists):
        links[i] |= {(i + 1) % lists, (i - 1) % lists} - {i}
    width = max(1, max(map(len, links)))
    padded = np.array([[*sorted(x), *[i] * (width - len(x))] for i, x in enumerate(links)])
    return Graph(centroids, padded, int((centroids @ centroids.mean(axis=0)).argmax()))


def usable(vector: str | Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


PLACES = "vec_id long, vector array<double>, list int"


def placed(rows: DataFrame, graph, lengths: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """(vec_id, vector, list): the posting lists of each vector, or with their ``lengths`` the lists that it searches for ``k``."""

    def lists(x: np.ndarray) -> list[int]:
        ids, d = graph.value.nearest(x, PROBES if lengths is not None else 4 * REPLICAS)
        if lengths is not None:
            near = int((np.sqrt(d) <= (1 + PRUNE) * np.sqrt(d[0]) + 1e-9).sum())
            if lengths[ids].sum() < ENOUGH * k:
                ids, d = graph.value.nearest(x, len(lengths))
            full = int(np.searchsorted(np.cumsum(lengths[ids]), ENOUGH * k)) + 1
            return ids[: max(near, full)].tolist()
        taken = [int(ids[0])]
        for i, far in zip(ids[1:].tolist(), d[1:].tolist(), strict=True):
            if len(taken) == REPLICAS or np.sqrt(far) > (1 + CLOSURE) * np.sqrt(d[0]) + 1e-9:
                break
            if all(2 - 2 * float(graph.value.centroids[t] @ graph.value.centroids[i]) > far / 4 for t in taken):
                taken.append(i)
        return taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            found = [lists(x) for x in unit(vectors)]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(found), pa.int32())], ["vec_id", "vector", "list"])

    return rows.mapInArrow(tidy(run), PLACES)


def search(index: DataFrame, queries: DataFrame, graph, k: int) -> DataFrame:
    """(query_id, vec_id, score): each piece's best ``k`` for each query of its list."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / PIECE)).cast("int")
    # at most MOST_LISTS rows
    counts = index.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    known = np.zeros(len(graph.value.centroids), np.int64)
    for r in counts.collect():
        known[r["list"]] = r["n"]
    lengths = F.broadcast(counts.select("list", pieces.alias("pieces")))
    posted = index.join(lengths, "list").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces").cast("long")).cast("int")).drop("pieces")
    asked = placed(queries, graph, known, k).join(lengths, "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    both = posted.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    met = both.repartition("list", "piece").sortWithinPartitions("list", "piece", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, scale, known = None, [], None, None, []
        for batch in batches:
            key = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            own = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            rows = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            out: list[list] = [[], [], []]
            at = 0
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at] and asks[to] == asks[at]:
                    to += 1
                if key[at] != now:
                    now, ids, vectors, scale = key[at], [], None, None
                if not asks[at]:
                    ids.append(own[at:to])
                    vectors = rows[at:to] if vectors is None else np.concatenate([vectors, rows[at:to]])
                elif ids:
                    if scale is None:
                        known, vectors = once(np.concatenate(ids), vectors, k + 1)
                        scale = unit(vectors)
                    for q in range(at, to):
                        score = scale @ unit(rows[q : q + 1])[0]
                        # vectors near the border go along, to be told apart by the exact measure
                        border = np.partition(score, -k - 1)[-k - 1] if len(score) > k + 1 else -np.inf
                        some = np.flatnonzero(score >= border - 1e-9)
                        found = [(-s, i) for s, n in zip(cosines(rows[q], vectors[some]).tolist(), some.tolist(), strict=True) for i in known[n]]
                        for s, i in sorted(x for x in found if x[1] != own[q])[:k]:
                            out[0].append(int(own[q])), out[1].append(i), out[2].append(-s)
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return met.select("vec_id", "vector", "list", "piece", "asks").mapInArrow(tidy(run), "query_id long, vec_id long, score double")


def once(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[list[list[int]], np.ndarray]:
    """(the smallest ``most`` ids of each different vector, the different vectors)."""
    different, place = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, place.ravel()))
    firsts = np.searchsorted(place.ravel()[order], np.arange(len(different) + 1))
    return [ids[order[a : min(b, a + most)]].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], different


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of ``a`` and each row of ``b``; equal rows have equal results."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max(axis=1, keepdims=True)
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest other rows by cosine, among all rows.

    ``is_query`` is an expression over vec_id.  Vectors that are null, zero or hold null or non-finite
    components, and rows without id, take no part.  Ties go to the smaller id; equal vectors are different rows;
    a row given twice counts once; vectors of another length than most are an error of the input and are told
    apart by their length, and more than LENGTHS lengths are refused; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    known = pick(rows, vec_id=(id_col, "long"), vector=(vector_col, "array<double>")).filter(F.col("vec_id").isNotNull() & usable("vector")).distinct()
    sizes = [(r[0], r[1]) for r in known.groupBy(F.size("vector")).count().limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    found = None
    for size, count in sorted(sizes):
        own = known.filter(F.size("vector") == size)
        share = min(1.0, SAMPLE / count)
        chosen = own.filter(F.xxhash64(F.lit("sample"), "vec_id").bitwiseAND((1 << 53) - 1) < int(share * (1 << 53))) if share < 1 else own
        table = chosen.select("vec_id", "vector").toArrow()
        sample = np.array(table.column(1).to_pylist(), dtype=np.float64).reshape(-1, size)[np.argsort(np.asarray(table.column(0)), kind="stable")]
        lists = max(1, min(MOST_LISTS, count // PER_LIST))
        graph = spark.sparkContext.broadcast(fit(unit(sample), lists))
        index = cut(placed(own, graph))
        part = search(index, own.filter(is_query), graph, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    # a replicated vector is found in several lists
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
