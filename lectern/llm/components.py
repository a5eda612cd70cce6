"""Connected components of an undirected graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, tidy

#: Links up to which they are joined in one task: 16 bytes each, whatever the corpus.
FEW = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each)."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        for end in (one, two):
            # the labels' own labels too, so that trees are joined and not only their nodes
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link; ``links`` has a and b.

    Up to ``few`` links are joined by one task.  More stay spread over the cluster: large and small stars
    take turns, so every node links its larger neighbours to its smallest neighbour, then itself and its smaller
    neighbours to it, until nothing changes.  The minimum of a node's neighbours is combined before each
    shuffle, and joins on it have one row a node on one side, so a node with many links can be split.  Each
    round is written to the shared checkpoint folder.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = cut(links.filter("a <> b").select(*ends))
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(tidy(_in_one_task), "node long, component long")
    edges, before = cut(edges.distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours of a node to the least around it
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # a node and its smaller neighbours to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(pair).alias("x")).select("x.a", "x.b")
        edges = cut(small.filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
    nodes, component = least_reachable(*np.concatenate(found, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(component)], ["node", "component"])
