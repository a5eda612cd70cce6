"""Sharding by minimax contiguous partition, in DataFrame operations only.

Documents of equal text are one atomic group; groups are ordered by the SHA-256 of their text.  The
partition into ``shards`` runs of consecutive groups whose largest shard is as small as can be is found
by binary search over the shard capacity: a capacity is feasible if filling shards greedily needs no
more than ``shards`` of them.

The groups themselves never leave the cluster.  The search runs over *cells*, the groups that share a
digest prefix: a first pass sums 65,536 cells, and later passes split, by two more hex digits at a time,
only cells that a best cut could still run through or that are large.  A cell of one group is not split
further, so the final capacity is exact for groups.  What the driver holds is bounded by the number of
cells, not of documents.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, documents

FIRST_DIGITS, MORE_DIGITS = 4, 2
#: A cell above this share of all bytes is split before the search begins.
LARGE = 1 / 512
#: Parts of a shard that are counted apart, so that numbering a shard's rows is no single task.
PARTS = 1024
#: Equal rows that one row tells out at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Cell:
    prefix: str
    size: int
    groups: bool  # more than one group


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the group's digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))


def fill(sizes: list[int], sums: list[int], capacity: int) -> list[int] | None:
    """Greedy cuts: for each shard the index after its last atom; None if an atom exceeds the capacity."""
    cuts, at = [], 0
    while at < len(sizes):
        end = bisect_right(sums, sums[at] + capacity) - 1
        if end == at:
            return None
        cuts.append(end)
        at = end
    return cuts


def smallest(sizes: list[int], shards: int) -> int:
    """The smallest capacity at which greedy filling of whole atoms needs at most ``shards`` shards."""
    sums = [0, *accumulate(sizes)]
    low, high = max([*sizes, -(-sums[-1] // shards), 1]), max(sums[-1], 1)
    while low < high:
        middle = (low + high) // 2
        cuts = fill(sizes, sums, middle)
        low, high = (low, middle) if cuts is not None and len(cuts) <= shards else (middle + 1, high)
    return low


def smallest_divisible(cells: list[Cell], shards: int) -> int:
    """A capacity below which no partition of groups can be: cells of several groups may be cut anywhere."""
    total = sum(c.size for c in cells)
    low, high = max([-(-total // shards), 1, *(c.size for c in cells if not c.groups)]), max(total, 1)
    sums = [0, *accumulate(c.size for c in cells)]
    while low < high:
        middle, at, used = (low + high) // 2, 0, 0
        while at < total and used <= shards:
            end = min(at + middle, total)
            k = bisect_right(sums, end) - 1
            if k < len(cells) and sums[k] < end and not cells[k].groups:
                end = sums[k]
            at, used = end, used + 1
        low, high = (low, middle) if used <= shards and at >= total else (middle + 1, high)
    return low


def touched(cells: list[Cell], shards: int, low: int, high: int) -> list[str]:
    """Prefixes of the cells of several groups through which a cut for a capacity in low..high can run."""
    sums = [0, *accumulate(c.size for c in cells)]
    found, early, late = set(), 0, 0
    for _ in range(shards):
        # earliest: shards filled to low that lose a whole cell at each border; latest: filled to high
        k = bisect_right(sums, early + low) - 1
        early = sums[min(k, len(cells))]
        late = min(late + high, sums[-1])
        first = max(bisect_right(sums, early) - 2, 0)
        last = min(bisect_right(sums, late), len(cells))
        found.update(c.prefix for c in cells[first:last] if c.groups)
    return sorted(found)


def cells_of(rows: DataFrame, digits: int, within: list[str] | None = None) -> list[Cell]:
    prefix = F.substring("digest", 1, digits)
    if within is not None:
        length = len(within[0])
        rows = rows.filter(F.substring("digest", 1, length).isin(within))
    out = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), (F.min("digest") != F.max("digest")).alias("groups"))
    return [Cell(*r) for r in out.collect()]


def boundaries(rows: DataFrame, shards: int) -> tuple[list[str], int]:
    """(digest prefixes at which shards 1, 2, ... start, capacity)."""
    cells = sorted(cells_of(rows, FIRST_DIGITS), key=lambda c: c.prefix)
    while cells:
        total = sum(c.size for c in cells)
        split = [c.prefix for c in cells if c.groups and c.size > LARGE * total]
        if not split:
            low, high = smallest_divisible(cells, shards), smallest([c.size for c in cells], shards)
            if low == high:
                break
            split = touched(cells, shards, low, high)
            if not split:
                break
        by_length: dict[int, list[str]] = {}
        for p in split:
            by_length.setdefault(len(p), []).append(p)
        gone = set(split)
        cells = [c for c in cells if c.prefix not in gone]
        for length, prefixes in by_length.items():
            cells += cells_of(rows, length + MORE_DIGITS, prefixes)
        cells.sort(key=lambda c: c.prefix)
    if not cells:
        return [], 0
    sizes = [c.size for c in cells]
    capacity = smallest(sizes, shards)
    cuts = fill(sizes, [0, *accumulate(sizes)], capacity) or []
    return [cells[k].prefix for k in cuts if k < len(cells)], capacity


def shard_of(digest: Column, starts: list[str]) -> Column:
    """A cell's prefix compares as a string before all digests of that cell and after all earlier ones."""
    out = F.lit(0)
    for s in starts:
        out = out + (digest >= F.lit(s)).cast("int")
    return out.cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into a shard under the law ``bytes``.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law ``bytes`` makes no
    promise about one more shard).  Equal texts share a shard; the largest shard is the smallest possible
    for groups in digest order.  Slots number a shard's rows without gaps: rows are counted by
    (shard, part of a hash of doc_id), the few counts are summed up in order, and rows are numbered within
    their part, so a shard's rows never meet in one task; equal rows are one row with a count until the end.  Null texts are empty (size 1, CRC of no
    bytes); null and repeated ids get slots of their own; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = sized(docs, id_col, text_col)
    starts, _ = boundaries(rows, shards)
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(PARTS)).cast("int").alias("part")
    dealt = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("digest"), starts).alias("shard"), part)
    # rows that are equal in all that is returned are one with a count, before and after the exchange
    own = cut(dealt.groupBy("shard", "part", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    # at most shards * PARTS rows
    counts = own.groupBy("shard", "part").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    earlier = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = own.withColumn("row", earlier).join(F.broadcast(offsets), ["shard", "part"])
    # equal rows are told out in blocks, which are spread if some rows have many
    blocks = numbered.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    if (counts.agg(F.max("most")).first()[0] or 0) > BLOCK:
        blocks = blocks.repartition("doc_id", "text_crc32", "at")
    last = F.least(F.col("n"), F.col("at") + BLOCK) - 1
    told = blocks.withColumn("copy", F.explode(F.sequence("at", last)))
    slot = (F.col("offset") + F.col("row") + F.col("copy")).cast("long").alias("slot")
    return told.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
