"""Near-duplicate groups by exact Jaccard similarity of word shingles, seeded by SimHash.

Documents with equal sets of shingles are one *node*.  Groups are found in two steps, and every link that either
step proposes is verified by all shingles of both texts:

1. Seeds.  Nodes whose SimHash fingerprints the Gray-order index links (see ``simhash``), and nodes that share one
   of a few MinHash values with a more central one, whose shingles are more common.  Each such bucket proposes
   a star around its most central node, never all its pairs, and dense groups of copies are connected by
   that.
2. The rest, exactly, by prefix filtering.  Shingles are put in one order for the whole corpus, rarest first as
   far as a table of counts of fixed size tells; any order gives the same result.  Two sets of similarity t or
   more share a shingle among the first n - ceil(t n) + 1 of each, so only these *prefixes* meet, and of them
   only shingles that a count-min sketch estimates to stand in several.  Nodes that the
   seeds have connected are not compared again.  Of the other pairs that meet, three bounds that no pair of
   similarity t fails take out most: of the sizes, of the places of the shared shingle, and of a parity bitmap
   (each shingle flips one bit, so two bitmaps differ in at most as many bits as the sets do).

So no link between nodes of different groups is lost, and the pairs of a group that is already known to be one
are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches as bounded
from lectern.llm.common import cut, documents, narrow, near, tidy
from lectern.llm.components import components
from lectern.llm.pii import bitmap
from lectern.llm.simhash import LOWER, fingerprint_links
from lectern.llm.sketch import mix, pieces, prefix, sketched

SHINGLE, SIMILARITY = 5, 0.8
#: Cells of the table of counts, and of a range of it that is summed at a time.
CELL_BITS, RANGE_BITS = 20, 14
#: Nodes that a worker remembers to send once, pairs that are looked at together, and shingles that are sent together.
MEMORY, PAIRS, AT_ONCE = 1 << 18, 1 << 17, 1 << 18
#: Bits of a parity bitmap, in longs.
PARITY = 4
#: MinHash values of a node.
SEEDS = 4
#: Bytes of text for each shingle of a prefix, or some more.
SPACING = 40
#: Connected nodes up to which their labels are broadcast.
LABELS = 1 << 20
PARITIES = [f"p{k}" for k in range(PARITY)]
NAMES = ["token", "chunks", "node", "place", *PARITIES]
#: Beyond this count in its cell, a shingle's nodes are dealt to chunks, and pairs of chunks meet.
CROWD = 1 << 14


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, without words none."""
    joined = b" ".join((text or "").encode("utf-8").translate(LOWER).split())
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    n = max(len(starts) - size + 1, 1)
    return np.unique(pieces(prefix(data), starts[:n], ends[min(size, len(starts)) - 1 :][:n]))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def cell(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def fingerprint(own: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes."""
    bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(own)).tobytes(), "big", signed=True)


def parity(own: np.ndarray) -> np.ndarray:
    """PARITY longs in which each shingle flips one bit."""
    width = 64 * PARITY
    return np.packbits(np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 == 1).view(np.int64)


def needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Shingles that sets of these sizes must share."""
    return np.ceil((a + b) * (t / (1 + t)) - 1e-9)


def counted(rows: DataFrame, size: int) -> Broadcast:
    """For each cell of shingles a level that rises with their count; 2**CELL_BITS bytes."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, n = np.unique(cell(shingles(text, size)), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if counts.any():
            parts = np.split(counts, 1 << (CELL_BITS - RANGE_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["range", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        levels = [(8 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(levels, pa.binary())], ["range", "levels"])

    sent = rows.select("text").mapInArrow(tidy(partial), "range int, counts binary")
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for k, x in sent.repartition("range").mapInArrow(tidy(merge), "range int, levels binary").collect():
        out[k << RANGE_BITS : (k + 1) << RANGE_BITS] = np.frombuffer(bytes(x), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def distinct_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its shingles) of the texts in column 0, a worker's repeated nodes mostly once.

    Every so many shingles, and at the end of a batch, comes a pair without shingles: what was made is to be sent.
    """
    size_now = 0
    sent: set[int] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = shingles(text, size)
            node = node_of(own)
            if not len(own) or node in sent:
                continue
            if len(sent) > MEMORY:
                sent.clear()
            sent.add(node)
            yield node, own
            size_now += len(own)
            if size_now > AT_ONCE:
                size_now = 0
                yield -1, np.zeros(0, np.uint64)
        yield -1, np.zeros(0, np.uint64)


def seeds(rows: DataFrame, levels: Broadcast, size: int) -> DataFrame:
    """(bucket, common, node, n, parity bitmap): for each node its MinHash values, and how common its shingles are."""
    names = ["bucket", "common", "node", "n", *PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node, own in distinct_sets(batches, size):
            if len(own):
                common = int(1e6 * levels.value[cell(own)].mean())
                mine = (common, node, len(own), *parity(own).tolist())
                lowest = [int(mix(own + np.uint64(k)).min()) - (1 << 63) for k in range(1, SEEDS + 1)]
                out += [(x, *mine) for x in lowest]
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                out = []

    return rows.select("text").mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))


def within_bounds(one: str, two: str, t: float) -> Column:
    """Whether two nodes with n and parity bitmaps can have similarity t."""
    n, m = F.col(f"{one}.n"), F.col(f"{two}.n")
    apart = sum((F.bit_count(F.col(f"{one}.{p}").bitwiseXOR(F.col(f"{two}.{p}"))) for p in PARITIES), F.lit(0))
    need = F.ceil((n + m) * F.lit(t / (1 + t)) - F.lit(1e-9))
    return (F.least(n, m) >= need) & (apart <= n + m - 2 * need)


def seed_pairs(rows: DataFrame, given: DataFrame, levels: Broadcast, size: int, t: float) -> DataFrame:
    """(a, b): pairs of nodes, a few for each node that has anything in common with others."""
    sent = cut(seeds(given, levels, size))
    # the most central node of each bucket
    best = F.max(F.struct("common", "node", "n", *PARITIES)).alias("two")
    met = sent.select("bucket", F.struct("node", "n", *PARITIES).alias("one")).join(sent.groupBy("bucket").agg(best), "bucket")
    stars = met.filter((F.col("one.node") != F.col("two.node")) & within_bounds("one", "two", t))
    linked = fingerprint_links(rows.filter("fp is not null").groupBy("fp").agg(F.min("node").alias("node")), "node")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return stars.select(*pair("one.node", "two.node")).unionByName(linked.select(*pair("a", "b")))


def prefix_of(own: np.ndarray, levels: Broadcast, t: float) -> np.ndarray:
    """Places in ``own`` of its prefix, in the corpus's order."""
    n = len(own)
    return np.lexsort((own, levels.value[cell(own)]))[: n - int(np.ceil(t * n - 1e-9)) + 1]


def repeated(rows: DataFrame, levels: Broadcast, size: int, t: float) -> Broadcast:
    """A count-min sketch of all prefixes: a shingle that stands in one of them only has nothing to meet."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        sets = (own for _, own in distinct_sets(iter([batch]), size) if len(own))
        return np.concatenate([np.zeros(0, np.uint64), *(own[prefix_of(own, levels, t)] for own in sets)])

    return sketched(rows.select("text"), values, hot=1 << 30, spacing=SPACING)


def prefixes(rows: DataFrame, levels: Broadcast, seen: Broadcast, size: int, t: float) -> DataFrame:
    """(token, chunks: pair of chunks, node, place: place << 32 | size of the set, parity bitmap) for each text's prefix.

    Only shingles that the sketch estimates to stand in several prefixes are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in NAMES]
        for node, own in distinct_sets(batches, size):
            if not len(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], NAMES)
                out = [[] for _ in NAMES]
                continue
            tokens = own[prefix_of(own, levels, t)]
            place = np.flatnonzero(seen.value.repeated(tokens))
            chunks = np.ceil(np.exp2((levels.value[cell(tokens[place])] + 1.0) / 8) / CROWD).astype(np.int64)
            at = np.repeat(place, chunks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            mine = node % np.repeat(chunks, chunks)
            pair = np.minimum(mine, other) << 32 | np.maximum(mine, other)
            same = [np.full(len(at), p) for p in parity(own)]
            for column, x in zip(out, (tokens[at].view(np.int64), pair, np.full(len(at), node), at << 32 | len(own), *same), strict=True):
                column.append(x)

    return rows.select("text").mapInArrow(tidy(run), ", ".join(f"{x} long" for x in NAMES))


def near_pairs(columns: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one token, of different groups, that no bound takes out; columns: node, group, place, parity."""
    _, at = np.unique(columns[0], return_index=True)
    node, group, place, *bits = (x[at] for x in columns)
    n = place & 0xFFFFFFFF
    order = np.argsort(n, kind="stable")
    node, group, n, before = node[order], group[order], n[order], place[order] >> 32
    bits = [x[order].view(np.uint64) for x in bits]
    # of two sets of similarity t, the smaller one has a shared shingle among even fewer of its first ones
    early = before <= n - np.ceil(2 * t / (1 + t) * n - 1e-9)
    most = np.searchsorted(n, np.floor(n / t + 1e-9), side="right")
    a_found, b_found = [], []
    step = max(1, PAIRS // max(len(node), 1))
    for low in range(0, len(node), step):
        a = np.arange(low, min(low + step, len(node)))
        a = a[early[a]]
        many = most[a] - a - 1
        x = np.repeat(a, many)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        new = group[x] != group[y]
        x, y = x[new], y[new]
        need = needed(n[x], n[y], t)
        keep = np.minimum(n[x] - before[x], n[y] - before[y]) >= need
        x, y, need = x[keep], y[keep], need[keep]
        apart = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in bits)
        keep = apart <= n[x] + n[y] - 2 * need
        a_found.append(node[x[keep]]), b_found.append(node[y[keep]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a_found]), np.concatenate([empty, *b_found])


def candidates(sent: DataFrame, t: float) -> DataFrame:
    """(a, b): pairs of nodes of different groups that share a shingle of their prefixes and pass the bounds."""
    names = ["token", "chunks", "node", "component", "place", *PARITIES]

    def found(groups: list[list[np.ndarray]]) -> pa.RecordBatch:
        pairs = [near_pairs(x, t) for x in groups]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in pairs)]) for i in range(2))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(len(names))]
            if rest is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(rest, columns, strict=True)]
            edges = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            edges = np.concatenate([[0], edges])
            # a bucket of one group has nothing to compare
            mixed = np.concatenate([[0], np.cumsum(np.diff(columns[3]) != 0)])
            many = np.flatnonzero(mixed[edges[1:] - 1] > mixed[edges[:-1]])
            yield found([[x[edges[k] : edges[k + 1]] for x in columns[2:]] for k in many.tolist()])
            rest = [x[edges[-1] :] for x in columns]
        if rest is not None:
            yield found([rest[2:]])

    dealt = sent.select(*names).repartition("token", "chunks").sortWithinPartitions("token", "chunks")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def similar(pairs: DataFrame, size: int, t: float) -> DataFrame:
    """(a, b) of those pairs with texts (one, two) whose shingles have similarity t or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, shingles(one.as_py(), size)
                y = shingles(two.as_py(), size)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= t * (len(x) + len(y) - shared) - 1e-9)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return pairs.select("a", "b", "one", "two").mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, given: DataFrame, size: int, t: float) -> DataFrame:
    """(a, b) of those ``pairs`` (a written table) that are similar; only texts of nodes in question are sent."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = narrow(nodes.join(near(cut(ends)), "node", "left_semi").select("node", "code"))
    lets = bitmap(wanted, F.col("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lets.value.has(batch.column(0).to_numpy())))

    held = given.select("code", "text").mapInArrow(tidy(run), "code long, text string").groupBy("code").agg(F.min("text").alias("text"))
    texts = cut(held.join(near(wanted), "code").select("node", "text"))
    # the ends that stand in many pairs come last, so that their shingles are made once
    sides = texts.select(F.col("node").alias("b"), F.col("text").alias("two")).join(near(pairs), "b")
    return similar(sides.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a"), size, t)


def grouped(docs: DataFrame, size: int, t: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, code, node) of every document, and (node, first, least) of every node.

    first is the node's first document, least that of its group: by (id is null, doc_id, code).
    """
    bounded(docs.sparkSession)
    given = documents(docs, id_col, text_col).withColumn("code", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for text in batch.column(2).to_pylist():
                own = shingles(text, size)
                told.append((node_of(own), fingerprint(own) if len(own) else None))
            made = [pa.array([x[i] for x in told], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "code", "node", "fp"])

    rows = cut(given.select("doc_id", "code", "text").mapInArrow(tidy(run), "doc_id long, code long, node long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "code")).alias("first")
    nodes = cut(rows.groupBy("node").agg(F.min("code").alias("code"), first))
    levels = counted(given, size)
    proposed = narrow(narrow(seed_pairs(rows, given, levels, size, t)).distinct())
    seeded = narrow(verified(proposed, nodes, given, size, t))
    labels = narrow(components(seeded))
    seen = repeated(given, levels, size, t)
    sent = prefixes(given, levels, seen, size, t).join(near(labels, LABELS), "node", "left")
    rest = narrow(narrow(candidates(sent.withColumn("component", F.coalesce("component", "node")), t)).distinct())
    if not rest.isEmpty():
        labels = narrow(components(seeded.unionByName(verified(rest, nodes, given, size, t))))
    levels.unpersist(), seen.unpersist()
    connected = narrow(nodes.join(near(labels), "node").select("node", "component", "first"))
    least = narrow(connected.groupBy("component").agg(F.min("first").alias("least")))
    named = narrow(labels.join(near(least), "component").select("node", "least"))
    return rows, nodes.join(near(named), "node", "left").select("node", "first", F.coalesce("least", "first").alias("least"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, t: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every document.

    Documents are linked if the sets of their shingles have Jaccard similarity t or more; component_id is the
    smallest doc_id that links reach.  Null texts, empty texts and texts without a word have equal, empty sets.
    Null ids are in a component like others but cannot name one unless all its members are null; an empty
    table gives an empty result; other columns are ignored.
    """
    rows, nodes = grouped(docs, size, t, id_col, text_col)
    return rows.join(nodes, "node").select("doc_id", F.col("least.doc_id").alias("component_id"))


def kept(docs: DataFrame, size: int = SHINGLE, t: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, code) of the document that stays of each group of ``near_duplicates``; code is the hash of its text."""
    _, nodes = grouped(docs, size, t, id_col, text_col)
    return nodes.filter(F.col("first").eqNullSafe(F.col("least"))).select("first.doc_id", "first.code")
