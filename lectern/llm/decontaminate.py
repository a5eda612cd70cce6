"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A document is contaminated by a benchmark item if a window of as many words as the item has a weighted
shingle similarity of THRESHOLD or more with it: shingles of five words (an item of fewer words is one
shingle), weighted by how often they occur, sum of minima over sum of maxima.

1. Windows without a shingle of any item have similarity 0.  More than that, a window of similarity t misses
   at most 1 - t of an item's shingles, so it has one of any larger share of them.  Each item's shingles with
   the longest first words, just more than 1 - t of them, are its *probes*.  All documents are searched for
   probes, which only costs a lookup for most words, and only documents with one go on.
2. In these, shingles are looked up among the items' shingles.  A window of similarity t shares at least
   t / (1 + t) of both sides' shingles, so every start is tried from which that many places of hits on one
   item lie in the window, in whatever order; no other start can reach t.
3. These windows get a SimHash fingerprint of their words, as items do.  A changed word changes five shingles
   but one word, and a moved part hardly changes any, so windows of similarity t are within RADIUS bits of the item
   nearly always, while other windows seldom are.  Windows and items of one size meet by multi-index blocks: the
   64 bits are cut into RADIUS + 1 blocks, and fingerprints within RADIUS bits agree in one block at least.
4. Pairs within RADIUS are verified by their exact similarity.

Windows travel as (document, place, hash of their shingles).  Equal windows of many documents are one to compare,
and words and shingles are made for one of them only.

Items are held against all documents, so they are the small side: they are broadcast if their shingles were
counted and are few, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc32_text, cut, narrow, pick
from lectern.llm.common import near as nearby
from lectern.llm.substring import NO_ID

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 11
#: Shingles of all items up to which they are broadcast.
BROADCAST = 500_000
#: First words of probes up to which they are a set in the plan; beyond, all shingles are looked up.
LITERALS = 20_000


def words_of(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def paired(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def hashed(rows: DataFrame, kinds: list[int]) -> DataFrame:
    """Columns n (number of words), h1 (their hashes) and, for each k of ``kinds``, h{k}: hash of the k words from each place on."""
    out = rows.withColumn("h1", F.transform(words_of("text"), lambda w: F.xxhash64(w))).withColumn("n", F.size("h1"))
    made = {2: (1, 1, 2), 3: (2, 1, 3), 4: (2, 2, 3), 5: (4, 1, 5)}
    needed = {k for k in made if k in kinds or (k == 2 and set(kinds) & {3, 4, 5}) or (k == 4 and 5 in kinds)}
    for k in sorted(needed):
        one, two, at = made[k]
        out = out.withColumn(f"h{k}", paired(F.col(f"h{one}"), F.slice(f"h{two}", at, F.size(f"h{two}"))))
    cut_off = {f"h{k}": F.slice(f"h{k}", 1, F.greatest(F.col("n") - (k - 1), F.lit(0))) for k in needed}
    return out.withColumns(cut_off) if cut_off else out


def by_kind(k: str | Column, kinds: list[int]) -> Column:
    """The column h{k} of ``hashed`` for the k of a row."""
    out = F.lit(None).cast("array<bigint>")
    for each in kinds:
        out = F.when((F.col(k) if isinstance(k, str) else k) == each, F.col(f"h{each}")).otherwise(out)
    return out


def simhash(shingles: str) -> Column:
    """Each bit is 1 if it is set in over half the hashes."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, k) -> bits | shiftleft(if(2 * size(filter({shingles}, h -> (shiftright(h, k) & 1L) = 1L)) > size({shingles}), 1L, 0L), k))")


def blocks(fp: str) -> Column:
    """(block, its bits) for each of the RADIUS + 1 blocks of a fingerprint."""
    edges = [round(64 * k / (RADIUS + 1)) for k in range(RADIUS + 2)]
    cuts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*cuts)


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, code, k, size, shingles, fp) of every item with a word; code tells items of equal id apart."""
    kinds = list(range(1, SHINGLE + 1))
    rows = pick(benchmark, item_id=(id_col, "long"), text=(text_col, "string")).filter("text is not null")
    rows = hashed(rows.withColumn("code", F.xxhash64("text")).distinct(), kinds).filter("n > 0")
    rows = rows.withColumn("k", F.least(F.lit(SHINGLE), "n")).withColumn("shingles", by_kind("k", kinds))
    led = F.zip_with(
        F.slice(words_of("text"), F.lit(1), F.size("shingles")), "shingles",
        lambda w, h: F.struct((-F.length(w)).alias("rank"), w.alias("word"), h.alias("shingle")),
    )
    enough = (F.floor(F.size("shingles") * (1 - THRESHOLD) + 1e-9) + 1).cast("int")
    probes = F.slice(F.array_sort(led), F.lit(1), enough).alias("probes")
    return rows.select("item_id", "code", "k", F.col("n").alias("size"), "shingles", simhash("h1").alias("fp"), probes)


def shingle_at(words: Column, i: Column, k: int) -> Column:
    """The hash that ``shingled`` gives to the k words from place i on."""
    h = [F.xxhash64(F.get(words, i + j)) for j in range(k)]
    if k == 1:
        return h[0]
    out = F.xxhash64(h[0], h[1])
    if k == 3:
        return F.xxhash64(out, h[2])
    if k >= 4:
        out = F.xxhash64(out, F.xxhash64(h[2], h[3]))
    return F.xxhash64(out, h[4]) if k == 5 else out


def with_probe(rows: DataFrame, items: DataFrame, kinds: list[int], near) -> DataFrame:
    """The documents in which a probe of some item occurs, repeated rows once."""
    probes = items.select("k", F.explode("probes").alias("p")).select("k", "p.word", "p.shingle").distinct()
    words = [r[0] for r in probes.select("word").distinct().limit(LITERALS + 1).collect()]
    if len(words) <= LITERALS:
        split = rows.withColumn("words", words_of("text"))
        places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(words), i)), lambda i: i.isNotNull())
        placed = split.select("key", "crc", "words", places.alias("places")).filter(F.size("places") > 0)
        hits = F.explode(F.array_distinct(F.concat(*(_hits(k) for k in kinds)))).alias("x")
        found = placed.select("key", "crc", hits).select("key", "crc", "x.k", "x.shingle")
        held = found.join(near(probes.select("k", "shingle").distinct()), ["k", "shingle"], "left_semi")
        held = narrow(held.select("key", "crc").distinct())
        rows = rows.join(nearby(held), ["key", "crc"], "left_semi")
    # wide rows, but those of documents that hold a probe only
    return cut(rows.groupBy("key", "crc").agg(F.min("text").alias("text")))


def _hits(k: int) -> Column:
    return F.transform("places", lambda i: F.struct(F.lit(k).alias("k"), shingle_at(F.col("words"), i, k).alias("shingle")))


def promising() -> Column:
    """Every start of a window that holds enough of ``places``, sorted places of hits of one item in one document.

    Enough places lie in the window if some place and the one ``enough`` - 1 after it do.  That gives an
    interval of starts for each place; what an interval shares with the one before is left to that one.
    """
    less = F.col("k") - 1
    of_item, of_window = F.col("size") - less, F.least("size", "n") - less
    enough = F.ceil((of_item + of_window) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).cast("int")
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))

    def interval(place: Column, i: Column) -> Column:
        end = F.get("places", i + enough - 1)
        low = F.greatest(F.lit(0), end - of_window + 1, F.when(i > 0, F.get("places", i - 1) + 1).otherwise(0))
        high = F.least(place, last)
        return F.when(end.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform("places", interval))


def windows_of(keyed: DataFrame, items: DataFrame, kinds: list[int], near) -> DataFrame:
    """(key, crc, k, size, start, kind) of every window that can be similar to an item; kind tells different windows apart."""
    spots = items.select("item_id", "code", "k", "size", F.explode(F.array_distinct("shingles")).alias("shingle"))
    made = hashed(keyed, kinds)

    def laid(k: int) -> Column:
        return F.transform(f"h{k}", lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("place"), h.alias("shingle")))

    places = made.select("key", "crc", "n", F.explode(F.concat(*map(laid, kinds))).alias("x")).select("key", "crc", "n", "x.*")
    hits = places.join(near(spots), ["k", "shingle"]).repartition("key", "crc")
    hits = hits.groupBy("key", "crc", "n", "k", "item_id", "code", "size").agg(F.sort_array(F.collect_set("place")).alias("places"))
    starts = F.transform(promising(), lambda start: F.struct("k", "size", start.alias("start")))
    mine = hits.groupBy("key", "crc").agg(F.array_distinct(F.flatten(F.collect_list(starts))).alias("windows")).filter(F.size("windows") > 0)
    kind = lambda w: F.xxhash64(w["k"], w["size"], said(by_kind(w["k"], kinds), w["k"], w))
    told = F.transform("windows", lambda w: F.struct(w["k"].alias("k"), w["size"].alias("size"), w["start"].alias("start"), kind(w).alias("kind")))
    return narrow(made.join(mine, ["key", "crc"]).select("key", "crc", F.explode(told).alias("w")).select("key", "crc", "w.*"))


def said(hashes: Column, k: Column, window: Column) -> Column:
    """What of a document's hashes of k words stands in a window."""
    return F.slice(hashes, window["start"] + 1, F.greatest(window["size"] - (k - 1), F.lit(1)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): each contaminated document with each of its items.

    The row tells the most similar window, the earliest on ties; start counts words from 0.  A document of
    fewer words than the item is one window.  Null and empty texts, of documents or items, match nothing; null
    ids are kept; repeated documents and items give one row for each pair of ids; empty tables give an empty
    result; other columns are ignored.
    """
    items = narrow(items_of(benchmark, item_col, item_text))
    counts = {r["k"]: r["m"] for r in items.groupBy("k").agg(F.sum(F.size("shingles")).alias("m")).collect()}
    if not counts:
        schema = "doc_id long, item_id long, start int, n_words int, distance int, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    kinds = sorted(counts)
    near = F.broadcast if sum(counts.values()) <= BROADCAST else (lambda x: x)
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).filter("text is not null")
    keyed = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), crc32_text("text").alias("crc"), "text")
    keyed = with_probe(keyed, items, kinds, near)
    windows = windows_of(keyed, items, kinds, near)
    # one of many equal windows
    best = windows.groupBy("kind").agg(F.min(F.struct("key", "crc", "k", "size", "start")).alias("w")).select("kind", "w.*")
    of_doc = best.groupBy("key", "crc").agg(F.collect_list(F.struct("kind", "k", "size", "start")).alias("windows"))
    parts = F.transform("windows", lambda w: F.struct(
        w["kind"].alias("kind"), w["size"].alias("size"), said(by_kind(w["k"], kinds), w["k"], w).alias("shingles"),
        said(F.col("h1"), F.lit(1), w).alias("words"),
    ))
    made = hashed(keyed.join(of_doc, ["key", "crc"]), kinds).select(F.explode(parts).alias("w")).select("w.*")
    made = cut(made.select("kind", "size", "shingles", simhash("words").alias("fp")))
    pairs = block_pairs(made, items, near)
    ends = items.select("item_id", "code", F.col("shingles").alias("b"))
    sides = pairs.join(made.select("kind", F.col("shingles").alias("a")), "kind")
    sides = sides.join(near(ends), pairs["item_id"].eqNullSafe(ends["item_id"]) & (pairs["code"] == ends["code"]))
    sides = sides.select("kind", pairs["item_id"], "distance", "a", "b")
    shared = F.expr("aggregate(array_distinct(b), 0, (s, x) -> s + least(size(filter(a, y -> y = x)), size(filter(b, y -> y = x))))")
    similarity = shared / (F.size("a") + F.size("b") - shared)
    verified = sides.select("kind", "item_id", "distance", similarity.alias("similarity")).filter(F.col("similarity") >= THRESHOLD)
    found = windows.join(nearby(narrow(verified)), "kind").select("key", "item_id", F.struct((-F.col("similarity")).alias("rank"), "start", "size", "distance").alias("x"))
    first = found.groupBy("key", "item_id").agg(F.min("x").alias("x"))
    told = F.col("x.start"), F.col("x.size").alias("n_words"), F.col("x.distance"), (-F.col("x.rank")).alias("similarity")
    return first.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "item_id", *told)


def met_by_block(made: DataFrame, items: DataFrame, near) -> DataFrame:
    """(kind, item_id, code, distance): windows and items of one size that agree in a block, once for each such block."""
    cells = made.select("kind", "size", "fp", F.explode(blocks("fp")).alias("b")).select("kind", "size", "fp", "b.*")
    theirs = items.select("item_id", "code", "size", F.col("fp").alias("item_fp"), F.explode(blocks("fp")).alias("b"))
    theirs = theirs.select("item_id", "code", "size", "item_fp", "b.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int").alias("distance")
    return cells.join(near(theirs), ["size", "block", "bits"]).select("kind", "item_id", "code", distance)


def block_pairs(made: DataFrame, items: DataFrame, near) -> DataFrame:
    """(kind, item_id, code, distance): windows and items of one size whose fingerprints are within RADIUS bits."""
    return met_by_block(made, items, near).filter(F.col("distance") <= RADIUS).distinct()
