"""Nearest neighbours, sharding and decontamination against brute force."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, queries, sharding, vectors

from .tools import EDGES, LONG, documents_of, prose, table


def brute_nearest(rows, k=5):
    known = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(known))
    unit = np.array([known[i] / np.linalg.norm(known[i]) for i in ids])
    out = {}
    for q in ids[ids % 50 == 0]:
        score = unit @ (known[q] / np.linalg.norm(known[q]))
        out[int(q)] = [(int(i), s) for s, i in sorted(zip(-score, ids, strict=True)) if i != q][:k]
    return out


def test_vectors_recall_on_the_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), {}
    for r in queries.op6_vectors(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for found in got.values():
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert [x[1:] for x in sorted(found)] == sorted((x[1:] for x in found), key=lambda x: (-x[1], x[0]))
    vectors_by_id = dict(rows)
    for q, found in got.items():
        for _, i, s in found:
            a, b = np.array(vectors_by_id[q]), np.array(vectors_by_id[i])
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_vectors_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [float("inf")] + [1.0] * 7), (1004, [None] + [1.0] * 7), (None, [1.0] * 8), (350, rows[3][1]), (400, [1e300] * 8), (450, [1e-300] * 8), (7, rows[7][1])]
    rows += [(501 + k, rows[0][1]) for k in range(7)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, EMBEDDING string")
    got = {}
    for r in vectors.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    scaled = [(i, None if v is None else [x / 1e300 if i == 400 and x else x * 1e300 if i == 450 and x else x for x in v]) for i, v in rows]
    want = brute_nearest(scaled)
    assert got.keys() == want.keys()
    # ties go to the smaller id
    assert [i for _, i in sorted(got[0])] == [501, 502, 503, 504, 505]
    assert sum(len({i for _, i in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    few = vectors.nearest(frame.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert vectors.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("per_list", [64, 8])
def test_vectors_of_many_clusters_and_alone(spark, monkeypatch, per_list):
    """Hundreds of lists; some queries stand alone, some in groups of three that have a centroid to themselves."""
    monkeypatch.setattr(vectors, "PER_LIST", per_list)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16))
    rows = [(k * 50 + 1 + j, (centres[k] + rng.normal(size=16) * 0.15).tolist()) for k in range(300) for j in range(49)]
    rows += [(50 * k, (rng.normal(size=16) * 3).tolist()) for k in range(150)]
    for k in range(150, 300):
        here = rng.normal(size=16)
        rows += [(i, (here + rng.normal(size=16) * 1e-4).tolist()) for i in (50 * k, 100_001 + 2 * k, 200_001 + 2 * k)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(rows) // per_list > 200
    got = {}
    for r in vectors.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    recall = sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (5 * len(want))
    assert recall >= 0.9, recall


def test_vectors_long_list_is_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 50)
    rng = np.random.default_rng(3)
    rows = [(k, (np.ones(6) + rng.normal(size=6) * 0.01).tolist()) for k in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_vectors_many_equal_ones(spark):
    """3,000 equal vectors, and as many of equal direction: each query gets the smallest ids, and little more is sent."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    rows = [(k, one.tolist()) for k in range(3000)] + [(10_000 + k, (one * 2.0 ** (k % 9)).tolist()) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    kept = vectors.search

    def search(*args):
        out = kept(*args)
        sent.append(out.count())
        return out

    vectors.search = search
    try:
        got = {}
        for r in vectors.nearest(frame, F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    finally:
        vectors.search = kept
    assert got.keys() == {i for i, _ in rows if i % 50 == 0}
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == [i for i in range(6) if i != q][:5]
    assert sum(sent) <= 20 * sum(map(len, got.values())), sent


def capacity(sizes, shards):
    """The smallest largest shard, by dynamic programming over contiguous groups."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = sums.astype(float)
    for _ in range(shards - 1):
        best = np.array([min((max(best[j], sums[i] - sums[j]) for j in range(i + 1)), default=0) for i in range(len(sums))])
    return int(best[-1])


def judged(docs, rows, shards=8):
    assert len(rows) == len(docs)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == Counter((i, size(t), crc32((t or "").encode()), "bytes", None) for i, t in docs)
    slots, bytes_, groups = {}, Counter(), {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    assert all(len(x) == 1 for x in groups.values())
    by_text = Counter()
    for _, t in docs:
        by_text[hashlib.sha256((t or "").encode()).hexdigest()] += size(t)
    if docs:
        assert max(bytes_.values()) == capacity([by_text[h] for h in sorted(by_text)], shards)


def test_sharding_on_the_table(spark, sf):
    judged(documents_of(spark, sf), queries.op9_sharding(spark, sf).collect())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding_edges(spark, shards):
    judged(EDGES, sharding.shard_documents(table(spark, EDGES), shards).collect(), shards)
    judged([], sharding.shard_documents(table(spark, []), shards).collect(), shards)
    for seed in range(3):
        docs = [(k, prose(k % 40 + seed, 5 + k % 13)) for k in range(120)]
        judged(docs, sharding.shard_documents(table(spark, docs), shards).collect(), shards)


def test_sharding_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 16)
    docs = [(None, "the same row")] * 300 + [(7, prose(1, 20))] * 40 + [(k, prose(k, 8)) for k in range(60)]
    judged(docs, sharding.shard_documents(table(spark, docs), 3).collect(), 3)


ITEMS = [(1, prose(71, 40)), (2, prose(72, 12)), (3, "only three words"), (4, "single"), (5, None), (6, ""), (7, prose(71, 40)), (8, prose(73, 25)), (None, prose(74, 15)), (9, "two words")]


def brute_similarity(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def brute_leaks(docs, items):
    """(doc, item) whose best window of the item's size reaches the threshold, with that similarity."""
    out = {}
    for key, text in docs:
        words = (text or "").lower().split()
        for item, said in items:
            theirs = (said or "").lower().split()
            if not theirs or text is None:
                continue
            k = min(5, len(theirs))
            cut = lambda w, k=k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            if not set(cut(words)) & set(cut(theirs)):
                continue
            for s in range(max(1, len(words) - len(theirs) + 1)):
                window = cut(words[s : s + len(theirs)])
                if window and (x := brute_similarity(window, cut(theirs))) >= 0.8 and x > out.get((key, item), (0,))[0]:
                    out[key, item] = (x, s)
    return out


def changed(text, every):
    return " ".join("odd" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_decontaminate_against_brute_force(spark):
    texts = {i: t for i, t in ITEMS if t}
    docs = [(10, prose(1, 50) + " " + texts[1].upper() + " " + prose(2, 10)), (11, texts[2]), (12, prose(3, 30) + "\n" + texts[8] + "\n" + texts[2]), (13, "Only  three\twords"), (14, "a single"), (15, changed(texts[1], 39)), (16, changed(texts[1], 9)), (17, prose(4, 200)), (18, " ".join(texts[8].split()[:15])), (19, " ".join(texts[8].split()[:23])), (20, None), (21, ""), (22, LONG + " " + texts[8]), (23, texts[None]), (None, texts[8]), (24, texts[8] + " " + texts[8]), (24, texts[8] + " " + texts[8]), (25, "two words two words")]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, TEXT string")
    rows = decontaminate.contaminated(table(spark, docs), items).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in rows}
    want = brute_leaks(docs, ITEMS)
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    assert decontaminate.contaminated(table(spark, []), items).count() == 0
    assert decontaminate.contaminated(table(spark, docs), items.limit(0)).count() == 0


def test_decontaminate_tries_every_start(spark):
    """Reordered items, whose best windows start where no shared shingle would lay them."""
    words = [f"w{k}" for k in range(100)]
    halves = " ".join(words[50:] + words[:50])
    thirds = " ".join(words[60:] + words[:30] + words[30:60])
    around = [prose(30 + k, 200) for k in range(4)]
    docs = [(1, f"{around[0]} {halves} {around[1]}"), (2, halves), (3, f"{thirds} {around[2]}"), (4, f"{around[3]} {halves}"), (5, " ".join(words[::-1])), (6, f"{around[0]} {' '.join(words[10:])}"), (7, " ".join(words * 3)), (8, " ".join(words[50:95] + words[:50])), (9, "a b " * 60)]
    items = [(1, " ".join(words)), (2, "a b " * 10)]
    rows = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in rows}
    want = brute_leaks(docs, items)
    assert (1, 1) in want and got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


def altered(rng, words, junk):
    """A window whose shingles are mostly those of ``words``: changed, cut off, moved, put in or left out."""
    n, w = len(words), list(words)
    kind = rng.choice(["change", "tail", "head", "put in", "leave out", "move"])
    few, some = rng.randrange(1, max(2, n // 25)), rng.randrange(1, max(2, n // 8))
    if kind == "change":
        for _ in range(few):
            w[rng.randrange(n)] = rng.choice(junk)
    elif kind == "tail":
        w[-some:] = rng.choices(junk, k=some)
    elif kind == "head":
        w[:some] = rng.choices(junk, k=some)
    elif kind == "put in":
        for _ in range(few):
            w.insert(rng.randrange(n), rng.choice(junk))
    elif kind == "leave out":
        for _ in range(few):
            w.pop(rng.randrange(len(w)))
    else:
        w = w[some:] + w[:some]
    return w


def test_decontaminate_recall_and_pruning(spark, monkeypatch):
    """Against the exact search over altered items: what the radius misses, and how few pairs the blocks let meet."""
    rng = random.Random(12)
    junk = [f"j{rng.randrange(3000)}" for _ in range(2000)]
    said = [[f"v{rng.randrange(800)}" for _ in range(40)] for _ in range(60)]
    docs = [(k, " ".join([*rng.choices(junk, k=20), *altered(rng, said[k % 60], junk), *rng.choices(junk, k=20)])) for k in range(400)]
    items = [(k, " ".join(w)) for k, w in enumerate(said)]
    seen = []
    kept = decontaminate.met_by_block

    def counted(made, *more):
        out = kept(made, *more)
        seen.append((made.count(), out.select("kind", "item_id").distinct().count()))
        return out

    monkeypatch.setattr(decontaminate, "met_by_block", counted)
    rows = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {(r["doc_id"], r["item_id"]) for r in rows}, brute_leaks(docs, items).keys()
    assert got <= want and len(want) > 200
    assert len(got) >= 0.97 * len(want), len(got) / len(want)
    (windows, pairs), = seen
    assert pairs <= 0.4 * windows * len(items), (windows, pairs)


def test_decontaminate_without_probe_words(spark, monkeypatch):
    """Beyond the number of words in the plan, and of shingles in a broadcast, results are the same."""
    docs = [(k, prose(k, 30) + " " + ITEMS[k % 4][1] + " tail") for k in range(12)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(table(spark, docs), items).collect()))
    monkeypatch.setattr(decontaminate, "LITERALS", 2)
    monkeypatch.setattr(decontaminate, "BROADCAST", 2)
    assert sorted(map(tuple, decontaminate.contaminated(table(spark, docs), items).collect()), key=str) == sorted(want, key=str)


def test_decontaminate_on_the_table(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontaminate(spark, sf).collect()}
    assert got == brute_leaks(documents_of(spark, sf), items).keys()


def test_native_operators_run_no_python(spark, sf):
    for query in (queries.op9_sharding, queries.op10_decontaminate):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
