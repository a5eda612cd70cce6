"""SimHash groups against all pairs."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash

from lectern.llm import components, queries, simhash

from .tools import EDGES, by_id, documents_of, prose, table

LARGE = Path("/root/testdata/sf0.1")
COLUMNS = ("doc_id", "fingerprint", "component_id")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Component of each place among (id, fingerprint) pairs: the smallest id reachable."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(distinct, dtype=np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= 3):
            a, b = find(f), find(distinct[k + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, f in fps:
        root = find(f)
        least[root] = i if least.get(root) is None else least[root] if i is None else min(i, least[root])
    return [least[find(f)] for _, f in fps]


def brute(docs):
    fps = [(i, brute_fingerprint(t)) for i, t in docs]
    return by_id([{"doc_id": i, "fingerprint": f"{f:016x}", "component_id": c} for (i, f), c in zip(fps, brute_groups(fps), strict=True)], *COLUMNS)


def test_on_the_table(spark, sf):
    assert by_id(queries.op4_simhash(spark, sf).collect(), *COLUMNS) == brute(documents_of(spark, sf))


def test_edges(spark):
    assert by_id(simhash.near_duplicates(table(spark, EDGES)).collect(), *COLUMNS) == brute(EDGES)
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    only = simhash.near_duplicates(table(spark, [(None, "a")])).collect()
    assert [(r["doc_id"], r["component_id"]) for r in only] == [(None, None)]


def test_chains_of_near_copies(spark):
    base = prose(8, 400).split()
    docs = []
    for k in range(60):
        words = list(base)
        for j in range(k):
            words[(j * 7) % len(words)] = f"w{j}"
        docs.append((1000 - k, " ".join(words)))
    assert by_id(simhash.near_duplicates(table(spark, docs)).collect(), *COLUMNS) == brute(docs)


def test_segments_find_all_links():
    rng = random.Random(4)
    for n, spread in ((5, 4), (300, 6), (3000, 14), (3000, 20)):
        seeds = [rng.getrandbits(64) for _ in range(5)]
        fps = {rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(spread + 20), rng.randrange(6))) for _ in range(n)}
        array = np.array(sorted(fps), dtype=np.uint64)
        a, b = (array[x] for x in simhash.segment_links(array))
        assert (np.bitwise_count(a ^ b) <= 3).all()
        want = brute_groups(list(enumerate(array.tolist())))
        forest = simhash.Forest(len(array))
        place = {x: k for k, x in enumerate(array.tolist())}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.union(place[x], place[y])
        assert [forest.find(k) for k in range(len(array))] == want


@pytest.mark.parametrize("per_segment", [512, 16, 400 / 2**20, 400 / 2**28])
def test_segments_of_any_width_find_all_links(spark, monkeypatch, per_segment):
    """One segment, leading bits of one block of four, of two blocks of five, of three blocks of six."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "SEGMENT", per_segment)
    rng = random.Random(6)
    fps = sorted({sum(1 << b for b in rng.sample(range(20), rng.randrange(8))) for _ in range(400)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(frame)
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = brute_groups([(f, f) for f in fps])
    assert [found.get(f, f) for f in fps] == want


def test_whole_nodes_are_pruned_on_the_table(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet") if LARGE.exists() else pytest.skip(f"no tables in {LARGE}")
    fps = np.unique(np.array([simhash.fingerprint(r["text"]) for r in docs.select("text").collect()], dtype=np.uint64))
    index = simhash.Index(fps[np.argsort(simhash.gray_rank(fps))])
    assert len(index.links()) > 0
    # pairs of nodes that went with everything below them, and pairs looked at, against all pairs
    assert index.pruned > 100_000 and index.met < len(fps) * (len(fps) - 1) // 4


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_a_path_and_a_star(spark, few):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(200)]
    rows = components.components(spark.createDataFrame([*path, *star, (5, 5)], "a long, b long"), few=few).collect()
    assert {r["node"]: r["component"] for r in rows} == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1201), 1000)}
    assert components.components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_gray_rank_orders_the_gray_code():
    x = np.arange(256, dtype=np.uint64)
    gray = x ^ (x >> np.uint64(1))
    assert (simhash.gray_rank(gray) == x).all()
