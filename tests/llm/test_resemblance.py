"""Near-duplicate groups against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest

from lectern.llm import resemblance
from lectern.llm.common import table as read

from .tools import EDGES, by_id, prose, table

COLUMNS = ("doc_id", "component_id")


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def brute(docs):
    sets = [brute_shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return by_id([{"doc_id": i, "component_id": least.get(find(k))} for k, (i, _) in enumerate(docs)], *COLUMNS)


def altered(seed, every, words=300):
    rng = random.Random(seed)
    said = [f"w{rng.randrange(5000)}" for _ in range(words)]
    return " ".join(said), " ".join(f"odd{k}" if k % every == every - 1 else w for k, w in enumerate(said))


def made():
    docs = []
    for k, every in enumerate((20, 38, 42, 45, 50, 60, 100)):
        one, two = altered(k, every)
        docs += [(10 * k, one), (10 * k + 1, two)]
    return docs


@pytest.mark.parametrize("crowd", [1 << 14, 4])
def test_groups_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(resemblance, "CROWD", crowd)
    rng = random.Random(5)
    line = prose(3, 25)
    docs = made() + [(200 + k, " ".join([line, *(rng.choice("abc") for _ in range(rng.randrange(12)))])) for k in range(60)]
    docs += [(400 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for k in range(40)] + EDGES
    assert by_id(resemblance.near_duplicates(table(spark, docs)).collect(), *COLUMNS) == brute(docs)
    assert resemblance.near_duplicates(table(spark, [])).count() == 0


def test_stage_joins_copies_with_every_45th_word_changed(spark, sf):
    docs = made()
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, rows, sf).collect()}
    assert kept == {c for _, c in brute(docs)} and 31 not in kept and 41 not in kept and 1 in kept


def test_stage_on_the_table(spark, sf):
    rows = read(spark, sf, "documents").collect()
    docs = [(r["doc_id"], r["text"]) for r in rows]
    kept = {c for _, c in brute(docs)}
    got = corpus_pipeline.without_near_duplicates(spark, read(spark, sf, "documents"), sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(kept)


def test_a_large_group_makes_no_pairs_of_its_own(spark, monkeypatch):
    """600 near copies of one text, most of them near one another too: links proposed stay about as many as copies."""
    rng = random.Random(9)
    said = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = [(1, " ".join(said))]
    for k in range(600):
        words = list(said)
        for at in rng.sample(range(150), rng.randrange(1, 5)):
            words[at] = f"odd{k}x{at}"
        docs.append((k + 2, " ".join(words)))
    pairs = []
    kept = resemblance.verified

    def verified(proposed, *more):
        pairs.append(proposed.count())
        return kept(proposed, *more)

    monkeypatch.setattr(resemblance, "verified", verified)
    assert by_id(resemblance.near_duplicates(table(spark, docs)).collect(), *COLUMNS) == brute(docs)
    assert sum(pairs) < 10 * len(docs), pairs


def test_parity_is_a_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (set(rng.integers(0, 1 << 10, rng.integers(1, 60)).tolist()) for _ in range(2))
        one, two = (resemblance.parity(np.array(sorted(x), np.uint64)).view(np.uint64) for x in (a, b))
        assert np.bitwise_count(one ^ two).sum() <= len(a ^ b)
