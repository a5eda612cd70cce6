"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lectern.llm import queries, sketch, substring, suffixes

from .tools import EDGES, by_id, documents_of, prose, random_texts, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    times = Counter(hash(r[i : i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(docs, raws, strict=True):
        gone, end = bytearray(len(r)), 0
        for i in range(len(r) - length + 1):
            if times[hash(r[i : i + length])] > 1:
                a = max(i, end)
                end = i + length
                gone[a:end] = b"\1" * (end - a)
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((key, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return by_id([dict(zip(COLUMNS1, x, strict=True)) for x in out], *COLUMNS1)


def brute_words(docs, size):
    seen, out = {}, []
    for key, text in sorted(dict.fromkeys(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        words = WORD.findall((text or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            w = b" ".join(words[i : i + size])
            if w in seen:
                gone[i : i + size] = [True] * size
            seen.setdefault(w, (key, i))
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out += [(key, len(words), sum(gone), hashlib.sha256(kept).hexdigest())] * docs.count((key, text))
    return by_id([dict(zip(COLUMNS3, x, strict=True)) for x in out], *COLUMNS3)


COLUMNS1 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
COLUMNS3 = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("length", [1, 2, 8, 12, 20])
def test_suffixes_short_strings(spark, length):
    docs = random_texts(length, 60, "ab" if length > 2 else "abcdefghijklmnopqrstuvwxyzäöüß", 80)
    got = suffixes.drop_repeats(table(spark, docs), length, "kept_sha256").collect()
    assert by_id(got, *COLUMNS1) == brute_bytes(docs, length)


def test_suffixes_hot_anchor_is_cut(spark, monkeypatch):
    for name, value in (("HOT", 3), ("BLOCK", 1 << 10)):
        monkeypatch.setattr(suffixes, name, value)
    text = prose(5, 200)
    docs = [(k, text[: 300 + 17 * k] + f" {k} " + text[200 + 11 * k :]) for k in range(40)]
    got = suffixes.drop_repeats(table(spark, docs).repartition(7), 50, "kept_sha256").collect()
    assert by_id(got, *COLUMNS1) == brute_bytes(docs, 50)


def test_suffixes_edges(spark):
    got = suffixes.drop_repeats(table(spark, EDGES), 200, "kept_sha256").collect()
    assert by_id(got, *COLUMNS1) == brute_bytes(EDGES, 200)
    kept = {r["doc_id"]: r["kept"] for r in suffixes.drop_repeats(table(spark, [(1, "ab" * 300), (2, "one of a kind")])).collect()}
    assert kept == {1: b"", 2: b"one of a kind"}
    assert suffixes.drop_repeats(table(spark, [])).count() == 0


def test_suffixes_on_the_table(spark, sf):
    assert by_id(queries.op1_suffixes(spark, sf).collect(), *COLUMNS1) == brute_bytes(documents_of(spark, sf), 200)


def test_bucket_pointer_refinement():
    for seed in range(20):
        data = np.random.default_rng(seed).integers(97, 99, 300, dtype=np.uint8).tobytes()
        for length in (1, 7, 8, 9, 20, 33):
            times = Counter(data[i : i + length] for i in range(len(data) - length + 1))
            want = [times[data[i : i + length]] > 1 for i in range(len(data) - length + 1)]
            assert suffixes.repeated_starts(data, length).tolist() == want


def test_refinement_takes_little_memory():
    data = np.random.default_rng(1).integers(97, 99, 1 << 18, dtype=np.uint8)
    room = len(data) - np.arange(len(data))
    tracemalloc.start()
    suffixes.classes(data, room, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 100 * len(data)


def test_suffixes_held_runs_are_sent_in_pieces(spark, monkeypatch):
    for name, value in (("HELD", 1 << 14), ("PIECE", 7), ("HOT", 30)):
        monkeypatch.setattr(suffixes, name, value)
    text = prose(6, 300)
    docs = [(k, text[50 * (k % 5) :] + f" {k} " + prose(k % 9, 60)) for k in range(60)]
    got = suffixes.drop_repeats(table(spark, docs).coalesce(1), 50, "kept_sha256").collect()
    assert by_id(got, *COLUMNS1) == brute_bytes(docs, 50)
    # a batch on its way to a worker takes memory on both sides
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


@pytest.mark.parametrize("size", [2, 3, 5])
def test_words_short_windows(spark, size):
    docs = random_texts(size, 80, "aab  \t", 60)
    got = substring.drop_repeats(table(spark, docs), size, "kept_sha256").collect()
    assert by_id(got, *COLUMNS3) == brute_words(docs, size)


def test_words_edges(spark):
    got = substring.drop_repeats(table(spark, EDGES), 20, "kept_sha256").collect()
    assert by_id(got, *COLUMNS3) == brute_words(EDGES, 20)
    assert substring.drop_repeats(table(spark, [])).count() == 0
    kept = substring.drop_repeats(table(spark, [(1, "a  b c"), (2, None)])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["kept"]) for r in kept] == [(2, "a b c"), (0, "")]


def test_words_on_the_table(spark, sf):
    assert by_id(queries.op3_substring(spark, sf).collect(), *COLUMNS3) == brute_words(documents_of(spark, sf), 20)


def test_sketch_never_misses(spark):
    texts = spark.createDataFrame([(k, str(k % 700)) for k in range(1000)], "doc_id long, text string").repartition(5)
    values = lambda batch: sketch.mix(np.array([int(t) for t in batch.column(1).to_pylist()], dtype=np.uint64))
    seen = sketch.sketched(texts, values, hot=1, spacing=3).value
    every = sketch.mix(np.arange(700, dtype=np.uint64))
    assert seen.repeated(every)[:300].all()
    assert seen.repeated(every)[300:].mean() < 0.01
    assert seen.frequent(every)[:300].all()


def test_anchor_is_the_leftmost_smallest():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 10):
        hashes = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        want = [int(np.argmin(hashes[i : i + width] >> np.uint64(32))) + i for i in range(50 - width + 1)]
        assert sketch.anchors(hashes, width).tolist() == want


def test_a_passage_in_many_surroundings(spark, monkeypatch):
    """One passage of 260 bytes in each of 3,000 texts that share nothing else; no bucket gathers its surroundings."""
    monkeypatch.setattr(suffixes, "HOT", 100)
    rng = random.Random(3)
    noise = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    passage = noise(260)
    docs = [(k, noise(60) + passage + noise(50)) for k in range(1500)] + [(9000, noise(900))]
    rows = suffixes.drop_repeats(table(spark, docs), output="kept_sha256").collect()
    assert by_id(rows, *COLUMNS1) == brute_bytes(docs, 200)
    # one run of starts for each text, or a few
    assert suffixes.find_repeats(suffixes.keyed(table(spark, docs), "doc_id", "text"), 200).count() <= 80 * len(docs)


def test_sketches_follow_the_text(spark):
    rows = lambda n: suffixes.keyed(table(spark, [(k, "x" * 1000) for k in range(n)]), "doc_id", "text")
    few, many = rows(10), rows(2000)
    assert sketch.size_of(few, 40) == sketch.RANGE_BITS < sketch.size_of(many, 4) <= sketch.MOST_BITS
    assert sketch.size_of(rows(0), 40) == sketch.RANGE_BITS


@pytest.mark.parametrize("bits", [16, 18])
def test_full_sketches_lose_nothing(spark, monkeypatch, bits):
    """Far more values than cells: more is estimated repeated, with the same results."""
    docs = [(k, prose(k, 400)) for k in range(60)] + [(100 + k, prose(k, 400)) for k in range(5)]
    want = [sorted(map(tuple, f(table(spark, docs)).collect())) for f in (suffixes.drop_repeats, substring.drop_repeats)]
    monkeypatch.setattr(sketch, "RANGE_BITS", 8)
    monkeypatch.setattr(sketch, "MOST_BITS", bits - 8)
    assert [sorted(map(tuple, f(table(spark, docs)).collect())) for f in (suffixes.drop_repeats, substring.drop_repeats)] == want
