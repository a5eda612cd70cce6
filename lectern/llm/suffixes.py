"""Suffix-array dedup by bucket-pointer refinement.

Which strings of ``length`` bytes occur twice is a question about the suffix array: neighbours that share
``length`` bytes.  Suffixes are sorted no deeper than that.  Initial buckets hold suffixes with equal first
8 bytes; a bucket is refined by sorting its suffixes on the bucket identifiers at a later offset, and each
refinement works on the identifiers the one before has left, so the sorted depth doubles: 8, 16, 32, ...,
and a last step of overlapping halves reaches ``length`` exactly.  Suffixes alone in their bucket are
settled and take no part in later steps.

At scale only suffixes that may be repeated are sorted.  Every string has an anchor, the 64-byte piece of
smallest hash inside it (see ``sketch``); a count-min sketch of all anchors rules out strings whose anchor
occurs once.  What is left travels as *runs*: neighbouring strings with the same anchor, sent once as the
bytes they span.  Runs with the same anchor meet in one task, which refines their suffixes.  An anchor that
occurs very often has its runs cut into single strings.  These need no refinement: each meets its equals by a
128-bit digest, so that a passage in any number of surroundings is spread over as many buckets as strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches as bounded
from lectern.llm.common import tidy, trim
from lectern.llm.sketch import anchors, pieces, prefix, sketched
from lectern.llm.substring import keyed

#: Bytes of an anchor, at most half of a string.
ANCHOR = 64
#: An anchor estimated to occur more often has its runs cut into single strings, which meet by their digest.
HOT = 1000
#: Bytes whose suffixes are refined together.
BLOCK = 1 << 21
#: Bytes of runs (with ENTRY for each one) that a worker holds, to find copies, before it sends them, PIECE rows at a time.
HELD, ENTRY, PIECE = 1 << 26, 256, 1 << 13


def refine(ids: np.ndarray, places: np.ndarray, offset: int) -> None:
    """Split the buckets of the suffixes at ``places`` by the bucket identifiers ``offset`` further on, in place.

    An identifier is the rank of its bucket's first suffix, so it stays below that of the next bucket.
    """
    both = ids[places] << 32
    both |= ids[places + offset]
    order = np.argsort(both)
    both = both[order]
    splits, starts = np.ones((2, len(order)), bool)
    splits[1:] = both[1:] != both[:-1]
    both >>= 32
    starts[1:] = both[1:] != both[:-1]
    at = np.arange(len(order))
    both += np.maximum.accumulate(np.where(splits, at, 0))
    both -= np.maximum.accumulate(np.where(starts, at, 0))
    ids[places[order]] = both


def classes(data: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers at depth ``length`` of the suffixes with ``room`` (bytes to the end of their part) for it; others -1.

    Two such suffixes have equal identifiers exactly if their first ``length`` bytes are equal.
    """
    n = len(data)
    depth = min(8, length)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.zeros(n, np.uint64)
    for k in range(depth):
        grams <<= np.uint64(8)
        grams |= padded[k : k + n]
    places = np.flatnonzero(room >= depth)
    grams = grams[places]
    order = np.argsort(grams)
    grams = grams[order]
    starts = np.ones(len(order), bool)
    starts[1:] = grams[1:] != grams[:-1]
    del grams
    ids = np.full(n, -1, np.int64)
    ids[places[order]] = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    del order
    while depth < length:
        step = min(depth, length - depth)
        places = places[room[places] >= depth + step]
        kept = ids[places]
        refine(ids, places[np.bincount(kept, minlength=n)[kept] > 1], step)
        depth += step
    ids[room < length] = -1
    return ids


def repeated_starts(data: bytes, length: int) -> np.ndarray:
    """Whether the string at each start also starts elsewhere in ``data``."""
    array = np.frombuffer(data, np.uint8)
    n = max(len(array) - length + 1, 0)
    if not n:
        return np.zeros(0, bool)
    found = classes(array, len(array) - np.arange(len(array)), length)[:n]
    return np.bincount(found)[found] > 1


RUNS = pa.schema([("bucket", pa.int64()), ("run", pa.binary()), ("key", pa.int64()), ("place", pa.int64()), ("copies", pa.bool_())])
FOUND = pa.schema([("key", pa.int64()), ("crc", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of true values."""
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def text_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all anchors-to-be, place of each string's anchor)."""
    short = min(ANCHOR, max(length // 2, 1))
    sums = prefix(data)
    starts = np.arange(len(data) - short + 1)
    hashes = pieces(sums, starts, starts + short)
    return hashes, anchors(hashes, length - short + 1)


def find_repeats(rows: DataFrame, length: int) -> DataFrame:
    """(key, crc, first, last): inclusive runs of starts whose string of ``length`` bytes also starts elsewhere."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for text in batch.column(3).to_pylist():
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            if len(data) >= length:
                hashes, at = text_anchors(data, length)
                out.append(hashes[at[np.flatnonzero(np.diff(at, prepend=-1))]])
        return np.concatenate(out)

    # an anchor for about a third of a string
    seen = sketched(rows, values, hot=HOT, spacing=max(length // 3, 1))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        # run, or digest of a string -> [bucket, key, place, whether it occurs again while it is held]
        met: dict[bytes, list] = {}
        whole: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The first of several equal runs stays as a witness; all of them are known to be repeated."""
            once = ((x[0], run, x[1], x[2], x[3]) for run, x in met.items())
            known = ((key ^ place, n.to_bytes(4, "little"), key, place, None) for key, place, n in whole)
            made = chain(once, known)
            while piece := list(islice(made, PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*piece, strict=True), RUNS.types, strict=True)], schema=RUNS)
            met.clear()
            whole.clear()

        for batch in batches:
            keys, crcs = batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist()
            for n, text in enumerate(batch.column(3).to_pylist()):
                raw = text.encode("utf-8")
                if len(raw) < length:
                    continue
                data = np.frombuffer(raw, np.uint8)
                hashes, at = text_anchors(data, length)
                firsts = np.flatnonzero(np.diff(at, prepend=-1))
                lasts = np.append(firsts[1:], len(at)) - 1
                heads = hashes[at[firsts]]
                again = seen.value.repeated(heads)
                firsts, lasts, heads = firsts[again], lasts[again], heads[again]
                hot = seen.value.frequent(heads)
                key, crc = keys[n], crcs[n]
                for f, la in zip(firsts[hot].tolist(), lasts[hot].tolist(), strict=True):
                    known = np.zeros(la - f + 1, bool)
                    for k in range(la - f + 1):
                        string = raw[f + k : f + k + length]
                        d = digest(string)
                        token = d if length > len(d) else string
                        if (old := met.get(token)) is None:
                            met[token] = [int.from_bytes(d[:8], "little", signed=True), key, (f + k) << 32 | crc, False]
                            held += ENTRY
                            continue
                        known[k] = True
                        if not old[3]:
                            whole.append((old[1], old[2], 1))
                            old[3] = True
                    whole += [(key, (f + a) << 32 | crc, b - a + 1) for a, b in zip(*(x.tolist() for x in spans(known)), strict=True)]
                firsts, lasts, buckets = firsts[~hot], lasts[~hot], heads[~hot].view(np.int64)
                for f, la, b in zip(firsts.tolist(), lasts.tolist(), buckets.tolist(), strict=True):
                    run = raw[f : la + length]
                    if (old := met.get(run)) is None:
                        met[run] = [b, key, f << 32 | crc, False]
                        held += len(run) + ENTRY
                    else:
                        if not old[3]:
                            whole.append((old[1], old[2], la - f + 1))
                            old[3] = True
                        whole.append((key, f << 32 | crc, la - f + 1))
                if held + ENTRY * len(whole) > HELD:
                    yield from flush()
                    held = 0
        yield from flush()
        trim()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come ordered by bucket; whole buckets are refined together, some BLOCK bytes at a time."""
        now, bucket, held, size = None, {}, [], 0

        def close() -> None:
            """A bucket with one run, or with none whose strings are still in question, needs no refinement; digests never do."""
            nonlocal size
            for run in [x for x in bucket if len(x) < length]:
                del bucket[run]
            if len(bucket) > 1 and any(not x[2] for x in bucket.values()):
                held.append(dict(bucket))
                size += sum(map(len, bucket))
            bucket.clear()

        def sort_out() -> pa.RecordBatch:
            """Refine the suffixes of all held buckets at once: a string counts only within its own bucket's runs, and equal strings share a bucket."""
            out = []
            all_runs = [(run, x) for b in held for run, x in b.items()]
            data = np.frombuffer(b"".join(run for run, _ in all_runs), np.uint8)
            lengths = np.array([len(run) for run, _ in all_runs], dtype=np.int64)
            ends = np.cumsum(lengths)
            room = np.repeat(ends, lengths)
            room -= np.arange(len(data))
            found = classes(data, room, length)
            starts = found >= 0
            times = np.bincount(found[starts], minlength=len(data) + 1)
            repeated = np.zeros(len(data), bool)
            repeated[starts] = times[found[starts]] > 1
            for (_, (key, place, copies)), end, n in zip(all_runs, ends.tolist(), lengths.tolist(), strict=True):
                if not copies:
                    mask = repeated[end - n : end - length + 1]
                    if mask.any():
                        out += [(key, place & 0xFFFFFFFF, (place >> 32) + a, (place >> 32) + b) for a, b in zip(*(x.tolist() for x in spans(mask)), strict=True)]
            held.clear()
            return frame(out)

        def frame(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 4, FOUND.types, strict=True)], schema=FOUND)

        for batch in batches:
            done = []
            for b, run, key, place, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != now:
                    close()
                    now = b
                    if size > BLOCK:
                        yield sort_out()
                        size = 0
                first = place >> 32
                if copies is None:
                    done.append((key, place & 0xFFFFFFFF, first, first + int.from_bytes(run, "little") - 1))
                elif (old := bucket.get(run)) is None:
                    bucket[run] = (key, place, copies)
                else:
                    # the same run in two batches: every string in it is repeated
                    strings = max(len(run) - length, 0)
                    for k, p, c in (old, (key, place, copies)):
                        if not c:
                            done.append((k, p & 0xFFFFFFFF, p >> 32, (p >> 32) + strings))
                    bucket[run] = (old[0], old[1], True)
            yield frame(done)
        close()
        yield sort_out()
        trim()

    sent = rows.mapInArrow(tidy(runs), "bucket long, run binary, key long, place long, copies boolean")
    met = sent.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(tidy(decide), "key long, crc long, first int, last int")


OUTPUTS = {"kept": (pa.binary(), "binary"), "kept_sha256": (pa.string(), "string")}


def drop_repeats(docs: DataFrame, length: int = 200, output: str = "kept", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that is covered by a string of ``length`` bytes which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and ``output``: kept (the bytes left,
    which need not be valid UTF-8) or kept_sha256.  Texts are taken as UTF-8; strings never cross documents and
    are judged on the input.  Null texts are empty; texts shorter than ``length`` lose nothing; a row given
    twice repeats all its strings; null ids are one more id; an empty table gives an empty result; other columns
    are ignored.
    """
    bounded(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = find_repeats(rows, length).groupBy("key", "crc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = rows.join(found, ["key", "crc"], "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for n, text in enumerate(batch.column(1).to_pylist()):
                raw, runs = text.encode("utf-8"), batch.column(2)[n]
                removed = n_spans = 0
                kept = raw
                if runs.is_valid and len(runs.values):
                    edge = np.zeros(len(raw) + 1, np.int64)
                    first, last = (runs.values.field(i).to_numpy() for i in range(2))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last.astype(np.int64) + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    removed, n_spans = int(gone.sum()), len(spans(gone)[0])
                for column, value in zip(made, (len(raw), removed, n_spans, kept if output == "kept" else hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(made, [pa.int64()] * 3 + [OUTPUTS[output][0]], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", output])

    return joined.mapInArrow(tidy(cut), f"doc_id long, n_bytes long, n_removed long, n_spans long, {output} {OUTPUTS[output][1]}")
