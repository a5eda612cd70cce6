r"""Substring dedup of word windows behind a count-min prefilter.

Pass 1 sketches the anchors of all windows (see ``sketch``).  Pass 2 groups, by 128-bit digest of their
words, only the windows that the sketch estimates to be repeated.  Every occurrence but the first, by
(doc_id, start), marks its words for removal.

Within a batch of documents only the first occurrence of a window needs to meet other batches: all later
ones in the batch are known to be removed.  So a passage that a third of all documents share sends one row
for each batch and window, not one for each document, and no key can gather an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches as bounded
from lectern.llm.common import crc32_text, documents, tidy
from lectern.llm.sketch import anchors, mix, pieces, prefix, sketched

#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (doc_id, with a value for null), crc of the text, doc_id, text: equal ids with different texts stay apart."""
    rows = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), crc32_text("text").alias("crc"), "doc_id", "text")


class Words:
    """A text's words joined by one space, with each word's start and end."""

    def __init__(self, text: str):
        self.joined = b" ".join(text.encode("utf-8").split())
        self.bytes = np.frombuffer(self.joined, np.uint8)
        spaces = np.flatnonzero(self.bytes == 32)
        some = int(len(self.bytes) > 0)
        self.starts = np.concatenate([np.zeros(some, np.int64), spaces + 1])
        self.ends = np.concatenate([spaces, np.full(some, len(self.bytes), np.int64)])

    def __len__(self) -> int:
        return len(self.starts)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all pieces of half a window, place of each window's anchor among them)."""
        short = size // 2
        hashes = pieces(prefix(self.bytes), self.starts[: len(self) - short + 1], self.ends[short - 1 :])
        return hashes, anchors(hashes, size - short + 1)


MARKS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("known", pa.bool_())])


def mark_windows(rows: DataFrame, size: int) -> DataFrame:
    """(key, crc, start) of every window that also starts earlier."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for text in batch.column(3).to_pylist():
            words = Words(text)
            if len(words) >= size:
                hashes, at = words.anchors(size)
                out.append(hashes[np.unique(at)])
        return np.concatenate(out)

    # an anchor every few words, of six bytes or so
    seen = sketched(rows, values, hot=1 << 30, spacing=2 * size)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, crcs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            digests, owners, places = [], [], []
            for n, text in enumerate(batch.column(3).to_pylist()):
                words = Words(text)
                if len(words) < size:
                    continue
                hashes, at = words.anchors(size)
                starts = np.flatnonzero(seen.value.repeated(hashes)[at])
                if len(starts):
                    joined = words.joined
                    digests += [digest(joined[s:e]) for s, e in zip(words.starts[starts].tolist(), words.ends[starts + size - 1].tolist(), strict=True)]
                    owners.append(np.full(len(starts), keys[n]))
                    places.append(starts << 32 | crcs[n])
            if not digests:
                continue
            both, key, place = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), np.concatenate(owners), np.concatenate(places)
            order = np.lexsort((place, key, both[:, 1], both[:, 0]))
            both, key, place = both[order], key[order], place[order]
            later = np.zeros(len(order), bool)
            later[1:] = (both[1:] == both[:-1]).all(axis=1)
            # the same row given twice is one place, and no earlier one
            first = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
            known = (key != key[first]) | (place != place[first])
            # what is known needs no meeting and is dealt out by its document instead of its window
            both[known, 0] = mix(key[known].view(np.uint64)).view(np.int64)
            both[known, 1] = 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[:, 0], both[:, 1], key, place, known)], schema=MARKS)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            k1, k2, key, place, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(k1):
                continue
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            fresh = carried is None or (k1[0], k2[0]) != carried[:2]
            first = np.maximum.accumulate(np.where(new, np.arange(len(k1)), 0))
            first_key, first_place = key[first], place[first]
            if not fresh:
                own = first == 0
                first_key, first_place = np.where(own, carried[2], first_key), np.where(own, carried[3], first_place)
            carried = (k1[-1], k2[-1], first_key[-1], first_place[-1])
            out = known | (key != first_key) | (place != first_place)
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(place[out] & 0xFFFFFFFF), pa.array((place[out] >> 32).astype(np.int32))], ["key", "crc", "start"])

    marks = rows.mapInArrow(tidy(candidates), "k1 long, k2 long, key long, place long, known boolean")
    met = marks.repartition("k1").sortWithinPartitions("k1", "k2", "key", "place")
    return met.mapInArrow(tidy(later), "key long, crc long, start int")


OUTPUTS = {"kept": pa.string(), "kept_sha256": pa.string()}


def drop_repeats(docs: DataFrame, size: int = 20, output: str = "kept", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that is covered by a window of ``size`` words which also starts earlier.

    Returns doc_id, n_words, n_removed and ``output``: kept (the words left, joined by one space) or
    kept_sha256 (its digest).  Windows are judged on the input.  Earlier means a smaller doc_id, null
    first, or the same doc_id and an earlier start; the same row given twice is no earlier occurrence of
    itself, so both copies keep the same words.  Null and empty texts have no words; texts shorter than a
    window lose nothing; an empty table gives an empty result; other columns are ignored.
    """
    bounded(docs.sparkSession, "64m")
    rows = keyed(docs, id_col, text_col)
    marked = mark_windows(rows, size).groupBy("key", "crc").agg(F.collect_list("start").alias("starts"))
    joined = rows.join(marked, ["key", "crc"], "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, out = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words, starts = Words(text), batch.column(2)[n]
                kept = words.joined
                gone = np.zeros(len(words), bool)
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    s = np.unique(starts.values.to_numpy())
                    edge[s] += 1
                    np.add.at(edge, s + size, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    edges = np.diff(np.concatenate([[1], gone, [1]]).astype(np.int8))
                    left = zip(np.flatnonzero(edges == -1).tolist(), np.flatnonzero(edges == 1).tolist(), strict=True)
                    kept = b" ".join(kept[words.starts[a] : words.ends[b - 1]] for a, b in left)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                out.append(kept.decode("utf-8") if output == "kept" else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, OUTPUTS[output])], ["doc_id", "n_words", "n_removed", output])

    return joined.mapInArrow(tidy(cut), f"doc_id long, n_words long, n_removed long, {output} string")
