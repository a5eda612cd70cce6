"""Byte-level BPE: a backtracking encoder with exact merges in linear time, and an offset-table decoder.

The encoder finds the longest vocabulary entry at every offset with an Aho-Corasick automaton, then
walks left to right.  A token is taken if the pair (previous token, token) could stand side by side
in a merge result (the pair-compatibility table); if not, the next shorter prefix token is tried,
and if none is left the walk steps back over the previous token, whose end offset is never tried
again.  Each offset is ruled out at most once, so the time is linear in the text.

Nothing is trained here and the vocabulary file is read from the path given.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.common import batches, documents, tidy

#: Pre-tokens of the byte-level scheme.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beside a space, also at either end.
UNEVEN = regex.compile(r"\s |(?: )(?:\s|$)|^ ")
#: Pairs of tokens, and bytes of texts and ids (with ENTRY for each one), that a worker remembers before it starts afresh.
MEMORY, BYTES, ENTRY = 1 << 19, 1 << 25, 160


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """What was made of pieces of text, with the bytes that it takes; texts without a space are pieces of any length."""

    size = 0

    def made(self, piece: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, piece: str) -> bytes:
        out = self.made(piece)
        if self.size > BYTES:
            self.clear()
            self.size = 0
        self.size += len(piece) + len(out) + ENTRY
        self[piece] = out
        return out


class Words(Remembered):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def made(self, piece: str) -> bytes:
        return pack(self.encode(piece.encode("utf-8")))


class AfterSpace(Remembered):
    """What stands between two spaces -> the ids of it and the space before it."""

    def __init__(self, coder: Codec):
        self.split, self.words = coder.split.findall, coder.words

    def made(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(" " + piece)))


def check(spec: dict) -> None:
    """Refuse a file whose scheme is another one than that of this encoder."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    other = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    other += [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
    other += [k for k in ("normalizer",) if spec.get(k)]
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or other:
        raise ValueError(f"not a plain byte-level BPE file: {model.get('type')}, {before.get('type')}, {other}")
    if before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("a byte-level file with a prefix space or without its own pattern is not supported")


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        model, letters = spec["model"], byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.specials.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for word, i in model["vocab"].items():
            self.strings[i] = bytes(letters[c] for c in word)
        ids = model["vocab"]
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        for k, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = ids[left + right]
            self.pairs[ids[left], ids[right]] = made
            if self.parts[made] == (made, made):
                self.parts[made] = (ids[left], ids[right])
        self.automaton = ahocorasick.Automaton()
        by_string = {}
        for i, s in enumerate(self.strings):
            if s and i not in self.specials.values():
                by_string[s] = i
                self.automaton.add_word(s.decode("latin-1"), i)
        self.whole = by_string
        self.automaton.make_automaton()
        #: The next shorter token that is a prefix of each token, -1 if there is none.
        self.shorter = [-1] * size
        for s, i in by_string.items():
            self.shorter[i] = next((by_string[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_string), -1)
        self.lengths = [len(s) for s in self.strings]
        for text, i in self.specials.items():
            self.strings[i] = text.encode("utf-8")
        #: Decoding: all tokens' bytes in one run, and where each one starts.
        self.run = np.frombuffer(b"".join(self.strings), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in self.strings])]).astype(np.int64)
        self.compatible: dict[int, bool] = {}
        self.words = Words(self.encode_bytes)
        self.split = regex.compile(SPLIT)
        self.pieces = AfterSpace(self)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def forget(self) -> None:
        for memory in (self.words, self.pieces, self.compatible):
            memory.clear()
        self.words.size = self.pieces.size = 0

    def fits(self, one: int, two: int) -> bool:
        """Whether the two tokens can be neighbours, that is, whether no merge across their border comes first."""
        key, limit, out = one << 32 | two, 1 << 62, None
        while out is None:
            made = self.pairs.get((one, two))
            if made is not None and made < limit:
                out = False
            elif one > two:
                limit, one = one, self.parts[one][1]
                if one == limit:
                    limit, two = two + 1, self.parts[two][0]
                    if two + 1 == limit:
                        out = True
            else:
                limit, two = two + 1, self.parts[two][0]
                if two + 1 == limit:
                    limit, one = one, self.parts[one][1]
                    if one == limit:
                        out = True
        if len(self.compatible) >= MEMORY:
            self.compatible.clear()
        self.compatible[key] = out
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.whole.get(data)) is not None:
            return [whole]
        n, lengths, compatible = len(data), self.lengths, self.compatible
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end - lengths[i] + 1] = i
        open_, out, at, token, last = bytearray(b"\x01") * (n + 1), [], 0, longest[0], -1
        while token != -1:
            while True:
                end = at + lengths[token]
                if open_[end]:
                    fits = True if last < 0 else compatible.get(last << 32 | token)
                    if fits is None:
                        fits = self.fits(last, token)
                    if fits:
                        out.append(token)
                        at, last, token = end, token, longest[end]
                        break
                if (less := self.shorter[token]) >= 0:
                    token = less
                    continue
                open_[at] = 0
                token = out.pop()
                at, last = at - lengths[token], out[-1] if out else -1
                break
        return out

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A space between two characters that are no white space starts a pre-token, so such texts are cut
        there and whole pieces are looked up; white space next to a space needs the full pattern.
        """
        if UNEVEN.search(text):
            return b"".join(map(self.words.__getitem__, self.split.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.words.__getitem__, self.split.findall(first)), *map(self.pieces.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), pack([self.specials[m[0]]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a run of ids: each id's slice of the offset table, gathered at once."""
        i = np.frombuffer(ids, dtype="<u4")
        starts = self.offsets[i]
        lengths = self.offsets[i.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        places = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.run[places].tobytes().decode("utf-8", errors="replace").encode("utf-8")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker and vocabulary."""
    return Codec(path)


KINDS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "decoded": (pa.string(), "string"),
    "n_tokens": (pa.int64(), "long"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def encode_documents(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return doc_id with the ``outputs`` asked for.

    outputs: any of ids, decoded, n_tokens, ids_sha256, decoded_sha256.  A null text is encoded as the
    empty text: no ids.  Rows are independent, so repeated rows, ties and null ids pass through one for
    one; an empty table gives an empty result; other columns are ignored.  ``vocabulary`` is a path that
    every executor can open.
    """

    batches(docs.sparkSession)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in given:
            made: dict[str, list] = {name: [] for name in outputs}
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                decoded = coder.decode(ids)
                for name in outputs:
                    made[name].append(
                        len(ids) // 4 if name == "n_tokens" else hashlib.sha256(ids).hexdigest() if name == "ids_sha256" else hashlib.sha256(decoded).hexdigest() if name == "decoded_sha256" else np.frombuffer(ids, dtype="<i4") if name == "ids" else decoded.decode("utf-8")
                    )
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[name], KINDS[name][0]) for name in outputs)], ["doc_id", *outputs])

        # the tables stay with the worker, what was remembered of texts does not
        coder.forget()

    schema = ", ".join(["doc_id long", *(f"{name} {KINDS[name][1]}" for name in outputs)])
    return documents(docs, id_col, text_col).mapInArrow(tidy(run), schema)
