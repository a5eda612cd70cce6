"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' character pieces (2 to 4 letters of the word with its
borders) and of the words themselves, hashed into a fixed number of buckets.  Embeddings and the softmax
layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows.  A
part of the sample is held back: it sets the temperature that calibrates the scores, and the score below
which a text is rejected.

Only the text is an input.  What is broadcast is the product of embeddings and softmax layer, buckets x
languages numbers, whatever the corpus's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import batches, pick, position, tidy

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIMENSIONS = 1 << 16, 16
#: Different labelled texts in the training sample at most, and languages: those with most different texts.
SAMPLE, LANGUAGES = 3000, 256
#: Rounds over the sample, more for a small one, so that as many steps as this are taken at least.
EPOCHS, STEPS, RATE, HELD_BACK = 8, 4000, 0.5, 0.2
#: This share of the held-back rows is rejected, as far as their number resolves it, and never for a score above CEILING.
REJECTED, CEILING = 0.005, 0.5
#: Words of a generation that a worker remembers.
MEMORY = 1 << 16
#: Characters of texts and of new words that are worked on at a time, times the numbers in a row of scores.
TEXTS, WORDS = 1 << 21, 1 << 18
#: CRC-32 by bytes.
TABLE = np.array([crc32(bytes([255 ^ i])) ^ 0xFF000000 for i in range(256)], np.uint32)


def pieces(word: str) -> list[int]:
    """Buckets of a word and its pieces; none if it has no letter."""
    if not any(map(str.isalpha, word)):
        return []
    framed = f"<{word}>"
    parts = [framed, *(framed[i : i + n] for n in (2, 3, 4) for i in range(len(framed) - n + 1))]
    return [crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts]


def portions(strings: Iterable[str], most: int) -> Iterator[list[str]]:
    """The strings in order, in lists of ``most`` characters at most, or of one string."""
    portion: list[str] = []
    size = 0
    for s in strings:
        if portion and size + len(s) > most:
            yield portion
            portion, size = [], 0
        portion.append(s)
        size += len(s)
    if portion:
        yield portion


def read(register: np.ndarray, points: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the UTF-8 bytes of one more code point each."""

    def byte(old: np.ndarray, value: np.ndarray) -> np.ndarray:
        return TABLE[(old ^ value) & 255] ^ (old >> 8)

    if points.max() < 0x80:
        return byte(register, points)
    lead = np.select([points < 0x80, points < 0x800, points < 0x10000], [points, 0xC0 | points >> 6, 0xE0 | points >> 12], 0xF0 | points >> 18)
    out = byte(register, lead)
    for least, shift in ((0x10000, 12), (0x800, 6), (0x80, 0)):
        at = np.flatnonzero(points >= least)
        out[at] = byte(out[at], 0x80 | points[at] >> shift & 0x3F)
    return out


def all_pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``pieces`` of all words, one after the other but in another order within a word, and how many each word has."""
    framed = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(words))
    ends = sizes.cumsum()
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    # characters from each one to the end of its word
    left = np.repeat(ends, sizes) - np.arange(len(points))
    real = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
    left[~np.repeat(real, sizes)] = 0
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    found, there = np.zeros((len(points), 4), np.int32), np.zeros((len(points), 4), bool)
    starts = ends - sizes
    found[starts, 0] = [crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in framed]
    there[starts, 0] = real
    register = read(np.full(len(points), 0xFFFFFFFF, np.uint32), points)
    for k in (1, 2, 3):
        register = read(register, padded[k : k + len(points)])
        found[:, k] = ~register & (BUCKETS - 1)
        there[:, k] = left > k
    return found[there], np.add.reduceat(there.sum(axis=1), starts)


@dataclass
class Model:
    """``weights``: each bucket's part of the logits, already divided by the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    threshold: float


class Scores(dict):
    """Word -> its row in ``rows``: summed logits of its pieces, and how many there are.

    Words of the last two generations are remembered, so that frequent ones stay.
    """

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.languages) + 1
        self.rows = np.zeros((1 << 12, self.width))
        self.old: tuple[dict[str, int], np.ndarray] = {}, self.rows

    def place(self, rows: np.ndarray, words: list[str]) -> None:
        n = len(self)
        while n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(words)] = rows
        self.update(zip(words, range(n, n + len(words)), strict=True))

    def learn(self, words: list[str]) -> None:
        """Rows of new words, from the generation before or from their pieces."""
        places, rows = self.old
        before = [w for w in words if w in places]
        self.place(rows[[places[w] for w in before]], before)
        for some in portions((w for w in words if w not in places), WORDS // self.width):
            found, sizes = all_pieces(some)
            made = np.zeros((len(some), self.width))
            real = np.flatnonzero(sizes)
            if len(real):
                made[real, :-1] = np.add.reduceat(self.model.weights[found], (sizes.cumsum() - sizes)[real], axis=0)
            made[:, -1] = sizes
            self.place(made, some)

    def score(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        return [x for some in portions((t or "" for t in texts), TEXTS // self.width) for x in self.scored(some)]

    def scored(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        if len(self) > MEMORY:
            self.old = dict(self), self.rows[: len(self)].copy()
            self.clear()
        found = [WORD.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.learn([w for w in set(chain.from_iterable(found)) if w not in self])
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
        total = np.zeros((len(texts), self.width))
        spoken = np.flatnonzero(sizes)
        if len(spoken):
            total[spoken] = np.add.reduceat(self.rows[places], (sizes.cumsum() - sizes)[spoken], axis=0)
        logits = total[:, :-1] / np.maximum(total[:, -1:], 1) + self.model.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for k, lang in enumerate(best):
            yield (self.model.languages[lang], float(p[k, lang])) if total[k, -1] else (UNKNOWN, 0.0)


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """Texts of each language in a sample of ``size``: all of a rare one, and equal shares of what is left."""
    out, left = {}, size
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, left // (len(counts) - k)))
        left = max(0, left - out[lang])
    return out


def sampled(labelled: DataFrame, size: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, their shares) of ``size`` different texts at most; whole texts are read.

    Each language has the texts of smallest hash, as many as ``quotas`` gives it, so none is left out for being
    rare, and copies of a text count once, so that a large group of copies cannot fill the sample.  What of a
    language can be among them is cut off by an estimate of the number of its different texts, which leaves
    half as many again and some more.
    """
    hashed = labelled.withColumn("h", F.xxhash64(F.lit("sample"), "text").bitwiseAND((1 << 53) - 1))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    number = {r["lang"]: max(1, r["n"]) for r in counts.collect()}
    share = quotas(number, size)
    if not share:
        return []
    pairs = [(lang, q, min(1 << 53, int((1.5 * q + 30) / number[lang] * (1 << 53)))) for lang, q in share.items()]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(pairs, "lang string, quota int, below long"))
    near = hashed.join(limits, "lang").filter(F.col("h") < F.col("below")).select("lang", "text", "h", "quota").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = near.withColumn("place", place).filter(F.col("place") <= F.col("quota")).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids, shares = [], [], []
            for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                found = [all_pieces(some)[0] for some in portions(WORD.findall(text.lower()), WORDS)]
                if sum(map(len, found)):
                    b, n = np.unique(np.concatenate(found), return_counts=True)
                    langs.append(lang), ids.append(b), shares.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "ids", "shares"])

    rows = chosen.mapInArrow(tidy(features), "lang string, ids array<int>, shares array<float>").toArrow()
    out = [(a, np.asarray(b.values), np.asarray(c.values)) for a, b, c in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2), strict=True)]
    return sorted(out, key=lambda x: (crc32(x[1].tobytes() + x[2].tobytes()), x[0]))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Train on all rows but the first fifth of each language, calibrate on that; None without labelled rows."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by_language = [[r for r in rows if r[0] == lang] for lang in languages]
    check = [r for own in by_language for r in own[: int(len(own) * HELD_BACK)]] or rows
    train = [r for own in by_language for r in own[int(len(own) * HELD_BACK) :]]
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(train)))
    step, steps = 0, epochs * len(train)
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            lang, ids, shares = train[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = shares @ embed[ids]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[languages.index(lang)] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * p
            # an embedding sees its small share only, hence the larger rate
            embed[ids] -= (rate * 50) * shares[:, None] * back
    weights = embed @ layer
    logits = np.array([shares @ weights[ids] + bias for _, ids, shares in check], dtype=np.float64)
    truth = np.array([languages.index(lang) for lang, _, _ in check])

    def scores(t: float) -> np.ndarray:
        z = logits / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return -np.log(np.maximum(scores(t)[np.arange(len(truth)), truth], 1e-12)).mean()

    temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    best = np.sort(scores(temperature).max(axis=1))
    threshold = min(CEILING, float(best[int(len(best) * REJECTED)]))
    return Model(languages, (weights / temperature).astype(np.float32), bias / temperature, threshold)


def train(docs: DataFrame, usable: Column | None = None, size: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on rows of ``docs`` with text and lang (and ``usable``, an expression over docs)."""
    rows = docs if usable is None else docs.filter(usable)
    labelled = pick(rows, lang=(lang_col, "string"), text=(text_col, "string")).filter("lang is not null and text is not null")
    return fit(sampled(labelled, size))


def identify(docs: DataFrame, model: Model | None, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (or, with ``keep``, all columns of ``docs``), lang_pred, score and rejected, for every row.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is everything if there
    was nothing to learn from.  Whole texts are read, whatever their length; repeated rows get equal results;
    an empty table gives an empty result.
    """
    # by position, for names may clash
    given = docs.toDF(*(f"_p{i}" for i in range(len(docs.columns))))
    passed = given.columns if keep else [f"_p{position(docs, id_col)}"]
    names = docs.columns if keep else ["doc_id"]
    rows = given.select(*(F.col(c) if keep else F.col(c).cast("long") for c in passed), F.col(f"_p{position(docs, text_col)}").cast("string").alias("_text"))
    batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value) if shared.value else None
        for batch in given:
            texts = (x.as_py() for x in batch.column(len(passed)))
            found = scores.score(texts) if scores is not None else [(UNKNOWN, 0.0) for _ in texts]
            limit = shared.value.threshold if shared.value else 1.0
            columns = [batch.column(i) for i in range(len(passed))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == UNKNOWN or x[1] < limit for x in found], pa.bool_())], [*passed, "lang_pred", "score", "rejected"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(tidy(run), ", ".join([*kinds, "lang_pred string", "score double", "rejected boolean"])).toDF(*names, "lang_pred", "score", "rejected")
