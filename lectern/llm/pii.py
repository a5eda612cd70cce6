r"""Personal data: fixed patterns, and terms that give protected entities away.

The patterns find emails, IP addresses, card and phone numbers.  Each distinct one is a protected entity c.
The terms t of all documents that mention it are collected, and the corpus tells how much a term reveals about an entity:

    PMI(c; t) = log2(N n(c, t) / (n(c) n(t))),    disclosure = PMI(c; t) / IC(c),   IC(c) = log2(N / n(c))

with n(.) counting documents over the whole corpus.  The disclosure is 1 if t occurs only in documents of c and falls
as t occurs elsewhere.  Terms of enough support whose disclosure reaches GENERALISE are generalised wherever
they occur, from REMOVE on they are removed.  What a term is generalised to is learned from the corpus too: a
term that most documents of the entity share and that reveals no entity.

The corpus is read four times: for entities, for terms together with entities of enough texts, for terms
alone, and for spans.  What is in question is few, so the second and third reading look entities or words up in
a bitmap, whose size follows their number, and send on only what it lets through; joins then decide exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batches as bounded
from lectern.llm.common import crc32_text, narrow, near, position, tidy
from lectern.llm.substring import NO_ID, keyed

KINDS = ("email", "ip", "card", "phone")
ADDED = "term"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails from a digit run's start fails from all its digits, so only starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
#: Code points on either side of a mention that ``terms_beside`` looks at; the disclosure counts whole documents.
CONTEXT = 48
#: Different texts that must hold both a term and an entity; fewer are no evidence about an entity.
SUPPORT = 3
GENERALISE, REMOVE = 0.9, 0.98
#: Revealing terms up to which all workers hold them.
TERMS = 1 << 17
#: Fewest and most bits that tell a bitmap's cells, and cells for each row put into it.
BITS, SPARSE = (16, 25), 32
#: Rows up to which cells are gathered without taking duplicates out first.
FEW = 1 << 20
MEMORY = 1 << 17
#: Pairs of an entity and a term that a worker sends together.
PAIRS = 1 << 16


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start; code points, end exclusive."""
    return [(kind, *span) for kind, find in FINDERS.items() for span in find(text)]


def entity(kind: str, mention: str) -> str:
    return f"{kind}:{digits_of(mention) if kind in ('card', 'phone') else mention.lower()}"


def terms_beside(text: str, start: int, end: int, taken: list[tuple[str, int, int]]) -> set[str]:
    low, high = max(start - CONTEXT, 0), min(end + CONTEXT, len(text))
    out = set()
    for a, b in ((low, start), (end, high)):
        for m in TERM.finditer(text, a, b):
            cut = (m.start() == a == low > 0 and text[a - 1].isalpha()) or (m.end() == b == high < len(text) and text[b].isalpha())
            if not cut and not any(s < m.end() and m.start() < e for _, s, e in taken):
                out.add(m[0].lower())
    return out


def terms_of(text: str) -> set[str]:
    """The terms of a document, counted alike for pairs and for terms alone."""
    return set(TERM.findall(text.lower()))


@dataclass
class Bits:
    """A bitmap over the upper bits of 64-bit hashes."""

    bits: np.ndarray
    width: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = (hashes.view(np.uint64) >> np.uint64(64 - self.width)).astype(np.int64)
        return self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 1


class Lets(dict):
    """Word -> whether the bitmap lets it through."""

    def __init__(self, bits: Bits):
        self.bits, self.width = bits.bits, bits.width

    def __missing__(self, word: str) -> bool:
        cell = xxhash.xxh64_intdigest(word, seed=42) >> (64 - self.width)
        out = self[word] = bool(self.bits[cell >> 3] >> (7 - (cell & 7)) & 1)
        return out


def bitmap(terms: DataFrame, hashed: Column | None = None) -> Broadcast:
    """The cells that rows of ``terms`` hit, by the hash of column term or by ``hashed``; SPARSE cells a row, within BITS.

    2**BITS[1] cells at most come to the driver, whatever the number of rows; beyond that more is let through.
    """
    n = terms.count()
    width = min(max(ceil(log2(max(n, 1) * SPARSE)), BITS[0]), BITS[1])
    cells = terms.select(F.shiftrightunsigned(F.xxhash64("term") if hashed is None else hashed, 64 - width).cast("int").alias("cell"))
    hit = np.zeros(1 << width, np.uint8)
    hit[np.asarray((cells if n <= FEW else cells.distinct()).toArrow().column(0), np.int64)] = 1
    return terms.sparkSession.sparkContext.broadcast(Bits(np.packbits(hit), width))


def mentioned(rows: DataFrame) -> DataFrame:
    """(entity, n_entity, n_texts): documents, and different texts, that mention each entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(3).to_pylist():
                code = None
                for name in {entity(kind, text[start:end]) for kind, start, end in base_spans(text)}:
                    code = xxhash.xxh64_intdigest(text) - (1 << 63) if code is None else code
                    found[name, code] += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array(found.values(), pa.int64())], ["entity", "code", "n"])

    sent = rows.mapInArrow(tidy(run), "entity string, code long, n long")
    by_text = sent.groupBy("entity", "code").agg(F.sum("n").alias("n"))
    return by_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))


def together(rows: DataFrame, lets: Broadcast) -> DataFrame:
    """(entity, term, n_both, n_texts): documents, and different texts, that hold both, for entities that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lets(lets.value)
        for batch in batches:
            if len(known) > MEMORY:
                known.clear()
            out: list[list] = [[], [], [], []]
            for text, n in Counter(batch.column(3).to_pylist()).items():
                names = [x for x in {entity(kind, text[start:end]) for kind, start, end in base_spans(text)} if known[x]]
                if not names:
                    continue
                terms, code = terms_of(text), xxhash.xxh64_intdigest(text) - (1 << 63)
                for name in names:
                    for column, x in zip(out, ([name] * len(terms), terms, [code] * len(terms), [n] * len(terms)), strict=True):
                        column.extend(x)
                    if len(out[0]) > PAIRS:
                        yield packed(out)
                        out = [[], [], [], []]
            yield packed(out)

    def packed(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["entity", "term", "code", "n"])

    sent = rows.mapInArrow(tidy(run), "entity string, term string, code long, n long")
    by_text = sent.groupBy("entity", "term", "code").agg(F.sum("n").alias("n"))
    return by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_texts"))


def term_counts(rows: DataFrame, lets: Broadcast) -> DataFrame:
    """(term, n_docs): documents with the term, for all terms that the bitmap lets through; sent once for many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = Lets(lets.value), Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])

        for batch in batches:
            if len(known) > MEMORY:
                known.clear()
            for text in batch.column(3).to_pylist():
                found.update(filter(known.__getitem__, terms_of(text)))
            if len(found) > PAIRS:
                yield packed()
                found.clear()
        yield packed()

    return rows.mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def revealing(rows: DataFrame) -> DataFrame:
    """(term, disclosure, general): terms that reveal some entity, with the largest disclosure; a written table.

    general is what a term to be generalised becomes: of the terms in at least half the documents of the entity that
    reveal no entity, the one that tells most about it.  It is null if there is none.
    """
    bounded(rows.sparkSession)
    total = rows.count()
    # an entity of too few texts, or in all documents, has no revealing term
    entities = narrow(mentioned(rows).filter((F.col("n_texts") >= SUPPORT) & (F.col("n_entity") < total)).select("entity", "n_entity"))
    counted = together(rows, bitmap(entities.select(F.col("entity").alias("term"))))
    pairs = narrow(counted.filter(F.col("n_texts") >= SUPPORT).select("entity", "term", "n_both"))
    counts = term_counts(rows, bitmap(pairs.select("term"))).select("term", F.col("n_docs").alias("n_term"))
    pmi = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    seen = counts.join(near(pairs), "term").join(near(entities), "entity")
    seen = narrow(seen.select("entity", "term", "n_both", "n_entity", (pmi / content).alias("disclosure")))
    top = narrow(seen.groupBy("term").agg(F.max(F.struct("disclosure", "entity")).alias("top")).select("term", "top.*"))
    found = top.filter(F.col("disclosure") >= GENERALISE)
    plain = near(narrow(top.filter(F.col("disclosure") < GENERALISE).select("term")))
    common = seen.filter(F.col("n_both") * 2 >= F.col("n_entity")).join(plain, "term", "left_semi")
    general = common.groupBy("entity").agg(F.max(F.struct("disclosure", "term")).alias("x"))
    general = near(narrow(general.select("entity", F.col("x.term").alias("general"))))
    return narrow(found.join(general, "entity", "left").select("term", "disclosure", "general"))


def gathered(terms: DataFrame) -> Broadcast | None:
    """term -> (disclosure, general) for all workers, if there are TERMS of them at most."""
    if terms.count() > TERMS:
        return None
    return terms.sparkSession.sparkContext.broadcast({r["term"]: (r["disclosure"], r["general"]) for r in terms.collect()})


def outside(text: str, known, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Mentions of ``known`` terms outside the ``spans`` of the patterns."""
    if any(map(known.__contains__, set(TERM.findall(text.lower())))):
        for m in TERM.finditer(text):
            if m[0].lower() in known and not any(s < m.end() and m.start() < e for _, s, e in spans):
                yield m


def told(kind: str, start: int, end: int, disclosure: float | None = None, general: str | None = None) -> dict:
    return {"kind": kind, "start": start, "end": end, "disclosure": disclosure, "general": general}


def spans_of(text: str, known: dict[str, tuple[float, str | None]]) -> tuple[list[dict], list[dict]]:
    """Spans of the patterns, and of revealing terms, both by start."""
    base = base_spans(text)
    return [told(*x) for x in base], [told(ADDED, *m.span(), *known[m[0].lower()]) for m in outside(text, known, base)]


class Held:
    """The words that a bitmap lets through, as a set that remembers."""

    def __init__(self, bits: Bits):
        self.known = Lets(bits)

    def __contains__(self, word: str) -> bool:
        return self.known[word]


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, crc, start, end, disclosure, general) of every mention of a revealing term outside base spans; equal rows give it once."""
    lets = bitmap(terms)
    names = ["key", "crc", "term", "start", "end"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(lets.value)
        for batch in batches:
            if len(held.known) > MEMORY:
                held.known.clear()
            out = []
            for key, crc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                out += [(key, crc, m[0].lower(), *m.span()) for m in outside(text, held, base_spans(text))]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    found = rows.mapInArrow(tidy(run), "key long, crc long, term string, start int, end int")
    return found.join(terms, "term").select("key", "crc", "start", "end", "disclosure", "general").distinct()


SPANS = "array<struct<kind:string,start:int,end:int,disclosure:double,general:string>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64()), ("general", pa.string())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, crc, base, added) for every document: spans of the patterns, and of revealing terms, both by start.

    key and crc tell the row's text apart when ids repeat.  Up to TERMS revealing terms are looked up where the
    patterns are; more are joined.  Null and empty texts have no spans; whole texts are
    read in time linear in their length; repeated rows get equal spans; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    terms = revealing(rows)
    known = gathered(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = {} if known is None else known.value
        for batch in batches:
            found = [spans_of(text, here) for text in batch.column(3).to_pylist()]
            spans = [pa.array([x[i] for x in found], SPAN_ARROW) for i in range(2)]
            columns = [batch.column(2), batch.column(0), batch.column(1), *spans]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "crc", "base", "added"])

    base = rows.mapInArrow(tidy(run), f"doc_id long, key long, crc long, base {SPANS}, added {SPANS}")
    if known is not None:
        return base
    one = F.struct("start", "end", "disclosure", "general")
    spans = term_spans(rows, terms).groupBy("key", "crc").agg(F.array_sort(F.collect_list(one)).alias("terms"))
    added = F.transform(F.coalesce("terms", F.array()), lambda x: F.struct(F.lit(ADDED).alias("kind"), *(x[c].alias(c) for c in ("start", "end", "disclosure", "general"))))
    return base.join(spans, ["key", "crc"], "left").select("doc_id", "key", "crc", "base", added.cast(SPANS).alias("added"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data marked by kind, and revealing terms generalised or removed, in the text column.

    Null texts stay null; repeated rows get equal texts; an empty table gives an empty result; other columns,
    whatever their names, stay as they are.
    """
    names, at = docs.columns, position(docs, text_col)
    flat = docs.toDF(*(f"_p{i}" for i in range(len(names))))
    flat = flat.withColumn(f"_p{at}", F.col(f"_p{at}").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
    terms = revealing(keyed(docs, id_col, text_col))
    known = gathered(terms)
    if known is None:
        own = F.col(f"_p{position(docs, id_col)}").cast("long"), F.coalesce(F.col(f"_p{at}"), F.lit(""))
        given = flat.withColumns({"key": F.coalesce(own[0], F.lit(NO_ID)), "crc": crc32_text(own[1])})
        one = F.struct("start", "end", "disclosure", "general")
        spans = term_spans(keyed(docs, id_col, text_col), terms).groupBy("key", "crc").agg(F.collect_list(one).alias("terms"))
        flat = given.join(spans, ["key", "crc"], "left").drop("key", "crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for n, text in enumerate(texts):
                if text:
                    base, added = spans_of(text, {} if known is None else known.value)
                    if known is None and (more := batch.column(len(names))[n]).is_valid:
                        added = [{"kind": ADDED, **x} for x in more.as_py()]
                    if base or added:
                        texts[n] = sanitise(text, base + added)
            columns = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [f"_p{i}" for i in range(len(names))])

    return flat.mapInArrow(tidy(run), schema).toDF(*names)


def sanitise(text: str, spans: list[dict]) -> str:
    """Mark pattern spans by their kind, put a more general term for revealing ones, remove the most revealing ones.

    A term for which the corpus has no more general one is marked as a term.
    """
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            if x["disclosure"] is None:
                now = f"[{x['kind'].upper()}]"
            elif x["disclosure"] < REMOVE:
                now = x["general"] or f"[{x['kind'].upper()}]"
            else:
                now = ""
            out += [text[at : x["start"]], now]
            at = x["end"]
        else:
            at = max(at, x["end"])
    return "".join([*out, text[at:]])
