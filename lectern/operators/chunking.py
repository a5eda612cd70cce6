"""Structure-aware chunks for retrieval.

Candidates come from window expressions: open headings of every element, runs of list items, table texts by
join.  Merging neighbours up to a token budget and cutting long texts are folds along a document; they run
per document over an Arrow stream that is sorted by document, so no document's rows are gathered at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import contextualize
from lectern.operators.sequence import breadcrumb, runs
from lectern.operators.tables import table_texts
from lectern.sources.reader import DocFrames
from lectern.storage import checkpoint

CLASSES = ["SectionHeader", "Title", "Paragraph", "ListItem", "Code", "Formula", "TableElement"]
CHUNK = "doc string, chunk_index int, text string, source_elements array<string>, headings array<string>, page_numbers array<int>, element_types array<string>, language string"
_ARROW = pa.schema([("doc", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("source_elements", pa.list_(pa.string())), ("headings", pa.list_(pa.string())), ("page_numbers", pa.list_(pa.int32())), ("element_types", pa.list_(pa.string())), ("language", pa.string())])


@dataclass(frozen=True)
class Options:
    max_tokens: int = 512
    overlap: int = 50
    merge_list_items: bool = True
    include_headings: bool = True
    chars_per_token: float = 4.0
    #: Without it a text beyond the budget stays whole.
    cut: bool = True

    def tokens(self, text: str) -> int:
        size = len(text.encode("utf-8"))
        return size if self.chars_per_token <= 0 else -int(-size // self.chars_per_token)

    def chars(self, tokens: int) -> int:
        return int(tokens * self.chars_per_token) if self.chars_per_token > 0 else tokens


def candidates(f: DocFrames, o: Options) -> DataFrame:
    """(doc, ord, text, els, headings, pages, types, heading, language): one row per piece that can be a chunk."""
    own = f.elements.filter(F.col("cls").isin(CLASSES))
    texts = table_texts(f.cells).select("doc", F.col("tbl").alias("el"), F.col("text").alias("table_text"))
    full = own.join(texts, ["doc", "el"], "left").withColumn("text", F.coalesce("table_text", "text", F.lit("")))
    heading = F.col("cls").isin("SectionHeader", "Title")
    kept = full.filter(heading | (F.col("cls") == "TableElement") | (F.trim("text") != "")).withColumn("_level", F.when(heading, F.coalesce("level", F.lit(1))))
    crumbs = breadcrumb(kept, "doc", "ord", "_level", "text")
    # a heading's own text is its chunk's text, not its context
    crumbs = crumbs.withColumn("headings", F.when(heading, F.slice("headings", 1, F.greatest(F.size("headings") - 1, F.lit(0)))).otherwise(F.col("headings")))
    item = F.when((F.col("cls") == "ListItem") & F.lit(o.merge_list_items), F.col("parent"))
    grouped = runs(crumbs, "doc", "ord", item)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "el", "text", "page", "cls", "headings")))
    rows = grouped.groupBy("doc", "run").agg(ordered.alias("x"))
    said = F.array_join(F.transform("x", lambda e: e["text"]), "\n")
    docs = f.docs.select("doc", "language").dropDuplicates(["doc"])
    out = rows.select("doc", F.col("x")[0]["ord"].alias("ord"), said.alias("text"), F.transform("x", lambda e: e["el"]).alias("els"), F.col("x")[0]["headings"].alias("headings"), F.array_compact(F.array_distinct(F.transform("x", lambda e: e["page"]))).alias("pages"), F.array_distinct(F.transform("x", lambda e: e["cls"])).alias("types"))
    out = out.withColumn("heading", F.arrays_overlap("types", F.array(F.lit("SectionHeader"), F.lit("Title"))))
    if o.include_headings:
        out = out.withColumn("text", contextualize("headings", "text"))
    return out.join(docs, "doc", "left")


def split(text: str, o: Options) -> list[str]:
    """Pieces of at most the budget: cut at the last newline in reach, else the last space, else hard; neighbours overlap."""
    most, over = max(o.chars(o.max_tokens), 1), o.chars(o.overlap)
    if not o.cut or o.tokens(text) <= o.max_tokens:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + most
        while end > at + 1 and o.tokens(text[at:end]) > o.max_tokens:
            end = at + max(1, (end - at) * 9 // 10)
        end = min(end, len(text))
        if end < len(text):
            cut = text.rfind("\n", at, end)
            cut = cut if cut > at else text.rfind(" ", at, end)
            end = cut if cut > at else end
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at += end - at - over if end - at > over else end - at
    return out


def fold(rows: Iterator[dict], o: Options) -> Iterator[dict]:
    """Merge neighbours under equal headings while they fit, then cut what does not; headings stay alone."""
    held: dict | None = None

    def pieces(x: dict) -> Iterator[dict]:
        for text in split(x["text"], o):
            yield x | {"text": text}

    for x in rows:
        if not o.tokens(x["text"]):
            continue
        both = None if held is None else held["text"] + "\n\n" + x["text"]
        if held is not None and not held["heading"] and not x["heading"] and held["headings"] == x["headings"] and o.tokens(both) <= o.max_tokens:
            union = lambda k, x=x: list(dict.fromkeys([*held[k], *x[k]]))
            held = held | {"text": both, "els": held["els"] + x["els"], "pages": union("pages"), "types": union("types")}
        else:
            if held is not None:
                yield from pieces(held)
            held = x
    if held is not None:
        yield from pieces(held)


def chunks(f: DocFrames, o: Options | None = None) -> DataFrame:
    """All chunks of all documents, numbered within each."""
    o = o or Options()

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Rows of a stream, a document at a time but not held beyond it."""
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        done: list[dict] = []
        for doc, rows in groupby(by_doc(batches), key=lambda r: r["doc"]):
            for k, x in enumerate(fold(rows, o)):
                done.append({"doc": doc, "chunk_index": k, "text": x["text"], "source_elements": x["els"], "headings": x["headings"], "page_numbers": x["pages"], "element_types": x["types"], "language": x["language"]})
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, _ARROW)
                    done = []
        yield pa.RecordBatch.from_pylist(done, _ARROW)

    ordered = candidates(f, o).repartition("doc").sortWithinPartitions("doc", "ord")
    return ordered.mapInArrow(run, CHUNK)


def chunks_json(chunked: DataFrame) -> DataFrame:
    """(doc, json): {"chunks": [{text, metadata}]} of each document."""
    meta = F.struct("chunk_index", "source_elements", "headings", "page_numbers", "element_types", "language")
    each = F.array_sort(F.collect_list(F.struct(F.col("chunk_index").alias("i"), F.struct("text", meta.alias("metadata")).alias("c"))))
    return chunked.groupBy("doc").agg(F.to_json(F.struct(F.transform(each, lambda x: x["c"]).alias("chunks"))).alias("json"))


def renumber(chunked: DataFrame, order: list[str]) -> DataFrame:
    """One numbering across documents.

    Rows are counted by document; documents are ranged in order over partitions and summed up within each, and only the
    sums of partitions, one row each, are summed up in one place.  The numbered documents are written, for ranges
    are drawn anew each time they are computed.
    """
    from pyspark.sql.window import Window

    counts = chunked.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    ranged = checkpoint(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("_part", before.alias("_offset")))
    starts = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, "_part")
    starts = starts.select(*order, (F.col("_before") + F.col("_offset")).alias("_from"))
    return chunked.join(starts, order).withColumn("chunk_index", (F.col("_from") + F.col("chunk_index")).cast("long")).drop("_from")
