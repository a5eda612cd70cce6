"""Conversion: raw bytes to typed frames in one parser pass.

A document is its content: ids are content hashes, and equal files are one document with a row of ``docs`` for
each of its names.  Each different content is parsed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.schema import CELLS, DOC, DOCS, ELEMENTS, PAGES, ROWS
from lectern.storage import stored

#: Parsed rows that are handed on together.
ROWS_AT_ONCE = 8192


@dataclass
class DocFrames:
    docs: DataFrame
    elements: DataFrame
    cells: DataFrame
    pages: DataFrame

    def with_(self, **frames: DataFrame) -> DocFrames:
        return replace(self, **frames)


def readers() -> dict[str, Callable[[str, bytes], list[dict]]]:
    from lectern.sources import asciidoc, delimited, doctags, html, image, latex, markdown, office, pdf, webvtt, xml

    return {
        "html": html.parse, "markdown": markdown.parse, "csv": delimited.parse, "webvtt": webvtt.parse,
        "asciidoc": asciidoc.parse, "latex": latex.parse, "xml": xml.parse, "docx": office.parse_docx,
        "pptx": office.parse_pptx, "xlsx": office.parse_xlsx, "image": image.parse, "doctags": doctags.parse,
        "pdf": pdf.parse,
    }


def parse_one(name: str, data: bytes, source_format: str | None, max_size: int | None) -> list[dict]:
    """Rows of one document; whatever fails is a document row with status Failure, and no other document's concern."""
    try:
        if max_size is not None and len(data) > max_size:
            raise ValueError(f"file has {len(data)} bytes, more than {max_size}")
        parse = readers().get(source_format or "")
        if parse is None:
            raise ValueError(f"no reader for format {source_format!r}")
        return parse(name, data)
    except Exception as e:  # the error belongs to this document's row
        digest = hashlib.sha256(data).hexdigest()
        row = {"kind": "doc", "doc": DOC + digest, "source_format": source_format, "document_hash": digest}
        return [row | {"file_name": name, "file_size": len(data), "status": "Failure", "error": f"{type(e).__name__}: {e}"}]


def read_rows(sources: DataFrame, max_size: int | None = None) -> DataFrame:
    """Parse (name, content binary, format) into rows of ``ROWS``, a few documents at a time."""
    schema = to_arrow_schema(StructType.fromDDL(ROWS))

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for name, data, kind in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows += parse_one(name.as_py(), data.as_py() or b"", kind.as_py(), max_size)
                if len(rows) >= ROWS_AT_ONCE:
                    yield packed(rows)
                    rows = []
        yield packed(rows)

    return sources.select("name", "content", "format").mapInArrow(run, ROWS)


def content_hash() -> Column:
    return F.sha2(F.coalesce("content", F.lit(b"")), 256)


def different(sources: DataFrame) -> DataFrame:
    """(name, content, format): each different content once, under its smallest name.

    Copies are taken out before the exchange, and parsing is spread by content, however few files the bytes came in.
    """
    one = sources.groupBy(content_hash().alias("id")).agg(F.min(F.struct("name", "format", "content")).alias("x"))
    return one.select("x.name", "x.content", "x.format")


def frames(rows: DataFrame, names: DataFrame | None = None) -> DocFrames:
    """The four typed tables; ``names`` (document_hash, file_name) gives each document a row for each of its names."""
    pick = lambda kind, columns: rows.filter(F.col("kind") == kind).select(*columns)
    docs = pick("doc", DOCS)
    if names is not None:
        docs = docs.drop("file_name").join(names, "document_hash").select(*DOCS)
    return DocFrames(docs, pick("element", ELEMENTS), pick("cell", CELLS), pick("page", PAGES))


def convert(sources: DataFrame, max_size: int | None = None, store: bool = False) -> DocFrames:
    """Detect formats where they are not given, parse each different content once, and split into frames.

    With ``store`` the parsed rows are written once, by kind, and all frames are read from there; without it each
    frame that is used runs the parser, which is less work for a query that uses a single one.
    """
    from lectern.sources.detect import detected

    if "format" not in sources.columns:
        sources = sources.withColumn("format", detected("name", "content"))
    rows = read_rows(different(sources), max_size)
    names = sources.select(content_hash().alias("document_hash"), F.col("name").alias("file_name")).distinct()
    return frames(stored(rows, "kind") if store else rows, names)


def read_files(spark: SparkSession, path: str, mode: str = "file", **options) -> DocFrames:
    """Documents of a folder, by the binary reader."""
    from lectern.sources.detect import detected

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    sources = files.select(name, "content").withColumn("format", detected("name", "content", mode))
    return convert(sources, **options)
