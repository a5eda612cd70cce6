"""Format detection as Column expressions; only a look into ZIP archives needs Python."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

EXTENSIONS = {
    "markdown": "md markdown mkd mdown", "html": "html htm xhtml", "csv": "csv tsv", "docx": "docx", "xlsx": "xlsx xls xlsm", "pptx": "pptx", "pdf": "pdf", "latex": "tex latex ltx",
    "image": "png jpg jpeg gif bmp tif tiff webp", "webvtt": "vtt", "asciidoc": "adoc asciidoc asc", "xml": "xml nxml jats", "json": "json", "text": "txt text", "xbrl": "xbrl", "epub": "epub", "rtf": "rtf", "doctags": "doctags dt",
}
MIMES = {
    "markdown": "text/markdown text/x-markdown", "html": "text/html application/xhtml+xml", "csv": "text/csv text/tab-separated-values", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "latex": "application/x-latex application/x-tex text/x-tex", "image": "image/png image/jpeg image/gif image/bmp image/tiff image/webp", "webvtt": "text/vtt", "asciidoc": "text/asciidoc text/x-asciidoc", "xml": "application/xml text/xml", "json": "application/json", "text": "text/plain", "epub": "application/epub+zip", "rtf": "application/rtf text/rtf", "xbrl": "application/xbrl+xml",
}

#: Bytes that are looked at.
HEAD = 8192


def _mapped(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kind, keys in table.items() for k in keys.split() for x in (k, kind)]
    return F.try_element_at(F.create_map(*pairs), key)


def by_extension(name: str | Column) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return _mapped(F.lower(F.regexp_extract(n, r"\.([^./\\]+)$", 1)), EXTENSIONS)


def by_mime(mime: str | Column) -> Column:
    m = F.col(mime) if isinstance(mime, str) else mime
    return _mapped(F.lower(F.trim(F.substring_index(m, ";", 1))), MIMES)


def zip_kind(content: Column) -> Column:
    """Office kind of an archive by its entries."""

    def one(data: bytes) -> str | None:
        try:
            names = zipfile.ZipFile(io.BytesIO(bytes(data))).namelist()
        except (zipfile.BadZipFile, TypeError):
            return None
        for prefix, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("META-INF/container.xml", "epub")):
            if any(n.startswith(prefix) for n in names):
                return kind
        return None

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return pandas_udf(run, "string")(content)


def by_magic(content: str) -> Column:
    """Binary formats by their first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda *xs: F.coalesce(*(F.when(head.startswith(x), True) for x in xs), F.lit(False))
    image = starts("89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "47494638") | (head.startswith("52494646") & head.endswith("57454250"))
    return F.when(starts("25504446"), "pdf").when(image, "image")


def csv_like(text: Column) -> Column:
    """At least two of the first ten lines, and every one that is not blank has the same number of commas, or else of tabs."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 10), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")

    def same(sep: str) -> Column:
        counts = F.array_distinct(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit("")))))
        return (F.size(counts) == 1) & (F.element_at(counts, 1) > 0)

    return (F.size(lines) >= 2) & (same(",") | same("\t"))


def by_text(text: Column) -> Column:
    """Text formats by their beginnings and markers."""
    lead = F.lower(F.regexp_replace(text, r"^[\s\x{FEFF}]+", ""))
    xml = lead.startswith("<?xml")
    marked = lambda *xs: F.coalesce(*(F.when(text.contains(x), True) for x in xs), F.lit(False))
    return (
        F.when(lead.startswith("webvtt"), "webvtt")
        .when(lead.startswith("<!doctype html") | lead.startswith("<html"), "html")
        .when(xml & lead.contains("<html"), "html")
        .when(xml & lead.contains("xbrl"), "xbrl")
        .when(xml, "xml")
        .when(lead.startswith("<doctag"), "doctags")
        .when(marked("\\documentclass", "\\begin{document}"), "latex")
        .when(csv_like(text), "csv")
    )


def by_content(content: str) -> Column:
    """First HEAD bytes: magic numbers, archives, then text if it is UTF-8."""
    # a cut may fall inside a character, of which 3 bytes at most are left
    heads = [F.substring(content, 1, HEAD - k).cast("string") for k in range(4)]
    text = F.coalesce(F.try_validate_utf8(heads[0]), F.when(F.length(content) > HEAD, F.coalesce(*map(F.try_validate_utf8, heads[1:]))))
    zipped = F.hex(F.substring(content, 1, 4)) == "504B0304"
    return F.coalesce(by_magic(content), F.when(zipped, zip_kind(F.when(zipped, F.col(content)))), F.when(~zipped, by_text(text)))


def detected(name: str, content: str, mode: str = "file") -> Column:
    """Files trust the extension first, streams the bytes first."""
    ext, data = by_extension(name), by_content(content)
    return F.coalesce(ext, data) if mode == "file" else F.coalesce(data, ext)


def formats(spark: SparkSession) -> DataFrame:
    from lectern.sources.reader import readers

    known = readers()
    return spark.createDataFrame([(k, v.split(), k in known) for k, v in EXTENSIONS.items()], "format string, extensions array<string>, supported boolean")


def file_info(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    return files.select(F.col(name).alias("name"), detected(name, content).alias("format"), F.length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"))


def within_size(files: DataFrame, most: int, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the number of bytes."""
    size = F.coalesce(F.length(content), F.lit(0))
    return files.filter(size <= most), files.filter(size > most)
