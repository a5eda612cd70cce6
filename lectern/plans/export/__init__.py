"""Exporters: one text per document, built by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import escape_doctag, escape_html, format_timestamp, timestamp
from lectern.operators.sequence import list_counters
from lectern.operators.tables import ordered
from lectern.schema import NS
from lectern.sources.reader import DocFrames

FORMATS = ("json", "markdown", "html", "text", "doctags", "webvtt", "jsonld", "turtle", "ntriples", "rdfxml")
EXTENSIONS = {"json": "json", "markdown": "md", "html": "html", "text": "txt", "doctags": "dt", "webvtt": "vtt", "jsonld": "jsonld", "turtle": "ttl", "ntriples": "nt", "rdfxml": "rdf"}
#: Hex digits of a document's hash that name its folder.
FOLDERS = 2
TEXTS = ["Title", "SectionHeader", "Paragraph", "ListItem", "Code"]


def _is(*names: str) -> Column:
    return F.col("cls").isin(*names)


def _joined(df: DataFrame, value: str, sep: str, keys: tuple[str, ...] = ("doc",), order: str = "ord") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(ordered(order, value), sep).alias("text"))


def _all(f: DocFrames, df: DataFrame, default: str = "") -> DataFrame:
    """A row for every converted document."""
    docs = f.docs.filter("status = 'Success'").select("doc").distinct()
    return docs.join(df, "doc", "left").select("doc", F.coalesce("text", F.lit(default)).alias("text"))


def _tables(cells: DataFrame, row: Column, sep: str) -> DataFrame:
    """(doc, el, body): rows made by ``row`` from columns texts, heads, all_head, any_head, first; joined."""
    head = F.coalesce("is_header", F.lit(False))
    rows = cells.groupBy("doc", "tbl", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text", head.alias("h"), "row_span", "col_span"))), lambda x: x).alias("cells"), F.bool_and(head).alias("all_head"), F.bool_or(head).alias("any_head"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc", "tbl").orderBy("row")
    rows = rows.withColumn("first_head", F.col("any_head") & (F.sum(F.col("any_head").cast("int")).over(w) == 1)).withColumn("made", row)
    return rows.groupBy("doc", F.col("tbl").alias("el")).agg(F.array_join(ordered("row", "made"), sep).alias("body"))


def markdown(f: DocFrames) -> DataFrame:
    # a bar in a cell is escaped, so that it does not end it; columns are as wide as their longest text in bytes
    said = f.cells.withColumn("text", F.replace("text", F.lit("|"), F.lit("\\|")))
    widths = said.groupBy("doc", "tbl", "col").agg(F.greatest(F.lit(3), F.max(F.octet_length("text"))).alias("w"))
    padded = said.join(widths, ["doc", "tbl", "col"]).withColumn("text", F.rpad("text", F.greatest("w", F.length("text")), F.lit(" "))).drop("w")
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: c["text"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.repeat(F.lit("-"), F.length(c["text"]))), " | "), F.lit(" |"))
    tables = _tables(padded, F.when(F.col("first_head"), F.concat(line, F.lit("\n"), rule)).otherwise(line), "\n")
    el = list_counters(f.elements).join(tables, ["doc", "el"], "left")
    block = (
        F.when(_is("SectionHeader"), F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), "text"))
        .when(_is("Paragraph"), F.col("text"))
        .when(_is("ListItem"), F.concat(F.when(F.col("number").isNotNull(), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- "), "text"))
        .when(_is("Code"), F.concat(F.lit("```"), F.coalesce("code_lang", F.lit("")), F.lit("\n"), F.regexp_replace("text", r"\n$", ""), F.lit("\n```")))
        .when(_is("TableElement"), F.col("body"))
        .when(_is("PictureElement"), F.concat(F.lit("!["), F.coalesce("alt_text", F.lit("")), F.lit("]("), F.coalesce("link_target", F.lit("")), F.lit(")")))
    )
    from pyspark.sql.window import Window

    made = el.withColumn("block", block).filter("block is not null")
    together = _is("ListItem") & (F.lag("cls").over(Window.partitionBy("doc").orderBy("ord")) == "ListItem") & F.col("parent").eqNullSafe(F.lag("parent").over(Window.partitionBy("doc").orderBy("ord")))
    made = made.withColumn("block", F.concat(F.when(F.coalesce(together, F.lit(False)), "\n").otherwise("\n\n"), "block"))
    out = _joined(made, "block", "")
    return _all(f, out.withColumn("text", F.concat(F.trim(F.regexp_replace("text", r"^\n+", "")), F.lit("\n"))), "\n")


def html(f: DocFrames) -> DataFrame:
    def tag(c: Column) -> Column:
        name = F.when(c["h"], "th").otherwise("td")
        spans = F.concat(F.coalesce(F.concat(F.lit(' rowspan="'), c["row_span"].cast("string"), F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' colspan="'), c["col_span"].cast("string"), F.lit('"')), F.lit("")))
        return F.concat(F.lit("<"), name, spans, F.lit(">"), escape_html(c["text"]), F.lit("</"), name, F.lit(">"))

    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", tag), ""), F.lit("</tr>"))
    tables = _tables(f.cells, F.when(F.col("all_head"), F.concat(F.lit("<thead>"), row, F.lit("</thead>"))).otherwise(row), "\n")
    captions = f.elements.filter("caption_of is not null").groupBy("doc", F.col("caption_of").alias("el")).agg(F.min_by("text", "ord").alias("caption"))
    from pyspark.sql.window import Window

    el = list_counters(f.elements).join(tables, ["doc", "el"], "left").join(captions, ["doc", "el"], "left")
    w = Window.partitionBy("doc").orderBy("ord")
    in_list = _is("ListItem")
    el = el.filter(~(_is("Caption") & F.col("caption_of").isNotNull()) & ~_is("Hyperlink", "Group", "UnorderedList", "OrderedList", "Reference"))
    el = el.withColumn("_p", F.lag(F.when(in_list, F.coalesce("parent", F.lit("")))).over(w)).withColumn("_n", F.lead(F.when(in_list, F.coalesce("parent", F.lit("")))).over(w))
    lst, own = F.when(F.col("number").isNotNull(), "ol").otherwise("ul"), F.coalesce("parent", F.lit(""))
    text = escape_html("text")
    level = F.coalesce("level", F.lit(1)).cast("string")
    image = F.concat(F.lit('<img src="'), escape_html(F.coalesce("link_target", F.lit(""))), F.lit('" alt="'), escape_html(F.coalesce("alt_text", F.lit(""))), F.lit('">'))
    block = (
        F.when(_is("SectionHeader"), F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">")))
        .when(in_list, F.concat(F.when(~F.col("_p").eqNullSafe(own), F.concat(F.lit("<"), lst, F.lit(">\n"))).otherwise(""), F.lit("<li>"), text, F.lit("</li>"), F.when(~F.col("_n").eqNullSafe(own), F.concat(F.lit("\n</"), lst, F.lit(">"))).otherwise("")))
        .when(_is("Code"), F.concat(F.lit("<pre><code"), F.coalesce(F.concat(F.lit(' class="language-'), escape_html("code_lang"), F.lit('"')), F.lit("")), F.lit(">"), text, F.lit("</code></pre>")))
        .when(_is("TableElement"), F.concat(F.lit("<table>\n"), F.coalesce("body", F.lit("")), F.lit("\n</table>")))
        .when(_is("PictureElement"), F.when(F.col("caption").isNotNull(), F.concat(F.lit("<figure>"), image, F.lit("<figcaption>"), escape_html("caption"), F.lit("</figcaption></figure>"))).otherwise(image))
        .when(_is("Paragraph", "Footnote", "Formula", "Caption"), F.concat(F.lit("<p>"), text, F.lit("</p>")))
    )
    body = _joined(el.withColumn("block", block).filter("block is not null"), "block", "\n")
    heads = f.elements.filter(_is("SectionHeader")).groupBy("doc").agg(F.min_by("text", "ord").alias("head"))
    docs = f.docs.filter("status = 'Success'").dropDuplicates(["doc"]).select("doc", "file_name", "language").join(heads, "doc", "left")
    title = escape_html(F.coalesce("file_name", "head", F.lit("Untitled")))
    page = F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), escape_html(F.coalesce("language", F.lit("en"))), F.lit('">\n<head><meta charset="utf-8"><title>'), title, F.lit("</title></head>\n<body>\n"), F.coalesce("text", F.lit("")), F.lit("\n</body>\n</html>\n"))
    return docs.join(body, "doc", "left").select("doc", page.alias("text"))


def text(f: DocFrames) -> DataFrame:
    """Texts in reading order, then all cell texts, one a line."""
    first = f.elements.filter(_is(*TEXTS) & F.col("text").isNotNull()).select("doc", F.struct(F.lit(0).alias("a"), F.col("ord").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("k"), "text")
    order = f.elements.filter(_is("TableElement")).select("doc", F.col("el").alias("tbl"), "ord")
    cells = f.cells.join(order, ["doc", "tbl"]).select("doc", F.struct(F.lit(1).alias("a"), F.col("ord").alias("b"), F.col("row").alias("c"), F.col("col").alias("d")).alias("k"), "text")
    return _all(f, _joined(first.unionByName(cells), "text", "\n", order="k"))


DOCTAGS = {"Title": "title", "SectionHeader": "section_header", "Paragraph": "text", "ListItem": "list_item", "Code": "code", "Formula": "formula", "Caption": "caption", "Footnote": "footnote", "PageHeader": "page_header", "PageFooter": "page_footer", "Reference": "reference", "PictureElement": "picture"}


def doctags(f: DocFrames) -> DataFrame:
    row = F.concat(F.array_join(F.transform("cells", lambda c: F.concat(F.when(c["h"], "<ched>").otherwise("<fcel>"), escape_doctag(c["text"]))), ""), F.lit("<nl>"))
    tables = _tables(f.cells, row, "\n")
    el = f.elements.join(tables, ["doc", "el"], "left")
    names = F.create_map(*(F.lit(x) for pair in DOCTAGS.items() for x in pair))
    name = F.when(_is("SectionHeader"), F.concat(F.lit("section_header_level_"), F.coalesce("level", F.lit(1)).cast("string"))).otherwise(F.try_element_at(names, F.col("cls")))
    said = escape_doctag(F.coalesce(F.when(_is("PictureElement"), F.col("alt_text")).otherwise(F.col("text")), F.lit("")))
    block = F.when(_is("TableElement"), F.concat(F.lit("<otsl>"), F.coalesce("body", F.lit("")), F.lit("</otsl>"))).otherwise(F.concat(F.lit("<"), name, F.lit(">"), said, F.lit("</"), name, F.lit(">")))
    made = el.withColumn("block", block).filter("block is not null").withColumn("page", F.coalesce("page", F.lit(1)))
    pages = _joined(made, "block", "\n", ("doc", "page")).withColumn("text", F.concat(F.lit("<page>\n"), "text", F.lit("\n</page>")))
    out = _joined(pages, "text", "\n", order="page")
    return _all(f, out.withColumn("text", F.concat(F.lit("<doctag>\n"), "text", F.lit("\n</doctag>\n"))), "<doctag>\n</doctag>\n")


def webvtt(f: DocFrames, seconds: float = 5.0) -> DataFrame:
    """Timed elements as cues; a document without any shows each text for some seconds."""
    from pyspark.sql.window import Window

    said = f.elements.filter(_is(*TEXTS) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    any_timed = F.max(F.col("start_time").isNotNull()).over(Window.partitionBy("doc"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1
    cues = said.withColumn("_timed", any_timed).withColumn("_i", n).filter(~F.col("_timed") | F.col("start_time").isNotNull())
    start = F.when(F.col("_timed"), format_timestamp("start_time")).otherwise(timestamp(F.col("_i") * F.lit(seconds)))
    end = F.when(F.col("_timed"), format_timestamp("end_time")).otherwise(timestamp((F.col("_i") + 1) * F.lit(seconds)))
    cues = cues.withColumn("block", F.concat(start, F.lit(" --> "), end, F.lit("\n"), "text"))
    out = _joined(cues, "block", "\n\n")
    return _all(f, out.withColumn("text", F.concat(F.lit("WEBVTT\n\n"), "text", F.lit("\n"))), "WEBVTT\n")


def json(f: DocFrames) -> DataFrame:
    """name, source_format, language, texts, tables, pictures of each document."""
    texts = f.elements.filter(_is(*TEXTS) & F.col("text").isNotNull())
    one = F.struct("ord", F.struct(F.col("cls").alias("type"), "text", F.col("ord").alias("reading_order"), F.col("level").alias("heading_level"), F.col("code_lang").alias("code_language")).alias("t"))
    texts = texts.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("texts"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text", F.coalesce("is_header", F.lit(False)).alias("is_header")))), lambda x: x)
    tables = f.cells.groupBy("doc", "tbl").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), cells.alias("cells"))
    order = f.elements.filter(_is("TableElement")).select("doc", F.col("el").alias("tbl"), "ord")
    tables = tables.join(order, ["doc", "tbl"]).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("rows", "cols", "cells").alias("t")))), lambda x: x["t"]).alias("tables"))
    pictures = f.elements.filter(_is("PictureElement")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("pic_format").alias("format"), "alt_text", "link_target").alias("t")))), lambda x: x["t"]).alias("pictures"))
    docs = f.docs.filter("status = 'Success'").dropDuplicates(["doc"]).select("doc", F.coalesce("file_name", F.lit("unknown")).alias("name"), "source_format", "language")
    full = docs.join(texts, "doc", "left").join(tables, "doc", "left").join(pictures, "doc", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(full.schema[c].dataType)).alias(c)
    return full.select("doc", F.to_json(F.struct("name", "source_format", "language", empty("texts"), empty("tables"), empty("pictures")), {"pretty": "true"}).alias("text"))


def jsonld(f: DocFrames) -> DataFrame:
    classes = ["Title", "SectionHeader", "Paragraph", "ListItem", "Code", "Formula", "Footnote", "Caption"]
    one = F.struct("ord", F.struct(F.concat(F.lit("doc:"), "cls").alias("@type"), F.col("text").alias("doc:textContent"), F.col("ord").alias("doc:readingOrder"), F.col("level").alias("doc:headingLevel"), F.col("code_lang").alias("doc:codeLanguage")).alias("t"))
    els = f.elements.filter(_is(*classes)).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("els"))
    docs = f.docs.filter("status = 'Success'").dropDuplicates(["doc"])
    context = F.struct(F.lit("https://schema.org/").alias("@vocab"), F.lit(NS).alias("doc"))
    body = F.struct(context.alias("@context"), F.lit("CreativeWork").alias("@type"), F.col("doc").alias("@id"), F.coalesce("title", "file_name").alias("name"), F.col("source_format").alias("encodingFormat"), F.col("creator").alias("author"), F.col("date").alias("datePublished"), F.col("page_count").alias("numberOfPages"), F.col("language").alias("inLanguage"), F.col("els").alias("doc:hasElement"))
    return docs.join(els, "doc", "left").select("doc", F.to_json(body).alias("text"))


def _rdf(f: DocFrames, syntax: str) -> DataFrame:
    from lectern.plans import quads as Q

    q = Q.to_quads(f)
    if syntax == "ntriples":
        line = F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), Q.object_term(), F.lit(" ."))
        return q.select(F.col("graph").alias("doc"), line.alias("line")).groupBy("doc").agg(F.concat(F.array_join(F.array_sort(F.collect_set("line")), "\n"), F.lit("\n")).alias("text"))
    owner = q.select("subject", F.col("graph").alias("doc")).distinct()
    blocks = (Q.turtle if syntax == "turtle" else Q.rdfxml)(q).join(owner, "subject")
    joined = F.array_join(ordered("subject", "block"), "\n")
    if syntax == "rdfxml":
        joined = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'), joined, F.lit("\n</rdf:RDF>"))
    return blocks.groupBy("doc").agg(F.concat(joined, F.lit("\n")).alias("text"))


def export(f: DocFrames, kind: str) -> DataFrame:
    """(doc, text) in one of FORMATS."""
    makers = {"json": json, "markdown": markdown, "html": html, "text": text, "doctags": doctags, "webvtt": webvtt, "jsonld": jsonld}
    if kind in makers:
        return makers[kind](f)
    if kind in ("turtle", "ntriples", "rdfxml"):
        return _rdf(f, kind)
    raise ValueError(f"unknown export format {kind!r}")


def write(f: DocFrames, kind: str, path: str) -> None:
    """Parquet files of (doc, file_name, text) below ``path``, in FOLDERS folders by the start of the document's hash.

    The number of folders and files follows from the cluster, not from the number of documents.
    """
    out = export(f, kind).withColumn("part", F.substring(F.regexp_extract("doc", r"([^:]*)$", 1), 1, FOLDERS))
    name = F.concat(F.regexp_extract("doc", r"([^:]*)$", 1), F.lit(f".{EXTENSIONS[kind]}")).alias("file_name")
    out.select("part", "doc", name, "text").repartition("part").sortWithinPartitions("part").write.mode("overwrite").partitionBy("part").parquet(path)
