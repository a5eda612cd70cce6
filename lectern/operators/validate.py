"""Validation: structural checks and shapes as one union of violations (doc, node, rule)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.schema import CLASSES
from lectern.sources.reader import DocFrames

VIOLATION = "doc string, node string, rule string"


def _rule(df: DataFrame, node: str | Column, rule: str) -> DataFrame:
    n = F.col(node) if isinstance(node, str) else node
    return df.select("doc", n.cast("string").alias("node"), F.lit(rule).alias("rule"))


def structure(f: DocFrames) -> DataFrame:
    """Contiguous order, levels of headings, positions of cells, parents that exist, text where it belongs."""
    w = Window.partitionBy("doc").orderBy("ord")
    el = f.elements
    gap = F.col("ord") - F.coalesce(F.lag("ord").over(w), F.lit(-1))
    cell = F.concat_ws("/", "tbl", "row", "col")
    parts = [
        _rule(el.withColumn("_g", gap).filter("_g <> 1"), "el", "reading order is contiguous from 0"),
        _rule(el.filter("ord is null"), "el", "every element has an order"),
        _rule(el.filter("cls = 'SectionHeader' and (level is null or level not between 1 and 6)"), "el", "a heading has a level from 1 to 6"),
        _rule(el.filter("cls in ('Paragraph', 'SectionHeader', 'ListItem', 'Code', 'Title') and text is null"), "el", "a text element has text"),
        _rule(f.cells.filter("row is null or col is null or row < 0 or col < 0"), cell, "a cell has a position"),
        _rule(f.cells.groupBy("doc", "tbl", "row", "col").count().filter("count > 1"), cell, "a position holds one cell"),
        _rule(el.filter("parent is not null").join(el.select("doc", F.col("el").alias("parent")), ["doc", "parent"], "left_anti"), "el", "a parent exists"),
        _rule(f.cells.join(el.filter("cls = 'TableElement'").select("doc", F.col("el").alias("tbl")), ["doc", "tbl"], "left_anti"), cell, "a cell's table exists"),
    ]
    return reduce(DataFrame.unionByName, parts)


def shapes(f: DocFrames) -> DataFrame:
    """Value constraints by node: cardinality, range, vocabulary."""
    docs = f.docs.filter("status = 'Success'")
    el = f.elements
    page = F.concat_ws("/", "doc", "page")
    cell = F.concat_ws("/", "tbl", "row", "col")
    parts = [
        _rule(docs.filter("source_format is null"), "doc", "document: one sourceFormat"),
        _rule(docs.filter("document_hash is null or document_hash not rlike '^[0-9a-f]{64}$'"), "doc", "document: hash is SHA-256 hex"),
        _rule(docs.filter("file_size is null or file_size < 0"), "doc", "document: fileSize is not negative"),
        _rule(docs.filter("page_count < 0"), "doc", "document: pageCount is not negative"),
        _rule(docs.filter("language is not null and language not rlike '^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$'"), "doc", "document: language is a tag"),
        _rule(f.pages.filter("page is null or page < 1"), page, "page: number from 1"),
        _rule(f.pages.filter("width <= 0 or height <= 0"), page, "page: positive size"),
        _rule(el.filter(~F.col("cls").isin(sorted(CLASSES))), "el", "element: known class"),
        _rule(el.filter("ord < 0"), "el", "element: order is not negative"),
        _rule(el.filter("cls = 'Hyperlink' and link_target is null"), "el", "hyperlink: has a target"),
        _rule(el.filter("cls = 'Reference' and citation_key is null"), "el", "reference: has a key"),
        _rule(el.filter("img_w < 0 or img_h < 0"), "el", "picture: size is not negative"),
        _rule(el.filter("confidence < 0 or confidence > 1"), "el", "element: confidence from 0 to 1"),
        _rule(f.cells.filter("row_span < 1 or col_span < 1"), cell, "cell: spans from 1"),
        _rule(f.cells.filter("text is null"), cell, "cell: one text"),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate(f: DocFrames) -> DataFrame:
    return structure(f).unionByName(shapes(f))


def json_problems(text: str) -> list[str]:
    """What an exported JSON document lacks."""
    try:
        d = json.loads(text)
    except ValueError as e:
        return [f"not JSON: {e}"]
    out = [f"no {k}" for k in ("name", "source_format", "texts", "tables", "pictures") if k not in d]
    out += [f"texts[{i}] lacks {k}" for i, t in enumerate(d.get("texts", [])) for k in ("type", "text", "reading_order") if k not in t]
    out += [f"tables[{i}] lacks {k}" for i, t in enumerate(d.get("tables", [])) for k in ("rows", "cols", "cells") if k not in t]
    return out
