"""Table operators over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = ["doc", "tbl"]


def ordered(by: str, value: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value])


def shape(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Row and column counts."""
    return cells.groupBy(*(keys or TABLE)).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def row_texts(cells: DataFrame, sep: str = " | ", keys: list[str] | None = None) -> DataFrame:
    """Each row's cell texts joined in column order."""
    return cells.groupBy(*(keys or TABLE), "row").agg(F.array_join(ordered("col", "text"), sep).alias("text"))


def table_texts(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return row_texts(cells, keys=keys).groupBy(*(keys or TABLE)).agg(F.array_join(ordered("row", "text"), "\n").alias("text"))


def column_widths(cells: DataFrame, least: int = 3, keys: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(keys or TABLE), "col").agg(F.greatest(F.lit(least), F.max(F.octet_length("text"))).alias("width"))


def header_rows(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether all, and whether any, cells of a row are header cells."""
    head = F.coalesce("is_header", F.lit(False))
    return cells.groupBy(*(keys or TABLE), "row").agg(F.bool_and(head).alias("all_header"), F.bool_or(head).alias("any_header"))


def unpivot(df: DataFrame, table: str, row: Column) -> DataFrame:
    """A relational table as cells (tbl, row, col, text, is_header): row 0 holds the column names, ``row`` numbers the rest from 1."""
    names = df.columns
    values = F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names))
    cells = df.select(row.cast("int").alias("row"), F.posexplode(values).alias("col", "text"))
    head = df.sparkSession.createDataFrame([(0, k, c) for k, c in enumerate(names)], "row int, col int, text string")
    return head.unionByName(cells).select(F.lit(table).alias("tbl"), "row", "col", "text", (F.col("row") == 0).alias("is_header"))


def resolve_references(elements: DataFrame) -> DataFrame:
    """References with the element whose label they name, the first by order."""
    labels = elements.filter("label_id is not null").groupBy("doc", "label_id").agg(F.min_by("el", "ord").alias("refers_to"))
    refs = elements.filter("cls = 'Reference'")
    return refs.join(labels.withColumnRenamed("label_id", "citation_key"), ["doc", "citation_key"], "left")
