"""Ordered-sequence operators over elements, as window expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cmp_to_key
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def reading_order(df: DataFrame, doc: list[str], keys: list, name: str = "ord") -> DataFrame:
    """0-based rank by the keys (page, top, left) within each document; it replaces any old order."""
    w = Window.partitionBy(*doc).orderBy(*keys)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def siblings(elements: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Columns prev and next: neighbours by order within ``by`` (the whole document, or its depths)."""
    w = Window.partitionBy("doc", *(by or [])).orderBy("ord")
    return elements.withColumns({"prev": F.lag("el").over(w), "next": F.lead("el").over(w)})


def breadcrumb(df: DataFrame, doc: str, order: str, level: str, text: str, levels: int = 6, name: str = "headings") -> DataFrame:
    """Open headings at each row, outermost first: a heading closes all of its level and deeper."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cols = {}
    for k in range(1, levels + 1):
        at = F.max(F.when(F.col(level) == k, F.col(order))).over(w)
        closed = F.max(F.when(F.col(level) < k, F.col(order))).over(w)
        said = F.last(F.when(F.col(level) == k, F.col(text)), ignorenulls=True).over(w)
        cols[f"_h{k}"] = F.when(at.isNotNull() & (closed.isNull() | (closed < at)), said)
    out = df.withColumns(cols)
    return out.withColumn(name, F.filter(F.array(*cols), lambda x: x.isNotNull())).drop(*cols)


def runs(df: DataFrame, doc: str, order: str, key: Column, name: str = "run") -> DataFrame:
    """Number of each run of neighbours with equal non-null key; rows with null key are runs of their own."""
    w = Window.partitionBy(doc).orderBy(order)
    new = (key.isNull() | F.lag(key).over(w).isNull() | (key != F.lag(key).over(w))).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def list_counters(elements: DataFrame) -> DataFrame:
    """Number of each item of an ordered list."""
    w = Window.partitionBy("doc", "parent").orderBy("ord")
    lists = elements.filter(F.col("cls") == "OrderedList").select("doc", F.col("el").alias("parent"), F.lit(True).alias("ordered"))
    return elements.join(lists, ["doc", "parent"], "left").withColumn("number", F.when(F.col("ordered") & (F.col("cls") == "ListItem"), F.row_number().over(w)))


def lines_to_paragraphs(lines: DataFrame, gap: float = 1.5) -> DataFrame:
    """(doc, page, paragraph, text): a line starts a paragraph if it lies more than ``gap`` average heights below the last."""
    w = Window.partitionBy("doc", "page").orderBy("top")
    height = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy("doc", "page"))
    new = F.coalesce((F.col("top") - F.lag("bottom").over(w)) > gap * height, F.lit(False)).cast("int")
    marked = lines.withColumn("_new", new).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy("doc", "page", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]), " ").alias("text"))


def upper_median(values: Column) -> Column:
    """The middle of an array's sorted values, the upper one of two."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def font_runs(words: DataFrame, body: float | None = None) -> DataFrame:
    """Headings from runs of words of one size above the body size (the upper median of the page).

    Words at one place go by their text, in runs as in what is said, so that the order of the input does not matter.
    """
    from lectern.functions.text import font_heading_level

    w = Window.partitionBy("doc", "page").orderBy("top", "left", "text", "font_size")
    sizes = F.collect_list("font_size").over(Window.partitionBy("doc", "page"))
    median = F.lit(body) if body is not None else upper_median(sizes)
    marked = words.withColumn("_body", median).withColumn("_new", F.coalesce(F.col("font_size") != F.lag("font_size").over(w), F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("doc", "page", "run").agg(F.first("font_size").alias("font_size"), F.first("_body").alias("_body"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"]), " ").alias("text"))
    return out.filter(F.col("font_size") > F.col("_body") * 1.15).withColumn("level", font_heading_level("font_size", "_body")).drop("_body")


def folded(df: DataFrame, by: list[str], order: list[str], fold: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """What ``fold`` makes of the rows of each group, in order.

    Groups stream by in a sorted partition and one is held at a time; a group is a page, whose size does not grow
    with the corpus.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in by)):
            done += fold(list(group))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        yield pa.RecordBatch.from_pylist(done, arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def words_to_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc, page, line, text, left, top, right, bottom): a line is anchored at its first word's centre."""

    def lines(page: list[dict]) -> Iterator[dict]:
        found: list[tuple[float, list[dict]]] = []
        for word in page:
            y = (word["top"] + word["bottom"]) / 2
            if not found or abs(y - found[-1][0]) > tolerance:
                found.append((y, []))
            found[-1][1].append(word)
        for n, (_, line) in enumerate(found):
            line.sort(key=lambda w: w["left"])
            yield {"doc": line[0]["doc"], "page": line[0]["page"], "line": n, "text": " ".join(w["text"] for w in line), "left": line[0]["left"], "top": min(w["top"] for w in line), "right": max(w["right"] for w in line), "bottom": max(w["bottom"] for w in line)}

    centred = words.select("doc", "page", "text", "left", "top", "right", "bottom", ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    return folded(centred, ["doc", "page"], ["y", "left"], lines, "doc string, page int, line long, text string, left double, top double, right double, bottom double")


def suppress(regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Non-maximum suppression per page: the most confident region drops those that overlap it beyond the threshold."""

    def overlap(r: dict, s: dict) -> float:
        w, h = min(r["right"], s["right"]) - max(r["left"], s["left"]), min(r["bottom"], s["bottom"]) - max(r["top"], s["top"])
        inner = max(w, 0) * max(h, 0)
        union = (r["right"] - r["left"]) * (r["bottom"] - r["top"]) + (s["right"] - s["left"]) * (s["bottom"] - s["top"]) - inner
        return inner / union if union > 0 else 0

    def keep(page: list[dict]) -> list[dict]:
        chosen: list[dict] = []
        for r in page:
            if all(overlap(r, s) <= threshold for s in chosen):
                chosen.append(r)
        return chosen

    ranked = regions.withColumn("_rank", -F.col("confidence"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in regions.schema.fields)
    return folded(ranked, ["doc", "page"], ["_rank", "left", "top"], keep, fields)


def band_order(regions: DataFrame, share: float = 0.2) -> DataFrame:
    """Reading order in bands: middles closer than ``share`` of the average height are read from left to right."""

    def order(page: list[dict]) -> list[dict]:
        near = share * sum(r["bottom"] - r["top"] for r in page) / len(page)

        def compare(a: dict, b: dict) -> float:
            gap = (a["top"] + a["bottom"] - b["top"] - b["bottom"]) / 2
            return a["left"] - b["left"] if abs(gap) < near else gap

        return [r | {"ord": k} for k, r in enumerate(sorted(page, key=cmp_to_key(compare)))]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in regions.schema.fields if f.name != "ord")
    return folded(regions.drop("ord"), ["doc", "page"], ["top", "left"], order, f"{fields}, ord long")


def section_text(elements: DataFrame, heading: Column) -> DataFrame:
    """Elements below each heading that satisfies ``heading``, up to the next heading of its level or above."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    marked = elements
    for k in range(1, 7):
        marked = marked.withColumn(f"_n{k}", F.min(F.when((F.col("cls") == "SectionHeader") & (F.col("level") <= k), F.col("ord"))).over(w))
    ends = F.coalesce(*(F.when(F.col("level") == k, F.coalesce(F.col(f"_n{k}"), F.lit(1 << 60))) for k in range(1, 7)))
    heads = marked.filter(heading & (F.col("cls") == "SectionHeader")).select("doc", F.col("el").alias("heading"), F.col("ord").alias("_from"), ends.alias("_to"))
    return elements.join(heads, "doc").filter((F.col("ord") > F.col("_from")) & (F.col("ord") < F.col("_to"))).drop("_from", "_to")
