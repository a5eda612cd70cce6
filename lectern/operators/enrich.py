"""Enrichment stages: functions from frames to frames, chained by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import ascii_fold
from lectern.operators.sequence import reading_order
from lectern.schema import DOC
from lectern.sources.reader import DocFrames

Stage = Callable[[DocFrames], DocFrames]


def reading_order_stage(f: DocFrames) -> DocFrames:
    """Elements with a box are ordered by page, top, left; the old order is replaced.

    Elements without a box come after them in their old order, so that no two have one place.
    """
    if "bbox" not in f.elements.columns:
        return f
    boxed = F.col("bbox").isNotNull()
    place = [F.when(boxed, F.col(c)) for c in ("page", "bbox.top", "bbox.left")]
    keys = [F.when(boxed, 0).otherwise(1), *(c.asc_nulls_first() for c in place), F.when(~boxed, F.col("ord")), "el"]
    return f.with_(elements=reading_order(f.elements, ["doc"], keys))


def text_normalization(f: DocFrames) -> DocFrames:
    """norm_text of elements and cells where folding changes the text."""

    def folded(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", ascii_fold("text")).withColumn("norm_text", F.when(F.col("_f") != F.col("text"), F.col("_f"))).drop("_f")

    return f.with_(elements=folded(f.elements), cells=folded(f.cells))


def provenance(elements: DataFrame, known: DataFrame | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(doc, el, provenance, model_name, processing_date) for elements with confidence that have none."""
    rows = elements.filter("confidence is not null")
    if known is not None:
        rows = rows.join(known.select("doc", "el"), ["doc", "el"], "left_anti")
    model = F.col("detected_by") if "detected_by" in elements.columns else F.lit("unknown")
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1
    return rows.select("doc", "el", F.concat("el", F.lit("/provenance-"), n.cast("string")).alias("provenance"), model.alias("model_name"), F.lit(date).alias("processing_date"))


def missing_structure(f: DocFrames) -> DataFrame:
    """Tables without cells: the input of a table model."""
    return f.elements.filter("cls = 'TableElement'").join(f.cells.select("doc", F.col("tbl").alias("el")).distinct(), ["doc", "el"], "left_anti")


def missing_text(f: DocFrames) -> DataFrame:
    """Elements with a box and no text: the input of text recognition."""
    boxed = f.elements.filter("bbox is not null") if "bbox" in f.elements.columns else f.elements.limit(0)
    return boxed.filter("text is null")


def model_stage(rows: Callable[[DocFrames], DataFrame], model, schema: str, merge: Callable[[DocFrames, DataFrame], DocFrames]) -> Stage:
    """A stage around a model: ``model`` maps pandas batches of ``rows`` to rows of ``schema``, ``merge`` puts them into the frames."""
    return lambda f: merge(f, rows(f).mapInPandas(model, schema))


STAGES: dict[str, Stage] = {"reading_order": reading_order_stage, "text_normalization": text_normalization, "layout_analysis": lambda f: f, "table_structure": lambda f: f, "ocr": lambda f: f, "vlm": lambda f: f, "provenance": lambda f: f}
PRESETS = {
    "standard_pdf": ["layout_analysis", "table_structure", "reading_order", "text_normalization", "provenance"],
    "simple": ["reading_order", "text_normalization"],
    "ocr_only": ["ocr", "reading_order", "text_normalization"],
    "vlm": ["vlm", "text_normalization", "provenance"],
}


def enrich(f: DocFrames, preset: str | list[str] = "simple", stages: dict[str, Stage] | None = None) -> DocFrames:
    """Run the stages of a preset; ``stages`` puts models in the place of the empty ones."""
    every = {**STAGES, **(stages or {})}
    for name in PRESETS[preset] if isinstance(preset, str) else preset:
        f = every[name](f)
    return f


def set_language(docs: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages by document replace those the readers found."""
    new = languages.select("doc", F.col("language").alias("_l"))
    return docs.join(new, "doc", "left").withColumn("language", F.coalesce("_l", "language")).drop("_l")


def translation_groups(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """(group_iri, doc, language, first): manifest rows (group, language, source) with their documents by file name."""
    hit = manifest.join(docs.filter("status = 'Success'").select(F.col("file_name").alias("source"), "doc"), "source")
    first = F.row_number().over(Window.partitionBy("group").orderBy("source")) == 1
    return hit.select(F.concat(F.lit(DOC.replace(":doc:", ":translation:")), "group").alias("group_iri"), "doc", "language", first.alias("first"))


def manifest(spark, text: str) -> DataFrame:
    """Rows of a TOML manifest with [[translations]] group, language, source."""
    import tomllib

    rows = [(str(x["group"]), x["language"], x["source"]) for x in tomllib.loads(text).get("translations", [])]
    return spark.createDataFrame(rows, "group string, language string, source string")


def stage_totals(results: DataFrame) -> DataFrame:
    """Sums over stage results (added, modified, duration_ms)."""
    return results.agg(F.sum("added").alias("added"), F.sum("modified").alias("modified"), F.sum("duration_ms").alias("duration_ms"))


def tallies(docs: DataFrame) -> DataFrame:
    """(succeeded, failed, exit_code): 0 if all succeeded, 1 if some failed, 2 if all did."""
    ok, bad = F.count_if(F.col("status") == "Success"), F.count_if(F.col("status") == "Failure")
    return docs.agg(ok.alias("succeeded"), bad.alias("failed"), F.when(bad == 0, 0).when(ok > 0, 1).otherwise(2).alias("exit_code"))
