"""The quad view of the typed frames, store operations on quads, and their serializations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schema import DC, NS, QUADS, RDF_TYPE, XSD
from lectern.sources.reader import DocFrames

LANG_TAG = r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"
NAMES = ["graph", "subject", "predicate", "object", "object_kind", "datatype", "lang"]


def _quad(p: str, o: Column, datatype: str | None = None) -> Column:
    """One (predicate, object, ...) struct; null if the object is."""
    fields = [F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit("literal" if datatype else "iri").alias("object_kind"), F.lit(XSD + datatype if datatype else None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")]
    return F.when(o.isNotNull(), F.struct(*fields))


def _spread(df: DataFrame, subject: Column, quads: list[Column]) -> DataFrame:
    """All quads of a row in one pass, without a scan per property."""
    rows = df.select(F.col("doc").alias("graph"), subject.alias("subject"), F.explode(F.array_compact(F.array(*quads))).alias("q"))
    return rows.select("graph", "subject", "q.*")


def to_quads(f: DocFrames) -> DataFrame:
    """Quads of all frames; one graph per document.  Rows are distinct because ids are."""
    from lectern.operators.sequence import siblings

    c, p = F.col, lambda name: NS + name
    docs = f.docs.filter("status = 'Success'").dropDuplicates(["doc"])
    doc = _spread(docs, c("doc"), [_quad(RDF_TYPE, F.lit(p("Document"))), *(_quad(p(n), c(k), t) for n, k, t in (("sourceFormat", "source_format", "string"), ("documentHash", "document_hash", "string"), ("fileName", "file_name", "string"), ("fileSize", "file_size", "integer"), ("pageCount", "page_count", "integer"), ("language", "language", "string"), ("description", "description", "string"), ("keywords", "keywords", "string"))), _quad(DC + "title", c("title"), "string"), _quad(DC + "date", c("date"), "string")])
    creators = docs.select(c("doc").alias("graph"), c("doc").alias("subject"), F.lit(DC + "creator").alias("predicate"), F.explode("creator").alias("object"), F.lit("literal").alias("object_kind"), F.lit(XSD + "string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    shapes = f.cells.groupBy("doc", c("tbl").alias("el")).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    linked = siblings(f.elements, ["depth"]).join(shapes, ["doc", "el"], "left")
    props = [("textContent", "text", "string"), ("readingOrder", "ord", "integer"), ("headingLevel", "level", "integer"), ("codeLanguage", "code_lang", "string"), ("linkTarget", "link_target", "string"), ("linkText", "link_text", "string"), ("altText", "alt_text", "string"), ("pictureFormat", "pic_format", "string"), ("imageWidth", "img_w", "integer"), ("imageHeight", "img_h", "integer"), ("startTime", "start_time", "string"), ("endTime", "end_time", "string"), ("labelId", "label_id", "string"), ("citationKey", "citation_key", "string"), ("confidence", "confidence", "float"), ("rowCount", "n_rows", "integer"), ("columnCount", "n_cols", "integer")]
    iris = [("parentElement", c("parent")), ("previousElement", c("prev")), ("nextElement", c("next")), ("onPage", F.when(c("page").isNotNull(), F.concat(c("doc"), F.lit("/page-"), c("page"))))]
    elements = _spread(linked, c("el"), [_quad(RDF_TYPE, F.concat(F.lit(NS), c("cls"))), *(_quad(p(n), c(k), t) for n, k, t in props), *(_quad(p(n), o) for n, o in iris)])
    back = linked.select(c("doc").alias("graph"), F.explode(F.array_compact(F.array(F.struct(c("doc").alias("s"), F.lit(p("hasElement")).alias("p"), c("el").alias("o")), F.when(c("parent").isNotNull(), F.struct(c("parent").alias("s"), F.lit(p("childElement")).alias("p"), c("el").alias("o"))), F.when(c("caption_of").isNotNull(), F.struct(c("caption_of").alias("s"), F.lit(p("hasCaption")).alias("p"), c("el").alias("o")))))).alias("x"))
    iri = lambda df: df.select("graph", c("x.s").alias("subject"), c("x.p").alias("predicate"), c("x.o").alias("object"), F.lit("iri").alias("object_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    cell = F.concat(c("tbl"), F.lit("/cell-"), c("row"), F.lit("-"), c("col"))
    cells = _spread(f.cells, cell, [_quad(RDF_TYPE, F.lit(p("TableCell"))), _quad(p("cellRow"), c("row"), "integer"), _quad(p("cellColumn"), c("col"), "integer"), _quad(p("cellText"), c("text"), "string"), _quad(p("isHeader"), F.coalesce(c("is_header"), F.lit(False)), "boolean"), _quad(p("cellRowSpan"), c("row_span"), "integer"), _quad(p("cellColSpan"), c("col_span"), "integer")])
    has_cell = f.cells.select(c("doc").alias("graph"), F.struct(c("tbl").alias("s"), F.lit(p("hasCell")).alias("p"), cell.alias("o")).alias("x"))
    page = F.concat(c("doc"), F.lit("/page-"), c("page"))
    pages = _spread(f.pages, page, [_quad(RDF_TYPE, F.lit(p("Page"))), _quad(p("pageNumber"), c("page"), "integer"), _quad(p("pageWidth"), c("width"), "float"), _quad(p("pageHeight"), c("height"), "float")])
    has_page = f.pages.select(c("doc").alias("graph"), F.struct(c("doc").alias("s"), F.lit(p("hasPage")).alias("p"), page.alias("o")).alias("x"))
    out = doc
    for part in (creators, elements, iri(back), cells, iri(has_cell), pages, iri(has_page)):
        out = out.unionByName(part)
    return out.select(*NAMES)


class QuadStore:
    """A set of quads with the operations of a graph store; each gives a new store."""

    def __init__(self, quads: DataFrame):
        self.quads = quads

    @classmethod
    def empty(cls, spark: SparkSession) -> QuadStore:
        return cls(spark.createDataFrame([], QUADS))

    def _with(self, rows: list[tuple]) -> QuadStore:
        return self.union(self.quads.sparkSession.createDataFrame(rows, QUADS))

    def insert(self, s: str, p: str, o: str, graph: str | None = None) -> QuadStore:
        return self._with([(graph, s, p, o, "iri", None, None)])

    def insert_literal(self, s: str, p: str, value: str, datatype: str = "string", graph: str | None = None) -> QuadStore:
        return self._with([(graph, s, p, value, "literal", datatype if ":" in datatype else XSD + datatype, None)])

    def insert_lang(self, s: str, p: str, value: str, lang: str, graph: str | None = None) -> QuadStore:
        if not re.match(LANG_TAG, lang):
            raise ValueError(f"invalid language tag {lang!r}")
        return self._with([(graph, s, p, value, "literal", None, lang)])

    def union(self, quads: DataFrame) -> QuadStore:
        """Set semantics: a quad that is there is not added."""
        return QuadStore(self.quads.unionByName(quads).dropDuplicates())

    def copy(self, source: str, target: str) -> QuadStore:
        return self.union(self.scan(source).withColumn("graph", F.lit(target)))

    def clear(self, graph: str | None = None) -> QuadStore:
        return QuadStore(self.quads.limit(0) if graph is None else self.quads.filter(~F.col("graph").eqNullSafe(graph)))

    def count(self, graph: str | None = None) -> int:
        return (self.quads if graph is None else self.scan(graph)).count()

    def scan(self, graph: str | None) -> DataFrame:
        return self.quads.filter(F.col("graph").eqNullSafe(graph))

    def query(self, text: str, graph: str | None = None):
        from lectern.plans.sparql import query

        return query(self.quads, text, graph)

    def ask(self, text: str, graph: str | None = None) -> bool:
        from lectern.plans.sparql import ask

        return ask(self.quads, text, graph)

    def serialize(self, syntax: str, graph: str | None = None) -> DataFrame:
        quads = self.quads if graph is None else self.scan(graph)
        makers = {"ntriples": ntriples, "turtle": turtle, "rdfxml": rdfxml}
        if syntax not in makers:
            raise ValueError(f"unknown syntax {syntax!r}")
        return makers[syntax](quads)


def escaped(value: str | Column) -> Column:
    out = F.col(value) if isinstance(value, str) else value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def object_term() -> Column:
    literal = F.concat(F.lit('"'), escaped("object"), F.lit('"'))
    plain = F.col("datatype").isNull() | (F.col("datatype") == XSD + "string")
    return F.when(F.col("object_kind") == "iri", F.concat(F.lit("<"), F.col("object"), F.lit(">"))).when(F.col("lang").isNotNull(), F.concat(literal, F.lit("@"), F.col("lang"))).when(plain, literal).otherwise(F.concat(literal, F.lit("^^<"), F.col("datatype"), F.lit(">")))


def triples(quads: DataFrame) -> DataFrame:
    return quads.drop("graph").dropDuplicates()


def ntriples(quads: DataFrame) -> DataFrame:
    """(line): one line per triple."""
    return triples(quads).select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), object_term(), F.lit(" .")).alias("line"))


def turtle(quads: DataFrame) -> DataFrame:
    """(subject, block): one block per subject, predicates in order."""
    pair = F.concat(F.when(F.col("predicate") == RDF_TYPE, F.lit("a")).otherwise(F.concat(F.lit("<"), "predicate", F.lit(">"))), F.lit(" "), object_term())
    lines = triples(quads).select("subject", pair.alias("pair")).groupBy("subject").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    return lines.select("subject", F.concat(F.lit("<"), "subject", F.lit("> "), F.array_join("pairs", " ;\n    "), F.lit(" .")).alias("block"))


def rdfxml(quads: DataFrame) -> DataFrame:
    """(subject, block): one description element per subject, to stand inside an rdf:RDF root."""
    from lectern.functions.text import escape_html

    name = F.regexp_extract("predicate", r"([^#/]+)$", 1)
    space = F.regexp_extract("predicate", r"^(.*[#/])", 1)
    kind = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "lang", F.lit('"'))).when(F.col("datatype").isNotNull() & (F.col("datatype") != XSD + "string"), F.concat(F.lit(' rdf:datatype="'), escape_html("datatype"), F.lit('"'))).otherwise("")
    head = F.concat(F.lit("  <p:"), name, F.lit(' xmlns:p="'), escape_html(space), F.lit('"'))
    line = F.when(F.col("object_kind") == "iri", F.concat(head, F.lit(' rdf:resource="'), escape_html("object"), F.lit('"/>'))).otherwise(F.concat(head, kind, F.lit(">"), escape_html("object"), F.lit("</p:"), name, F.lit(">")))
    grouped = triples(quads).select("subject", line.alias("line")).groupBy("subject").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select("subject", F.concat(F.lit('<rdf:Description rdf:about="'), escape_html("subject"), F.lit('">\n'), F.array_join("lines", "\n"), F.lit("\n</rdf:Description>")).alias("block"))
