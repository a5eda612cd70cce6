"""Typed tables of the document graph, and its vocabulary of classes and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NS = "urn:lectern:ontology#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DC = "http://purl.org/dc/terms/"
DOC = "urn:lectern:doc:"
ONTOLOGY_GRAPH = "urn:lectern:ontology"

#: What a reader emits: one row per document, element, cell or page, told apart by ``kind``.
ROWS = (
    "kind string, doc string, el string, cls string, ord long, text string, level int, page int, parent string, depth int, "
    "code_lang string, link_target string, link_text string, alt_text string, pic_format string, img_w int, img_h int, "
    "start_time string, end_time string, label_id string, citation_key string, caption_of string, confidence float, "
    "tbl string, row int, col int, is_header boolean, row_span int, col_span int, width float, height float, "
    "source_format string, document_hash string, file_name string, file_size long, page_count int, language string, "
    "title string, creator array<string>, date string, description string, keywords string, status string, error string"
)
DOCS = ["doc", "source_format", "document_hash", "file_name", "file_size", "page_count", "language", "title", "creator", "date", "description", "keywords", "status", "error"]
ELEMENTS = ["doc", "el", "cls", "ord", "text", "level", "page", "parent", "depth", "code_lang", "link_target", "link_text", "alt_text", "pic_format", "img_w", "img_h", "start_time", "end_time", "label_id", "citation_key", "caption_of", "confidence"]
CELLS = ["doc", "tbl", "row", "col", "text", "is_header", "row_span", "col_span"]
PAGES = ["doc", "page", "width", "height"]
QUADS = "graph string, subject string, predicate string, object string, object_kind string, datatype string, lang string"

# The names below are fixed values: classes, properties, domains and ranges of the vocabulary that queries use.
_TEXT = "Title SectionHeader Paragraph ListItem Footnote Caption Code Formula Reference Hyperlink".split()
#: class -> parent
CLASSES: dict[str, str | None] = {
    **dict.fromkeys("Document Page DocumentElement TableCell BoundingBox Provenance TranslationGroup".split()),
    **dict.fromkeys("TextElement TableElement PictureElement KeyValueItem Group Furniture".split(), "DocumentElement"),
    **dict.fromkeys(_TEXT, "TextElement"),
    **dict.fromkeys(["OrderedList", "UnorderedList"], "Group"),
    **dict.fromkeys(["PageHeader", "PageFooter"], "Furniture"),
}

#: property, domain, range (xsd type names are lower case first)
PROPERTIES: list[tuple[str, str, str]] = [
    tuple(line.split())
    for line in """
hasElement Document DocumentElement
hasPage Document Page
sourceFormat Document string
documentHash Document string
fileName Document string
fileSize Document long
pageCount Document integer
language Document string
pageNumber Page positiveInteger
pageWidth Page float
pageHeight Page float
textContent TextElement string
readingOrder DocumentElement nonNegativeInteger
onPage DocumentElement Page
headingLevel SectionHeader integer
parentElement DocumentElement DocumentElement
childElement DocumentElement DocumentElement
nextElement DocumentElement DocumentElement
previousElement DocumentElement DocumentElement
codeLanguage Code string
linkTarget Hyperlink anyURI
linkText Hyperlink string
keyName KeyValueItem string
keyValue KeyValueItem string
hasBoundingBox DocumentElement BoundingBox
bboxLeft BoundingBox float
bboxTop BoundingBox float
bboxRight BoundingBox float
bboxBottom BoundingBox float
bboxPage BoundingBox Page
hasCell TableElement TableCell
cellRow TableCell nonNegativeInteger
cellColumn TableCell nonNegativeInteger
cellRowSpan TableCell positiveInteger
cellColSpan TableCell positiveInteger
cellText TableCell string
isHeader TableCell boolean
rowCount TableElement nonNegativeInteger
columnCount TableElement nonNegativeInteger
pictureData PictureElement base64Binary
pictureFormat PictureElement string
hasCaption PictureElement Caption
pictureCategory PictureElement string
altText PictureElement string
imageWidth PictureElement nonNegativeInteger
imageHeight PictureElement nonNegativeInteger
startTime DocumentElement duration
endTime DocumentElement duration
duration Document duration
hasProvenance DocumentElement Provenance
confidence DocumentElement float
detectedBy DocumentElement string
modelName Provenance string
modelVersion Provenance string
processingDate Provenance dateTime
refersTo DocumentElement DocumentElement
labelId DocumentElement string
citationKey Reference string
hasTranslation TranslationGroup Document
translationGroup Document TranslationGroup
normalizedText TextElement string
normalizedCellText TableCell string
elementLanguage DocumentElement string
""".strip().splitlines()
]


def range_iri(kind: str) -> str:
    return (NS if kind[0].isupper() else XSD) + kind


def ontology(spark: SparkSession) -> DataFrame:
    """The vocabulary as quads of the ontology graph: type, label, parent class; domain and range."""
    rows = []

    def add(s: str, p: str, o: str, kind: str = "iri") -> None:
        rows.append((ONTOLOGY_GRAPH, NS + s, p, o, kind, XSD + "string" if kind == "literal" else None, None))

    for name, parent in CLASSES.items():
        add(name, RDF_TYPE, RDFS + "Class")
        add(name, RDFS + "label", name, "literal")
        if parent:
            add(name, RDFS + "subClassOf", NS + parent)
    for name, domain, kind in PROPERTIES:
        add(name, RDF_TYPE, "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property")
        add(name, RDFS + "label", name, "literal")
        add(name, RDFS + "domain", NS + domain)
        add(name, RDFS + "range", range_iri(kind))
    return spark.createDataFrame(rows, QUADS)
