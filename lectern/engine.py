"""One object for conversion, queries, chunks and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking
from lectern.operators.enrich import enrich
from lectern.plans import export
from lectern.plans.quads import QuadStore, to_quads
from lectern.sources import detect
from lectern.sources.reader import DocFrames, convert, read_files



def _tool(about: str, needs: tuple[str, ...] = (), **fields: tuple[str, str]) -> dict:
    made = {k: {"type": kind, "description": text} for k, (kind, text) in fields.items()}
    return {"description": about, "inputSchema": {"type": "object", "properties": made, "required": list(needs)}}


_ID = ("string", "id that convert_document gave")
_LIMIT, _OFFSET = ("integer", "rows at most"), ("integer", "rows to skip")
#: What an assistant may call, with the schema of each call's arguments.
TOOLS = {
    "convert_document": _tool("Read a file or folder", ("source",), source=("string", "path"), format=("string", "preset of stages")),
    "query_document": _tool("SPARQL over the graph", ("document_id", "sparql"), document_id=_ID, sparql=("string", "SELECT or ASK"), limit=_LIMIT, offset=_OFFSET),
    "export_document": _tool("Text in another format", ("document_id",), document_id=_ID, format=("string", "json if not given")),
    "list_elements": _tool("Elements in order", ("document_id",), document_id=_ID, element_type=("string", "class"), limit=_LIMIT, offset=_OFFSET),
    "chunk_document": _tool("Chunks for retrieval", ("document_id",), document_id=_ID, max_tokens=("integer", "budget"), include_headings=("boolean", "headings before texts")),
    "list_documents": _tool("What was converted"),
    "list_formats": _tool("Formats that can be read"),
}


class Engine:
    """Sets of documents under ids; a query sees one set or all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sets = spark, {}

    def health(self) -> dict:
        return {"status": "ok", "documents": len(self.sets)}

    def formats(self) -> DataFrame:
        return detect.formats(self.spark)

    def tools(self) -> dict:
        return TOOLS

    def convert(self, sources: DataFrame | str, preset: str | None = None, **options) -> str:
        """Convert a folder or a (name, content) table; gives the id of the set."""
        if isinstance(sources, str):
            f = read_files(self.spark, sources, store=True, **options)
        else:
            f = convert(sources, store=True, **options)
        key = str(uuid.uuid4())
        self.sets[key] = enrich(f, preset) if preset else f
        return key

    def frames(self, key: str) -> DocFrames:
        return self.sets[key]

    def documents(self) -> DataFrame:
        if not self.sets:
            raise ValueError("nothing was converted yet")
        parts = [f.docs.withColumn("id", F.lit(k)) for k, f in self.sets.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def elements(self, key: str, cls: str | None = None) -> DataFrame:
        el = self.sets[key].elements
        return (el if cls is None else el.filter(F.col("cls") == cls)).orderBy("doc", "ord")

    def export(self, key: str, kind: str) -> DataFrame:
        return export.export(self.sets[key], kind)

    def chunks(self, key: str, **options) -> DataFrame:
        return chunking.chunks(self.sets[key], chunking.Options(**options))

    def store(self, key: str | None = None) -> QuadStore:
        chosen = [self.sets[key]] if key else list(self.sets.values())
        quads = to_quads(chosen[0])
        for f in chosen[1:]:
            quads = quads.unionByName(to_quads(f))
        return QuadStore(quads if len(chosen) == 1 else quads.dropDuplicates())

    def query(self, sparql: str, key: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        out = self.store(key).query(sparql)
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)
