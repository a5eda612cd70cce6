"""SPARQL SELECT and ASK as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.plans.sparql.compiler import Compiler
from lectern.plans.sparql.parser import parse


def query(quads: DataFrame, text: str, graph: str | None = None) -> DataFrame:
    """Rows of a SELECT, one string column per variable in the order of the query; null where unbound.

    The default graph is the union of all graphs, or ``graph`` if given; FROM and FROM NAMED take its place.
    """
    q = parse(text)
    if q["form"] != "select":
        raise ValueError("not a SELECT query")
    return Compiler(quads, graph, q).rows(q)


def ask(quads: DataFrame, text: str, graph: str | None = None) -> bool:
    q = parse(text)
    if q["form"] != "ask":
        raise ValueError("not an ASK query")
    return not Compiler(quads, graph, q).solutions(q["where"]).df.limit(1).isEmpty()
