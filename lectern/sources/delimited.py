"""CSV and TSV reader: the delimiter is the one that gives the most columns, then the most even ones."""

from __future__ import annotations

import csv
import io

from lectern.sources.base import Builder, decode

DELIMITERS = (",", "\t", ";", "|")


#: Characters of one field; the parser's own limit would fail a document with a long cell.
LONGEST = 1 << 30
csv.field_size_limit(LONGEST)


def rows_of(text: str, delimiter: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def variance(widths: list[int]) -> float:
    """Population variance of the rows' column counts."""
    mean = sum(widths) / len(widths)
    return sum((w - mean) ** 2 for w in widths) / len(widths)


def sniffed(text: str) -> list[list[str]]:
    """Rows by the best delimiter; the comma if none stands in the text."""
    best, chosen = (0, 0.0), None
    for d in (x for x in DELIMITERS if x in text):
        rows = rows_of(text, d)
        widths = [len(r) for r in rows]
        if widths and (score := (max(widths), -variance(widths))) > best:
            best, chosen = score, rows
    return rows_of(text, ",") if chosen is None else chosen


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "csv")
    text = decode(data).removeprefix("\ufeff")
    b.table(sniffed(text))
    return b.rows()
