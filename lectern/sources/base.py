"""What all readers share: a builder that numbers elements in reading order and collects rows."""

from __future__ import annotations

import hashlib
import re

from lectern.schema import DOC

PICTURES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "tiff", "bmp")


class Builder:
    """Rows of one document.  Elements get ids ``{doc}/{prefix}-{order}``; a cell belongs to its own table."""

    def __init__(self, name: str, data: bytes, source_format: str):
        self.hash = hashlib.sha256(data).hexdigest()
        self.doc = DOC + self.hash
        self.meta: dict = {"kind": "doc", "doc": self.doc, "source_format": source_format, "document_hash": self.hash, "file_name": name, "file_size": len(data), "status": "Success"}
        self.out: list[dict] = []
        self.order = 0
        self.stack: list[str] = []

    @property
    def parent(self) -> str | None:
        return self.stack[-1] if self.stack else None

    def element(self, cls: str, prefix: str, text: str | None = None, **more) -> str:
        el = f"{self.doc}/{prefix}-{self.order}"
        self.out.append({"kind": "element", "doc": self.doc, "el": el, "cls": cls, "ord": self.order, "text": text, "parent": self.parent, "depth": len(self.stack), **more})
        self.order += 1
        return el

    def open(self, cls: str, prefix: str, **more) -> str:
        el = self.element(cls, prefix, **more)
        self.stack.append(el)
        return el

    def close(self) -> None:
        if self.stack:
            self.stack.pop()

    def cell(self, table: str, row: int, col: int, text: str, header: bool, row_span: int | None = None, col_span: int | None = None) -> None:
        self.out.append({"kind": "cell", "doc": self.doc, "tbl": table, "row": row, "col": col, "text": text, "is_header": header, "row_span": row_span, "col_span": col_span})

    def table(self, rows: list[list[str]], header_rows: int = 1, text: str | None = None, **more) -> str | None:
        """A table of plain rows; ragged rows are padded to the widest."""
        width = max(map(len, rows), default=0)
        if not width:
            return None
        el = self.element("TableElement", "table", text, **more)
        for r, row in enumerate(rows):
            for c in range(width):
                self.cell(el, r, c, row[c] if c < len(row) else "", r < header_rows)
        return el

    def page(self, number: int, width: float | None = None, height: float | None = None) -> None:
        self.out.append({"kind": "page", "doc": self.doc, "page": number, "width": width, "height": height})

    def rows(self) -> list[dict]:
        return [self.meta, *self.out]


def picture_format(target: str, query: bool = True, more: tuple[str, ...] = ()) -> str | None:
    """Image format by the last extension of a link; with ``query`` what follows ? or # is cut off first."""
    clean = re.split(r"[?#]", target)[0] if query else target
    ext = clean.rsplit(".", 1)[-1].lower() if "." in clean else ""
    return ext if ext in (*PICTURES, *more) else None


def decode(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")
