"""AsciiDoc reader: a state machine over lines."""

from __future__ import annotations

import re

from lectern.sources.base import Builder, decode, picture_format

ADMONITION = re.compile(r"(NOTE|TIP|WARNING|CAUTION|IMPORTANT):\s+(.*)")


def split_row(line: str) -> list[str]:
    """Cells between bars; empty ones count only if the line ends with a bar."""
    cells = [x.strip() for x in line.split("|")[1:]]
    return cells if line.rstrip().endswith("|") else [x for x in cells if x]


def attributes(line: str) -> list[str]:
    return [x.strip().strip('"') for x in line.strip()[1:-1].split(",")]


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "asciidoc")
    lines = decode(data).replace("\r\n", "\n").split("\n")
    i, n = 0, len(lines)
    pending: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(held)
            if m := ADMONITION.match(text):
                b.open("Group", "group", label_id=m[1])
                b.element("Paragraph", "paragraph", m[2])
                b.close()
            else:
                b.element("Paragraph", "paragraph", text)
            held.clear()

    def until(mark: str, at: int) -> tuple[list[str], int]:
        end = at
        while end < n and lines[end].rstrip() != mark:
            end += 1
        return lines[at:end], end + 1

    while i < n:
        line = lines[i].rstrip()
        bare = line.strip()
        if not bare:
            flush()
            i += 1
        elif re.match(r":[\w!-]+:", bare) or bare.startswith(("include::", "//")):
            i += 1
        elif m := re.match(r"(={1,6})\s+(.+)", line):
            flush()
            level = len(m[1]) - 1
            if level == 0:
                b.element("Title", "title", m[2].strip())
                b.meta.setdefault("title", m[2].strip())
            else:
                b.element("SectionHeader", "heading", m[2].strip(), level=level)
            i += 1
        elif bare.startswith("|==="):
            flush()
            body, i = until("|===", i + 1)
            rows, width = [], 0
            for x in body:
                if x.strip():
                    cells = split_row(x)
                    if len(cells) == 1 and width > 1 and rows and len(rows[-1]) < width:
                        rows[-1] += cells
                    elif len(cells) == 1 and width > 1:
                        rows.append(cells)
                    else:
                        width = max(width, len(cells))
                        rows.append(cells)
            if width <= 1 and rows:  # one cell a line: rows end at blank lines
                grouped: list[list[str]] = [[]]
                for x in body:
                    if x.strip():
                        grouped[-1] += split_row(x)
                    elif grouped[-1]:
                        grouped.append([])
                rows = [g for g in grouped if g]
            b.table(rows)
            pending = []
        elif bare == "----" or bare == "....":
            flush()
            body, i = until(bare, i + 1)
            lang = pending[1] if len(pending) > 1 and pending[0] == "source" else None
            b.element("Code", "code", "\n".join(body), code_lang=lang)
            pending = []
        elif bare in ("____", "====", "****"):
            flush()
            body, i = until(bare, i + 1)
            b.open("Group", "group")
            for x in body:
                if x.strip():
                    b.element("Paragraph", "paragraph", x.strip())
            b.close()
            pending = []
        elif re.fullmatch(r"\[[^\]]*\]", bare):
            flush()
            pending = attributes(bare)
            i += 1
        elif m := re.match(r"image::?([^\[]+)\[([^\]]*)\]", bare):
            flush()
            alt = m[2].split(",")[0].strip().strip('"')
            b.element("PictureElement", "picture", None, link_target=m[1], alt_text=alt or None, pic_format=picture_format(m[1], query=False))
            i += 1
        elif m := re.match(r"([*-]|\.)\s+(.+)", bare):
            flush()
            kind = m[1] if m[1] == "." else "*"
            b.open("OrderedList" if kind == "." else "UnorderedList", "list")
            while i < n and (m := re.match(r"\.\s+(.+)" if kind == "." else r"[*-]\s+(.+)", lines[i].strip())):
                b.element("ListItem", "listitem", m[1].strip())
                i += 1
            b.close()
        elif re.match(r"\.\S", bare):
            i += 1
        else:
            held.append(bare)
            i += 1
    flush()
    return b.rows()
