"""Office readers: word processing, slides and sheets, from the XML inside their archives."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from lectern.sources.base import Builder
from lectern.sources.xml import below, first, tag


def attr(e: ET.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


#: Unpacked bytes of one part of an archive; a larger part fails the document.
LARGEST = 1 << 29
#: Cells of a sheet's bounding rectangle up to which empty ones between used ones are cells too.
DENSE = 1 << 20


class Archive:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, path: str) -> ET.Element | None:
        if path not in self.names:
            return None
        with self.zip.open(path) as part:
            data = part.read(LARGEST + 1)
        if len(data) > LARGEST:
            raise ValueError(f"{path} has more than {LARGEST} bytes unpacked")
        return ET.fromstring(data)

    def links(self, path: str) -> dict[str, tuple[str, str]]:
        """Relationship id -> (target resolved against the part, kind)."""
        folder, name = posixpath.split(path)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in below(root, "Relationship") if root is not None else ():
            target = r.get("Target", "")
            inside = r.get("TargetMode") != "External"
            out[r.get("Id", "")] = (posixpath.normpath(posixpath.join(folder, target)).lstrip("/") if inside and not target.startswith("/") else target.lstrip("/") if inside else target, r.get("Type", "").rsplit("/", 1)[-1])
        return out


def heading_level(style: str | None) -> int | None:
    """0 for a title, 1 to 9 for heading styles."""
    s = (style or "").lower().replace(" ", "")
    if s == "title":
        return 0
    m = re.fullmatch(r"heading([1-9])", s)
    return int(m[1]) if m else None


def is_list_style(style: str | None) -> bool:
    return (style or "").lower().replace(" ", "").startswith(("listparagraph", "listbullet", "listnumber"))


def word_text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        if tag(x) == "t":
            out.append(x.text or "")
        elif tag(x) in ("tab", "br", "cr"):
            out.append(" ")
    return "".join(out).strip()


class Word:
    def __init__(self, b: Builder, z: Archive):
        self.b, self.z = b, z
        self.rels = z.links("word/document.xml")
        styles, numbering, notes = z.xml("word/styles.xml"), z.xml("word/numbering.xml"), z.xml("word/footnotes.xml")
        self.styles, self.outline = {}, {}
        for s in below(styles, "style") if styles is not None else ():
            key = attr(s, "styleId") or ""
            self.styles[key] = attr(first(s, "name"), "val") or key
            if (level := attr(first(s, "outlineLvl"), "val")) is not None:
                self.outline[key] = int(level)
        self.ordered: dict[tuple[str, str], bool] = {}
        if numbering is not None:
            kinds = {attr(a, "abstractNumId"): {attr(v, "ilvl"): attr(first(v, "numFmt"), "val") for v in below(a, "lvl")} for a in below(numbering, "abstractNum")}
            for n in below(numbering, "num"):
                for level, fmt in kinds.get(attr(first(n, "abstractNumId"), "val"), {}).items():
                    self.ordered[attr(n, "numId"), level] = fmt not in ("bullet", "none", None)
        self.notes = {attr(n, "id"): word_text(n) for n in below(notes, "footnote")} if notes is not None else {}
        self.list: tuple | None = None

    def end_list(self) -> None:
        if self.list:
            self.b.close()
            self.list = None

    def paragraph(self, p: ET.Element) -> None:
        b, props = self.b, first(p, "pPr")
        style = attr(first(props, "pStyle"), "val") if props is not None else None
        name = self.styles.get(style or "", style)
        number = first(props, "numPr") if props is not None else None
        num = (attr(first(number, "numId"), "val"), attr(first(number, "ilvl"), "val") or "0") if number is not None else None
        level = heading_level(name)
        if level is None:
            outline = attr(first(props, "outlineLvl"), "val") if props is not None else None
            level = int(outline) if outline is not None else self.outline.get(style or "")
        text = word_text(p)
        listed = level is None and (num is not None and num[0] != "0" or is_list_style(name))
        if not listed:
            self.end_list()
        for h in below(p, "hyperlink"):
            target = self.rels.get(attr(h, "id") or "", (attr(h, "anchor"), ""))[0]
            b.element("Hyperlink", "link", word_text(h), link_target=target, link_text=word_text(h))
        for d in below(p, "docPr"):
            if first(p, "blip") is not None:
                blip = self.rels.get(attr(first(p, "blip"), "embed") or "", (None, ""))[0]
                b.element("PictureElement", "picture", None, alt_text=d.get("descr") or d.get("name"), link_target=blip, pic_format=blip.rsplit(".", 1)[-1].lower() if blip and "." in blip else None)
        if text:
            if level == 0:
                b.element("Title", "title", text)
                b.meta.setdefault("title", text)
            elif level is not None:
                b.element("SectionHeader", "heading", text, level=min(level, 6))
            elif listed:
                ordered = self.ordered.get(num, False) if num else False
                if self.list != (num[0] if num else None, ordered):
                    self.end_list()
                    self.list = (num[0] if num else None, ordered)
                    b.open("OrderedList" if ordered else "UnorderedList", "list")
                b.element("ListItem", "listitem", text)
            else:
                b.element("Paragraph", "paragraph", text)
        for f in below(p, "footnoteReference"):
            if note := self.notes.get(attr(f, "id")):
                b.element("Footnote", "footnote", note)

    def table(self, t: ET.Element) -> None:
        self.end_list()
        el = self.b.element("TableElement", "table")
        rows: list[list] = []
        for r, tr in enumerate(x for x in t if tag(x) == "tr"):
            col, row = 0, []
            for tc in (x for x in tr if tag(x) == "tc"):
                across = int(attr(first(tc, "gridSpan"), "val") or 1)
                merge = first(tc, "vMerge")
                if merge is not None and attr(merge, "val") in (None, "continue"):
                    for old in reversed(rows):
                        if hit := next((c for c in old if c[1] == col), None):
                            hit[4] += 1
                            break
                else:
                    row.append([r, col, word_text(tc), across, 1])
                col += across
            rows.append(row)
        for r, col, text, across, down in (c for row in rows for c in row):
            self.b.cell(el, r, col, text, False, down if down > 1 else None, across if across > 1 else None)

    def body(self, e: ET.Element) -> None:
        for c in e:
            if tag(c) == "p":
                self.paragraph(c)
            elif tag(c) == "tbl":
                self.table(c)
            elif tag(c) in ("sdt", "sdtContent", "ins"):
                self.body(c)


def parse_docx(name: str, data: bytes) -> list[dict]:
    b, z = Builder(name, data, "docx"), Archive(data)
    root = z.xml("word/document.xml")
    if root is None:
        raise ValueError("no word/document.xml")
    lang = first(root, "lang")
    if lang is None and (styles := z.xml("word/styles.xml")) is not None:
        lang = first(styles, "lang")
    if attr(lang, "val"):
        b.meta["language"] = attr(lang, "val")
    word = Word(b, z)
    word.body(first(root, "body"))
    word.end_list()
    for path, kind in sorted(word.rels.values()):
        if kind in ("header", "footer") and (part := z.xml(path)) is not None and word_text(part):
            b.element("PageHeader" if kind == "header" else "PageFooter", f"page{kind}", word_text(part))
    return b.rows()


def slide_text(p: ET.Element) -> str:
    return "".join(x.text or "" for x in below(p, "t")).strip()


def parse_pptx(name: str, data: bytes) -> list[dict]:
    b, z = Builder(name, data, "pptx"), Archive(data)
    deck, rels = z.xml("ppt/presentation.xml"), z.links("ppt/presentation.xml")
    slides = [rels[attr(s, "id")][0] for s in below(deck, "sldId") if attr(s, "id") in rels] if deck is not None else []
    ids = {s: k for s in below(deck, "sldId") for k in [next((v for n, v in s.attrib.items() if n.endswith("}id")), None)]} if deck is not None else {}
    slides = [rels[k][0] for k in ids.values() if k in rels] or slides or sorted(n for n in z.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
    for page, path in enumerate(slides, 1):
        root = z.xml(path)
        b.page(page)
        if root is None:
            continue
        links = z.links(path)
        for shape in below(root, "sp", "pic", "graphicFrame"):
            if tag(shape) == "pic":
                props = first(shape, "cNvPr")
                target = links.get(attr(first(shape, "blip"), "embed") or "", (None, ""))[0]
                b.element("PictureElement", "picture", None, page=page, alt_text=(props.get("descr") or props.get("name")) if props is not None else None, link_target=target, pic_format=target.rsplit(".", 1)[-1].lower() if target and "." in target else None)
            elif tag(shape) == "graphicFrame":
                rows = [[c for c in tr if tag(c) == "tc"] for tr in below(shape, "tr")]
                if any(rows):
                    el = b.element("TableElement", "table", page=page)
                    for r, cells in enumerate(rows):
                        for c, tc in enumerate(cells):
                            if tc.get("hMerge") or tc.get("vMerge"):
                                continue
                            down, across = int(tc.get("rowSpan", 1)), int(tc.get("gridSpan", 1))
                            b.cell(el, r, c, slide_text(tc), r == 0, down if down > 1 else None, across if across > 1 else None)
            else:
                kind = attr(first(shape, "ph"), "type")
                if kind in ("title", "ctrTitle"):
                    if t := " ".join(slide_text(p) for p in below(shape, "p")).strip():
                        b.element("SectionHeader", "title", t, level=1, page=page)
                else:
                    for p in below(shape, "p"):
                        if t := slide_text(p):
                            b.element("Paragraph", "paragraph", t, page=page)
        notes = next((t for t, k in links.values() if k == "notesSlide"), None)
        if notes and (part := z.xml(notes)) is not None:
            for shape in below(part, "sp"):
                if attr(first(shape, "ph"), "type") == "body" and (t := " ".join(x for x in map(slide_text, below(shape, "p")) if x)):
                    b.element("Footnote", "footnote", t, page=page)
    b.meta["page_count"] = len(slides)
    return b.rows()


def column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(name: str, data: bytes) -> list[dict]:
    b, z = Builder(name, data, "xlsx"), Archive(data)
    strings = z.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in below(si, "t")) for si in below(strings, "si")] if strings is not None else []
    book, rels = z.xml("xl/workbook.xml"), z.links("xl/workbook.xml")
    if book is None:
        raise ValueError("no xl/workbook.xml")
    for sheet in below(book, "sheet"):
        rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        root = z.xml(rels.get(rid, ("", ""))[0])
        el = b.element("TableElement", "table", sheet.get("name"))
        grid: dict[tuple[int, int], str] = {}
        for at, row in enumerate(below(root, "row") if root is not None else ()):
            r = int(row.get("r", at + 1)) - 1
            for k, c in enumerate(x for x in row if tag(x) == "c"):
                v, kind = first(c, "v"), c.get("t")
                text = "".join(t.text or "" for t in below(c, "t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                grid[r, column(c.get("r", "")) if c.get("r") else k] = text
        if grid:
            top, left = min(r for r, _ in grid), min(c for _, c in grid)
            height, width = max(r for r, _ in grid) - top + 1, max(c for _, c in grid) - left + 1
            dense = height * width <= max(DENSE, 4 * len(grid))
            for r, c in ((top + k // width, left + k % width) for k in range(height * width)) if dense else sorted(grid):
                b.cell(el, r - top, c - left, grid.get((r, c), ""), r == top)
    return b.rows()
