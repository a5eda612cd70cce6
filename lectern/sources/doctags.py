"""DocTags reader: a flat scan over the tags a document model emits."""

from __future__ import annotations

import re

from lectern.sources.base import Builder, decode

CLASSES = {"title": "Title", "section_header": "SectionHeader", "text": "Paragraph", "paragraph": "Paragraph", "list_item": "ListItem", "caption": "Caption", "footnote": "Footnote", "code": "Code", "formula": "Formula", "picture": "PictureElement", "page_header": "PageHeader", "page_footer": "PageFooter", "reference": "Reference"}
TOKEN = re.compile(r"<(/?)([a-z_]+?)(?:_level_(\d))?((?:\s[^>]*)?)>")
LOC = re.compile(r"<loc_\d+>")


def parse(name: str, data: bytes) -> list[dict]:
    """Text of an element whose end tag is missing reaches to the next tag; an unterminated table ends with the input."""
    b = Builder(name, data, "doctags")
    text = LOC.sub("", decode(data))
    at, page = 0, 1
    pages = {1}
    while m := TOKEN.search(text, at):
        at = m.end()
        tag = m[2]
        if m[1]:
            continue
        if tag in ("page", "page_break"):
            page += tag == "page_break" or (page == 1 and len(b.out) > 0)
            pages.add(page)
        elif tag in ("otsl", "table"):
            end = text.find(f"</{tag}>", at)
            body = text[at : end if end >= 0 else len(text)]
            at = end + len(tag) + 3 if end >= 0 else len(text)
            rows = [[(c[0], c[1].strip()) for c in re.findall(r"<(ched|rhed|fcel|ecel|th|td)>([^<]*)", r)] for r in re.split(r"<nl>|</?tr>", body)]
            rows = [r for r in rows if r]
            if rows:
                el = b.element("TableElement", "el", page=page)
                for r, row in enumerate(rows):
                    for c, (kind, value) in enumerate(row):
                        b.cell(el, r, c, value, kind in ("ched", "rhed", "th"))
        elif tag in CLASSES:
            end = text.find("<", at)
            value = text[at : end if end >= 0 else len(text)].strip()
            b.element(CLASSES[tag], "el", value if tag != "picture" else None, level=int(m[3] or 1) if tag == "section_header" else None, page=page, alt_text=(value or None) if tag == "picture" else None)
            at = end if end >= 0 else len(text)
    for p in sorted(pages):
        b.page(p)
    b.meta["page_count"] = len(pages)
    return b.rows()
