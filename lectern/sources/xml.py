"""XML readers: journal articles (JATS), patents (USPTO), and any other vocabulary."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from lectern.sources.base import Builder, decode, picture_format


def kind(text: str) -> str:
    """jats, uspto or generic, by document type and root element."""
    head = text[:4096]
    doctype = re.search(r"<!DOCTYPE[^>]*>", head, re.S)
    root = re.search(r"<([A-Za-z][\w.:-]*)", re.sub(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", head, flags=re.S))
    name = root[1] if root else ""
    if doctype and re.search(r"NLM|JATS", doctype[0]):
        return "jats"
    if name.startswith("us-patent"):
        return "uspto"
    return "jats" if name == "article" else "generic"


def tree(text: str) -> ET.Element:
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", text, flags=re.S)
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)(\w+);", lambda m: __import__("html").unescape(m[0]), text)
    return ET.fromstring(text.encode("utf-8") if not text.startswith("<?xml") else re.sub(r"^<\?xml.*?\?>", "", text, flags=re.S).encode("utf-8"))


def tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def said(e: ET.Element | None, without: tuple[str, ...] = ()) -> str:
    if e is None:
        return ""

    def parts(x: ET.Element):
        yield x.text or ""
        for c in x:
            if tag(c) not in without and tag(c):
                yield from parts(c)
            yield c.tail or ""

    return " ".join("".join(parts(e)).split())


def below(e: ET.Element, *names: str):
    return (x for x in e.iter() if tag(x) in names)


def first(e: ET.Element, name: str) -> ET.Element | None:
    return next(below(e, name), None)


def build_date(year: str, month: str | None, day: str | None) -> str:
    return "-".join([year, *(x.zfill(2) for x in (month, day if month else None) if x)])


def read_table(b: Builder, e: ET.Element, **more) -> str | None:
    rows = [[c for c in tr if tag(c) in ("th", "td", "entry")] for tr in below(e, "tr", "row")]
    heads = {id(tr) for h in below(e, "thead") for tr in below(h, "tr", "row")}
    trs = list(below(e, "tr", "row"))
    if not any(rows):
        return None
    el = b.element("TableElement", "table", **more)
    for r, (tr, cells) in enumerate(zip(trs, rows, strict=True)):
        col = 0
        for c in cells:
            across = int(c.get("colspan", "1")) if c.get("colspan", "1").isdigit() else 1
            b.cell(el, r, col, said(c), tag(c) == "th" or id(tr) in heads, int(c.get("rowspan")) if c.get("rowspan", "").isdigit() else None, across if across > 1 else None)
            col += max(across, 1)
    return el


class Jats:
    def __init__(self, b: Builder):
        self.b = b

    def front(self, root: ET.Element) -> None:
        title = first(root, "article-title")
        if title is not None and said(title):
            self.b.element("Title", "title", said(title))
            self.b.meta["title"] = said(title)
        names = []
        for c in below(root, "contrib"):
            name = first(c, "name")
            full = " ".join(x for x in (said(first(c, "given-names")), said(first(c, "surname"))) if x) if name is not None else said(first(c, "collab"))
            if full:
                names.append(full)
        if names:
            self.b.meta["creator"] = names
        date = first(root, "pub-date")
        if date is not None and said(first(date, "year")):
            self.b.meta["date"] = build_date(said(first(date, "year")), said(first(date, "month")) or None, said(first(date, "day")) or None)
        for a in below(root, "abstract"):
            self.b.open("Group", "group", label_id="abstract")
            self.walk(a, 1)
            self.b.close()

    def paragraph(self, e: ET.Element, cls: str = "Paragraph", prefix: str = "paragraph") -> None:
        if t := said(e, ("fig", "table-wrap", "disp-formula", "list", "fn")):
            self.b.element(cls, prefix, t)
        for x in below(e, "xref"):
            self.b.element("Reference", "reference", said(x), citation_key=x.get("rid"))
        for c in e:
            if tag(c) in ("fig", "table-wrap", "disp-formula", "list", "fn"):
                self.one(c, 1)

    def walk(self, e: ET.Element, depth: int) -> None:
        for c in e:
            self.one(c, depth)

    def one(self, e: ET.Element, depth: int) -> None:
        name, b = tag(e), self.b
        if name == "sec":
            b.open("Group", "group", label_id=e.get("id"))
            self.walk(e, depth + 1)
            b.close()
        elif name == "title":
            if said(e):
                b.element("SectionHeader", "heading", said(e), level=max(1, min(depth - 1 if depth > 1 else 1, 6)))
        elif name == "p":
            self.paragraph(e)
        elif name == "list":
            b.open("OrderedList" if e.get("list-type") in ("order", "number", "ordered") else "UnorderedList", "list")
            for item in e:
                if tag(item) == "list-item" and (t := said(item, ("list",))):
                    b.element("ListItem", "listitem", t)
                    for inner in item:
                        if tag(inner) == "list":
                            self.one(inner, depth)
            b.close()
        elif name == "table-wrap":
            el = read_table(b, e, label_id=e.get("id"))
            cap = first(e, "caption")
            if cap is not None and said(cap):
                b.element("Caption", "caption", said(cap), caption_of=el)
        elif name == "fig":
            graphic = first(e, "graphic")
            href = next((v for k, v in (graphic.attrib if graphic is not None else {}).items() if k.endswith("href")), None)
            el = b.element("PictureElement", "picture", None, link_target=href, pic_format=picture_format(href or ""), label_id=e.get("id"), alt_text=said(first(e, "alt-text")) or None)
            cap = first(e, "caption")
            if cap is not None and said(cap):
                b.element("Caption", "caption", said(cap), caption_of=el)
        elif name in ("disp-formula", "inline-formula"):
            tex = first(e, "tex-math")
            b.element("Formula", "formula", said(tex if tex is not None else e), label_id=e.get("id"))
        elif name in ("code", "preformat"):
            b.element("Code", "code", "".join(e.itertext()), code_lang=e.get("language"))
        elif name == "fn":
            b.element("Footnote", "footnote", said(e), label_id=e.get("id"))
        elif name == "ref":
            if said(e):
                b.element("Reference", "reference", said(e, ("label",)), citation_key=e.get("id"))
        elif name not in ("front", "article-meta", "journal-meta"):
            self.walk(e, depth)


def uspto(b: Builder, root: ET.Element) -> None:
    title = first(root, "invention-title")
    if title is not None and said(title):
        b.element("Title", "title", said(title))
        b.meta["title"] = said(title)
    people = []
    for who in below(root, "us-applicant", "applicant", "inventor"):
        full = " ".join(x for x in (said(first(who, "first-name")), said(first(who, "last-name"))) if x) or said(first(who, "orgname"))
        if full and full not in people:
            people.append(full)
    if people:
        b.meta["creator"] = people
    for d in below(root, "date"):
        if re.fullmatch(r"\d{8}", said(d)):
            t = said(d)
            b.meta["date"] = b.meta.get("date") or f"{t[:4]}-{t[4:6]}-{t[6:]}"

    def walk(e: ET.Element) -> None:
        for c in e:
            name = tag(c)
            if name in ("abstract", "description", "claims", "claim"):
                b.open("Group", "group", label_id=c.get("id") or name)
                walk(c)
                b.close()
            elif name == "heading":
                level = c.get("level", "1")
                b.element("SectionHeader", "heading", said(c), level=min(max(int(level), 1), 6) if level.isdigit() else 1)
            elif name in ("p", "claim-text"):
                if t := said(c, ("tables", "claim-text")):
                    b.element("Paragraph", "paragraph", t)
                walk(c)
            elif name in ("tables", "table"):
                read_table(b, c)
            else:
                walk(c)

    walk(root)


def generic(b: Builder, e: ET.Element) -> None:
    """Depth first without recursion limits of very deep trees in mind: every element is a group of its name."""
    todo: list[tuple[str, ET.Element | str]] = [("open", e)]
    while todo:
        what, x = todo.pop()
        if what == "close":
            b.close()
        elif what == "text":
            if t := " ".join(x.split()):
                b.element("Paragraph", "paragraph", t)
        elif tag(x):
            b.open("Group", "group", label_id=tag(x))
            rest: list = [("text", x.text or "")]
            for c in x:
                rest += [("open", c), ("text", c.tail or "")]
            todo += [*reversed([*rest, ("close", x)])]


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "xml")
    text = decode(data).removeprefix("\ufeff")
    root, what = tree(text), kind(text)
    if what == "jats":
        reader = Jats(b)
        reader.front(root)
        for part in ("body", "back", "floats-group"):
            for e in root:
                if tag(e) == part:
                    reader.walk(e, 1)
    elif what == "uspto":
        uspto(b, root)
    else:
        generic(b, root)
    return b.rows()
