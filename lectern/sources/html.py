"""HTML reader over the standard library's tokenizer, with a tree builder that closes implied end tags."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from lectern.sources.base import Builder, decode, picture_format

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
SKIPPED = frozenset("script style noscript template head".split())
STRUCTURE = frozenset("ul ol table blockquote pre figure p div section article header footer h1 h2 h3 h4 h5 h6".split())
PARENTS = {"ul": "UnorderedList", "ol": "OrderedList", "blockquote": "Group", "section": "Group", "article": "Group", "header": "PageHeader", "footer": "PageFooter"}
PASSING = frozenset("html body main div nav aside".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def find_all(self, *tags: str):
        """Descendants of these tags in document order."""
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, Node):
                    if child.tag in tags:
                        yield child
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def text(self, without: frozenset[str] = frozenset()) -> str:
        out, todo = [], [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, str):
                    out.append(child)
                elif child.tag not in without and child.tag not in SKIPPED:
                    if child.tag == "br":
                        out.append(" ")
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()
        return " ".join("".join(out).split())


    def raw(self) -> str:
        """All text as it stands."""
        out, todo = [], [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, str):
                    out.append(child)
                else:
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._close({"p"}, {"td", "th", "li", "table", "button"} - {tag})
        if tag in CLOSES:
            tags, stop = CLOSES[tag]
            for _ in range(3):
                self._close(tags, stop)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(text: str) -> Node:
    parser = Tree()
    parser.feed(text)
    parser.close()
    return parser.root


def code_language(classes: str) -> str | None:
    names = classes.split()
    for prefix in ("language-", "lang-"):
        for n in names:
            if n.startswith(prefix):
                return n[len(prefix) :]
    return names[0] if names else None


def span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "")
    return max(int(value), 1) if value.isdigit() else 1


def read_table(b: Builder, node: Node) -> None:
    """Header cells of a row come first, then its data cells; a column span moves the next cell on, row spans do not."""
    rows = []
    for tr in node.find_all("tr"):
        own = [c for c in tr.children if isinstance(c, Node)]
        rows.append([*(c for c in own if c.tag == "th"), *(c for c in own if c.tag == "td")])
    if not any(rows):
        return
    el = b.element("TableElement", "table")
    for r, cells in enumerate(rows):
        col = 0
        for c in cells:
            down, across = span(c, "rowspan"), span(c, "colspan")
            b.cell(el, r, col, c.text(), c.tag == "th", down if down > 1 else None, across if across > 1 else None)
            col += across


def link(b: Builder, node: Node) -> None:
    text = node.text()
    if text or node.attrs.get("href"):
        b.element("Hyperlink", "link", text, link_target=node.attrs.get("href"), link_text=text)


def picture(b: Builder, node: Node) -> str:
    src = node.attrs.get("src", "")
    return b.element("PictureElement", "picture", None, alt_text=node.attrs.get("alt"), link_target=src or None, pic_format=picture_format(src))


def below(node: Node, enter) -> Iterator[Node]:
    """Nodes below ``node`` in document order, without recursion; only what ``enter`` lets is descended into."""
    todo = [iter(node.children)]
    while todo:
        for child in todo[-1]:
            if isinstance(child, Node):
                yield child
                if enter(child):
                    todo.append(iter(child.children))
                    break
        else:
            todo.pop()


def inline(b: Builder, node: Node, within: frozenset[str] = frozenset()) -> None:
    """Links and images below a text element become elements of their own after it; ``within`` is left to the caller."""
    for child in below(node, lambda x: x.tag not in within and x.tag != "img"):
        if child.tag in within:
            continue
        if child.tag == "a":
            link(b, child)
        elif child.tag == "img":
            picture(b, child)


def walk(b: Builder, root: Node) -> None:
    """Elements of a tree, however deep; what is open stands on a stack with whether it closes a parent."""
    todo = [(iter(root.children), False)]
    while todo:
        children, opened = todo[-1]
        for child in children:
            if isinstance(child, Node) and child.tag not in SKIPPED and (into := visit(b, child)) is not None:
                todo.append((iter(into), child.tag in PARENTS))
                break
        else:
            todo.pop()
            if opened:
                b.close()


def visit(b: Builder, child: Node) -> list | None:
    """Elements of one node; what below it is to be walked."""
    tag = child.tag
    if tag in PASSING:
        return child.children
    if tag in PARENTS:
        b.open(PARENTS[tag], tag)
        return child.children
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        if text := child.text():
            b.element("SectionHeader", "heading", text, level=int(tag[1]))
            inline(b, child)
    elif tag == "p":
        if text := child.text():
            b.element("Paragraph", "paragraph", text)
        inline(b, child)
    elif tag == "li":
        if text := child.text(STRUCTURE):
            b.element("ListItem", "listitem", text)
        inline(b, child, STRUCTURE)
        # lists and tables nested in a list item
        return [x for x in below(child, lambda x: x.tag not in STRUCTURE) if x.tag in STRUCTURE]
    elif tag == "a":
        link(b, child)
    elif tag == "img":
        picture(b, child)
    elif tag == "table":
        read_table(b, child)
    elif tag == "pre":
        code = next(child.find_all("code"), None)
        raw = (code or child).raw()
        if code is not None:
            b.element("Code", "code", raw, code_lang=code_language(code.attrs.get("class", "")))
        elif raw.strip():
            b.element("Paragraph", "paragraph", raw.strip())
    elif tag == "figure":
        el = next((picture(b, i) for i in child.find_all("img")), None)
        for c in child.find_all("figcaption"):
            b.element("Caption", "caption", c.text(), caption_of=el)
    return None


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "html")
    root = tree(decode(data))
    html = next(root.find_all("html"), None)
    if html is not None and html.attrs.get("lang"):
        b.meta["language"] = html.attrs["lang"]
    for meta in root.find_all("meta"):
        key, value = meta.attrs.get("name", "").lower(), meta.attrs.get("content", "")
        if value and key in ("description", "keywords"):
            b.meta[key] = value
        elif value and key == "author":
            b.meta.setdefault("creator", []).append(value)
    title = next(root.find_all("title"), None)
    if title is not None and title.text():
        b.element("Title", "title", title.text())
        b.meta["title"] = title.text()
    walk(b, next(root.find_all("body"), None) or root)
    return b.rows()
