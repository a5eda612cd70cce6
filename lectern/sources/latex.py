"""LaTeX reader: commands, environments and paragraphs over one pass of the source."""

from __future__ import annotations

import re

from lectern.sources.base import Builder, decode, picture_format

LEVELS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
FORMULAS = frozenset("equation align gather multline eqnarray displaymath math".split())
VERBATIM = frozenset("verbatim lstlisting minted".split())
LISTS = {"itemize": "UnorderedList", "enumerate": "OrderedList", "description": "UnorderedList"}


def argument(s: str, at: int, left: str = "{", right: str = "}") -> tuple[str, int] | None:
    """(content, end) of a balanced group that starts at ``at``, white space aside."""
    while at < len(s) and s[at] in " \t\n":
        at += 1
    if at >= len(s) or s[at] != left:
        return None
    depth = 0
    for i in range(at, len(s)):
        if s[i] == "\\":
            continue
        if i and s[i - 1] == "\\" and (i < 2 or s[i - 2] != "\\"):
            continue
        depth += (s[i] == left) - (s[i] == right)
        if not depth:
            return s[at + 1 : i], i + 1
    return s[at + 1 :], len(s)


def environment(s: str, name: str, at: int) -> tuple[str, int]:
    """(body, end) of an environment whose begin ends at ``at``."""
    depth = 1
    for m in re.finditer(rf"\\(begin|end)\{{{re.escape(name)}\}}", s[at:]):
        depth += 1 if m[1] == "begin" else -1
        if not depth:
            return s[at : at + m.start()], at + m.end()
    return s[at:], len(s)


def clean(s: str) -> str:
    """Text of a fragment: commands go, their arguments stay, ties are spaces."""
    s = re.sub(r"\\(?:label|ref|eqref|pageref|cite[tp]?|footnote)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", s)
    s = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ", s) if "\\" in s else s
    s = re.sub(r"\\([%$&#_{}])", r"\1", s).replace("~", " ").replace("{", "").replace("}", "")
    return " ".join(s.split())


def without_comments(s: str) -> str:
    return re.sub(r"(?<!\\)%[^\n]*", "", re.sub(r"(?m)^[ \t]*%[^\n]*\n", "", s))


def tabular_rows(body: str) -> list[list[str]]:
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body)
    rows = [[clean(c) for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\(?:\[[^\]]*\])?", body)]
    return [r for r in rows if any(r)]


class Reader:
    def __init__(self, b: Builder):
        self.b = b

    def text(self, s: str, cls: str = "Paragraph", prefix: str = "paragraph") -> None:
        for part in re.split(r"\n[ \t]*\n", s):
            self.refs(part, cls, prefix)

    def refs(self, part: str, cls: str, prefix: str) -> None:
        notes, found = [], []
        at = 0
        while (k := part.find("\\footnote", at)) >= 0:
            got = argument(part, k + 9)
            if not got:
                break
            notes.append(got[0])
            part = part[:k] + part[got[1] :]
            at = k
        for m in re.finditer(r"\\(ref|eqref|pageref|cite[tp]?)\*?(?:\[[^\]]*\])*\{([^}]*)\}", part):
            found += [(m[1], key.strip()) for key in m[2].split(",") if key.strip()]
        if t := clean(part):
            self.b.element(cls, prefix, t)
        for _, key in found:
            self.b.element("Reference", "ref", key, citation_key=key)
        for note in notes:
            self.b.element("Footnote", "footnote", clean(note))

    def body(self, s: str) -> None:
        at, held = 0, []
        token = re.compile(r"\\begin\{([^}]*)\}|\\\[|\$\$|\\(chapter|section|subsection|subsubsection|paragraph|title|author|date)\*?(?=[\[{\s])|\\(maketitle|tableofcontents|newpage|clearpage)\b|\\(?:documentclass|usepackage|bibliography|bibliographystyle|newcommand|renewcommand)\b")

        def flush() -> None:
            if held:
                self.text("".join(held))
                held.clear()

        while m := token.search(s, at):
            held.append(s[at : m.start()])
            at = m.end()
            if m[1] is not None:
                inner, at = environment(s, m[1], at)
                flush()
                self.env(m[1].rstrip("*"), inner)
            elif m[0] in ("\\[", "$$"):
                end = s.find("\\]" if m[0] == "\\[" else "$$", at)
                end = len(s) if end < 0 else end
                flush()
                self.formula(s[at:end])
                at = end + 2
            elif m[2]:
                if (opt := argument(s, at, "[", "]")) and s[at : at + 1] == "[":
                    at = opt[1]
                got = argument(s, at)
                if not got:
                    continue
                at = got[1]
                flush()
                t = clean(got[0])
                if m[2] == "title":
                    self.b.element("Title", "title", t)
                    self.b.meta.setdefault("title", t)
                elif m[2] == "author":
                    self.b.meta["creator"] = [x for x in (clean(p) for p in got[0].split("\\and")) if x]
                elif m[2] == "date":
                    self.b.meta["date"] = t or None
                else:
                    label = re.match(r"\s*\\label\{([^}]*)\}", s[at:])
                    if label:
                        at += label.end()
                    self.b.element("SectionHeader", "heading", t, level=LEVELS[m[2]], label_id=label[1] if label else None)
            elif not m[3]:
                for _ in range(3):
                    for pair in ("[]", "{}"):
                        if (got := argument(s, at, *pair)) and s[at : at + 1] in "[{":
                            at = got[1]
        held.append(s[at:])
        flush()

    def formula(self, s: str) -> None:
        label = re.search(r"\\label\{([^}]*)\}", s)
        t = re.sub(r"\\label\{[^}]*\}", "", s).strip()
        if t:
            self.b.element("Formula", "formula", t, label_id=label[1] if label else None)

    def env(self, name: str, s: str) -> None:
        label = re.search(r"\\label\{([^}]*)\}", s)
        caption = re.search(r"\\caption(?:\[[^\]]*\])?(?=\{)", s)
        said = argument(s, caption.end())[0] if caption else None
        if name == "document":
            self.body(s)
        elif name == "abstract":
            self.text(s)
        elif name in LISTS:
            self.b.open(LISTS[name], "list")
            self.items(s)
            self.b.close()
        elif name in ("table", "tabular", "tabularx", "longtable"):
            body, el = s, None
            if name == "table":
                m = re.search(r"\\begin\{(tabular\*?|tabularx|longtable)\}", s)
                body = environment(s, m[1], m.end())[0] if m else ""
            if got := argument(body, 0):
                body = body[got[1] :]
            rows = tabular_rows(body)
            if rows:
                el = self.b.table(rows, label_id=label[1] if label else None)
            if said:
                self.b.element("Caption", "caption", clean(said), caption_of=el)
        elif name == "figure":
            el = None
            for m in re.finditer(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}", s):
                el = self.b.element("PictureElement", "picture", None, link_target=m[1], pic_format=picture_format(m[1], False, ("pdf", "eps")), label_id=label[1] if label else None)
            if said:
                self.b.element("Caption", "caption", clean(said), caption_of=el)
        elif name in FORMULAS:
            self.formula(s)
        elif name in VERBATIM:
            lang = re.match(r"\s*\[[^\]]*language=([\w+#-]+)[^\]]*\]", s) or re.match(r"\s*\{(\w+)\}", s) if name != "verbatim" else None
            body = re.sub(r"^\s*(?:\[[^\]]*\])?(?:\{\w+\})?\n", "", s, count=1) if name != "verbatim" else s.removeprefix("\n")
            self.b.element("Code", "code", body.rstrip("\n"), code_lang=lang[1] if lang else None)
        elif name in ("center", "flushleft", "flushright", "quote", "quotation"):
            self.b.open("Group", "group")
            self.body(s)
            self.b.close()

    def items(self, s: str) -> None:
        for part in re.split(r"\\item(?:\[[^\]]*\])?", s)[1:]:
            m = re.search(r"\\begin\{(itemize|enumerate|description)\}", part)
            head = part[: m.start()] if m else part
            self.refs(head, "ListItem", "listitem")
            if m:
                inner, _ = environment(part, m[1], m.end())
                self.env(m[1], inner)


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "latex")
    Reader(b).body(without_comments(decode(data).replace("\r\n", "\n")))
    return b.rows()
