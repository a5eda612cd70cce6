"""Markdown reader: headings, paragraphs, quotes, fenced and indented code, nested lists, pipe tables, images.

Of CommonMark it leaves out reference links, lazy continuation of quotes and link definitions; raw HTML blocks
are skipped and inline HTML stays in the text.
"""

from __future__ import annotations

import re

from lectern.sources.base import Builder, decode, picture_format

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})[.)])(?:([ \t]+)|$)")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
DIVIDER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]*)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)")
LINK = re.compile(r"\[([^\]]*)\]\(\s*<?[^)\s>]*>?(?:\s+[\"'][^\"']*[\"'])?\s*\)")
NOTE = re.compile(r" {0,3}\[\^([^\]]+)\]:[ \t]*(.*)")


def plain(text: str) -> str:
    """Text of inline markup, without its marks."""
    codes: list[str] = []

    def hold(m: re.Match) -> str:
        codes.append(m[2].strip() if m[2].strip() else m[2])
        return f"\x00{len(codes) - 1}\x00"

    out = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", hold, text, flags=re.S)
    out = LINK.sub(r"\1", out)
    out = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", out)
    out = re.sub(r"(?<!\\)(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", out, flags=re.S)
    out = re.sub(r"(?<![\\*])\*(?=[^\s*])([^*]+?)(?<=\S)\*(?!\*)", r"\1", out)
    out = re.sub(r"(?<![\w\\])_(?=[^\s_])([^_]+?)(?<=\S)_(?!\w)", r"\1", out)
    out = re.sub(r"\[\^[^\]]+\]", "", out)
    out = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", out)
    return re.sub(r"\x00(\d+)\x00", lambda m: codes[int(m[1])], out).strip()


def row_cells(line: str) -> list[str]:
    line = line.strip()
    line = line.removeprefix("|")
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [plain(x.replace("\\|", "|")) for x in re.split(r"(?<!\\)\|", line)]


def text_block(b: Builder, cls: str, prefix: str, raw: str) -> None:
    """A text element; an image in it becomes a picture, and drops what stood before it in the text."""
    last = 0
    for m in IMAGE.finditer(raw):
        b.element("PictureElement", "picture", None, alt_text=m[1] or None, link_target=m[2] or None, pic_format=picture_format(m[2], query=False))
        last = m.end()
    if text := plain(raw[last:]):
        b.element(cls, prefix, text)


def blocks(b: Builder, lines: list[str], cls: str = "Paragraph", loose: bool = True) -> None:
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            j = i + 1
            while j < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[j]):
                j += 1
            b.element("Code", "code", "".join(x + "\n" for x in lines[i + 1 : j]), code_lang=m[2] or None)
            i = j + 1
        elif m := ATX.match(line):
            if text := plain(m[2] or ""):
                b.element("SectionHeader", "heading", text, level=len(m[1]))
            i += 1
        elif RULE.match(line):
            i += 1
        elif line.startswith("    "):
            j = i
            while j < n and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            b.element("Code", "code", "\n".join(x[4:] for x in lines[i:j]).rstrip("\n") + "\n")
            i = j
        elif re.match(r" {0,3}>", line):
            j = i
            while j < n and re.match(r" {0,3}>", lines[j]):
                j += 1
            b.open("Group", "group")
            blocks(b, [re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]])
            b.close()
            i = j
        elif ITEM.match(line):
            i = read_list(b, lines, i)
        elif m := NOTE.match(line):
            if text := plain(m[2]):
                b.element("Footnote", "footnote", text, label_id=m[1])
            i += 1
        elif i + 1 < n and "|" in line and DIVIDER.match(lines[i + 1]) and ("|" in lines[i + 1] or "|" in line):
            j = i + 2
            while j < n and "|" in lines[j] and lines[j].strip():
                j += 1
            head = row_cells(line)
            body = [row_cells(x)[: len(head)] for x in lines[i + 2 : j]]
            b.table([head, *body])
            i = j
        else:
            j = i + 1
            while j < n and lines[j].strip() and not (FENCE.match(lines[j]) or ATX.match(lines[j]) or re.match(r" {0,3}>", lines[j]) or re.match(r" {0,3}([-*+]|1[.)])[ \t]", lines[j]) or RULE.match(lines[j])) and not re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j]):
                j += 1
            raw = "\n".join(x.strip() for x in lines[i:j])
            if j < n and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j])):
                if text := plain(raw):
                    b.element("SectionHeader", "heading", text, level=1 if m[1][0] == "=" else 2)
                j += 1
            elif not re.match(r" {0,3}<(?:!--|/?(?:div|table|p|pre|script|style|section|article|ul|ol|h[1-6])\b)", line, re.I):
                text_block(b, cls, "listitem" if cls == "ListItem" else "paragraph", raw)
            i = j


def read_list(b: Builder, lines: list[str], i: int) -> int:
    """A list and its items; items of a loose list are paragraphs, and an item's own text goes when a list is nested in it."""
    first = ITEM.match(lines[i])
    mark = first[2][-1]
    b.open("OrderedList" if first[3] else "UnorderedList", "list")
    items: list[list[str]] = []
    loose = False
    while i < len(lines):
        m = ITEM.match(lines[i])
        if not m or m[2][-1] != mark or RULE.match(lines[i]):
            break
        width = len(m[1]) + len(m[2]) + (1 if not m[4] or len(m[4]) > 4 else len(m[4]))
        own, j = [lines[i][width:] if m[4] else ""], i + 1
        while j < len(lines):
            x = lines[j]
            if not x.strip():
                k = j
                while k < len(lines) and not lines[k].strip():
                    k += 1
                if k < len(lines) and (lines[k].startswith(" " * width)):
                    loose = loose or not ITEM.match(lines[k][width:])
                    own += [""] * (k - j)
                    j = k
                    continue
                if k < len(lines) and (nxt := ITEM.match(lines[k])) and nxt[2][-1] == mark:
                    loose = True
                    j = k
                break
            if x.startswith(" " * width):
                own.append(x[width:])
            elif ITEM.match(x) or ATX.match(x) or FENCE.match(x) or x.lstrip().startswith(">"):
                break
            else:
                own.append(x.strip())
            j += 1
        items.append(own)
        i = j
    for own in items:
        nested = next((k for k in range(1, len(own)) if ITEM.match(own[k])), None)
        blocks(b, own if nested is None or loose else own[nested:], "Paragraph" if loose else "ListItem")
    b.close()
    return i


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "markdown")
    blocks(b, decode(data).replace("\r\n", "\n").replace("\t", "    ").split("\n"))
    return b.rows()
