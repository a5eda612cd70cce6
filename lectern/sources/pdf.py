"""PDF text reader and the text heuristics behind it.

Text is taken from plain and Flate streams, of simple fonts and of fonts with a ToUnicode table; objects may stand in
object streams.  Encrypted files give their document row only.  The heuristics are plain functions that also serve tables of extracted paragraphs.
"""

from __future__ import annotations

import re
import zlib

from lectern.sources.base import Builder

#: Unpacked bytes of a stream that are read.
LARGEST = 1 << 28


def split_into_paragraphs(text: str) -> list[str]:
    """Blank lines and deep indents break paragraphs; lines of a paragraph are joined by spaces."""
    out: list[list[str]] = [[]]
    for block in text.split("\n\n"):
        out.append([])
        for k, line in enumerate(block.split("\n")):
            if not line.strip() or (k and len(line) - len(line.lstrip()) >= 4):
                out.append([])
            if line.strip():
                out[-1].append(line.strip())
    return [" ".join(x) for x in out if x]


def numbered_heading(text: str) -> int | None:
    m = re.match(r"([0-9]+(?:\.[0-9]+)*\.?)[ \t]+(\S.*)$", text.strip(), re.S)
    if not m or "." not in m[1] or len(m[2].encode()) > 100:
        return None
    return min(len(re.findall(r"[0-9]+", m[1])), 6)


def all_caps(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= 2 and all(c.isupper() for c in letters)


def heading_of(text: str, on_page: int) -> int | None:
    """Level of a paragraph that looks like a heading, among ``on_page`` paragraphs of its page."""
    if level := numbered_heading(text):
        return level
    size = len(text.encode())
    if size < 80 and all_caps(text):
        return 1
    if on_page >= 3 and size < 60 and text[-1:] not in ".,;:" and len(text.split()) <= 8 and text[:1].isupper():
        return 2
    return None


def decode_string(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", errors="replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_date(text: str) -> str:
    m = re.match(r"D:(\d{4})(\d{2})(\d{2})", text)
    return f"{m[1]}-{m[2]}-{m[3]}" if m else text


def literal(raw: bytes) -> bytes:
    codes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\(\d{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and int(m[1][:1]) < 8 else codes.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1]), raw, flags=re.S)


STRING = rb"\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)"


HEX = rb"<([0-9A-Fa-f\s]*)>"
SHOWN = re.compile(
    rb"/([^\s/<>\[\]()]+)\s+[-\d.]+\s+Tf|(?:" + STRING + rb"|" + HEX + rb")\s*(Tj|'|\")|\[((?:[^\[\]\\]|\\.)*)\]\s*TJ"
    rb"|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]|(T\*)|(ET)",
    re.S,
)
PIECE = re.compile(STRING + rb"|" + HEX + rb"|(-?[\d.]+)", re.S)


class Font:
    """What the codes of a font's strings mean, by its ToUnicode table."""

    def __init__(self, table: bytes):
        text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", errors="replace")
        self.map: dict[int, str] = {}
        spaces = re.findall(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", table)
        self.width = len(spaces[0]) // 2 if spaces else 2
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                self.map[int(code, 16)] = text(to)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
                codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 65535) + 1)
                if one:
                    for k, code in enumerate(codes):
                        first = text(one)
                        self.map[code] = first[:-1] + chr(min(ord(first[-1:] or "\0") + k, 0x10FFFF))
                else:
                    self.map.update(zip(codes, map(text, re.findall(rb"<([0-9A-Fa-f]+)>", many)), strict=False))

    def decode(self, raw: bytes) -> str:
        codes = (int.from_bytes(raw[k : k + self.width], "big") for k in range(0, len(raw), self.width))
        return "".join(self.map.get(c, "") for c in codes)


def stream_text(data: bytes, fonts: dict[bytes, Font] | None = None) -> str:
    """Text in the order of a content stream; strings of a font with a ToUnicode table are decoded by it."""
    out: list[str] = []
    font: Font | None = None

    def said(plain: bytes | None, coded: bytes | None) -> str:
        raw = literal(plain) if coded is None else bytes.fromhex((h := re.sub(rb"\s", b"", coded)).decode() + "0" * (len(h) % 2))
        return font.decode(raw) if font else decode_string(raw)

    for m in SHOWN.finditer(data):
        if m[1]:
            font = (fonts or {}).get(m[1])
        elif m[4]:
            out.append(("\n" if m[4] != b"Tj" else "") + said(m[2], m[3]))
        elif m[5] is not None:
            out.append("".join(said(p[1], p[2]) if p[3] is None else (" " if float(p[3]) < -200 else "") for p in PIECE.finditer(m[5])))
        elif m[7] is not None:
            drop = abs(float(m[7]))
            out.append("\n\n" if drop > 20 else "\n" if drop else " ")
        elif m[8]:
            out.append("\n")
        else:
            out.append("\n\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


class File:
    """Numbered objects, those inside object streams too."""

    def __init__(self, data: bytes):
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
        for n, body in list(self.objects.items()):
            if re.search(rb"/Type\s*/ObjStm\b", body[:2000]):
                inner = self.stream(n)
                count, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
                heads = [int(x) for x in inner[:first].split()[: 2 * count]]
                places = [*(first + x for x in heads[1::2]), len(inner)]
                for k, number in enumerate(heads[::2]):
                    self.objects.setdefault(number, inner[places[k] : places[k + 1]])

    def stream(self, n: int) -> bytes:
        """An object's stream, unpacked; no more than LARGEST bytes of it."""
        body = self.objects.get(n, b"")
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1], LARGEST) if b"FlateDecode" in body[: m.start()] else m[1]

    def inside(self, body: bytes, key: bytes) -> bytes:
        """What stands in a dictionary under a key: the dictionary itself, or the object that is named."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        at, depth = m.end(), 1
        while depth and (t := re.compile(rb"<<|>>").search(body, at)):
            depth += 1 if t[0] == b"<<" else -1
            at = t.end()
        return body[m.end() : at]

    def fonts(self, page: bytes) -> dict[bytes, Font]:
        found = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.inside(self.inside(page, b"Resources"), b"Font")):
            if table := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.objects.get(int(n), b"")):
                found[name] = Font(self.stream(int(table[1])))
        return found


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "pdf")
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    file = File(data)
    objects = file.objects
    pages = [(n, o) for n, o in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", o)]
    kids = re.search(rb"/Kids\s*\[([^\]]*)\]", b" ".join(o for o in objects.values() if re.search(rb"/Type\s*/Pages\b", o)))
    if kids:
        order = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])]
        pages.sort(key=lambda x: order.index(x[0]) if x[0] in order else len(order))
    for p, (_, body) in enumerate(pages, 1):
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body) or re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", data)
        sides = [float(x) for x in box.groups()] if box else None
        b.page(p, sides[2] - sides[0] if sides else None, sides[3] - sides[1] if sides else None)
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
        fonts = file.fonts(body)
        text = "\n".join(stream_text(file.stream(int(x)), fonts) for x in re.findall(rb"(\d+)\s+\d+\s+R", refs[1] or refs[2])) if refs else ""
        parts = split_into_paragraphs(text)
        for t in parts:
            if level := heading_of(t, len(parts)):
                b.element("SectionHeader", f"header-{p}", t, level=level, page=p, confidence=0.6)
            else:
                b.element("Paragraph", f"paragraph-{p}", t, page=p)
    info = re.search(rb"/Info\s+(\d+)", data)
    fields = dict(re.findall(rb"/(Title|Author|Subject|Keywords|CreationDate)\s*" + STRING, objects.get(int(info[1]), b""))) if info else {}
    for key, field in ((b"Title", "title"), (b"Subject", "description"), (b"Keywords", "keywords")):
        if fields.get(key):
            b.meta[field] = decode_string(literal(fields[key]))
    if fields.get(b"Author"):
        b.meta["creator"] = [decode_string(literal(fields[b"Author"]))]
    if fields.get(b"CreationDate"):
        b.meta["date"] = parse_date(decode_string(literal(fields[b"CreationDate"])))
    b.meta["page_count"] = len(pages)
    return b.rows()
