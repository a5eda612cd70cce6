"""Image reader: format and size from the file's header."""

from __future__ import annotations

import struct

from lectern.sources.base import Builder


def jpeg_size(d: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(d):
        if d[at] != 0xFF:
            at += 1
            continue
        mark = d[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", d[at + 5 : at + 9])
            return w, h
        at += 2 if mark in (0x01, 0xFF) or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]
    raise ValueError("no frame header")


def tiff_size(d: bytes) -> tuple[int, int]:
    e = "<" if d[:2] == b"II" else ">"
    at = struct.unpack(e + "I", d[4:8])[0]
    found = {}
    for k in range(struct.unpack(e + "H", d[at : at + 2])[0]):
        tag, kind = struct.unpack(e + "HH", d[at + 2 + 12 * k : at + 6 + 12 * k])
        raw = d[at + 10 + 12 * k : at + 14 + 12 * k]
        found[tag] = struct.unpack(e + "H", raw[:2])[0] if kind == 3 else struct.unpack(e + "I", raw)[0]
    return found[256], found[257]


def webp_size(d: bytes) -> tuple[int, int]:
    if d[12:16] == b"VP8X":
        return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little")
    if d[12:16] == b"VP8L":
        bits = int.from_bytes(d[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return tuple(x & 0x3FFF for x in struct.unpack("<HH", d[26:30]))


def measure(d: bytes) -> tuple[str, int, int]:
    if d.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png", *struct.unpack(">II", d[16:24])
    if d.startswith(b"GIF8"):
        return "gif", *struct.unpack("<HH", d[6:10])
    if d.startswith(b"BM"):
        w, h = struct.unpack("<ii", d[18:26])
        return "bmp", w, abs(h)
    if d.startswith(b"\xff\xd8\xff"):
        return "jpeg", *jpeg_size(d)
    if d[:4] in (b"II*\0", b"MM\0*"):
        return "tiff", *tiff_size(d)
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        return "webp", *webp_size(d)
    raise ValueError("unknown image format")


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "image")
    kind, width, height = measure(data)
    b.element("PictureElement", "picture", None, link_target=name, pic_format=kind, img_w=width, img_h=height)
    return b.rows()
