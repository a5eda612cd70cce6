"""WebVTT reader: one paragraph per cue, with its times."""

from __future__ import annotations

import re

from lectern.sources.base import Builder, decode

TIME = re.compile(r"(?:\d+:)?\d{1,2}:\d{2}\.\d{3}$")
TAG = re.compile(r"<[^>]*>?")


def times(line: str) -> tuple[str, str] | None:
    left, arrow, right = line.partition("-->")
    end = right.split()
    if arrow and end and TIME.match(left.strip()) and TIME.match(end[0]):
        return left.strip(), end[0]
    return None


def parse(name: str, data: bytes) -> list[dict]:
    b = Builder(name, data, "webvtt")
    text = decode(data).removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if not text.startswith("WEBVTT"):
        raise ValueError("no WEBVTT header")
    for block in re.split(r"\n[ \t]*\n", text)[1:]:
        lines = [x for x in block.split("\n") if x.strip()]
        if not lines or re.match(r"(NOTE|STYLE|REGION)\b", lines[0]):
            continue
        at = next((i for i in range(min(2, len(lines))) if times(lines[i])), None)
        if at is None:
            continue
        start, end = times(lines[at])
        body = "\n".join(TAG.sub("", x).strip() for x in lines[at + 1 :]).strip()
        if body:
            b.element("Paragraph", "cue", body, start_time=start, end_time=end)
    return b.rows()
