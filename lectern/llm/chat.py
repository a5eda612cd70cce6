r"""Chat formatting over typed content parts.

A message's content is a list of typed parts.  A visitor walks the parts in order and flattens them to
text in which images, audio clips and documents are ordered placeholders, each recorded with its
reference, its place and the number of model tokens it expands to.

Template, for each turn: ``<|im_start|>`` role newline body ``<|im_end|>`` newline.  Texts cannot forge a
mark: every ``<`` that is followed by any number of backslashes and a bar gets one more backslash, so
``<|`` never occurs inside an escaped text, and taking one backslash away restores it exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick, tidy

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: newlines and backslashes become backslash pairs before control strings are escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one message; ``out`` is the escaped body."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 768
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def place(self, kind: str, ref: str | None, tokens: int) -> None:
        at = self.length
        self.add(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": ref, "place": at, "n_tokens": max(1, tokens)})

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda x: math.ceil((x or 0) / self.patch)
        self.place("image", part.get("ref"), side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self.place("audio", part.get("ref"), math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.place("document", part.get("ref"), (part.get("pages") or 0) * self.page_tokens)


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, start and end of its body, attachments)."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    head = f"{START}{escape_role(role or '')}\n"
    return f"{head}{''.join(visitor.out)}{END}\n", len(head), len(head) + visitor.length, visitor.attachments


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, unescaped; placeholders stay as they are."""
    for m in TURN.finditer(formatted):
        yield unescape_role(m[1]), unescape(m[2])


ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("n_tokens", pa.int64())])
TURN_SCHEMA = "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,place:long,n_tokens:long>>, extra_tokens long"
TURN_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(ATTACHMENT)), ("extra_tokens", pa.int64())])
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def format_turns(conversations: DataFrame, content: str = "text", learn: str = "assistant") -> DataFrame:
    """One formatted piece for each row; a conversation's formatted text is its pieces in turn order.

    ``content`` is a string column or one of typed parts (``PARTS``).  loss_start and loss_end are the code
    points of the piece under the loss mask (null where the role is not ``learn``).  Null role, text or parts
    are empty; null conv_id and turn are kept; repeated rows and equal turns each give a piece; an empty
    table gives an empty result; other columns are ignored.  No row needs another one, so a conversation
    with any share of the rows is no burden.
    """
    typed = dict(conversations.dtypes).get(content, "string").startswith("array")
    rows = pick(conversations, conv_id=("conv_id", "long"), turn=("turn", "long"), role=("role", "string"), content=(content, PARTS if typed else "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = [x for x in row["content"] or [] if x] if typed else [{"type": "text", "text": row["content"]}]
                formatted, start, end, found = format_turn(row["role"], parts)
                mine = row["role"] == learn
                out.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "formatted": formatted, "loss_start": start if mine else None, "loss_end": end if mine else None, "attachments": found, "extra_tokens": sum(x["n_tokens"] for x in found)})
            yield pa.RecordBatch.from_pylist(out, TURN_ARROW)

    return rows.mapInArrow(tidy(run), TURN_SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted pieces in (turn, role, piece) order, null turns first.

    The hashes run over the pieces as they stream by in order: a worker holds one batch and two hash
    states, whatever a conversation's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        done.append(finish(now, state))
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(row["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if row["loss_start"] is not None:
                    learnt = unescape(row["formatted"][row["loss_start"] : row["loss_end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(row["formatted"])
            yield pa.RecordBatch.from_pylist(done, DIGEST_ARROW)
            done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([finish(now, state)], DIGEST_ARROW)

    def finish(conv_id, state) -> dict:
        return dict(zip(DIGEST_ARROW.names, [conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]], strict=True))

    ordered = turns.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "formatted")))
    return ordered.mapInArrow(tidy(run), DIGEST)
