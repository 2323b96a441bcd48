"""Operator 1: chat formatting of messages with typed content parts.

A visitor walks the parts of a message (text, image, audio, document) in order. Text is escaped and
appended; any other part leaves a placeholder and a record of what it refers to, where the
placeholder stands and how many tokens it expands to. Marks open and close each turn. A control
string inside a text gets a backslash after its first character, one more if it has some already, so
that texts never hold a control string and the reader can undo it.

Rows of a conversation are brought together by a shuffle and a sort; a task then streams over them
and holds one conversation at a time, which is one row of output anyway.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
#: Other roles are named after the mark; the name ends at the line break.
OTHER = ("[ROLE] ", " [/ROLE]")
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

_TAIL = r"(?=/?(?:INST|SYS|ROLE)\]|/?s>|\|(?:image|audio|document)\|>)"
_BARE = re.compile(r"([<\[])(\\*)" + _TAIL)
_HELD = re.compile(r"([<\[])\\(\\*)" + _TAIL)
_OPEN = re.compile("|".join(re.escape(m[0]) for m in (*MARKS.values(), OTHER)))
_PLACE = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))
_ROLES = {m[0]: role for role, m in MARKS.items()}
_FLUSH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _BARE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _HELD.sub(r"\1\2", text)


def _name(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Expansion:
    """Tokens that parts expand to. ``text`` counts those of a text; parts without measures take the defaults."""

    text: Callable[[str], int] = words
    patch: int = 28
    image: int = 256
    audio_per_second: float = 25.0
    page: int = 512

    def of_image(self, width: int | None, height: int | None) -> int:
        return math.ceil(width / self.patch) * math.ceil(height / self.patch) if width and height else self.image

    def of_audio(self, seconds: float | None) -> int:
        return math.ceil((seconds or 0) * self.audio_per_second)

    def of_document(self, pages: int | None) -> int:
        return self.page * (pages or 1)


@dataclass
class Flattener:
    """Visitor over the parts of one conversation's messages; grows the formatted text."""

    expansion: Expansion
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    turns: int = 0
    tokens: int = 0
    spans: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    _texts: list[str] = field(default_factory=list)
    _learned: bool = False

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def _end_text(self) -> None:
        """Texts in a row are escaped as one, or a control string could form where they meet."""
        if text := "".join(self._texts):
            begin = self.length
            self._put(escape(text))
            self.tokens += self.expansion.text(text)
            if self._learned:
                self.spans.append({"begin": begin, "end": self.length})
        self._texts.clear()

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._end_text()
        self.attachments.append({"kind": kind, "ref": part["ref"], "turn": self.turns, "begin": self.length, "tokens": tokens})
        self.tokens += tokens
        self._put(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self._texts.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.of_image(part["width"], part["height"]))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.of_audio(part["seconds"]))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.of_document(part["pages"]))

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type']}", self.visit_text)(part)

    def turn(self, role: str | None, parts: list[dict | None] | None) -> None:
        role = role or ""
        start, end = MARKS.get(role, OTHER)
        self._put(start if role in MARKS else f"{start}{_name(role)}\n")
        self._learned = role == "assistant"
        for part in parts or []:
            self.visit(part)
        self._end_text()
        self._put(end)
        self.turns += 1


_FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<begin: long, end: long>>, attachments array<struct<kind: string, ref: string, turn: long, begin: long, tokens: long>>, n_tokens long"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("begin", pa.int64()), ("tokens", pa.int64())]))),
    ("n_tokens", pa.int64()),
])


def _format(expansion: Expansion):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        chars, now, out = 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or row["conv_id"] != now:
                    if out is not None:
                        done.append(_finished(now, out))
                        chars += out.length
                        if chars > _FLUSH_CHARS:
                            yield pa.RecordBatch.from_pylist(done, _ARROW)
                            done, chars = [], 0
                    now, out = row["conv_id"], Flattener(expansion)
                out.turn(row["role"], row["parts"])
        if out is not None:
            done.append(_finished(now, out))
        yield pa.RecordBatch.from_pylist(done, _ARROW)

    return run


def _finished(conv: int | None, out: Flattener) -> dict:
    return {"conv_id": conv, "n_turns": out.turns, "formatted": "".join(out.pieces), "loss": out.spans, "attachments": out.attachments, "n_tokens": out.tokens}


def text_part(text: Column) -> Column:
    """The parts of a message that is one text."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(kind).alias(name) for name, kind in null.items())))


def format_conversations(messages: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """A row for each conversation of ``messages`` (conv_id, turn, role, and parts, an array of PART, or else text).

    Gives conv_id, n_turns, formatted, loss (spans of assistant text, in code points of formatted),
    attachments (kind, ref, turn, place and expanded tokens) and n_tokens. Turns go by number, null
    ones last; ties go by role and content, and repeated rows are turns of their own. A null text is
    empty, null parts are none, a part of unknown type counts as its text, and a null role is an
    empty one. Rows without conv_id form one conversation. Other columns are ignored.
    """
    parts = F.col("parts") if "parts" in messages.columns else text_part(F.col("text"))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), "role", parts.alias("parts"))
    held = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("_turn").asc_nulls_last(), "role", "parts")
    return held.select("conv_id", "role", "parts").mapInArrow(_format(expansion or Expansion()), _FORMATTED)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation; placeholders are left out."""
    at = 0
    while at < len(formatted):
        mark = _OPEN.match(formatted, at)
        if not mark:
            raise ValueError(f"no turn begins at {at}")
        at, role = mark.end(), _ROLES.get(mark[0])
        if role is None:
            line = formatted.index("\n", at)
            role, at = _role(formatted[at:line]), line + 1
        end = (MARKS[role] if mark[0] in _ROLES else OTHER)[1]
        close = formatted.index(end, at)
        yield role, "".join(map(unescape, _PLACE.split(formatted[at:close])))
        at = close + len(end)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss")), strict=True):
            formatted, turns, learned, n, chars = formatted.as_py(), hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text in read_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in loss.as_py():
                text = unescape(formatted[span["begin"] : span["end"]])
                learned.update(text.encode())
                chars += len(text)
            rows.append({"conv_id": conv.as_py(), "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": learned.hexdigest(), "formatted_chars": len(formatted)})
        yield pa.RecordBatch.from_pylist(rows, _READ)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the formatted text and its loss spans alone."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
