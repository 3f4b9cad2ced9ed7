"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags.

A conversation becomes a sequence of text segments, each with a flag that says whether
loss is taken on it. Control strings cannot arise from texts: every character that begins
one, and the escape character, is escaped inside a text, reversibly. Rows are dealt by
conversation and sorted by turn; one pass streams over them with the state of one turn
in memory, so a conversation of any length needs no more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquarry.llm import common


@dataclass(frozen=True)
class Template:
    """What stands around a turn, by role; roles without a header are written after ``other``."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### @", ": ")
    end: str = " </turn>\n"
    #: Escape character, and the letter that follows it for each escaped character.
    escape: str = "\\"
    letters: dict[str, str] = field(default_factory=lambda: {"\\": "\\", "#": "h", "<": "l", "@": "a", ":": "c"})
    #: Of these, those that are escaped in a role's name alone.
    in_names: str = "@:"
    #: Roles whose texts carry loss.
    trained: frozenset[str] = frozenset({"assistant"})

    def encode(self, text: str, name: bool = False) -> str:
        """Escape a text (or a role's name) so that no control string can be in it."""
        for c in self.escape + "".join(self.letters).replace(self.escape, ""):  # the escape character first
            if name or c not in self.in_names:
                text = text.replace(c, self.escape + self.letters[c])
        return text

    def decode(self, text: str) -> str:
        """Undo ``encode``."""
        if self.escape not in text:
            return text
        back = {v: k for k, v in self.letters.items()}
        return re.sub(re.escape(self.escape) + "(.)", lambda m: back[m[1]], text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> tuple[tuple[str, bool], ...]:
        """A turn's segments with their loss flags: header, text, end."""
        head = self.headers.get(role) or self.other[0] + self.encode(role, True) + self.other[1]
        return (head, False), (self.encode(text), role in self.trained), (self.end, False)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Read turns back from a formatted text."""
        heads = {v: k for k, v in self.headers.items()}
        first = re.compile("|".join(map(re.escape, heads)) + f"|{re.escape(self.other[0])}(?P<other>[^:]*){re.escape(self.other[1])}")
        at = 0
        while at < len(formatted):
            head = first.match(formatted, at)
            if head is None or (end := formatted.find("</turn>", head.end())) < 0:
                raise ValueError(f"no turn at {at}")
            end -= len(self.end[: self.end.index("</turn>")])
            role = heads[head[0]] if head[0] in heads else self.decode(head["other"])
            yield role, self.decode(formatted[head.end() : end])
            at = end + len(self.end)


#: The machine: which roles may follow each state; a state is the role before, "" at the start.
TRANSITIONS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: States in which a conversation may end.
FINAL = ("user", "assistant")


def format_segments(conversations: DataFrame, template: Template = Template(), *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Text segments of every conversation, in order, dealt by conversation and sorted.

    A row per segment: conv_id, turn_no (from 0, by turn, then role, then text: a defined
    order where turns tie or rows repeat), part (0 header, 1 text, 2 end), text, loss,
    fault (in the first segment of the first turn that the machine rejects: what it met).
    Rows with a null id are one conversation of that id, as GROUP BY has it: whoever wants
    them apart gives them ids. Null roles and texts count as empty; null turns come first; an unknown or empty role is
    written under the template's general header. Other columns are ignored. Conversations
    with a fault are formatted too. An empty table gives no rows.
    """
    common.tune(conversations.sparkSession)
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, state = object(), 0, ""
        for batch in common.chunks(batches):
            ids, out = batch.column("conv_id").to_pylist(), []
            for at, (conv, role, text) in enumerate(zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if conv != last:
                    last, number, state = conv, 0, ""
                fault = None
                if state is not None and role not in TRANSITIONS[state]:
                    fault, state = f"{role or 'no role'} after {state or 'start'}", None
                elif state is not None:
                    state = role
                for part, (segment, loss) in enumerate(template.segments(role, text)):
                    out.append((at, number, part, segment, loss, fault if part == 0 else None))
                number += 1
            at, *columns = zip(*out, strict=True)
            types = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "turn_no", "part", "text", "loss", "fault"])

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn_no long, part int, text string, loss boolean, fault string")


class _Reading:
    """Digests of one conversation, read back from its segments."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars, self.fault, self.pending, self.role = conv, 0, 0, 0, None, [], ""
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, text: str, loss: bool, fault: str | None) -> None:
        self.chars += len(text)
        self.fault = self.fault or fault
        self.pending.append(text)
        if loss:
            plain = template.decode(text)
            self.loss += len(plain)
            self.loss_sha.update(plain.encode())
        if text == template.end:  # what was formatted so far is whole turns
            for role, plain in template.turns("".join(self.pending)):
                self.turns += 1
                self.role = role
                self.turns_sha.update(f"{role}\n{plain}\n".encode())
            self.pending = []

    def row(self) -> tuple:
        fault = self.fault or (None if self.role in FINAL else f"end after {self.role or 'no role'}")
        return self.conv, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars, fault is None, fault


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader of ``format_segments``'s output gets back, a row per conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn parsed
    from the formatted text), loss_chars and loss_sha256 (of the unescaped text under the
    loss mask, in code points), formatted_chars, valid and fault (what the machine met first).
    The input must be as ``format_segments`` returns it: no shuffle is made here.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "fault"]
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        reading, rows, kind = None, [], None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, text, loss, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "fault")), strict=True):
                if reading is None or conv != reading.conv:
                    if reading is not None:
                        rows.append(reading.row())
                    reading = _Reading(conv)
                reading.add(template, text, loss, fault)
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows = []
        if reading is not None:
            yield batch_of([*rows, reading.row()])

    return segments.mapInArrow(run, f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, fault string")
