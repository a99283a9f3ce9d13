"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the marks around a turn of each role, which role's text carries loss, and
which role may follow which. Formatting a conversation emits text segments with a loss flag
each; the formatted conversation is their concatenation. Control strings inside a text are
broken up by an escape that the reader undoes, so a text that holds the template's own marks
comes back unchanged.

Rows of a conversation meet in one partition, sorted by turn, and stream through the machine:
its state (the last role) passes from batch to batch, and no conversation is held as a whole.

A null text is empty, a null role is the empty role (valid nowhere), a null id is an id like
any other. Equal turns are ordered by role and text; repeated rows are turns of their own. A
wrong turn order does not drop a conversation: it clears its ``valid`` flag. An empty table
gives no segments; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """``opens``/``close``: marks before and after a turn's text. ``header`` ends a role's name."""

    open: str = "<|turn|>"
    header: str = "<|text|>"
    close: str = "</s>"
    #: strings that must not appear inside a text, besides the marks
    controls: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: role -> roles that may follow; the key "" is the start
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    ends: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def _control_strings(self) -> list[str]:
        return sorted({self.open, self.header, self.close, *self.controls}, key=lambda s: (-len(s), s))

    def escaper(self):
        """Doubles the escape character and puts ``escape-`` behind the first character of every
        control string, overlapping ones included."""
        e = re.escape(self.escape)
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self._control_strings())
        pattern = re.compile(f"{e}|{starts}")
        return lambda text: pattern.sub(
            lambda m: self.escape * 2 if m[0] == self.escape else m[0] + self.escape + "-", text)

    def unescaper(self):
        e = re.escape(self.escape)
        pattern = re.compile(f"{e}(?:({e})|-)")
        return lambda text: pattern.sub(lambda m: m[1] or "", text)


SEGMENTS = "conv_id bigint, seq bigint, part string, segment string, loss boolean, turn_valid boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("part", pa.string()), ("segment", pa.string()),
                       ("loss", pa.bool_()), ("turn_valid", pa.bool_())])
DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint, valid boolean")
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                      ("valid", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def format_turns(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every conversation: three a turn (mark and role, text, end mark), numbered in
    order within it, with the loss flag of each and whether the turn's role may come there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = template.escaper()
        conv, last, seq, first = None, START, 0, True
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if first or conv_id != conv:
                    conv, last, seq, first = conv_id, START, 0, False
                valid = role in template.follows.get(last, ())
                out.append((conv, seq, "head", template.open + escape(role) + template.header, False, valid))
                out.append((conv, seq + 1, "text", escape(text), role in template.loss_roles, valid))
                out.append((conv, seq + 2, "close", template.close, False, valid))
                last, seq = role, seq + 3
            yield _batch(out, _SEGMENTS)

    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, SEGMENTS))


class _Reader:
    """Reads formatted text back, piece by piece: finds the marks, undoes the escape, and feeds the
    digests. Holds one turn at most."""

    def __init__(self, template: Template, conv):
        self.t, self.conv, self.unescape = template, conv, template.unescaper()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid, self.role, self.rest = True, START, ""

    def feed(self, segment: str, loss: bool, turn_valid: bool) -> None:
        self.chars += len(segment)
        self.valid &= turn_valid
        self.rest += segment
        if loss:
            text = self.unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        while (end := self.rest.find(self.t.close)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(self.t.close):]
            head, _, text = turn.removeprefix(self.t.open).partition(self.t.header)
            self.role = self.unescape(head)
            self.turns.update(f"{self.role}\n{self.unescape(text)}\n".encode())
            self.n += 1

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                bool(self.valid and self.role in self.t.ends))


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the formatted segments alone: turns, digests of turns and loss text,
    length, and whether the machine accepted it. Streams in segment order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv_id, segment, loss, ok in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "turn_valid"))):
                if reader is None or reader.conv != conv_id:
                    if reader is not None:
                        out.append(reader.row())
                    reader = _Reader(template, conv_id)
                reader.feed(segment, loss, ok)
            yield _batch(out, _DIGESTS)
        if reader is not None:
            yield _batch([reader.row()], _DIGESTS)

    return (segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
            .mapInArrow(run, DIGESTS))
