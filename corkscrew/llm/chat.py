"""Chat formatting by a finite-state machine over roles.

A declarative template names the control strings; the machine walks a
conversation's turns in order, checks each step from state to state and emits
text segments with a loss flag. Control strings and the escape character
inside texts are escaped by the escape character, so the output can be read
back without doubt.

Defined results: a null text is empty, a null role is an empty role; turns are
ordered by turn (nulls first), ties by role and text; an unknown role is
written under the generic marker and makes the conversation invalid, as does a
forbidden step, but every conversation is formatted; rows without a
conversation id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import ship


@dataclass(frozen=True)
class Template:
    """Control strings of a format. No control string may hold ``escape``, and
    none may begin inside another's text, so that borders make none."""

    markers: dict[str, str] = field(default_factory=lambda: {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"})
    other: str = "### Role:"
    end_role: str = "</role>"
    end_turn: str = "</turn>"
    after_marker: str = " "
    after_turn: str = "\n"
    escape: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; a state is the role before, "" at the start
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [*self.markers.values(), self.other, self.end_role, self.end_turn]


class Formatter:
    def __init__(self, template: Template):
        self.t = template
        esc, words = re.escape(template.escape), sorted(template.controls, key=len, reverse=True)
        any_control = "|".join(map(re.escape, words))
        self._escape = re.compile(f"({esc}|{any_control})").sub
        self._unescape = re.compile(f"{esc}({esc}|{any_control})").sub
        self.tokens = re.compile(f"{esc}(?:{esc}|{any_control})|({any_control})", re.S)
        self.role_of = {m: r for r, m in template.markers.items()}

    def escape(self, text: str) -> str:
        return self._escape(lambda m: self.t.escape + m[1], text)

    def unescape(self, text: str) -> str:
        return self._unescape(lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The (text, loss) segments of one turn."""
        t = self.t
        marker = t.markers.get(role)
        head = marker + t.after_marker if marker else t.other + t.after_marker + self.escape(role) + t.end_role
        return [(head, False), (self.escape(text), role in t.loss), (t.end_turn + t.after_turn, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of an output."""
        t, at, turns = self.t, 0, []
        while at < len(formatted):
            m = self.tokens.match(formatted, at)
            at = m.end() + len(t.after_marker)
            if m[1] == t.other:
                stop = self._next(formatted, at, t.end_role)
                role, at = self.unescape(formatted[at:stop]), stop + len(t.end_role)
            else:
                role = self.role_of[m[1]]
            stop = self._next(formatted, at, t.end_turn)
            turns.append((role, self.unescape(formatted[at:stop])))
            at = stop + len(t.end_turn) + len(t.after_turn)
        return turns

    def _next(self, formatted: str, at: int, control: str) -> int:
        for m in self.tokens.finditer(formatted, at):
            if m[1] == control:
                return m.start()
            if m[1]:
                break
        raise ValueError("not an output of this template")


class _Conversation:
    """State of the machine between turns."""

    def __init__(self, formatter: Formatter):
        self.f, self.state, self.valid, self.turns = formatter, "", True, 0
        self.out: list[str] = []
        self.chars = 0
        self.loss: list[dict[str, int]] = []

    def turn(self, role: str, text: str) -> None:
        self.valid &= role in self.f.t.steps.get(self.state, ())
        self.state, self.turns = role, self.turns + 1
        for part, loss in self.f.segments(role, text):
            if loss:
                self.loss.append({"start": self.chars, "end": self.chars + len(part)})
            self.out.append(part)
            self.chars += len(part)


def format_conversations(rows: DataFrame, template: Template | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, valid, formatted, loss): ``loss`` lists the code
    point ranges of ``formatted`` that are trained on."""
    ship()
    template = template or Template()
    ordered = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        key, open_ = None, None

        def emit(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in done], pa.int64()), pa.array([c.turns for _, c in done], pa.int64()), pa.array([c.valid and c.state in template.ends for _, c in done]), pa.array(["".join(c.out) for _, c in done], pa.string()), pa.array([c.loss for _, c in done], loss_type)],
                names=["conv_id", "n_turns", "valid", "formatted", "loss"],
            )

        for batch in batches:
            done = []
            for k, r, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if open_ is None or k != key:
                    if open_ is not None:
                        done.append((key, open_))
                    key, open_ = k, _Conversation(formatter)
                open_.turn(r, x)
            if done:
                yield emit(done)
        if open_ is not None:
            yield emit([(key, open_)])

    return ordered.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, "conv_id long, n_turns long, valid boolean, formatted string, loss array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of outputs, read back from ``formatted`` and ``loss`` alone."""
    ship()
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = formatter.read(value)
                trained = "".join(formatter.unescape(value[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{x}\n" for r, x in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(value)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)), batch.column(1)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
            )

    return formatted.select("conv_id", "valid", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
