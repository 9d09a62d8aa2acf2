"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

The machine has a state for each role that spoke last; a template names the moves that are allowed. Conversations that
break the order are formatted all the same and flagged, so that a filter on `valid` is the caller's choice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Edge(Enum):
    """States before the first and after the last turn; no role equals them, whatever its name."""

    START = "start"
    END = "end"


START, END = Edge.START, Edge.END


def _name(state: str | Edge) -> str:
    return f"<{state.value}>" if isinstance(state, Edge) else state


@dataclass(frozen=True)
class Template:
    """open/close: what stands before and after a role's text; moves: the roles allowed after each state; loss: trained roles.

    Inside texts the escape character is doubled, and each control string gets the escape character behind its first
    character, so that none stands whole; this is undone exactly by dropping each escape character and keeping the one
    behind it. Names of other roles have the first characters of all control strings, `]` and `%` as %XX.
    """

    open: dict[str, str] = field(default_factory=lambda: {"system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": "<s>[ANS] "})
    close: dict[str, str] = field(default_factory=lambda: {"system": " [/SYS]</s>", "user": " [/INST]</s>", "assistant": " [/ANS]</s>"})
    other: tuple[str, str] = ("<s>[ROLE:{role}] ", " [/ROLE]</s>")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", END)})
    loss: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE:", "[/ROLE]")

    def marks(self, role: str) -> tuple[str, str]:
        if role in self.open:
            return self.open[role], self.close[role]
        for c in self.coded:
            role = role.replace(c, f"%{ord(c):02X}")
        return self.other[0].replace("{role}", role), self.other[1]

    @property
    def coded(self) -> list[str]:
        """Characters that role names don't hold as such, the one that marks the others first."""
        return ["%", *sorted({"]", *(c[0] for c in self.controls)})]

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for c in self.controls:
            text = text.replace(c, c[0] + self.escape + c[1:])
        return text

    def unescaped(self, text: str) -> str:
        parts, i = [], 0
        while (j := text.find(self.escape, i)) >= 0:
            parts += [text[i:j], text[j + 1]]
            i = j + 2
        return "".join([*parts, text[i:]])

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The three segments of a turn: opening mark, escaped text, closing mark; the text alone may carry loss."""
        before, after = self.marks(role)
        return [(before, False), (self.escaped(text), role in self.loss), (after, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation; ValueError if it isn't one."""
        opens = {v: k for k, v in self.open.items()}
        head = self.other[0].partition("{role}")
        turns, i = [], 0
        while i < len(formatted):
            role = next((r for mark, r in opens.items() if formatted.startswith(mark, i)), None)
            if role is not None:
                i += len(self.open[role])
            elif formatted.startswith(head[0], i) and (stop := formatted.find(head[2], i)) >= 0:
                role = formatted[i + len(head[0]) : stop]
                for c in reversed(self.coded):
                    role = role.replace(f"%{ord(c):02X}", c)
                i = stop + len(head[2])
            else:
                raise ValueError(f"no turn at {i}")
            close = self.marks(role)[1]
            stop = formatted.find(close, i)  # no text holds a whole control string
            if stop < 0:
                raise ValueError(f"turn at {i} does not end")
            turns.append((role, self.unescaped(formatted[i:stop])))
            i = stop + len(close)
        return turns


SEGMENTS = "conv long, turn_no long, segment int, text string, loss boolean, role string, broken string"


def format_turns(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv, turn_no, segment, text, loss, role, broken) in order within partitions, each conversation in one.

    Rows go by turn (nulls first), then role and text; rows are read one after the other, so a conversation of any
    length needs the memory of a turn. A null text is empty, a null role is the role `null`; null conv_ids are one
    conversation. `broken` says on a turn's first segment which move of the machine it breaks (null: none); a text that
    ends in a wrong state is flagged on its last segment.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("null")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, no, held = START, None, 0, None  # held: the last segment of the conversation so far
        first = True
        for b in batches:
            out: list[tuple] = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if first or c != conv:
                    if held is not None:
                        out.append((*held[:6], None if END in template.moves.get(state, ()) else f"{_name(state)} to {_name(END)}"))
                        held = None
                    conv, state, no, first = c, START, 0, False
                broken = None if role in template.moves.get(state, ()) else f"{_name(state)} to {role}"
                if held is not None:
                    out.append(held)
                parts = template.segments(role, text)
                out += [(c, no, i, s, loss, role, broken if i == 0 else None) for i, (s, loss) in enumerate(parts)]
                held, state, no = out.pop(), role, no + 1
            yield _batch(out)
        if held is not None:
            yield _batch([(*held[:6], None if END in template.moves.get(state, ()) else f"{_name(state)} to {_name(END)}")])

    return rows.mapInArrow(run, SEGMENTS)


_TYPES = [("conv", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("role", pa.string()), ("broken", pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_TYPES)], names=[n for n, _ in _TYPES])


def read_back(segments: DataFrame, template: Template = Template(), conv_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Per conversation, from its segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    A turn is parsed from the text of its segments, so memory is bounded by a turn. in_order: the segments come straight
    from format_turns(), in its order and partitions; others, such as those of a written table, are brought into order.
    """
    if not in_order:
        segments = segments.select([n for n, _ in _TYPES]).repartition("conv").sortWithinPartitions("conv", "turn_no", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, turns, loss, n, chars, total, valid, turn = None, False, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, []

        def finish() -> tuple:
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, valid

        for b in batches:
            done = []
            for c, segment, text, flag, broken in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 6)), strict=True):
                if not open_ or (c != conv):
                    if open_:
                        done.append(finish())
                    conv, open_, turns, loss, n, chars, total, valid, turn = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, []
                valid, total = valid and broken is None, total + len(text)
                turn.append(text)
                if flag:
                    plain = template.unescaped(text)
                    chars += len(plain)
                    loss.update(plain.encode())
                if segment == 2:
                    ((role, said),) = template.parse("".join(turn))
                    turns.update(f"{role}\n{said}\n".encode())
                    n, turn = n + 1, []
            if done:
                yield _rows(done)
        if open_:
            yield _rows([finish()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return segments.mapInArrow(run, f"`{conv_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
