"""Chat formatting: a finite-state machine over roles that emits text segments with loss flags.

A template is data: the text that opens and closes a turn of each role, whether its text is trained on, which role may
follow which, and the control strings. Each turn becomes three segments, ``open``, ``text`` and ``close``; their texts joined
in order are the formatted conversation. Only ``text`` segments of roles with ``loss`` are under the loss mask.

Escaping: inside a text (and an unknown role's name) a backslash is doubled, and a control string gets a backslash after
its first character. No control string is left in an escaped text, and dropping the backslashes gives the text back.

Conversations are brought together by one shuffle on their id and read turn by turn, so memory does not depend on their
length. One conversation is one sequence (so are its digests): a very long one is read by one task, as a stream.

Defined cases: a null text is empty, a null role is the role ``''``. Roles that the template lacks are marked with their
name. Ties in ``turn`` (and null turns, which come first) are ordered by role, then text; repeated rows are repeated turns.
Turns that the machine does not allow are formatted too and have ``valid`` false. A null conversation id is one
conversation of its own. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn]
    #: Roles that may follow a role; ``None`` stands for the beginning.
    follows: dict[str | None, tuple[str, ...]]
    control: tuple[str, ...]
    #: For roles that are not listed: before the name, between name and text, after the text.
    other: tuple[str, str, str] = ("[ROLE] ", " [NAMED] ", " [/ROLE]\n")
    escape: str = "\\"
    _marks: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if any(self.escape in c or len(c) < 2 for c in self.control):
            raise ValueError("control strings have two or more characters and no escape character")
        marks = "|".join(map(re.escape, [self.escape, *sorted(self.control, key=len, reverse=True)]))
        object.__setattr__(self, "_marks", re.compile(marks))

    def escaped(self, text: str) -> str:
        return self._marks.sub(lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + re.escape(self.escape) + "?)", r"\1", text)

    def turn(self, role: str) -> Turn:
        a, b, c = self.other
        return self.roles.get(role) or Turn(a + self.escaped(role) + b, c)

    def role_of(self, opened: str) -> str:
        """The role that an opening segment stands for."""
        for role, turn in self.roles.items():
            if turn.open == opened:
                return role
        return self.unescaped(opened[len(self.other[0]):len(opened) - len(self.other[1])])

    def allowed(self, before: str | None, role: str) -> bool:
        return role in self.follows.get(before, ())


INSTRUCT = Template(
    roles={"system": Turn("<s>[SYS] ", " [/SYS]\n"), "user": Turn("<s>[INST] ", " [/INST]"),
           "assistant": Turn(" ", "</s>", loss=True)},
    follows={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    control=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[NAMED]"))


def format_chats(turns: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id") -> DataFrame:
    """Segments ``(id, turn_no, part, segment, loss, valid)``.

    All segments of a conversation are in one partition and in order; ``turn_no`` counts its turns from 0.
    """
    schema = T.StructType([T.StructField(id_col, turns.schema[id_col].dataType), *[T.StructField(n, t) for n, t in (
        ("turn_no", T.LongType()), ("part", T.StringType()), ("segment", T.StringType()), ("loss", T.BooleanType()),
        ("valid", T.BooleanType()))]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, number = object(), None, 0
        for batch in batches:
            rows: list[list] = [[] for _ in arrow.names]
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != current:
                    current, before, number = conv, None, 0
                turn, valid = template.turn(role), template.allowed(before, role)
                for part, segment, loss in (("open", turn.open, False), ("text", template.escaped(text), turn.loss),
                                            ("close", turn.close, False)):
                    for column, value in zip(rows, (conv, number, part, segment, loss, valid)):
                        column.append(value)
                before, number = role, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, arrow)], schema=arrow)

    together = turns.select(id_col, F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"),
                            F.col("turn").alias("_turn")).repartition(F.col(id_col))
    ordered = together.sortWithinPartitions(id_col, "_turn", "_role", "_text")
    return ordered.select(id_col, "_role", "_text").mapInArrow(run, schema)


def read_back(segments: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id") -> DataFrame:
    """Digests of conversations, taken from the output of ``format_chats`` alone.

    ``(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)``: roles are read from the opening
    segments, texts from unescaped segments, the loss text from the flags.
    """
    schema = T.StructType([T.StructField(id_col, segments.schema[id_col].dataType), *[T.StructField(n, t) for n, t in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
        ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("valid", T.BooleanType()))]])
    arrow = to_arrow_schema(schema)
    coded = lambda s: s.encode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started = None, False
        for batch in batches:
            rows: list[tuple] = []
            for conv, part, segment, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not started or conv != current:
                    if started:
                        rows.append((current, turns, all_turns.hexdigest(), lost, all_loss.hexdigest(), formatted, good))
                    current, started = conv, True
                    turns, lost, formatted, good = 0, 0, 0, True
                    all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
                formatted += len(segment)
                good &= valid
                if part == "open":
                    all_turns.update(coded(template.role_of(segment)) + b"\n")
                elif part == "text":
                    text = template.unescaped(segment)
                    all_turns.update(coded(text) + b"\n")
                    turns += 1
                    if loss:
                        all_loss.update(coded(text))
                        lost += len(text)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
        if started:
            last = (current, turns, all_turns.hexdigest(), lost, all_loss.hexdigest(), formatted, good)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, last))], schema=arrow)

    return segments.select(id_col, "part", "segment", "loss", "valid").mapInArrow(run, schema)
