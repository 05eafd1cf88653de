"""Chat formatting whose output parses back to its source.

A turn is written as mark, text, end mark: ``[INST]text[/INST]`` for a user,
``<s>text</s>`` for an assistant, ``[SYS]text[/SYS]`` for a system turn. Any other role is
written out, ``[ROLE]role[/ROLE]text[/TURN]``; a null role is ``[NOROLE]text[/TURN]``.

Each turn is first written as it is and read back by a deterministic parser. If what the
parser recovers is not the turn, the conflicting content, which is every control string
and every backslash, gets a backslash before it, until the turn is recovered. In reading,
a backslash before ``\\``, ``<`` or ``[`` is dropped and the next character taken as it is,
so escaping is reversible.

A conversation is its turns, one after the other, and is parsed again as a whole: the reader
goes on from where the last turn ended, has the next turn's text behind it, and compares each
turn that it recovers with its source. A turn that isn't recovered there is escaped and read
again; one that still isn't is an error. Conversations are streamed in parts of at most
``PART`` characters (a longer turn makes one of its own), so one of any length takes the memory
of a part; offsets count from the conversation's start.

The loss mask covers the texts of assistant turns, without marks.

Cases: null text is empty; rows are ordered by turn, then role, then text, nulls first;
repeated rows are turns of their own; a null conversation id is a conversation; an empty table
gives no rows; rows that an id shares with others, whatever their source, are one conversation;
other columns and their names play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a formatted conversation that are held at once.
PART = 1 << 20
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER, NONE, ROLE_END, TURN_END = "[ROLE]", "[NOROLE]", "[/ROLE]", "[/TURN]"
CONTROL = (*[x for pair in MARKS.values() for x in pair], OTHER, NONE, ROLE_END, TURN_END)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_STOP = re.compile(r"\\[\\<\[]|" + _CONTROL.pattern)
_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_UNESCAPE = re.compile(r"\\([\\<\[])")
_BY_MARK = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _content(text: str, at: int, end: str) -> tuple[int, int]:
    """Where the content from at ends and where the turn goes on; any other control string is an error."""
    for m in _STOP.finditer(text, at):
        if m[0] == end:
            return m.start(), m.end()
        if m[0][0] != "\\":
            raise ParseError(f"{m[0]} at {m.start()}")
    raise ParseError(f"no {end} after {at}")


def parse_turn(text: str, at: int = 0) -> tuple[str | None, str, int, int, int]:
    """Role, text, the span of the (escaped) text, and where the next turn starts."""
    m = _CONTROL.match(text, at)
    if not m:
        raise ParseError(f"no turn at {at}")
    if m[0] in _BY_MARK:
        role, end = _BY_MARK[m[0]]
        start = m.end()
    elif m[0] == OTHER:
        stop, start = _content(text, m.end(), ROLE_END)
        role, end = unescape(text[m.end() : stop]), TURN_END
    elif m[0] == NONE:
        role, end, start = None, TURN_END, m.end()
    else:
        raise ParseError(f"{m[0]} at {at}")
    stop, after = _content(text, start, end)
    return role, unescape(text[start:stop]), start, stop, after


def parse(text: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        role, said, _, _, at = parse_turn(text, at)
        out.append((role, said))
    return out


def _write(role: str | None, text: str, safe: bool) -> str:
    put = escape if safe else str
    if role in MARKS:
        return MARKS[role][0] + put(text) + MARKS[role][1]
    if role is None:
        return NONE + put(text) + TURN_END
    return OTHER + put(role) + ROLE_END + put(text) + TURN_END


def write_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """The turn, and the span of its text, escaped only if it doesn't read back as it is."""
    for safe in (False, True):
        out = _write(role, text, safe)
        try:
            got_role, got, start, stop, after = parse_turn(out)
        except ParseError:
            continue
        if (got_role, got, after) == (role, text, len(out)):
            return out, start, stop
    raise ParseError("a turn can't be written reversibly")


def format_conversation(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under its loss mask."""
    out, at, spans = [], 0, []
    for role, text in turns:
        piece, start, stop = write_turn(role, text or "")
        if role == "assistant":
            spans.append((at + start, at + stop))
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def render(turns: DataFrame, *, role_col: str = "role", text_col: str = "text", into: str = "__turn") -> DataFrame:
    """turns with their formatted text. No shuffle."""

    @F.arrow_udf("string")
    def write(roles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([write_turn(r, t or "")[0] for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return turns.withColumn(into, write(F.col(role_col), F.col(text_col)))


class Reader:
    """Assembles a conversation turn by turn and parses it, a turn behind."""

    def __init__(self) -> None:
        self.number, self.offset = 0, 0
        self.waiting: tuple[str | None, str, str] | None = None
        self._clear()

    def _clear(self) -> None:
        self.pieces: list[str] = []
        self.size = 0
        self.turns: list[tuple[int, int, int]] = []
        self.loss: list[tuple[int, int]] = []

    def add(self, role: str | None, text: str, piece: str) -> None:
        self._read(piece)
        self.waiting = role, text, piece

    def _read(self, behind: str) -> None:
        """Parses the turn that waits, from where the last one ended and with the next one's text behind it."""
        if self.waiting is None:
            return
        role, text, piece = self.waiting
        for own in (piece, _write(role, text, True)):
            try:
                got_role, got, start, stop, after = parse_turn(own + behind)
            except ParseError:
                continue
            if (got_role, got, after) == (role, text, len(own)):
                at = self.offset + self.size
                self.pieces.append(own)
                self.size += len(own)
                self.turns.append((at + start, at + stop, at + after))
                if role == "assistant":
                    self.loss.append((at + start, at + stop))
                self.waiting = None
                return
        raise ParseError(f"turn {self.number + len(self.turns)} isn't recovered")

    def part(self) -> tuple[int, int, str, list, list]:
        """Number of the first turn, offset, text, turns and loss spans of what is parsed; drops it."""
        out = self.number, self.offset, "".join(self.pieces), self.turns, self.loss
        self.number += len(self.turns)
        self.offset += self.size
        self._clear()
        return out

    def end(self) -> None:
        self._read("")


_PARTS = "conv_id long, part int, first_turn long, at long, formatted string, turns array<struct<start: long, stop: long, end: long>>, loss array<struct<start: long, stop: long>>"


def _assemble(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Turns in order of conversation, to the parts of each."""
    turn = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "stop", "end")]))
    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "stop")]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), turn, span]
    names = ["conv_id", "part", "first_turn", "at", "formatted", "turns", "loss"]
    rows: list[tuple] = []
    reader: Reader | None = None
    conv, parts, held = None, 0, 0

    def flush() -> None:
        nonlocal parts, held
        if reader.turns:
            out = reader.part()
            rows.append((conv, parts, *out))
            held += len(out[2])
            parts += 1

    def batch_of() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        rows.clear()
        held = 0
        return out

    for batch in batches:
        for c, role, text, piece in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if reader is None or c != conv:
                if reader is not None:
                    reader.end()
                    flush()
                reader, conv, parts = Reader(), c, 0
            elif reader.size + len(piece) > most:
                flush()
            reader.add(role, text or "", piece)
            if held >= most:
                yield batch_of()
        if rows:
            yield batch_of()
    if reader is not None:
        reader.end()
        flush()
        yield batch_of()


def conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv_id, part, first_turn, at, formatted, turns, loss: formatted conversations in parts.

    turns has the start and the end of each turn's escaped text and the turn's end, loss the
    spans under the mask, by characters of the conversation. A conversation is a row of part 0
    unless it is longer than a part.
    """
    own = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    placed = render(own, role_col="r", text_col="x", into="f").repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x", "f")
    return placed.mapInArrow(lambda it: _assemble(it, part), _PARTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, to what a reader of the formatted text recovers of each conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state, rows = None, []

    def close() -> None:
        rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    for batch in batches:
        for conv, number, at, text, loss in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "at", "formatted", "loss")], strict=True):
            if number == 0:
                if state is not None:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{'' if role is None else role}\n{said}\n".encode())
            for span in loss:
                under = unescape(text[span["start"] - at : span["stop"] - at])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(text)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
            rows.clear()
    if state is not None:
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def digests(parts: DataFrame) -> DataFrame:
    """What a reader of the conversations' formatted parts recovers, one row for each conversation.

    The parts of a conversation must follow each other in one partition, as conversations() leaves them.
    """
    return parts.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
