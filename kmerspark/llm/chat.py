r"""Chat formatting with a grammar round trip.

    conversation := <s> turn*
    turn         := [INST] text [/INST]  |  <<SYS>> text <</SYS>>
                 |  text </s>            |  <<ROLE>> role <</ROLE>> text </s>

Markers are set off from the text by single spaces.  The roles user, system and
assistant have the first three forms, in that order, and any other role has the
last.  Each turn is rendered as it is, parsed back by the deterministic parser
and compared with its source; where they differ, a conflicting control string
gets one backslash more in front, until what is read back is identical.  A
control string is a marker only with no backslash before it; the parser takes
one backslash off the others.

Turns are rendered apart from each other, so a conversation of any length is
formatted in parallel, one row a turn.  Reading back folds a conversation's
turns into its digests as they stream by in order, without holding them.

Defined results: null text and null role count as empty; turns are taken in the
order (turn, role, text), nulls first; repeated rows are repeated turns; a null
conv_id is a conversation of its own; an empty table gives an empty table;
columns besides the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerspark.scratch import materialize

BEGIN = "<s>"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"]
FORMS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": (" ", " </s>")}
CONTROL = "|".join(map(re.escape, CONTROLS))
_LIVE = re.compile(rf"(?<!\\)(?:{CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*(?:{CONTROL}))")


def escape(text: str, controls: list[str]) -> str:
    if not controls:
        return text
    return re.sub(rf"\\*(?:{'|'.join(map(re.escape, controls))})", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_turn(s: str, at: int) -> tuple[str, int, int, int]:
    """The turn that starts at ``at``: role, where its text starts and ends, and where the next turn starts."""
    role = next((r for r in ("user", "system") if s.startswith(FORMS[r][0], at)), None)
    if role is None and s.startswith("<<ROLE>> ", at):
        m = _LIVE.search(s, at + 9)
        if not m or not s.startswith(" <</ROLE>> ", m.start() - 1):
            raise ValueError(f"role not closed at {at}")
        role, start, close = unescape(s[at + 9 : m.start() - 1]), m.end() + 1, " </s>"
    elif role is None:
        if not s.startswith(" ", at):
            raise ValueError(f"no turn at {at}")
        role, start, close = "assistant", at + 1, FORMS["assistant"][1]
    else:
        start, close = at + len(FORMS[role][0]), FORMS[role][1]
    m = _LIVE.search(s, start)
    if not m or m.start() - 1 < start or not s.startswith(close, m.start() - 1):
        raise ValueError(f"turn not closed at {at}")
    return role, start, m.start() - 1, m.end()


def parse(s: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a run of turns."""
    turns, at = [], 0
    while at < len(s):
        role, start, end, at = parse_turn(s, at)
        turns.append((role, unescape(s[start:end])))
    return turns


def _render(role: str, text: str, controls: list[str]) -> str:
    text = escape(text, controls)
    if role in FORMS:
        return f"{FORMS[role][0]}{text}{FORMS[role][1]}"
    return f"<<ROLE>> {escape(role, CONTROLS)} <</ROLE>> {text} </s>"


def render(role: str, text: str) -> str:
    """The turn, with its conflicting content escaped until it is read back identical."""
    escaped: list[str] = []
    while True:
        piece = _render(role, text, escaped)
        try:
            if parse(piece) == [(role, text)]:
                return piece
        except ValueError:
            pass
        left = [c for c in CONTROLS if c in text and c not in escaped]
        if not left:
            raise ValueError(f"cannot be rendered: {role!r} {text[:80]!r}")
        escaped.append(min(left, key=text.index))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with each turn rendered.

    piece: the turn as text of the conversation, which is BEGIN and its pieces in
    order; loss_from, loss_to: the part of the piece under the loss mask, the
    assistant's text, or null.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, spans = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                pieces.append(render(role, text))
                spans.append(parse_turn(pieces[-1], 0)[1:3] if role == "assistant" else (None, None))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.string()), *(pa.array([s[i] for s in spans], pa.int32()) for i in (0, 1))], [*b.schema.names, "piece", "loss_from", "loss_to"])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, piece string, loss_from int, loss_to int")


class _Fold:
    """What is known of a conversation after the pieces so far."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss = conv_id, 0, len(BEGIN), 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        for role, text in parse(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(piece[start:end])
            self.loss += len(text)
            self.masked.update(text.encode())
        self.chars += len(piece)

    def row(self) -> list:
        return [self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars]


def read_back(formatted: DataFrame) -> DataFrame:
    """What the parser and the loss mask find in format_turns' output: one row per conversation."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "piece", "loss_from", "loss_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: _Fold | None = None
        for b in batches:
            done = []
            for conv_id, *piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fold is None or fold.conv_id != conv_id:
                    if fold is not None:
                        done.append(fold.row())
                    fold = _Fold(conv_id)
                fold.add(*piece)
            if done:
                yield _rows(done, b.schema.field(0).type)
            id_type = b.schema.field(0).type
        if fold is not None:
            yield _rows([fold.row()], id_type)

    def _rows(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write, and read the written turns back."""
    return read_back(materialize(format_turns(conversations), "formatted"))


#: The same by SQL: the digests of the source, and the template's lengths.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE role
      WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 6
      ELSE 25 + length(role) + len(regexp_extract_all(role, '{CONTROL}')) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
