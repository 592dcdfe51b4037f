"""Chat formatting with a grammar round trip.

Template: ``### Role: text</turn>`` and a newline for each turn. The grammar is deterministic: a
header runs to its first unescaped ``: ``, a body to its first unescaped ``</turn>``; a backslash
escapes a following backslash, ``<`` or ``#`` (in a header also ``:``), and no body may hold an
unescaped ``### ``. Each rendered turn is parsed again; if the turn that comes back differs, the
text is escaped and the parse repeated, until both are identical.

Conversations are streamed: rows are dealt out by conversation, sorted by turn, and rendered,
read back and digested one turn at a time, so a task holds one turn, however long the conversation is.

Defined cases: null texts and roles are empty; rows of one turn follow by role, then text; null turns
come first; rows without conversation id form one conversation of their own; repeated rows are repeated turns;
an empty table gives no conversations; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Roles with a name of their own in the template; others are spelt out after ``=``.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
CLOSE = "</turn>"

_ESCAPE = re.compile(r"\\(?=[\\<#]|\Z)|</turn>|### ")
_UNESCAPE = re.compile(r"\\([\\<#])")
_ROLE_ESCAPE = re.compile(r"[\\:<#]")
_HEADER = re.compile(r"### ((?:[^\\:<#]|\\.)*): ", re.S)
_CONTROL = re.compile(r"(\\+)?(</turn>|### )")


class NotInGrammar(ValueError):
    """Text that is no sequence of turns."""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, start and end of the body, end of the turn) of the turn that starts at ``at``."""
    header = _HEADER.match(text, at)
    if header is None:
        raise NotInGrammar(at)
    name = re.sub(r"\\(.)", r"\1", header[1], flags=re.S)
    role = NAMES.get(header[1]) if not name.startswith("=") else name[1:]
    if role is None:
        raise NotInGrammar(at)
    start = header.end()
    for m in _CONTROL.finditer(text, start):
        if len(m[1] or "") % 2:
            continue  # escaped
        if m[2] != CLOSE or not text.startswith("\n", m.end()):
            raise NotInGrammar(m.start())
        body = text[start : m.end() - len(CLOSE)]
        return role, _UNESCAPE.sub(r"\1", body), start, m.end() - len(CLOSE), m.end() + 1
    raise NotInGrammar(at)


def render_turn(role: str, text: str) -> str:
    """One turn of the template, escaped as far as needed for the parser to return it."""
    name = ROLES.get(role) or "=" + _ROLE_ESCAPE.sub(lambda m: "\\" + m[0], role)
    for body in (text, escape(text)):
        out = f"### {name}: {body}{CLOSE}\n"
        try:
            back = parse_turn(out)
        except NotInGrammar:
            continue
        if back[:2] == (role, text) and back[4] == len(out):
            return out
    raise AssertionError("escaped text must come back")


def parse(text: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation."""
    out, at = [], 0
    while at < len(text):
        role, body, _, _, at = parse_turn(text, at)
        out.append((role, body))
    return out


def _sorted(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.selectExpr(f"`{conv}` AS conv", f"`{turn}` AS turn", f"coalesce(`{role}`, '') AS role", f"coalesce(`{text}`, '') AS text")
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, seq, rendered, loss_start, loss_end) for each turn: a conversation is its turns' texts in
    order of seq; the loss mask covers code points loss_start to loss_end of a turn (null: none of it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, fresh = None, 0, True
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for conv_id, r, t in zip(ids, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                seq = 0 if fresh or conv_id != last else seq + 1
                fresh, last = False, conv_id
                made = render_turn(r, t)
                _, _, start, end, _ = parse_turn(made)
                out.append((seq, made, *((start, end) if r == "assistant" else (None, None))))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["conv", "seq", "rendered", "loss_start", "loss_end"],
            )

    kind = df.schema[conv].dataType.simpleString()
    schema = f"conv {kind}, seq long, rendered string, loss_start long, loss_end long"
    return _sorted(df, conv, turn, role, text).mapInArrow(run, schema)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, from format_turns' output alone (in its order, task by task)."""
    kind = rendered.schema["conv"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush(b: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 6
            kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        b = None
        for b in batches:
            for conv, text, start, end in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(text):
                    role, body, s, e, at = parse_turn(text, at)
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                    if start is not None and start <= s and e <= end:
                        state[3] += len(body)
                        state[4].update(body.encode())
                state[5] += len(text)
            yield flush(b)
        close()
        if b is not None:
            yield flush(b)

    return rendered.mapInArrow(run, schema)
