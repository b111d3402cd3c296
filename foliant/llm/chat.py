"""Chat formatting by event sourcing.

A log holds events of conversations: ``message`` sets a turn's text, ``delta`` adds to the
text that its latest start has, ``edit`` replaces it, ``regenerate`` starts an assistant
turn anew with the event's text, ``delete`` takes the turn out. The log is dealt out by
conversation, sorted by conversation, turn and sequence within the partitions, and read as
a stream, so that a task holds one turn's fold and the rendering of one conversation.
Rendering marks turns with control strings; inside texts they are escaped, reversibly.

A conversation's output is one value, rendered and hashed from its first turn to its
last, so it stays in one task, whatever its length; the task reads its events as a stream
and holds only the rendered text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, text_or_empty

#: The template's control strings. A turn is OPEN role MIDDLE text CLOSE; learned texts stand between LEARN and CLOSE.
OPEN, MIDDLE, LEARN, CLOSE = "<|turn|>", "<|text|>", "<|learn|>", "<|end|>"
#: Control strings of other templates, which texts must not bring in either.
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
#: Roles whose texts are learned.
LEARNED = ("assistant",)
KINDS = ("message", "delta", "edit", "regenerate", "delete")

#: An escape puts ESCAPE behind the first character of a control string, and doubles it where it stands there already.
ESCAPE = "\\"
_CONTROL = re.compile("|".join(re.escape(x[0]) + r"(\\*)" + re.escape(x[1:]) for x in [OPEN, MIDDLE, LEARN, CLOSE, *FOREIGN]))
_TURN = re.compile(re.escape(OPEN) + "(.*?)(" + re.escape(MIDDLE) + "|" + re.escape(LEARN) + ")(.*?)" + re.escape(CLOSE), re.S)


def escaped(text: str) -> str:
    """``text`` without any control string: one more ESCAPE in each, so that it can be taken out again."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == ESCAPE else m[0], text)


def rendered(turns: list[tuple[str, str]]) -> str:
    """(role, text) pairs as one string."""
    return "".join(f"{OPEN}{escaped(role)}{LEARN if role in LEARNED else MIDDLE}{escaped(text)}{CLOSE}" for role, text in turns)


def parsed(formatted: str) -> list[tuple[str, str, bool]]:
    """Role, text and whether it is learned of each turn; the inverse of ``rendered``."""
    return [(unescaped(m[1]), unescaped(m[3]), m[2] == LEARN) for m in _TURN.finditer(formatted)]


def from_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A conversation table as a log: a message a row. Rows that share a turn follow by role, then by text."""
    rows = conversations.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return rows.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def _folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of each turn that is left. ``events``: ordered (conv_id, turn, seq, kind, role, text).

    Events of one turn number after a ``message`` belong to it, whatever role they name; another
    message of the same number is a turn of its own. A turn whose first event is no message
    starts with that event and its role. Events of a kind that isn't in KINDS change nothing.
    """
    key, role, text, alive = None, "", [], False
    for conv, turn, _, kind, of, piece in events:
        if kind not in KINDS:
            continue
        if kind == "message" or (conv, turn) != key:
            if alive:
                yield key[0], role, "".join(text)
            key, role, text, alive = (conv, turn), of, [piece], kind != "delete"
        elif kind == "delta":
            text.append(piece)
        elif kind == "delete":
            alive = False
        else:
            text, alive = [piece], True
    if alive:
        yield key[0], role, "".join(text)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds: list = []

    def events() -> Iterator[tuple]:
        for batch in batches:
            kinds.append(batch.column("conv_id").type)
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "kind", "role", "text")), strict=True)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kinds[0]), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["conv_id", "formatted", "n_turns"])

    ready, size, current, parts, any_yet = [], 0, None, [], False
    for conv, role, text in _folded(events()):
        if any_yet and conv != current:
            ready.append((current, "".join(parts), len(parts)))
            size += len(ready[-1][1])
            parts = []
            if size > 4 << 20:
                yield out(ready)
                ready, size = [], 0
        current, any_yet = conv, True
        parts.append(rendered([(role, text)]))
    if any_yet:
        ready.append((current, "".join(parts), len(parts)))
        yield out(ready)


def format_log(log: DataFrame) -> DataFrame:
    """One row per conversation with a turn left: ``conv_id, formatted, n_turns``.

    ``log``: conv_id, turn, seq, kind (of KINDS), role, text; others are ignored. Events
    count in the order of turn, then seq, then kind, role and text, nulls first; events of other kinds are left out; a null
    text, role or kind counts as empty (as ``message`` for the kind), rows without a
    conversation are one conversation of their own, and repeated rows are repeated events.
    """
    small_batches(log.sparkSession)
    rows = log.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return dealt.mapInArrow(_formatted, f"conv_id {kind}, formatted string, n_turns long")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("formatted").to_pylist():
            turns = parsed(text)
            all_turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, said, learned in turns:
                all_turns.update(f"{role}\n{said}\n".encode())
                if learned:
                    loss.update(said.encode())
                    chars += len(said)
            rows.append((len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(text)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from ``format_log``'s output: counts and digests of the turns and of the learned texts."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted").mapInArrow(_digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
