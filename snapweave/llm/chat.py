"""Chat formatting by replaying conversation logs.

A log row is an event: ``message`` opens a turn with a role and a text, ``delta`` appends
text to it, ``edit`` replaces its text, ``regenerate`` empties it so that later
deltas start anew. Rows are dealt by conversation and sorted by sequence; a task
folds them as they stream by and keeps one turn at a time, so a conversation of
any length needs no more memory than its longest turn. Final messages are sorted once
more where they lie, for messages that share a number, and rendered.

Template: ``### Role: text </turn>\\n``. Inside roles and texts a backslash is
put before ``\\``, ``#``, ``:`` and ``<`` so that neither marker can occur there;
unescaping drops it again.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPE = re.compile(r"[\\#<:]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:#<]*(?:\\.[^\\:#<]*)*): ([^\\:#<]*(?:\\.[^\\:#<]*)*) </turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and where its text starts and ends there."""
    head = f"{OPEN}{escape(role)}{MID}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end span the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conversation, message, role, text) of each final message from sorted events (conversation, message, thread, kind, role, text)."""
    now, role, parts = None, "", []
    for conv, message, thread, kind, who, text in events:
        if (conv, message, thread) != now or kind == "message":
            if now is not None:
                yield (*now[:2], role, "".join(parts))
            now, role, parts = (conv, message, thread), "", []
        role = who or role
        if kind in ("edit", "regenerate"):
            parts = []
        parts.append(text or "")
    if now is not None:
        yield (*now[:2], role, "".join(parts))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _framed(rows: Iterable[tuple], kinds: tuple, names: list[str], text: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes by the column ``text``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text])
        if size > 1 << 22 or len(held) >= 20000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _framed(fold(_rows(batches)), (pa.int64(), pa.int64(), pa.string(), pa.string()), ["conv_id", "message", "role", "text"], 3)


def _rendered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def turns() -> Iterator[tuple]:
        now, no = None, 0
        for conv, message, role, text in _rows(batches):
            now, no = (conv,), no + 1 if now == (conv,) else 0
            yield (conv, message, no, role, *render(role, text))

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    yield from _framed(turns(), kinds, ["conv_id", "message", "no", "role", "formatted", "text_start", "text_end"], 4)


def reconstruct(log: DataFrame, conv_col: str = "conv_id", message_col: str = "message", seq_col: str = "seq", kind_col: str = "kind", role_col: str = "role", text_col: str = "text", thread_col: str | None = None) -> DataFrame:
    """``conv_id, message, no, role, formatted, text_start, text_end``: one formatted turn per final message, conversation by conversation; ``no`` counts a conversation's messages from 0.

    Messages are in order of number, those of one number (told apart by the whole number in
    ``thread_col``) in order of role and text. Of events with equal keys, ``message`` comes first, then kinds,
    roles and texts in order, so results don't depend on input order. Null roles keep the message's earlier role
    (none: empty); null text is empty; null conversation ids form one conversation, null
    sequences come first. Unknown kinds append. No events, no rows.
    """
    cols = {"conv_id": (conv_col, "long"), "message": (message_col, "long"), "seq": (seq_col, "long"), "kind": (kind_col, "string"), "role": (role_col, "string"), "text": (text_col, "string")}
    thread = (log[thread_col] if thread_col else F.lit(0)).cast("long").alias("thread")
    rows = log.select(*[log[c].cast(t).alias(n) for n, (c, t) in cols.items()], thread)
    opens = F.coalesce(F.col("kind") != "message", F.lit(True))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "message", "thread", "seq", opens, "kind", "role", "text")
    final = rows.select("conv_id", "message", "thread", "kind", "role", "text").mapInArrow(_folded, "conv_id long, message long, role string, text string")
    final = final.sortWithinPartitions("conv_id", "message", "role", "text")  # a conversation's rows lie together: no shuffle
    return final.mapInArrow(_rendered, "conv_id long, message long, no long, role string, formatted string, text_start long, text_end long")


def _digests(loss_role: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted turns back, as they stream by: one row when a conversation ends."""
    now, first, rows = None, True, []

    def ended() -> tuple:
        return (now, n, turns.hexdigest(), chars, loss.hexdigest(), total)

    for b in batches:
        for conv, formatted, start, end in zip(*[b.column(i).to_pylist() for i in range(4)]):
            if first or conv != now:
                if not first:
                    rows.append(ended())
                now, first, n, chars, total = conv, False, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in parse(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
                if role == loss_role:
                    masked = unescape(formatted[start:end])
                    chars += len(masked)
                    loss.update(masked.encode())
            total += len(formatted)
        if len(rows) >= 5000:
            yield _frame(rows)
            rows = []
    if not first:
        rows.append(ended())
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def digests(formatted: DataFrame, loss_role: str = "assistant", dealt: bool = False) -> DataFrame:
    """Per conversation, read back from ``reconstruct``'s rows: turns, their digest, and the text under the loss mask (texts of ``loss_role``).

    ``dealt`` says that ``formatted`` is what ``reconstruct`` has just returned, whose conversations lie
    together and in order; otherwise (rows that were stored, joined or filtered) they are dealt and sorted again.
    """
    rows = formatted.select("conv_id", "no", "formatted", "text_start", "text_end")
    if not dealt:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "no")
    return rows.drop("no").mapInArrow(functools.partial(_digests, loss_role), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def message_events(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A table of finished turns (``conv_id, turn, role, text``) as the log that would have led to it: ``conv_id, message, thread, seq, kind, role, text``.

    A turn of ``loss_role`` was streamed: its second half first, then it was regenerated and came in two
    deltas. Any other turn was sent with its first half and edited. Rows that share a turn stay separate
    messages: ``thread`` is a number of the row.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda seq, kind, said: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", second), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", second))
    edited = F.array(event(0, "message", first), event(1, "edit", text))
    rows = conversations.select("conv_id", F.col("turn").alias("message"), F.monotonically_increasing_id().alias("thread"), "role", F.when(F.col("role") == loss_role, streamed).otherwise(edited).alias("events"))
    return rows.select("conv_id", "message", "thread", "role", F.explode("events").alias("event")).select("conv_id", "message", "thread", "event.seq", "event.kind", "role", "event.text")
