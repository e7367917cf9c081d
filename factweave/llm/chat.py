"""Chat formatting by replaying event logs (operator 4).

A log holds events of conversations. Sorted by sequence, they are folded into final messages:
streamed pieces are appended, edits replace, regenerations cut back to before a message, retractions
drop one. The final messages are rendered with marks of turns; the marks inside texts are escaped.

Template: each turn stands between an opening and a closing mark, by role ``<<SYS>>`` ``<</SYS>>``,
``[INST]`` ``[/INST]`` or ``<s>`` ``</s>`` for system, user, assistant; any other role is
``<<TURN>>`` role ``\\n`` text ``<</TURN>>``. A mark inside a text gets one backslash after its first
character; a text that already holds such a form gets one more. No mark starts with the end of
another, so the first closing mark found always ends the turn.

Defined cases: null texts are empty, a null role is the empty role. A conversation without an event
gives no row. Events that name a message that is not there are ignored. Equal events at one place all
count. Rows with a null conversation id are one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import sliced

#: Opening and closing mark by role; the last pair is for every other role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), None: ("<<TURN>>", "<</TURN>>")}
#: What is escaped inside a text: a mark's first character, any backslashes, and its rest.
ESCAPED = r"([<\[])(\\*)(</?SYS>>|</?TURN>>|/?INST\]|/?s>)"
_ESCAPE = re.compile(ESCAPED)
_UNESCAPE = re.compile(ESCAPED.replace(r"(\\*)", r"\\(\\*)"))
_OPEN = {opening: (role, closing) for role, (opening, closing) in MARKS.items()}
_OPENING = re.compile("|".join(re.escape(x) for x in _OPEN))

#: Kinds of events. start: a message of a role opens with a text; piece: text appended; edit: a message's
#: text is replaced; redo: a message and all after it are withdrawn, and a message of its role opens;
#: drop: a message is withdrawn. ``message`` names the message (null: the latest).
KINDS = ("start", "piece", "edit", "redo", "drop")


_LINE = re.compile(r"\\(.)")


def _one_line(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@dataclass
class Replay:
    """The messages of one conversation as its events come by: (name, role, parts of the text)."""

    messages: list[tuple[object, str, list[str]]] = field(default_factory=list)

    def find(self, name: object) -> int | None:
        if name is None:
            return len(self.messages) - 1 if self.messages else None
        return next((i for i in range(len(self.messages) - 1, -1, -1) if self.messages[i][0] == name), None)

    def apply(self, kind: str, name: object, role: str | None, text: str | None) -> None:
        text = text or ""
        if kind == "start":
            self.messages.append((name, role or "", [text]))
            return
        at = self.find(name)
        if at is None:
            return
        own, its_role, parts = self.messages[at]
        if kind == "piece":
            parts.append(text)
        elif kind == "edit":
            parts[:] = [text]
        elif kind == "redo":
            self.messages[at:] = [(own, its_role, [text])]
        elif kind == "drop":
            del self.messages[at]

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for _, role, parts in self.messages]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of its loss mask: the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        known = role if role in MARKS else None
        opening, closing = MARKS[known]
        body = escape(text) if known else f"{escape(_one_line(role))}\n{escape(text)}"
        if role == "assistant":
            spans.append((at + len(opening), at + len(opening) + len(body)))
        out.append(opening + body + closing)
        at += len(out[-1])
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _OPENING.match(text, at)
        if not m:
            raise ValueError(f"no opening mark at {at}")
        role, closing = _OPEN[m[0]]
        end = text.index(closing, m.end())
        body = text[m.end() : end]
        if role is None:
            role, _, body = body.partition("\n")
            role = _LINE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        turns.append((role, unescape(body)))
        at = end + len(closing)
    return turns


def replay(events: DataFrame, order: list[str], key: str = "conv_id") -> DataFrame:
    """key, formatted, loss (array of start, end), n_turns of each conversation.

    events: key, kind, message, role, text, and the columns of order. They are dealt by conversation
    and sorted, and a task reads them as a stream: it holds the messages of one conversation, never a
    group of rows.
    """
    places = [F.col(c).alias(f"place{i}") for i, c in enumerate(order)]
    chosen = events.select(F.col(key).cast("long").alias("key"), "kind", F.col("message").cast("string").alias("message"), "role", "text", *places)
    dealt = chosen.repartition("key").sortWithinPartitions("key", *(f"place{i}" for i in range(len(order)))).select("key", "kind", "message", "role", "text")
    schema = pa.schema([("key", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.list_(pa.int64()))), ("n_turns", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, rows = None, None, 0, []

        def close() -> None:
            turns = held.turns()
            text, spans = render(turns)
            rows.append((key, text, [list(x) for x in spans], len(turns)))

        for batch in sliced(batches):
            for k, *event in zip(*(batch[i].to_pylist() for i in range(5))):
                if held is None or k != key:
                    if held is not None:
                        close()
                    key, held = k, Replay()
                held.apply(*event)
            size = sum(len(r[1]) for r in rows)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if held is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return dealt.mapInArrow(run, "key long, formatted string, loss array<array<long>>, n_turns long").withColumnRenamed("key", key)


def turn_events(turns: DataFrame, size: int = 400) -> tuple[DataFrame, list[str]]:
    """The log of conversations given by turn: a start and pieces of size characters for each row.

    Rows of one turn follow each other by role and text; equal rows both count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    n = F.ceil(F.length("text") / F.lit(size)).cast("int")

    def piece(i: Column) -> Column:
        return F.when(i == 0, F.lit("")).otherwise(F.substring(F.col("text"), (i - 1) * size + 1, F.lit(size)))

    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("i"), piece(i).alias("t")))
    made = row.withColumn("head", F.xxhash64("role", "text")).select("conv_id", "turn", "head", "row", "role", F.explode(parts).alias("p"))
    events = made.select("conv_id", "turn", "head", "row", F.col("p.i").alias("part"), F.when(F.col("p.i") == 0, "start").otherwise("piece").alias("kind"), F.col("row").alias("message"), "role", F.col("p.t").alias("text"))
    return events, ["turn", "role", "head", "row", "part"]


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: turns, loss text, lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for k, text, loss in zip(*(batch[i].to_pylist() for i in range(3))):
                turns = parse(text)
                own = "".join(unescape(text[a:b]) for a, b in loss)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((k, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(own), hashlib.sha256(own.encode()).hexdigest(), len(text)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(key, "formatted", "loss").mapInArrow(run, f"{key} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
