"""Chat formatting with a grammar round trip.

A conversation is the concatenation of its turns, each ``<s>[INST] role\\n text \\n</s>`` with the markers below.  A turn's
rendering is parsed back by a deterministic parser; while the result is not the source, the control strings at fault are
escaped and it is parsed again.  A control string inside a role or text gets one more backslash in front than it has, and
only one without any is read as a marker, so unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import arrow_map

#: The control strings.  Only OPEN, MIDDLE and CLOSE are used by the template; the others are escaped as well, for
#: tokenizers that know them.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")
_ESCAPED = re.compile(r"\\(\\*)(" + "|".join(map(re.escape, CONTROL)) + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class ParseError(ValueError):
    """The text is not in the grammar."""


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    start: int
    """Where the text begins in the formatted text, in code points."""
    end: int


def _marker(text: str, at: int) -> re.Match | None:
    """The next control string from ``at`` that no backslash escapes."""
    return next((m for m in _CONTROL.finditer(text, at) if not m[1]), None)


def parse(text: str) -> Iterator[Turn]:
    """Turns of a formatted text.  Every unescaped control string must stand where the grammar has one."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ParseError(f"no turn begins at {at}")
        role = at + len(OPEN)
        middle = _marker(text, role)
        if middle is None or not text.startswith(MIDDLE, middle.start() - 1):
            raise ParseError(f"no role ends after {role}")
        body = middle.start() - 1 + len(MIDDLE)
        close = _marker(text, body)
        if close is None or close.start() - 1 < body or not text.startswith(CLOSE, close.start() - 1):
            raise ParseError(f"no text ends after {body}")
        end = close.start() - 1
        yield Turn(unescape(text[role : middle.start() - 1]), unescape(text[body:end]), body, end)
        at = end + len(CLOSE)


def render(role: str, text: str) -> str:
    """A turn that parses back to itself, escaped only if it must be."""
    for change in ((lambda x: x), escape):
        out = OPEN + change(role) + MIDDLE + change(text) + CLOSE
        try:
            back = list(parse(out))
        except ParseError:
            continue
        if len(back) == 1 and (back[0].role, back[0].text) == (role, text):
            return out
    raise ParseError("a turn cannot be rendered")  # the grammar is complete: no text leads here


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered: one row per input row, null role and text as empty."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def make(batches):
        for b in batches:
            role, text = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield {"conv_id": b.column(0), "turn": b.column(1), "rendered": [render(r, t) for r, t in zip(role, text, strict=True)]}

    return arrow_map(rows, make, "conv_id long, turn long, rendered string")


def format_turns(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, position, rendered, offset, loss_start, loss_end: a conversation's formatted text is its rows' ``rendered`` in order.

    Rows come sorted within partitions by conversation, turn and rendered text, a conversation whole in one partition; they are
    read as a stream, so a conversation of any length needs the memory of a batch.  Offsets and the loss mask (the texts of
    ``learn`` roles, else null) are code points in the conversation's formatted text.  Null role and text are empty, a null
    turn comes first, rows with a null conv_id are one conversation, repeated rows are turns of their own.  Extra columns are
    not read; an empty table gives an empty result.
    """
    dealt = turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")

    def place(batches):
        conv, position, offset = object(), 0, 0
        for b in batches:
            out = {k: [] for k in ("conv_id", "position", "rendered", "offset", "loss_start", "loss_end")}
            for c, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != conv:
                    conv, position, offset = c, 0, 0
                (turn,) = parse(text)
                masked = turn.role in learn
                for k, v in (("conv_id", c), ("position", position), ("rendered", text), ("offset", offset), ("loss_start", offset + turn.start if masked else None), ("loss_end", offset + turn.end if masked else None)):
                    out[k].append(v)
                position, offset = position + 1, offset + len(text)
            yield out

    return arrow_map(dealt, place, "conv_id long, position long, rendered string, offset long, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_turns``: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The mask is applied to the formatted text: a row's text between loss_start and loss_end, less the row's offset.
    """

    def read(batches):
        conv, state = None, None
        fields = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

        def close():
            return conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

        for b in batches:
            done = []
            columns = [b.column(i).to_pylist() for i in range(6)]
            for c, _, text, offset, start, end in zip(*columns, strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(close())
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for turn in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{turn.role}\n{turn.text}\n".encode())
                if start is not None:
                    learnt = unescape(text[start - offset : end - offset])
                    state["loss"].update(learnt.encode())
                    state["loss_chars"] += len(learnt)
                state["chars"] += len(text)
            if done:
                yield dict(zip(fields, map(list, zip(*done, strict=True)), strict=True))
        if state is not None:
            yield dict(zip(fields, ([v] for v in close()), strict=True))

    return arrow_map(formatted, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """The conversations and number -1, whose two turns consist of control strings."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
