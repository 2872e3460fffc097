"""Chat formatting by a grammar round trip.

Grammar of a formatted conversation:

    conversation = turn*
    turn         = "<|turn|>" role level "<|text|>" body "<|end|>"
    level        = "" | "<|esc1|>" | "<|esc2|>"

Each turn is rendered with its texts as they stand, reparsed by a deterministic
parser, and compared with its source. Only if they differ it is rendered anew
with the next level of escapes: level 1 breaks the control strings that occur
(a backslash after their first character) and doubles backslashes; level 2
escapes every character that a control string begins with. Unescaping reads
escapes from left to right, so both levels are reversible for any text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from terracell.llm.base import map_rows, small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEVELS = ("", "<|esc1|>", "<|esc2|>")
#: Control strings of this and of widespread templates: none may stand in a formatted text unescaped.
CONTROL = (TURN, TEXT, END, *LEVELS[1:], "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED_ROLE = "assistant"

_CONTROL = re.compile("|".join(sorted(map(re.escape, CONTROL), key=len, reverse=True)))
_ANY = re.compile(r"[<\[\\]")
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return _CONTROL.sub(lambda m: m[0][0] + "\\/" + m[0][1:], text.replace("\\", "\\\\"))
    return _ANY.sub(lambda m: "\\" + {"<": "l", "[": "b", "\\": "\\"}[m[0]], text)


def unescape(text: str, level: int) -> str:
    if level == 0:
        return text
    return _ESCAPE.sub(lambda m: {"\\": "\\", "/": "", "l": "<", "b": "["}.get(m[1], m[0]), text)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the body as formatted. ValueError off the grammar."""
    at = 0
    while at < len(text):
        middle = text.find(TEXT, at)
        if not text.startswith(TURN, at) or middle < 0:
            raise ValueError(f"no turn at {at}")
        role, level = text[at + len(TURN) : middle], 0
        for n in (1, 2):
            if role.endswith(LEVELS[n]):
                role, level = role.removesuffix(LEVELS[n]), n
        start = middle + len(TEXT)
        end = text.find(END, start)
        if end < 0:
            raise ValueError(f"no end after {start}")
        yield unescape(role, level), unescape(text[start:end], level), start, end
        at = end + len(END)


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """(formatted turn, start, end of its body, escape level): the first level whose reparse gives the source and leaves no foreign control string."""
    for level in range(3):
        safe = escape(role, level), escape(text, level)
        formatted = f"{TURN}{safe[0]}{LEVELS[level]}{TEXT}{safe[1]}{END}"
        try:
            turns = list(parse(formatted))
        except ValueError:
            continue
        if [t[:2] for t in turns] == [(role, text)] and not any(_CONTROL.search(s) for s in safe):
            return formatted, *turns[0][2:], level
    raise AssertionError("level 2 escapes every control string")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end, escaped): each turn rendered on its own, no shuffle.

    A formatted conversation is its turns' ``formatted`` in order, joined by
    nothing. loss_start and loss_end bound the trained text in code points from
    the turn's beginning; they are null for other roles than the assistant. Null
    texts and null roles count as empty. Rows that repeat a turn are turns of their
    own. Rows without a conv_id are one conversation without an id; a null turn
    comes first. Other columns are ignored, whatever their names.
    """
    source = conversations.select("conv_id", "turn", "role", "text")
    schema = StructType([source.schema["conv_id"], source.schema["turn"], source.schema["role"]]).add("formatted", StringType()).add("loss_start", LongType()).add("loss_end", LongType()).add("escaped", IntegerType())

    def run(batches):
        for b in batches:
            out = []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                formatted, start, end, level = render(role or "", text or "")
                trained = role == TRAINED_ROLE
                out.append((formatted, start if trained else None, end if trained else None, level))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    return map_rows(source, run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from formatted turns, a row a conversation.

    Turns are sorted by conversation and turn (ties by role and formatted text)
    and stream through their task one by one: of a conversation only two running
    hashes and three counts are held, however long it is.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType
    schema = StructType().add("conv_id", kind).add("n_turns", LongType()).add("turns_sha256", StringType()).add("loss_chars", LongType()).add("loss_sha256", StringType()).add("formatted_chars", LongType())
    ordered = turns.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches):
        state: list | None = None

        def row():
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.fieldNames())

        kinds = None
        for b in batches:
            kinds = (b.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            rows = []
            for conv, formatted, start, end in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, at, to in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if start is not None and (at, to) == (start, end):
                        state[3] += len(text)
                        state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([row()])

    return ordered.mapInArrow(run, schema)
