"""Chat formatting by prefix-target expansion.

`expand(turns)` turns each conversation into training examples: every assistant
turn becomes an example whose context is all turns before it and whose only
trainable text is that reply.  A conversation that does not end with an
assistant turn gets one more example without a target, so no turn is lost.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` for each turn.  Inside roles and
texts a backslash is doubled, `<|` becomes `<\\|`, and a line break in a role becomes
`\\n`; so a control string in a text can never be read as one, and `unescape`
gives back exactly what was there.

An example is `text`, `loss_start` and `loss_end` (code points; equal where
nothing is trainable).  Conversations are dealt by id and read in turn order as
a stream: a task holds the text of one conversation, not the rows of many.

Defined cases: null role or text is empty; null conv_id is a conversation of
its own; ids and turns are whole 64-bit numbers, nulls beside them change nothing;
turns that repeat a number are ordered by role, then text; an assistant
turn with empty text is an example with an empty target; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Characters of examples that are handed on at once.
CHUNK = 4_000_000

EXAMPLES = "conv_id bigint, example bigint, target_turn bigint, n_turns bigint, text string, loss_start bigint, loss_end bigint, last boolean"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"

_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def escape(s: str, role: bool = False) -> str:
    s = s.replace("\\", "\\\\").replace("<|", "<\\|")
    return s.replace("\n", "\\n") if role else s


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    out, at = [], 0
    while at < len(text):
        at += len(OPEN)
        line, end = text.index("\n", at), text.index(CLOSE, at)
        out.append((unescape(text[at:line]), unescape(text[line + 1 : end])))
        at = end + len(CLOSE)
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch: numbers beside nulls stay whole."""
    kinds = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _examples(turns: Iterator[tuple]) -> Iterator[tuple]:
    """Examples of conversations whose turns come together and in order; `last` is known one example late."""
    held, now, prefix, n, made, open_ = None, object(), "", 0, 0, False

    def rest() -> Iterator[tuple]:
        if held is not None:
            yield (*held, not open_)
        if n and (open_ or held is None):
            yield (now, made, None, n, prefix, len(prefix), len(prefix), True)

    for conv, turn, role, text in turns:
        if conv != now:
            yield from rest()
            held, now, prefix, n, made, open_ = None, conv, "", 0, 0, False
        role = role or ""
        head = f"{prefix}{OPEN}{escape(role, True)}\n"
        body = head + escape(text or "")
        prefix, n, open_ = body + CLOSE, n + 1, role != "assistant"
        if not open_:
            if held is not None:
                yield (*held, False)
            held = (conv, made, turn, n, prefix, len(head), len(body))
            made += 1
    yield from rest()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    for row in _examples(_values(batches)):
        rows.append(row)
        chars += len(row[4])
        if chars >= CHUNK:
            yield _batch(rows, EXAMPLES)
            rows, chars = [], 0
    yield _batch(rows, EXAMPLES)


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example (0..), target_turn (null: none), n_turns, text, loss_start, loss_end, last.

    The examples of a conversation stay together, in order, in one partition.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, loss, chars, total, n = [], hashlib.sha256(), 0, 0, 0
    for conv, _, _, _, text, start, end, last in _values(batches):
        piece = unescape(text[start:end])
        loss.update(piece.encode("utf-8", "surrogatepass"))
        chars, total, n = chars + len(piece), total + len(text), n + 1
        if last:
            read, all_ = parse(text), hashlib.sha256()
            for role, said in read:
                all_.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            out.append((conv, len(read), all_.hexdigest(), chars, loss.hexdigest(), total, n))
            loss, chars, total, n = hashlib.sha256(), 0, 0, 0
            if len(out) >= 2000:
                yield _batch(out, DIGEST)
                out = []
    yield _batch(out, DIGEST)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted examples as `expand` left them.

    formatted_chars counts the code points of all examples of the conversation.
    """
    return examples.mapInArrow(_read_back, DIGEST)
