"""Chat formatting by columnar byte assembly.

A turn becomes ``header + escaped text + footer``. The headers mark the role, and every control string inside a text (or a
role) is escaped by a backslash after its first character; one that already has backslashes there gets one more, so that
dropping one restores the text. Turns are formatted independently of each other: a conversation is its turns' strings in
order, and no conversation has to fit a task.

A batch is assembled as bytes: the lengths of all segments, their running sum and the places they go to are computed with
numpy, and headers, contents and footers are copied into one buffer that becomes the Arrow column.

Defined cases: null texts and roles count as empty; null turns come first; turns of equal number go by their formatted
strings; rows of a null conversation form one conversation; repeated rows are repeated turns. Keys and turns must be whole numbers. A text of
any length is formatted in one row; other columns are not read, so they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shingles import slices, text_buffer
from plumbline.llm.words import ragged_take

#: The control strings of the template, and how each role's turns begin and end.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]")
USER, ASSISTANT = ("[INST] ", " [/INST]"), ("[OUT] ", "</s>")
OTHER = ("[ROLE] ", " [/ROLE] ", "</s>")
#: A control string: its first character, backslashes, and the rest. No rest holds a first character.
ESCAPABLE = r"([<\[])(\\*)(/?s>|/?INST\]|OUT\]|/?ROLE\])"
_ESCAPED = re.compile(r"([<\[])\\(\\*(?:/?s>|/?INST\]|OUT\]|/?ROLE\]))")
_TURN = re.compile(r"\[INST\] (?P<user>.*) \[/INST\]|\[OUT\] (?P<assistant>.*)</s>|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*)</s>", re.DOTALL)
#: Text bytes assembled at once.
SLICE_BYTES = 4 << 20


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, ESCAPABLE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    if m["user"] is not None:
        return "user", unescape(m["user"])
    if m["assistant"] is not None:
        return "assistant", unescape(m["assistant"])
    return unescape(m["role"]), unescape(m["other"])


def _table(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = [s.encode() for s in strings]
    lengths = np.array(list(map(len, own)), np.int64)
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum(lengths) - lengths, lengths


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and the loss spans (start and end in characters; equal where there is none)."""
    coded = pc.fill_null(roles, "").dictionary_encode()
    names = coded.dictionary.to_pylist()
    escaped_names = escape(coded.dictionary).to_pylist()
    heads = [USER[0] if r == "user" else ASSISTANT[0] if r == "assistant" else OTHER[0] + e + OTHER[1] for r, e in zip(names, escaped_names, strict=True)]
    feet = [USER[1] if r == "user" else ASSISTANT[1] if r == "assistant" else OTHER[2] for r in names]
    role = coded.indices.to_numpy().astype(np.int64)
    escaped = escape(pc.fill_null(texts, ""))
    content, bounds = text_buffer(escaped)
    sources = [_table(heads), (content, bounds[:-1], np.diff(bounds)), _table(feet)]
    picks = [role, slice(None), role]
    lengths = np.stack([s[2][p] for s, p in zip(sources, picks, strict=True)], 1)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(-1, 3)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i, ((data, starts, _), pick) in enumerate(zip(sources, picks, strict=True)):
        moved, at = ragged_take(data, starts[pick], lengths[:, i])
        place = np.repeat(begins[:, i] - at[:-1], lengths[:, i]) + np.arange(len(moved))
        out[place] = moved
    offsets = np.concatenate([[0], ends[2::3]]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(role), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    start = np.array(list(map(len, heads)), np.int64)[role]
    assistant = np.array([n == "assistant" for n in names], bool)[role]
    return formatted, start, start + np.where(assistant, pc.utf8_length(escaped).to_numpy(), 0)


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, formatted string, loss_start long, loss_end long`` of every row of ``conv_id, turn, role, text``.

    The characters from ``loss_start`` to ``loss_end`` of a turn are under the loss mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(text_buffer(batch.column(3))[1], SLICE_BYTES):
                part = batch.slice(i, j - i)
                formatted, start, end = assemble(part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), formatted.cast(pa.string()), pa.array(start), pa.array(end)],
                    names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
                )

    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return own.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Read conversations back from their formatted turns: counts and digests, a row per conversation.

    A conversation's turns stream through one task in order (its digests are of all of them), which holds one batch.
    """
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, own, done = nothing, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        def close() -> None:
            done.append((current, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if conv != current or current is nothing:
                    if current is not nothing:
                        close()
                    current, own = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, plain = parse_turn(text)
                own[0] += 1
                own[1].update(f"{role}\n{plain}\n".encode())
                if b > a:
                    loss = unescape(text[a:b])
                    own[2] += len(loss)
                    own[3].update(loss.encode())
                own[4] += len(text)
            if len(done) > 1000:
                yield rows()
                done = []
        if current is not nothing:
            close()
        if done:
            yield rows()

    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
