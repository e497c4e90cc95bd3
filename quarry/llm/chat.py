r"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\ntext<|im_end|>\n``.  Whatever could be read as a
control string inside a role or text is escaped reversibly: ``<``, any number of
backslashes and ``|`` gain one backslash after the ``<``; in roles ``\`` and newline
are written ``\\`` and ``\n`` as well.  So ``<|`` stands only where the template put
it.

``format_turns`` works on Arrow batches of turns: segment lengths give cumulative
offsets, and headers and contents are scattered into one preallocated buffer, which
becomes the output column without another copy.  It shuffles nothing.  ``read_back``
parses formatted turns again, and ``digests`` streams each conversation's turns in
order through running hashes, so a conversation of any length needs the memory of
one batch.

Defined cases: null roles and texts count as empty; a null conversation is a
conversation of its own; turns go by ``turn`` with null first, ties by role, then
text; repeated rows are turns each; an empty table gives no rows; other columns are
ignored.
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

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes that are scattered at a time; each needs an index of 8 bytes.
SLICE = 1 << 20
MASKED_ROLE = "assistant"

FORMATTED = "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(texts: pa.Array) -> pa.Array:
    """The column with a backslash more in each ``<``, backslashes, ``|``."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def escape_roles(roles: pa.Array) -> pa.Array:
    slashed = pc.replace_substring(roles, "\\", "\\\\")
    return escape(pc.replace_substring(slashed, "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and the n + 1 offsets of its values in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def assemble(segments: list) -> tuple[pa.Array, list[np.ndarray]]:
    """Concatenate row by row: each segment is constant bytes or a string column.

    Returns the joined column, and each segment's start within its row.
    """
    n = next(len(s) for s in segments if not isinstance(s, bytes))
    lengths = [np.full(n, len(s), np.int64) if isinstance(s, bytes) else np.diff(raw_bytes(s)[1]) for s in segments]
    within = np.cumsum([np.zeros(n, np.int64), *lengths], axis=0)
    ends = np.cumsum(within[-1])
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    out = np.empty(int(offsets[-1]), np.uint8)
    for segment, before in zip(segments, within, strict=False):
        starts = offsets[:-1] + before
        if isinstance(segment, bytes):
            out[starts[:, None] + np.arange(len(segment))] = np.frombuffer(segment, np.uint8)
        else:
            data, source = raw_bytes(segment)
            shift = starts - source[:-1]
            for a in range(int(source[0]), int(source[-1]), SLICE):
                b = min(a + SLICE, int(source[-1]))
                # Rows that have bytes in the slice, and how many.
                i, j = np.searchsorted(source, a, "right") - 1, np.searchsorted(source, b, "left")
                index = np.repeat(shift[i:j], np.diff(np.clip(source[i : j + 1], a, b)))
                index += np.arange(a, b)
                out[index] = data[a:b]
    joined = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))
    return joined, list(within)


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        role, text = (pc.fill_null(batch.column(batch.schema.get_field_index(c)), "") for c in ("role", "text"))
        body = escape(text)
        formatted, within = assemble([START, escape_roles(role), b"\n", body, END])
        masked = pc.equal(role, MASKED_ROLE)
        start, end = (pc.if_else(masked, pa.array(within[i]), pa.scalar(None, pa.int64())) for i in (3, 4))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), role, text, formatted.cast(pa.string()), start, end],
            ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its formatted form and, for assistant turns, the loss mask's byte span in it."""
    own = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return own.mapInArrow(format_batches, FORMATTED)


def read_back(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, text = formatted[len(START) : -len(END)].split("\n", 1)
    return unescape_role(head), unescape(text)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of turns of one conversation; runs may span batches."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    key, state, done = None, None, []

    def flush():
        if state is not None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def table():
        columns = zip(*done, strict=True)
        types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if state is None or conv != key:
                flush()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_back(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(formatted)
            if start is not None:
                masked = unescape(formatted.encode()[start:end].decode())
                state[2] += len(masked)
                state[3].update(masked.encode())
        if len(done) >= 10_000:
            yield table()
            done.clear()
    flush()
    if done:
        yield table()


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from the formatted turns."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = formatted.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(digest_batches, DIGESTS)
