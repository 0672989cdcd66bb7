"""Chat formatting by columnar byte assembly.

A turn is `<|im_start|>` role, a line feed, text, `<|im_end|>` and a line feed. Inside roles and texts a backslash is doubled
and `<|` becomes `<\\|` (in roles a line feed becomes `\\n`), so no text can hold a control string, and it all reads back.
For each Arrow batch the lengths of all parts give their offsets, and headers and contents are scattered into one buffer that
becomes the Arrow string column. A conversation is one or more segments of whole turns, so that a very long one is never in
memory as a whole. Mask spans are byte offsets into the UTF-8 text of a segment and cover the assistant texts, no markers.

Cases: a null text or role is an empty one; a null conv_id is a conversation; turns with equal numbers (null first) follow role
and text, and repeated rows stay; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import lists, pieces, string_buffer

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
SCHEMA = "conv_id long, segment int, n_turns int, text string, mask_start array<long>, mask_end array<long>"


def _escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: bytes) -> bytes:
    if b"\\" not in text:
        return text
    parts = text.split(b"\\\\")
    return b"\\".join(p.replace(b"\\|", b"|").replace(b"\\n", b"\n") for p in parts)


def _put(out: np.ndarray, at: np.ndarray, what: bytes) -> None:
    out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def _scatter(out: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    out[np.repeat(at - offsets[:-1], np.diff(offsets)) + np.arange(len(raw))] = raw


def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all rows (columns role and text) one after another; start of each row; span of each text."""
    role, role_at = string_buffer(pc.replace_substring(_escaped(batch.column("role")), "\n", "\\n"))
    text, text_at = string_buffer(_escaped(batch.column("text")))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    start = np.append(0, np.cumsum(len(OPEN) + role_size + 1 + text_size + len(CLOSE)))
    out = np.empty(int(start[-1]), np.uint8)
    role_to = start[:-1] + len(OPEN)
    text_to = role_to + role_size + 1
    _put(out, start[:-1], OPEN)
    _scatter(out, role_to, role, role_at)
    out[text_to - 1] = 10
    _scatter(out, text_to, text, text_at)
    _put(out, text_to + text_size, CLOSE)
    return out, start, text_to, text_to + text_size


def _formatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, segment = (), 0  # the conversation that the last batch ended in, and its next segment
    for batch in pieces(batches, limit=8 << 20):
        out, start, text_from, text_to = assemble(batch)
        conv, null = batch.column("conv_id").fill_null(0).to_numpy(), batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])))
        number = np.zeros(len(head), np.int32)
        if last == (conv[0], null[0]):
            number[0] = segment
        last, segment = (conv[-1], null[-1]), int(number[-1]) + 1
        spoken = np.flatnonzero(pc.equal(batch.column("role"), "assistant").fill_null(False).to_numpy(zero_copy_only=False))
        of = np.searchsorted(head, spoken, side="right") - 1
        bounds, base = np.searchsorted(of, np.arange(len(head) + 1)), start[head][of]
        ends = np.append(head, batch.num_rows)
        columns = [
            pa.array(conv[head], pa.int64(), mask=null[head]), pa.array(number), pa.array(np.diff(ends), pa.int32()),
            pa.StringArray.from_buffers(len(head), pa.py_buffer(start[ends].astype(np.int32)), pa.py_buffer(out)),
            lists(text_from[spoken] - base, bounds, pa.int64()), lists(text_to[spoken] - base, bounds, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "n_turns", "text", "mask_start", "mask_end"])


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to segments: conv_id, segment, n_turns, text, mask_start, mask_end."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_formatter, SCHEMA)


def parse_turns(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn of a segment."""
    for turn in text.split(CLOSE)[:-1]:
        role, _, said = turn[len(OPEN) :].partition(b"\n")
        yield unescape(role), unescape(said)


def _chars(text: bytes) -> int:
    return len(text.decode("utf-8"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    held = None

    def row(x):
        return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])

    for batch in batches:
        done = []
        for conv, text, starts, ends in zip(batch.column("conv_id").to_pylist(), batch.column("text"), batch.column("mask_start").to_pylist(), batch.column("mask_end").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            if held is None or held[0] != conv:
                if held is not None:
                    done.append(row(held))
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse_turns(raw):
                held[1] += 1
                held[2].update(role + b"\n" + said + b"\n")
            for a, b in zip(starts, ends, strict=True):
                said = unescape(raw[a:b])
                held[3] += _chars(said)
                held[4].update(said)
            held[5] += _chars(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True) if done else [[]] * 6, kinds, strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(held), kinds, strict=True)], names)


def chat_digests(segments: DataFrame) -> DataFrame:
    """Read segments back and parse them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "text", "mask_start", "mask_end")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
