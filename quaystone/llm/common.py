"""Helpers shared by the training-data operators: the shared folder, tables in it, and word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII characters that are neither letters nor digits; bytes of other scripts are parts of words.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time: the 64-bit arrays of one piece stay near the cache.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, base: str, name: str) -> DataFrame:
    """Cut the lineage: write df once below the shared folder and read it back. A written table survives the loss of executors."""
    path = f"{base}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.up) < n:
        n = max(n, PIECE + 4096)
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers.up, _powers.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers.up, _powers.down


_powers.up = _powers.down = np.zeros(0, np.uint64)


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and the n + 1 offsets into them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE, tails: bool = False):
    """Words `[^\\x20\\x09-\\x0D]+` (or other runs without `space`) of all texts in one byte buffer.

    Returns (hash, start, end, bounds): a 64-bit hash, the byte span of each word, and for each text the range
    bounds[i]:bounds[i + 1] of its words. With tails, a full stop or comma that ends a word after an ASCII letter is a word of
    its own. Works in pieces cut between words, so long texts need no long temporaries.
    """
    n, out = len(raw), ([], [], [])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            gaps = np.flatnonzero(space[raw[at:end]] | edge[at:end])
            gaps = gaps[gaps > 0]
            if len(gaps):
                end = at + int(gaps[-1])
            else:
                rest = np.flatnonzero(space[raw[end:]] | edge[end:n])
                end = end + int(rest[0]) if len(rest) else n
        piece = raw[at:end]
        gap, cut = space[piece], edge[at : end + 1]
        before = np.empty(len(piece), bool)
        before[0] = True
        before[1:] = gap[:-1]
        after = np.empty(len(piece), bool)
        after[-1] = True
        after[:-1] = gap[1:]
        begins, ends = ~gap & (before | cut[:-1]), ~gap & (after | cut[1:])
        if tails:
            tail = ((piece == 44) | (piece == 46)) & ends & ~begins
            tail[1:] &= _LETTER[piece[:-1]]
            begins |= tail
            ends[:-1] |= tail[1:]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((LOWER[piece] if lower else piece).astype(np.uint64) * up[1 : len(piece) + 1] + up[: len(piece)], out=total[1:])
        out[0].append(mix((total[stop] - total[start]) * down[start]))
        out[1].append(start + at)
        out[2].append(stop + at)
        at = end
    start = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)
    stop = np.concatenate(out[2]) if out[2] else np.zeros(0, np.int64)
    h = np.concatenate(out[0]) if out[0] else np.zeros(0, np.uint64)
    return h, start, stop, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Hash of each run of `size` consecutive words, from the words' hashes."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)) | np.uint64(1)
    n = len(h) - size + 1
    total = h[:n] * factor[0]
    for j in range(1, size):
        total += h[j : j + n] * factor[j]
    return mix(total)


def release() -> None:
    """Give freed memory back to the system, as Python workers live on between tasks and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about `limit` bytes of text, or one longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(batch.num_rows, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end
        release()


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and n + 1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def blobs(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary array over one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.asarray(bounds, np.int32)), pa.py_buffer(data)])
