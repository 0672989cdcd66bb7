"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped by the reader.

Each partition of the ordered documents writes one shard of three files: `.bin` (token ids, little-endian, 16 bits if the
vocabulary allows, else 32), `.off` (n + 1 offsets into it, 64 bits) and `.ids` (doc_ids, 64 bits, with `.nul`: one byte each,
1 for a null doc_id). The manifest has one row a shard; the prefix sums of its counts are the shards' bases, so no task waits
for another. Words are encoded once and assembled by index arithmetic where the tokenizer's own rules allow it (lower-casing, and
white space that only separates, as in the default one); with any other tokenizer whole texts are encoded.

Cases: a null text is an empty one, which gives the end id alone; null doc_ids come first; rows that repeat a doc_id are each
written, in the order of a hash of their text; an empty table gives shards without documents; extra columns are not carried.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.llm.common import LOWER, pieces, stored, string_buffer, text_of, words
from quaystone.llm.files import Reader, filesystem, unique

END_ID = 1
#: Distinct words that a task remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 20
#: Ids (in bytes) and documents that a task reads back, about.
READ_BYTES, READ_DOCS = 16 << 20, 40_000
#: Rules of a tokenizer whose words can be encoded one by one (fixed values, as its file states them).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Token ids of texts, through the ids of their words.

    The tokenizer lower-cases, and no token of its crosses white space, nor the border between an ASCII letter and a full stop
    or comma before white space. So each distinct lower-case word is encoded once and remembered by a 64-bit hash, with its
    length and first eight bytes to check it by. Texts with a possible special token are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        bar = self._encode(["|"])[0]
        self.bar = bar[0] if len(bar) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 18, self.dtype), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, new: list[str]) -> list[np.ndarray]:
        """Ids of each word; words travel to the tokenizer many at a time, with a bar between them, where they hold none."""
        alone = [i for i, w in enumerate(new) if "|" in w or self.bar is None]
        out: list = [None] * len(new)
        for i, ids in zip(alone, self._encode([new[i] for i in alone]), strict=True):
            out[i] = np.array(ids, self.dtype)
        rest = [i for i, x in enumerate(out) if x is None]
        groups = [rest[i : i + 100] for i in range(0, len(rest), 100)]
        for group, ids in zip(groups, self._encode([" | ".join(new[i] for i in g) for g in groups]), strict=True):
            ids = np.array(ids, self.dtype)
            cut = np.flatnonzero(ids == self.bar)
            for i, a, b in zip(group, np.append(0, cut + 1), np.append(cut, len(ids)), strict=True):
                out[i] = ids[a:b]
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, new: list[str]) -> None:
        """keys ascending and unknown."""
        ids = self._encode_words(new)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + total] = np.concatenate(ids) if ids else 0
        place = np.searchsorted(self.keys, keys)
        at = self.used + np.cumsum(size) - size
        self.keys, self.checks, self.at, self.size = (np.insert(old, place, add) for old, add in ((self.keys, keys), (self.checks, checks), (self.at, at), (self.size, size)))
        self.used += total

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted(self.keys, h)
        slot[slot == len(self.keys)] = 0
        return slot, (self.keys[slot] == h) if len(self.keys) else np.zeros(len(h), bool)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a byte buffer, each followed by the end id, and the number of ids of each."""
        if not self.by_words:
            found = self._encode([raw[a:b].tobytes().decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.array([i for ids in found for i in (*ids, END_ID)], self.dtype), np.array([len(ids) + 1 for ids in found], np.int64)
        low = LOWER[raw]
        h, start, stop, bounds = words(low, offsets, tails=True)
        padded = np.append(low, np.zeros(8, np.uint8))
        check = (stop - start).astype(np.uint64) << np.uint64(56)
        for j in range(7):
            check |= np.where(start + j < stop, padded[start + j], 0).astype(np.uint64) << np.uint64(8 * j)
        slot, known = self._slots(h)
        if not known.all():
            keys, first = np.unique(h[~known], return_index=True)
            if len(self.keys) + len(keys) > REMEMBERED:
                self.forget()
                keys, first = np.unique(h, return_index=True)
            else:
                first = np.flatnonzero(~known)[first]
            data = low.tobytes()
            self._learn(keys, check[first], [data[a:b].decode("utf-8") for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
            slot, known = self._slots(h)
        size = self.size[slot].astype(np.int64)
        before = np.append(0, np.cumsum(size))
        total, n = int(before[-1]), len(offsets) - 1
        place = np.arange(total)
        out = np.full(n + total, END_ID, self.dtype)
        out[place + np.repeat(np.repeat(np.arange(n), np.diff(bounds)), size)] = self.flat[np.repeat(self.at[slot] - before[:-1], size) + place]
        count = np.diff(before[bounds]) + 1
        odd = set(np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)), offsets))).tolist()) if len(raw) else set()
        odd |= set((np.searchsorted(bounds, np.flatnonzero(self.checks[slot] != check), side="right") - 1).tolist()) if len(h) else set()
        if odd:
            parts = np.split(out, np.cumsum(count)[:-1])
            for i in odd:
                ids = self._encode([raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")])[0]
                parts[i] = np.array([*ids, END_ID], self.dtype)
                count[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, count


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder a Python worker: what it remembers serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _writer(out_dir: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_for(tokenizer), TaskContext.get().partitionId()
        system, folder = filesystem(out_dir)
        system.create_dir(folder, recursive=True)
        name = unique("tokens", task)
        sizes, ids, nulls = [np.zeros(1, np.int64)], [], []
        with system.open_output_stream(f"{folder}/{name}.bin") as out:
            for batch in pieces(batches, limit=2 << 20):
                tokens, count = encoder.encode(*string_buffer(batch.column(1)))
                out.write(tokens.astype(tokens.dtype.newbyteorder("<")).tobytes())
                sizes.append(count)
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
        offsets = np.cumsum(np.concatenate(sizes))
        for end, values in (("off", offsets.astype("<i8")), ("ids", np.concatenate([np.zeros(0, np.int64), *ids]).astype("<i8")), ("nul", np.concatenate([np.zeros(0, bool), *nulls]).astype(np.uint8))):
            with system.open_output_stream(f"{folder}/{name}.{end}") as out:
                out.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task], pa.int32()), "name": [name], "width": pa.array([encoder.dtype().itemsize], pa.int32()), "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    return run


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, order: list | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text) below out_dir, in the order of `order` (columns of docs; doc_id by default).

    Returns the manifest: shard, name, width, n_docs, n_tokens, first_doc and first_token (documents and ids before the shard).
    """
    order = order or [F.col("doc_id").cast("long")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = [*(f"o{i}" for i in range(len(order))), "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards = stored(rows.mapInArrow(_writer(out_dir, tokenizer), "shard int, name string, width int, n_docs long, n_tokens long"), out_dir, "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return stored(
        shards.withColumns({"first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)), "first_token": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))}), out_dir, "manifest"
    )


def _reader(out_dir: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, nulls, tokens = (Reader(f"{out_dir}/{row['name']}.{end}") for end in ("ids", "off", "nul", "bin"))
                first, n, width = row["doc"], row["docs"], row["width"]
                at = offsets.read(8 * first, 8 * (n + 1)).view("<i8").astype(np.int64)
                doc = pa.array(ids.read(8 * first, 8 * n).view("<i8").astype(np.int64), mask=nulls.read(first, n).astype(bool))
                for lo in range(0, n, 2000):
                    hi = min(n, lo + 2000)
                    own = [tokens.read(width * int(a), width * int(b - a)).view(f"<u{width}").astype("<u4") for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)]
                    last = pa.array([zlib.crc32(x.data) for x in own], pa.int64()) if digest else pa.array(own, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc[lo:hi], pa.array(row["first_token"] + at[lo:hi]), pa.array(np.diff(at[lo : hi + 1])), last], ["doc_id", "start", "n_tokens", "last"])
                for x in (ids, offsets, nulls, tokens):
                    x.close()

    return run


def read_tokens(manifest: DataFrame, out_dir: str, digest: bool = False, docs_per_read: int = 4000) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and ids (array), or ids_crc32 with digest. Large shards are read in several
    tasks; their number follows from the files' sizes, as rows of the manifest are small however much they stand for."""
    size, docs = manifest.agg(F.sum(F.col("n_tokens") * F.col("width")), F.sum("n_docs")).first()
    tasks = 1 + (size or 0) // READ_BYTES + (docs or 0) // READ_DOCS
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_per_read).cast("long"))).alias("doc")
    reads = manifest.filter("n_docs > 0").select("name", "width", "n_docs", "first_token", step)
    reads = reads.select("name", "width", "first_token", "doc", F.least(F.lit(docs_per_read), F.col("n_docs") - F.col("doc")).alias("docs")).repartition(int(tasks), "name", "doc")
    out = reads.mapInArrow(_reader(out_dir, digest), f"doc_id long, start long, n_tokens long, last {'long' if digest else 'array<long>'}")
    return out.withColumnRenamed("last", "ids_crc32" if digest else "ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer: str | None = None, order: list | None = None) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, out_dir, tokenizer or default_tokenizer(), order), out_dir, digest=True)
