"""JSON documents of any size, read by many tasks.

Spark's text reader splits files at closing braces, whatever lines there are. A task joins the pieces of its byte range to chunks
of about CHUNK bytes and says, for a chunk that begins inside a string and for one that doesn't, how it changes the stack of open
brackets. A scan over these few facts of each file gives the state in which every chunk begins; then each chunk is cut into
records by itself, and records that lie in several chunks are put together from their parts. No task holds more than a chunk or a
record.

Records are the objects in the array `records` of an object, in a bare array, or bare objects, one document after another. A file
that isn't whole in itself (a bracket or string left open, a bracket too many) is left out, unless it is JSON lines (its first line
is a document of its own); then its good lines count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
_TOKEN = re.compile(r'"records"\s*:\s*\[|"(?:[^"\\]|\\.)*"|["{}\[\]]', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_CHUNK = "file string, size long, block long, seq int, text string, bytes long"
_STATE = "file string, block long, seq int, inside boolean, stack string, document string, record string, closed boolean, good boolean"


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size, seq = None, [], 0, 0

        def row() -> pa.RecordBatch:
            text = "}".join(parts)
            values = [key[0], key[1], key[2], seq, text, size]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["file", "size", "block", "seq", "text", "bytes"])

        for batch in batches:
            for file, total, block, text in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "block", "value")), strict=True):
                if key != (file, total, block) or size >= limit:
                    if key is not None:
                        yield row()
                    seq = seq + 1 if key == (file, total, block) else 0
                    key, parts, size = (file, total, block), [], 0
                parts.append(text)
                size += len(text.encode()) + 1
        if key is not None:
            yield row()

    return run


def _change(text: str, inside: bool) -> tuple[bool, int, str]:
    """What a text does to the state: whether it ends inside a string, how many open brackets it closes, and those it leaves open
    (R: the bracket of an array `records`)."""
    at, pops, opened = 0, 0, []
    if inside:
        found = _REST_OF_STRING.match(text)
        if not found:
            return True, 0, ""
        at = found.end()
    for token in _TOKEN.finditer(text, at):
        mark = token[0]
        if mark == '"':  # a string that doesn't end here
            return True, pops, "".join(opened)
        if mark in "{[":
            opened.append(mark)
        elif mark in "}]":
            if opened:
                opened.pop()
            else:
                pops += 1
        elif mark[-1] == "[":
            opened.append("R")
    return False, pops, "".join(opened)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f"{c}{i}": [] for i in (0, 1) for c in ("ends", "pops", "opened")}
        for text in batch.column("text").to_pylist():
            for i in (0, 1):
                for c, v in zip(("ends", "pops", "opened"), _change(text, bool(i)), strict=True):
                    out[f"{c}{i}"].append(v)
        kinds = {"ends": pa.bool_(), "pops": pa.int64(), "opened": pa.string()}
        names = ["file", "size", "block", "seq", "bytes"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(v, kinds[c[:-1]]) for c, v in out.items()], [*names, *out])


def _level(stack: str) -> int:
    """How many brackets are open where a record begins, the record's own included; 0 outside records."""
    return 3 if stack.startswith("{R{") else 2 if stack.startswith("[{") else 0


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each chunk of one file begins. One row a chunk."""
    inside, stack, document, record, good, out = False, "", None, None, True, []
    rows = list(pdf.sort_values(["block", "seq"]).itertuples())
    total = sum(r.bytes for r in rows)
    for i, r in enumerate(rows):
        name = f"{r.block}-{r.seq}"
        begins = (inside, stack, document, record)
        ends, pops, opened = (r.ends1, r.pops1, r.opened1) if inside else (r.ends0, r.pops0, r.opened0)
        inside = bool(ends)
        good &= pops <= len(stack)
        keeps = len(stack) - pops
        stack = stack[: max(0, keeps)] + opened
        # The brace that the reader took away. After a file's last chunk there may be none.
        closed = i + 1 < len(rows) or (stack == "{" and total != r.size + 1)
        if closed and not inside:
            good &= bool(stack)
            stack, keeps = stack[:-1], min(keeps, len(stack) - 1)
        document = None if not stack else name if keeps <= 0 else document
        record = None if not _level(stack) else name if keeps < _level(stack) else record
        out.append((r.file, r.block, r.seq, *begins, closed))
    good = bool(good and not inside and not stack)
    return pd.DataFrame([(*x, good) for x in out], columns=[c.split(" ")[0] for c in _STATE.split(", ")])


def cut(text: str, inside: bool, stack: str) -> Iterator[tuple[str, str]]:
    """The parts of a chunk that count: kind and text. whole: a record; tail, middle, head: the begin, the midst and the end of a record
    that goes over chunks; d-tail, d-middle, d-head: the same of a document that isn't known to hold records; skip and d-skip: such a
    document, begun before or in this chunk, holds some."""
    depth, at = list(stack), 0
    # Where the open record and document begin in this chunk, and whether they begin here.
    record, record_here = (0 if _level(stack) else None), False
    document, document_here = (0 if stack[:1] == "{" and stack[1:2] != "R" else None), False
    holds = None
    if inside:
        found = _REST_OF_STRING.match(text)
        at = found.end() if found else len(text)
    for token in _TOKEN.finditer(text, at):
        mark = token[0]
        if mark == '"':
            break
        if mark[-1] in "{[":
            depth.append(mark if mark in "{[" else "R")
            path = "".join(depth[:3])
            if path == "{R" and document is not None:
                holds, document = ("d-skip" if document_here else "skip"), None
            elif path == "{":
                document, document_here = token.start(), True
            if _level(path) == len(depth):
                record, record_here = token.start(), True
        elif mark in "}]" and depth:
            if record is not None and len(depth) == _level("".join(depth[:3])):
                yield ("whole" if record_here else "head"), text[record : token.end()]
                record = None
            depth.pop()
            if not depth:
                if document is not None:
                    yield ("whole" if document_here else "d-head"), text[document : token.end()]
                elif holds == "skip":
                    yield "skip", ""
                document = holds = None
    if holds:
        yield holds, ""
    if record is not None:
        yield ("tail" if record_here else "middle"), text[record:]
    if document is not None:
        yield ("d-tail" if document_here else "d-middle"), text[document:]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "seq", "text", "inside", "stack", "document", "record", "closed"]
    for batch in batches:
        out = []
        for file, block, seq, text, inside, stack, document, record, closed in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            name = f"{block}-{seq}"
            for kind, part in cut(text + "}" * closed, inside, stack):
                of_record, began = kind in ("tail", "middle", "head"), kind in ("tail", "d-tail", "d-skip")
                owner = None if kind == "whole" else name if began else record if of_record else document
                out.append((file, block, seq, "record" if of_record else "document", owner, kind.endswith("skip"), part))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "seq", "kind", "owner", "skip", "text"])


def _is_document(lines: pd.Series) -> pd.Series:
    def one(line: str) -> bool:
        try:
            return isinstance(json.loads(line), dict | list)
        except ValueError:
            return False

    return lines.map(one)


def read_records(spark: SparkSession, path: str, record: str, chunk: int = CHUNK) -> DataFrame:
    """The records of all JSON files at path. record: their schema; fields that don't fit it are null, and what isn't an object goes."""
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = raw.mapInArrow(_chunks(chunk), _CHUNK)
    facts = "file string, size long, block long, seq int, bytes long, ends0 boolean, pops0 long, opened0 string, ends1 boolean, pops1 long, opened1 string"
    states = chunks.mapInArrow(_changes, facts).groupBy("file").applyInPandas(_scan, _STATE)
    known = chunks.join(states.filter("good"), ["file", "block", "seq"])
    parts = known.select("file", "block", "seq", "text", "inside", "stack", "document", "record", "closed").mapInArrow(_pieces, "file string, block long, seq int, kind string, owner string, skip boolean, text string")
    alone = parts.filter("owner IS NULL").select("text")
    ordered = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    spread = parts.filter("owner IS NOT NULL").groupBy("file", "kind", "owner").agg(ordered.alias("p"), F.bool_or("skip").alias("skip")).filter("NOT skip")
    texts = alone.union(spread.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    # Files that aren't whole: JSON lines, if the first line is a document.
    bad = states.filter("NOT good").select("file").distinct()
    first, documents = F.pandas_udf(_is_document, "boolean"), F.pandas_udf(_documents, "array<string>")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value").filter(F.trim("value") != "")
    lines = lines.join(bad, "file", "left_semi")
    by_line = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "n")).alias("value")).filter(first("value")).select("file")
    texts = texts.union(lines.join(by_line, "file", "left_semi").select(F.explode(documents("value")).alias("text")))
    return texts.select(F.from_json("text", f"struct<{record}>").alias("r")).select("r.*").dropna(how="all")


def _documents(lines: pd.Series) -> pd.Series:
    """The records of a line that is a document."""

    def one(line: str) -> list[str]:
        try:
            found = json.loads(line)
        except ValueError:
            return []
        found = found.get("records", [found]) if isinstance(found, dict) else found
        return [json.dumps(x) for x in found if isinstance(x, dict)] if isinstance(found, list) else []

    return lines.map(one)
