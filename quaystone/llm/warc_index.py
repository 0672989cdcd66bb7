"""WARC archives with a two-level capture index.

Archives: each page is one gzip member (response, or revisit where a page with the same payload and a larger page_id is the
response), so a capture reads back from its byte range alone. Index, level one: lines sorted by reversed-host URL key, page_id
and place, cut into compressed blocks. Level two: a sparse directory with the first key and the byte range of each block. The
index is range-partitioned; the table of its partitions, with their first keys, is the only thing that every task sees, and it
has one row for each index file. A lookup finds its files and blocks by binary search, reads and searches those blocks, then
reads the captures by range, adjacent ones at once. A key of many captures spreads over many blocks, read by different tasks.

Cases: null html is an empty payload; a null url has the empty key and no target URI; a null page_id is always a response that
nothing refers to; rows that repeat a page_id are each written, and all of a largest page_id are responses; an empty table
gives an empty archive; extra columns are not carried.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import pieces, stored
from quaystone.llm.files import Reader, filesystem, unique

LINES_PER_BLOCK = 512
#: Captures nearer than this to one another are read at once, up to so many bytes.
GAP, READ_AT_ONCE = 16 << 10, 4 << 20
FILE_BYTES = 256 << 20
#: Bytes of archives and captures that a task of a lookup reads, about.
READ_PER_TASK, CAPTURES_PER_TASK = 16 << 20, 20_000
#: A stated time keeps archives the same from run to run.
DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(rb"[\x00-\x20%\x7f]")


def quoted(url: str) -> str:
    """url without white space, control characters and bare percent signs, so that it fits a header or an index line; reversible."""
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def unquoted(url: str) -> str:
    return unquote_to_bytes(url).decode()


def url_key(url: str | None) -> str:
    """Reversed-host key: host labels from the top down, then `)` and path; no scheme, `www.`, default port, user or fragment, in lower-case host."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip()).partition("#")[0]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.").rstrip(".")
    port = "" if port in ("", "80", "443") else f":{port}"
    return quoted(f"{','.join(reversed(host.split('.')))}{port}){path or '/'}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record; payload is left out where the record refers to another."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quoted(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _archive_writer(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(out_dir)
        system.create_dir(folder, recursive=True)
        task, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in pieces(batches, text="html"):
                lines = []
                for page, url, html, size, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "refers_to")), strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = unique("pages", task) + ".warc.gz", 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    payload = html.encode()
                    member = record(page, url, payload, base32_sha1(payload), size, refers)
                    out.write(member)
                    lines.append((url_key(url), page, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*lines, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["key", "page_id", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def _index_writer(out_dir: str, lines_per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(out_dir)
        system.create_dir(folder, recursive=True)
        name, at, lines, directory = unique("index", TaskContext.get().partitionId()), 0, [], []
        with system.open_output_stream(f"{folder}/{name}.cdx.gz", compression=None) as out:

            def flush() -> int:
                block = zlib.compress("\n".join(" ".join(map(str, x)) for x in lines).encode(), 6)
                out.write(block)
                directory.append(f"{lines[0][0]} {at} {len(block)}")
                lines.clear()
                return at + len(block)

            first = last = None
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "length")), strict=True):
                    first, last = row[0] if first is None else first, row[0]
                    lines.append(row)
                    if len(lines) == lines_per_block:
                        at = flush()
            if lines:
                at = flush()
        with system.open_output_stream(f"{folder}/{name}.dir", compression=None) as out:
            out.write("\n".join(directory).encode())
        if directory:
            yield pa.RecordBatch.from_pydict({"index": [name], "first_key": [first], "last_key": [last], "blocks": pa.array([len(directory)], pa.int32())})

    return run


def write_archive(pages: DataFrame, out_dir: str, min_revisit_bytes: int = 0, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Archive pages (page_id, url, html) and index them below out_dir. Returns the table of index files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    # Of payloads that several pages have, the largest page_id. Those are fewer than the pages, and have no payloads here.
    groups = rows.filter(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes)).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups.select("digest", "response"), out_dir, "groups")
    typed = rows.join(groups, "digest", "left").withColumn("refers_to", F.expr(f"IF(size >= {min_revisit_bytes} AND page_id < response, response, NULL)"))
    typed = typed.select("page_id", "url", "html", "size", "refers_to")
    lines = stored(typed.mapInArrow(_archive_writer(out_dir), "key string, page_id long, file string, at long, length long"), out_dir, "lines")
    ordered = lines.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    return stored(ordered.mapInArrow(_index_writer(out_dir, lines_per_block), "index string, first_key string, last_key string, blocks int"), out_dir, "index-files")


def block_range(keys: list[str], key: str) -> tuple[int, int]:
    """Blocks that may hold key, by binary search in their first keys: a key can begin in the block before its own first."""
    return max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key)


def _find_blocks(out_dir: str, files: list[tuple[str, str, str]]):
    firsts = [x[1] for x in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], list[tuple[int, int]]]] = {}
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                for name, _, last in files[slice(*block_range(firsts, key))]:
                    if last < key:
                        continue
                    if name not in held:
                        if len(held) > 8:
                            held.clear()
                        reader = Reader(f"{out_dir}/{name}.dir")
                        rows = [x.rsplit(" ", 2) for x in bytes(reader.read(0, 1 << 40) if reader.map is not None else reader.file.read()).decode().split("\n")]
                        reader.close()
                        held[name] = [x[0] for x in rows], [(int(x[1]), int(x[2])) for x in rows]
                    keys, places = held[name]
                    found += [(key, name, *places[i]) for i in range(*block_range(keys, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "index", "at", "length"])

    return run


def _find_captures(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, place, lines, keys = None, None, None, [], []
        for batch in batches:
            found = []
            for key, index, at, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if index != name:
                    if reader is not None:
                        reader.close()
                    reader, name, place = Reader(f"{out_dir}/{index}.cdx.gz"), index, None
                if place != at:
                    place, lines = at, [x.rsplit(" ", 4) for x in zlib.decompress(bytes(reader.read(at, length))).decode().split("\n")]
                    keys = [x[0] for x in lines]
                found += [(key, x[2], int(x[3]), int(x[4])) for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "at", "length"])
        if reader is not None:
            reader.close()

    return run


def _read_captures(out_dir: str, payloads: bool):
    names = ["key", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            i = 0
            while i < len(rows):
                j, (_, file, start, length) = i + 1, rows[i]
                end = start + length
                while j < len(rows) and rows[j][1] == file and start <= rows[j][2] <= end + GAP and rows[j][2] + rows[j][3] - start <= READ_AT_ONCE:
                    end = max(end, rows[j][2] + rows[j][3])
                    j += 1
                if file != name:
                    if reader is not None:
                        reader.close()
                    reader, name = Reader(f"{out_dir}/{file}"), file
                data, found = bytes(reader.read(start, end - start)), []
                for key, _, at, size in rows[i:j]:
                    headers, payload = parse_record(data[at - start : at - start + size])
                    digest, url = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers.get("WARC-Target-URI")
                    if headers["WARC-Type"] == "response" and (base32_sha1(payload) != digest or len(payload) != int(headers["X-Payload-Length"])):
                        raise ValueError(f"the payload of {file} at {at} doesn't match its digest")
                    found.append((key, number(headers["WARC-Record-ID"]), None if url is None else unquoted(url), headers["WARC-Type"], number(headers.get("WARC-Refers-To")), int(headers["X-Payload-Length"]), digest, payload if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in enumerate(kinds)], names)
                i = j
        if reader is not None:
            reader.close()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column(0).to_pylist()), pa.string())], ["key"])


def look_up(urls: DataFrame, out_dir: str, index_files: DataFrame, payloads: bool = True) -> DataFrame:
    """All captures of the URLs in column `url` (in any form with the same key): key, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and payload (null without payloads, empty for a revisit)."""
    keys = urls.select("url").distinct().mapInArrow(_keys, "key string").distinct()
    # One row an index file, so as many as the index had partitions.
    files = sorted((r["first_key"], r["index"], r["last_key"]) for r in index_files.collect())
    files = [(name, first, last) for first, name, last in files]
    blocks = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_find_blocks(out_dir, files), "key string, index string, at long, length long")
    captures = blocks.repartition("index", "at").sortWithinPartitions("index", "at", "key").mapInArrow(_find_captures(out_dir), "key string, file string, at long, length long")
    near = F.floor(F.col("at") / READ_AT_ONCE)
    # Captures are small however much they stand for, so the number of tasks follows from the bytes they are to read.
    captures = stored(captures, out_dir, f"captures-{unique('of', 0)}")
    size, n = captures.agg(F.sum("length"), F.count("*")).first()
    captures = captures.repartition(int(1 + (size or 0) // READ_PER_TASK + n // CAPTURES_PER_TASK), "file", near).sortWithinPartitions("file", "at")
    return captures.mapInArrow(_read_captures(out_dir, payloads), "key string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archived_pages(spark: SparkSession, pages: DataFrame, out_dir: str) -> DataFrame:
    """Write, index, and read all pages back through the index, without payloads."""
    index_files = write_archive(pages, out_dir)
    return look_up(pages.select("url"), out_dir, index_files, payloads=False)
