"""Exact substring deduplication by level-wise doubling.

A window of `window` words can only repeat if its half-length windows repeat. Level 1 therefore looks at windows of half the
length (of each run of them, only at the one with the smallest hash, which equal full windows share); only places where such a
window repeats are extended to twice that length, and so on up to `window` words. Windows are equal if the 64-bit hashes of
their words and of the half they share are.

What a level finds goes back to the documents packed by group of documents, one row for each task and group, so that rows don't
grow with documents times tasks. A group holds about `GROUP_BYTES` of text.

Cases: a null text has no words; a null doc_id neither removes nor loses words; rows that share a doc_id are one document for
"smaller doc_id", and each is judged on its own text; extra columns are not carried (join them back by doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import lists, mix, pieces, shingles, string_buffer, text_of, words

WINDOW = 13
#: Places or hashes that a task packs by document before they leave it.
PACKED_AT_ONCE = 1 << 20
#: Text of the documents whose hashes or places travel together, and are in memory together.
GROUP_BYTES = 8 << 20
_LOW = np.uint64(0xFFFFFFFF)


def levels(window: int) -> list[int]:
    """Window lengths: each at most twice the one before. The first is half of `window`, or less for very long windows."""
    out = [window]
    while out[0] > 14:
        out.insert(0, (out[0] + 1) // 2)
    return [(out[0] + 1) // 2, *out] if out[0] > 1 else out


def _windows(batch: pa.RecordBatch, first: int, window: int):
    """For the texts of a batch: word hashes, place and text of each whole window, and its smallest half-length hash."""
    raw, offsets = string_buffer(batch.column(batch.schema.get_field_index("text")))
    h, _, _, bounds = words(raw, offsets)
    short = shingles(h, first)
    n = len(h) - window + 1
    if n <= 0:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), bounds
    least = short[:n].copy()
    for j in range(1, window - first + 1):
        np.minimum(least, short[j : j + n], out=least)
    of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    whole = np.flatnonzero(of[:n] == of[window - 1 :])
    return h, whole, of[whole], least[whole], bounds


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)


def _repeats(batch: pa.RecordBatch, of: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the hashes `least`, in texts `of`, are among their document's keys (the lower halves of repeated hashes)."""
    keys = batch.column(batch.schema.get_field_index("keys"))
    tag = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))
    owner = np.repeat(tag, keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    known = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
    return np.isin(mix((least & _LOW) ^ tag[of]), mix(known ^ owner))


def _anchors(before: int, first: int, window: int):
    """before: the length from which the level before extended to `first`, 0 at the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, at, of, least, _ = _windows(batch, first, window)
            if before and len(of):
                # Windows of which each part of the length before repeats.
                _, part, part_of, key, _ = _windows(batch, before, first)
                good = np.zeros(len(h) + 1, np.int64)
                good[part + 1] = _repeats(batch, part_of, key)
                good = np.cumsum(good)
                n = window - first + 1
                alive = good[at + n] - good[at] == n
                of, least = of[alive], least[alive]
            if not len(of):
                continue
            new = np.ones(len(of), bool)
            new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
            key, doc = least[new], _ids(batch)[of[new]]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            size = np.diff(np.append(np.flatnonzero(head), len(key)))
            # What repeats inside the batch is settled here and goes on packed by document; one row of each hash, however
            # often it repeats, meets those of other batches.
            sure = np.repeat(size > 1, size)
            open_ = head & ~sure
            yield _anchor_rows(key[open_], doc[open_], key[:0], np.zeros(int(open_.sum()) + 1, np.int32))
            proven = head & sure
            yield _anchor_rows(key[proven], doc[proven], key[proven], np.arange(int(proven.sum()) + 1))
            key, doc = key[sure], doc[sure]
            order = np.argsort(doc, kind="stable")
            key, doc = key[order], doc[order]
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[: len(doc)]
            yield _anchor_rows(mix(doc[at].astype(np.uint64)), doc[at], key, np.append(at, len(doc)))

    return run


def _anchor_rows(route, doc, keys, bounds) -> pa.RecordBatch:
    """keys: empty where the hash `route` is open, that hash itself where it is known to repeat, else settled hashes of the
    document. No null lists: Arrow writers slow down with each null in a row."""
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(doc), lists(keys.view(np.int64), bounds, pa.int64())], ["route", "doc_id", "keys"])


def _repeated(groups: int):
    """Rows sorted by hash and document, in: hashes that are in two documents or more, packed by group of documents, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        for part in _repeated_hashes(batches):
            waiting.append(part)
            if sum(len(x[0]) for x in waiting) >= PACKED_AT_ONCE:
                yield _packed_keys(waiting, groups)
                waiting.clear()
        if waiting:
            yield _packed_keys(waiting, groups)

    return run


def _repeated_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and their repeated hashes. Holds one row between batches."""
    held = None  # hash, document, whether it is out already
    for batch in batches:
        size, route = batch.column(2).value_lengths().to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
        sure = size == 1
        first = (np.cumsum(size) - size)[sure]
        sure[sure] = batch.column(2).flatten().to_numpy(zero_copy_only=False)[first] == route[sure]
        own = (size == 0) | sure
        if not own.all():
            settled = batch.filter(pa.array(~own))
            yield np.repeat(settled.column(1).to_numpy(zero_copy_only=False), size[~own]), settled.column(2).flatten().to_numpy(zero_copy_only=False)
        h, doc, sure = route[own], batch.column(1).to_numpy(zero_copy_only=False)[own], sure[own]
        if not len(h):
            continue
        skip = 0
        if held is not None:
            h, doc, sure = np.insert(h, 0, held[0]), np.insert(doc, 0, held[1]), np.insert(sure, 0, held[2])
            skip = int(held[2])
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(at, len(h)))
        good = np.logical_or.reduceat(sure, at) | (doc[at] != doc[at + size - 1])
        keep = np.repeat(good, size)
        keep[:skip] = False
        held = (h[at[-1]], doc[at[-1]], bool(good[-1]))
        yield doc[keep], h[keep]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns differs from its row before."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))[: len(columns[0])]


def _groups_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _packed_keys(parts: list, groups: int) -> pa.RecordBatch:
    """One row a group: its documents, the number of hashes of each, and the lower halves of those."""
    doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    group = _groups_of(doc, groups)
    order = np.lexsort((doc, group))
    group, doc, h = group[order], doc[order], h[order]
    each = _heads(group, doc)
    count, at = np.diff(np.append(each, len(doc))), _heads(group)
    bounds = np.append(np.searchsorted(each, at), len(each))
    low = (h.view(np.uint64) & _LOW).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(group[at]), lists(doc[each], bounds, pa.int64()), lists(count, bounds, pa.int32()), lists(low, np.append(at, len(doc)), pa.int32())], ["group", "doc_id", "n", "keys"])


def _by_group(merged):
    """Packed rows sorted by group, in: what `merged` makes of all rows of a group, out. Holds one group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = None, []
        for batch in batches:
            cut = np.append(_heads(batch.column(0).to_numpy()), batch.num_rows)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                group = batch.column(0)[a].as_py()
                if held is not None and group != held:
                    yield merged([np.concatenate(x) for x in zip(*waiting, strict=True)])
                    waiting.clear()
                held = group
                waiting.append([batch.column(i)[a:b].flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3)])
        if waiting:
            yield merged([np.concatenate(x) for x in zip(*waiting, strict=True)])

    return run


def _keys_by_doc(columns: list[np.ndarray]) -> pa.RecordBatch:
    doc, n, keys = columns
    doc = np.repeat(doc, n)
    order = np.argsort(doc, kind="stable")
    doc, keys = doc[order], keys[order]
    at = _heads(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), lists(keys, np.append(at, len(doc)), pa.int32())], ["doc_id", "keys"])


def _text_hashes(batch: pa.RecordBatch) -> np.ndarray:
    raw, offsets = string_buffer(batch.column(batch.schema.get_field_index("text")))
    view = memoryview(raw)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, batch.num_rows).view(np.int64)


def _window_rows(route, doc, th, pos, hashes, bounds, late, late_bounds) -> pa.RecordBatch:
    none = np.zeros(len(doc) + 1, np.int32)
    open_ = lists(none[:0], none, pa.int64()) if hashes is None else lists(hashes.view(np.int64), bounds, pa.int64())
    sealed = lists(none[:0], none, pa.int32()) if late is None else lists(late, late_bounds, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(doc), pa.array(th), pa.array(pos, pa.int32()), open_, sealed], ["route", "doc_id", "th", "pos", "hs", "late"])


def _candidates(first: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, at, of, least, bounds = _windows(batch, first, window)
            if not len(at):
                continue
            seen = _repeats(batch, of, least)
            at, of, least = at[seen], of[seen], least[seen]
            if not len(at):
                continue
            ids, th = _ids(batch), _text_hashes(batch)
            key, doc, pos = shingles(h, window)[at], ids[of], (at - bounds[of]).astype(np.int32)
            order = np.lexsort((doc, key))
            head = np.append(True, key[order][1:] != key[order][:-1])
            least_doc = np.empty_like(doc)
            least_doc[order] = np.repeat(doc[order][head], np.diff(np.append(np.flatnonzero(head), len(key))))
            late = doc > least_doc  # a smaller document of this batch has the window: settled
            if late.any():
                where = np.flatnonzero(late)
                cut = np.flatnonzero(np.append(True, of[where][1:] != of[where][:-1]))
                which = of[where][cut]
                yield _window_rows(mix(ids[which].astype(np.uint64)), ids[which], th[which], np.zeros(len(cut)), None, None, pos[where], np.append(cut, len(where)))
            # Equal windows have the same smallest half, so runs of windows that share one can travel together.
            own = np.flatnonzero(~late)
            if len(own):
                cut = np.flatnonzero(np.append(True, (np.diff(pos[own]) != 1) | (of[own][1:] != of[own][:-1]) | (least[own][1:] != least[own][:-1])))
                which = own[cut]
                yield _window_rows(least[which], doc[which], th[of[which]], pos[which], key[own], np.append(cut, len(own)), None, None)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs to one row a window; rows of settled places as they are."""
    names = ["route", "doc_id", "th", "pos", "late", "h"]
    for batch in batches:
        batch = batch.select(["route", "doc_id", "th", "pos", "hs", "late"])
        sealed = pc.equal(batch.column(4).value_lengths(), 0)
        if sealed.true_count:
            part = batch.filter(sealed)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(5), pa.nulls(part.num_rows, pa.int64())], names)
        part = batch.filter(pc.invert(sealed))
        if part.num_rows:
            size = part.column(4).value_lengths().to_numpy(zero_copy_only=False)
            total = int(size.sum())
            step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            route, doc, th, pos = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), size) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc), pa.array(th), pa.array((pos + step).astype(np.int32)), lists(doc[:0], np.zeros(total + 1, np.int32), pa.int32()), part.column(4).flatten()], names)


def _later(groups: int):
    """Rows (route, doc_id, th, pos, late, h) sorted by route, hash and document, in: places of windows that a smaller document
    has too, out, packed by group of documents. Holds one hash and its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        for part in _late_places(batches):
            waiting.append(part)
            if sum(len(x[0]) for x in waiting) >= PACKED_AT_ONCE:
                yield _packed_places(waiting, groups)
                waiting.clear()
        if waiting:
            yield _packed_places(waiting, groups)

    return run


def _packed_places(parts: list, groups: int) -> pa.RecordBatch:
    doc, th, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    group = _groups_of(doc, groups)
    order = np.argsort(group, kind="stable")
    at = _heads(group[order])
    bounds = np.append(at, len(group))
    return pa.RecordBatch.from_arrays([pa.array(group[order][at]), lists(doc[order], bounds, pa.int64()), lists(th[order], bounds, pa.int64()), lists(pos[order], bounds, pa.int32())], ["group", "doc_id", "th", "pos"])


def _places_by_text(columns: list[np.ndarray]) -> pa.RecordBatch:
    doc, th, pos = columns
    order = np.lexsort((th, doc))
    doc, th, pos = doc[order], th[order], pos[order]
    at = _heads(doc, th)
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(th[at]), lists(pos, np.append(at, len(doc)), pa.int32())], ["doc_id", "th", "pos"])


def _late_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held = None
    for batch in batches:
        sealed = batch.column(5).is_null()
        if sealed.true_count:
            size = batch.column(4).filter(sealed).value_lengths().to_numpy(zero_copy_only=False)
            doc, th = (np.repeat(batch.column(i).filter(sealed).to_numpy(zero_copy_only=False), size) for i in (1, 2))
            yield doc, th, batch.column(4).filter(sealed).flatten().to_numpy(zero_copy_only=False)
        batch = batch.filter(pc.invert(sealed))
        if not batch.num_rows:
            continue
        route, doc, th, pos, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
        head = _heads(route, h)
        first = doc[head]
        if held is not None and held[:2] == (route[0], h[0]):
            first[0] = held[2]
        held = (route[-1], h[-1], first[-1])
        late = doc > np.repeat(first, np.diff(np.append(head, len(h))))
        yield doc[late], th[late], pos[late]


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            removed = batch.column(batch.schema.get_field_index("removed"))
            th = _text_hashes(batch)
            kept_texts, n_words, n_removed = [], [], []
            for i in range(batch.num_rows):
                own = texts[i].as_buffer().to_pybytes().split()
                n_words.append(len(own))
                spans = removed[i].values
                gone = np.zeros(0, bool)
                if spans is not None and len(spans):
                    mine = spans.filter(pa.array(spans.field("th").to_numpy(zero_copy_only=False) == th[i]))
                    pos = mine.field("pos").flatten().to_numpy(zero_copy_only=False)
                    step = np.zeros(len(own) + 1, np.int32)
                    np.add.at(step, pos, 1)
                    np.add.at(step, np.minimum(pos + window, len(own)), -1)
                    gone = np.cumsum(step[:-1]) > 0
                if gone.any():
                    own = [own[j] for j in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(own))
                kept_texts.append(b" ".join(own).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(kept_texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Returns doc_id, text (kept words joined by one space), n_words and n_removed for each row of docs.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    total = docs.select(F.sum(F.octet_length(text_of(docs)))).first()[0] or 0
    steps, groups = levels(window), 1 + total // GROUP_BYTES
    # A doc_id that is a long stays as it is, so that both joins below read the same shuffled texts.
    key = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(key, text_of(docs).alias("text"))
    known = docs.filter(F.col("doc_id").isNotNull())
    before, length = 0, steps[0]
    places = known
    for longer in steps[1:]:
        anchors = (
            places.mapInArrow(_anchors(before, length, longer), "route long, doc_id long, keys array<long>")
            .repartition("route").sortWithinPartitions("route", "doc_id")
            .mapInArrow(_repeated(groups), "group long, doc_id array<long>, n array<int>, keys array<int>")
            .repartition("group").sortWithinPartitions("group")
            .mapInArrow(_by_group(_keys_by_doc), "doc_id long, keys array<int>")
        )
        places = known.join(anchors, "doc_id")
        before, length = length, longer
    removed = (
        places.mapInArrow(_candidates(before, window), "route long, doc_id long, th long, pos int, hs array<long>, late array<int>")
        .repartition("route").mapInArrow(_unpacked, "route long, doc_id long, th long, pos int, late array<int>, h long").sortWithinPartitions("route", "h", "doc_id")
        .mapInArrow(_later(groups), "group long, doc_id array<long>, th array<long>, pos array<int>")
        .repartition("group").sortWithinPartitions("group")
        .mapInArrow(_by_group(_places_by_text), "doc_id long, th long, pos array<int>")
        .groupBy("doc_id").agg(F.collect_list(F.struct("th", "pos")).alias("removed"))
    )
    out = "doc_id long, text string, n_words long, n_removed long"
    none = F.array().cast("array<struct<th:bigint,pos:array<int>>>")
    lone = docs.filter(F.col("doc_id").isNull()).withColumn("removed", none)
    return known.join(removed, "doc_id", "left").select("doc_id", "text", F.coalesce("removed", none).alias("removed")).unionByName(lone).mapInArrow(_cut(window), out)
