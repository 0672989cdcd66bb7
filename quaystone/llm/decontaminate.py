"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items become passages of `2 * STEP` words with TF-IDF weights over hashed words. A distributed
randomised SVD of all passages gives a latent space: one pass for document frequencies, one for the range of the matrix (each
task sends the product of its passages with a fixed random matrix, folded back onto the words), one for the singular values.
In the space scaled by those, overlapping passages of documents that have a high cosine with a passage of an item are
candidates, whatever words they share. A candidate is checked on all words of the item and the text around it: it is
contaminated if their longest common subsequence covers `VERBATIM` of the item, or `PARAPHRASE` of it and the item's answer is
found there too, or `DENSE` of it within `SPAN` times the item's words of text, or if `RUN` words of the item stand there in a row.
Words are compared by 32 bits of their hashes. An item of more than `PART_WORDS` words is cut into parts of so many words that
overlap by half, each of which counts as the item: a text that holds a part is contaminated by the item.

The model has WORDS x RANK numbers, whatever the input; items are worked through in blocks of a bounded size, one pass over the
tokenized documents for each.

Cases: null or empty texts hold no passage; items without words match nothing; a null doc_id is reported as null; rows that
repeat a doc_id are reported once for each item, with the best of them and, of a long item, with the best part, whose words
item_words then counts; empty tables give an empty table; extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import BREAKS, blobs, pieces, shared_dir, shingles, stored, string_buffer, text_of, words

WORDS, RANK, STEP = 4096, 128, 12
COSINE, VERBATIM, PARAPHRASE, ANSWER_WORDS = 0.25, 0.7, 0.5, 5
DENSE, SPAN, RUN = 0.45, 1.5, 13
#: Words of an item that are compared as one.
PART_WORDS = 1024
#: Items of a block at most, and bytes of its table of words by item.
ITEMS_AT_ONCE, MASK_BYTES = 2000, 64 << 20
#: Buckets in a row of the partial sums that tasks send, lanes that those are summed in first; words, passages and rows of a sum
#: that are worked on at a time.
SLICE, LANES, AT_ONCE, PASSAGES, AT_A_TIME = 256, 64, 1 << 16, 1024, 16
#: Known words of a text whose places in the items are joined at a time; pairs that are compared at once.
RUNS, PAIRS = 8, 1 << 14


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words without ASCII punctuation, as 32 bits of their hash, and their bounds by text."""
    h, _, _, bounds = words(*string_buffer(texts), lower=True, space=BREAKS)
    return (h >> np.uint64(32)).astype(np.uint32), bounds


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, bounds = tokens(batch.column(batch.schema.get_field_index("text")))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), blobs(ids.tobytes(), 4 * bounds)], ["doc_id", "words"])


def _runs(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive runs of `step` words, the last of a text shorter, and the text of each."""
    count = -(-np.diff(bounds) // step)
    text = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[text] + step * first, text


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the words of some texts, and their bounds."""
    for batch in pieces(batches, text="words", limit=4 * AT_ONCE):
        raw, offsets = string_buffer(batch.column(batch.schema.get_field_index("words")))
        ids = raw.view(np.uint32) if raw.ctypes.data % 4 == 0 else raw.copy().view(np.uint32)
        if len(ids):
            yield batch, ids, offsets // 4


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total = np.zeros(WORDS, np.int64), 0
    for _, ids, bounds in _parts(batches):
        starts, text = _runs(bounds, 2 * STEP)
        b = np.append(ids & (WORDS - 1), WORDS).astype(np.uint16)[_places(starts, np.minimum(starts + 2 * STEP, bounds[text + 1]), 2 * STEP, len(ids))].T.copy()
        b.sort(axis=1)
        first = np.ones(b.shape, bool)
        first[:, 1:] = b[:, 1:] != b[:, :-1]
        count += np.bincount(b[first], minlength=WORDS + 1)[:WORDS]
        total += len(starts)
    seen = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(count[seen], total))], ["word", "n"])


def _places(starts: np.ndarray, ends: np.ndarray, size: int, n: int) -> np.ndarray:
    """Word places of each run, one row a place; n (a word that isn't there) past the end of a run."""
    at = np.arange(size)[:, None] + starts
    return np.where(at < ends, at, n)


def _sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each column of `rows`, in blocks that stay in the cache. The table's last row is zero."""
    out, part = np.zeros((rows.shape[1], table.shape[1]), np.float32), np.empty((256, table.shape[1]), np.float32)
    for at in range(0, len(out), 256):
        own = out[at : at + 256]
        for row in rows[:, at : at + 256]:
            np.take(table, row, axis=0, out=part[: len(own)], mode="clip")
            own += part[: len(own)]
    return out


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])


def _passages(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive passages as sums of the table's rows (not scaled), the reciprocal of their TF-IDF lengths, and their words."""
    starts, text = _runs(bounds, 2 * STEP)
    words_of = np.append((ids & (WORDS - 1)).astype(np.int64), WORDS)[_places(starts, np.minimum(starts + 2 * STEP, bounds[text + 1]), 2 * STEP, len(ids))]
    scale = 1 / np.sqrt(np.maximum((_with_zero(idf) ** 2)[words_of].sum(axis=0), 1e-12))
    return _sums(table, words_of), scale.astype(np.float32), words_of


def _sliced(total: np.ndarray, kind: str) -> pa.RecordBatch:
    n = len(total) // SLICE or 1
    lane = pa.array([TaskContext.get().partitionId() % LANES] * n, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), lane, pa.array([x.astype(kind).tobytes() for x in np.array_split(total, n)], pa.binary())], ["part", "lane", "data"])


def _by_word(y: np.ndarray, words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the passages' rows of y that hold a word, at most AT_A_TIME of them in one: ascending words, and their sums."""
    flat = words_of.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    word = flat[order]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(np.append(head, len(word)))
    pieces_of = -(-size // AT_A_TIME)
    step = np.arange(int(pieces_of.sum())) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
    start, end = np.repeat(head, pieces_of) + AT_A_TIME * step, np.repeat(head + size, pieces_of)
    passage = np.append(order % len(y), len(y))
    return word[start], _sums(_with_zero(y), passage[_places(start, np.minimum(start + AT_A_TIME, end), AT_A_TIME, len(order))])


def _range(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The product of the transposed passage matrix with (passage matrix x random matrix), over this task's passages."""
        idf = model.value["idf"]
        table = _with_zero((idf[:, None] * np.random.default_rng(11).standard_normal((WORDS, RANK))).astype(np.float32))
        total = np.zeros((WORDS + 1, RANK))
        for _, ids, bounds in _parts(batches):
            y, scale, words_of = _passages(ids, bounds, table, idf)
            y *= (scale**2)[:, None]
            word, part = _by_word(y, words_of)
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            total[word[head]] += np.add.reduceat(part, head, axis=0)
        yield _sliced(total[:WORDS] * idf[:, None], "<f4")

    return run


def _gram(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros((RANK, RANK)), _with_zero(model.value["table"])
        for _, ids, bounds in _parts(batches):
            x, scale, _ = _passages(ids, bounds, table, model.value["idf"])
            x *= scale[:, None]
            total += x.T @ x
        yield _sliced(total, "<f8")

    return run


def _summed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of equal parts, one batch of them in memory at a time."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), kind).astype(np.float64)
                total[part] = total[part] + x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "data"])

    return run


def _collected(rows: DataFrame, shape: tuple[int, int], kind: str) -> np.ndarray:
    """The sum over tasks of a matrix of fixed size: first by part and lane, so that no task gets a part from every task."""
    by_lane = rows.repartition("part", "lane").select("part", "data").mapInArrow(_summed(kind), "part int, data binary")
    parts = sorted((r["part"], bytes(r["data"])) for r in by_lane.repartition("part").mapInArrow(_summed("<f8"), "part int, data binary").collect())
    flat = np.concatenate([np.zeros(0), *(np.frombuffer(d, "<f8") for _, d in parts)])
    return flat.reshape(shape) if len(flat) else np.zeros(shape)


def fit_space(tokenized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """idf of the hashed words, and the table that takes a passage's words to the scaled latent space, idf included."""
    sc = tokenized.sparkSession.sparkContext
    counts = {r["word"]: r["n"] for r in tokenized.mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    df = np.zeros(WORDS)
    df[list(counts)] = list(counts.values())
    idf = np.log((2 + total) / (1 + df))
    part = "part int, lane int, data binary"
    z = _collected(tokenized.mapInArrow(_range(sc.broadcast({"idf": idf})), part), (WORDS, RANK), "<f4")
    q, _ = np.linalg.qr(z)
    table = (idf[:, None] * q).astype(np.float32)
    gram = _collected(tokenized.mapInArrow(_gram(sc.broadcast({"idf": idf, "table": table})), part), (RANK, RANK), "<f8")
    squares, w = np.linalg.eigh(gram)
    sigma = np.sqrt(np.maximum(squares, 1e-9 * max(squares.max(), 1e-9)))
    return idf, (idf[:, None] * (q @ w / sigma)).astype(np.float32)


def _overlapping(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each passage: two runs of STEP words, the last run of a text only where it is the first too."""
    starts, text = _runs(bounds, STEP)
    same = text[1:] == text[:-1]
    keep = np.append(same, False) | np.append(True, ~same) if len(text) else np.zeros(0, bool)
    return starts[keep], text[keep]


def _latent(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit vectors of the passages from each start, which are apart by STEP inside a text, to STEP or 2 * STEP words further."""
    bucket = np.append((ids & (WORDS - 1)).astype(np.int64), WORDS)
    # A run is the second half of one passage and the first of the next: it is summed once. Short texts have no second half.
    second = np.where(starts + STEP < ends, starts + STEP, len(ids))
    runs, place = np.unique(np.concatenate([starts, second]), return_inverse=True)
    until = np.empty(len(runs), np.int64)
    until[place] = np.concatenate([ends, ends])
    sums = _sums(table, bucket[_places(runs, np.minimum(runs + STEP, until), STEP, len(ids))])
    x = sums[place[: len(starts)]] + sums[place[len(starts) :]]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        if w in masks:
            u = v & masks[w]
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def item_masks(items: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item and known word (0: any other), the item's places of that word as bits; and all places of the item."""
    wide = max(1, -(-max(map(len, items)) // 64))
    masks, full = np.zeros((wide, len(items), len(known) + 1), np.uint64), np.zeros((wide, len(items)), np.uint64)
    for i, item in enumerate(items):
        slot = np.searchsorted(known, item) + 1
        for j, w in enumerate(slot.tolist()):
            bit = np.uint64(1 << j % 64)
            masks[j // 64, i, w] |= bit
            full[j // 64, i] |= bit
    return masks, full


def known_words(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of each word among the known ones (sorted), from 1; 0 for any other."""
    if not len(known):
        return np.zeros(len(ids), np.int32)
    flag = np.zeros(1 << 16, bool)
    flag[known >> np.uint32(16)] = True
    out, some = np.zeros(len(ids), np.int32), np.flatnonzero(flag[ids >> np.uint32(16)])
    slot = np.searchsorted(known, ids[some])
    slot[slot == len(known)] = 0
    out[some] = np.where(known[slot] == ids[some], slot + 1, 0)
    return out


def common_subsequences(masks: np.ndarray, full: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each item with its stretch lo:hi of the text's known words, all pairs at once
    and bit-parallel over the items."""
    order = np.argsort(lo - hi, kind="stable")  # the longest stretches first, so that those still open are in front
    item, at, size = item[order], lo[order].astype(np.int64), (hi - lo)[order]
    wide, each = len(masks), masks.shape[2]
    flat, base, numbers = masks.reshape(wide, -1), item.astype(np.int64) * each, numbers.astype(np.int64)
    v = [full[w][item] for w in range(wide)]
    place, u, s = np.empty(len(item), np.int64), np.empty(len(item), np.uint64), np.empty(len(item), np.uint64)
    for n in (len(size) - np.cumsum(np.bincount(size)))[:-1].tolist() if len(size) else []:
        np.take(numbers, at[:n], out=place[:n], mode="clip")
        at[:n] += 1
        place[:n] += base[:n]
        carry = None
        for w in range(wide):
            x = v[w][:n]
            np.take(flat[w], place[:n], out=u[:n], mode="clip")
            u[:n] &= x
            np.add(x, u[:n], out=s[:n])
            if wide > 1:
                over = s[:n] < x
                if carry is not None:
                    s[:n] += carry
                    over |= (s[:n] == 0) & carry
                carry = over
            x ^= u[:n]
            x |= s[:n]
    out = np.empty(len(item), np.int64)
    out[order] = sum(np.bitwise_count(full[w][item]).astype(np.int64) - np.bitwise_count(v[w] & full[w][item]) for w in range(wide))
    return out


class Places:
    """Upper bounds of common subsequences: how many places of an item have a word that a stretch of text has.

    The words of many items have a row over all items (row 0: any other word); those of few are listed with their items.
    """

    def __init__(self, masks: np.ndarray):
        held = masks.any(axis=0)
        items, count = len(held), held.sum(axis=0)
        often = np.flatnonzero(32 * count > items)
        self.row = np.zeros(len(count), np.int64)
        self.row[often] = np.arange(1, len(often) + 1)
        self.rows = [np.concatenate([np.zeros((1, items), np.uint64), table[:, often].T]) for table in masks]
        held[:, often] = False
        word, self.item = np.nonzero(held.T)
        self.bits = masks[:, self.item, word]
        self.bounds = np.searchsorted(word, np.arange(len(count) + 1))

    def covered(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """For each item and its stretch lo:hi of the text's known words, rounded to whole runs of RUNS words: places with one of
        these words. The bits of a run are joined once for all items, then those of 2, 4, 8 ... runs."""
        out, some = np.zeros(len(item), np.int64), np.flatnonzero(hi > lo)
        if not len(some):
            return out
        start, end = lo[some] // RUNS, -(-hi[some] // RUNS)
        first, total = int(start.min()), int(end.max() - start.min())
        numbers = numbers[first * RUNS : (first + total) * RUNS]
        runs = np.zeros((total, RUNS), np.int64)
        runs.ravel()[: len(numbers)] = self.row[numbers]
        runs = runs.T.copy()
        # Each entry of a word of few items, and the run it is for.
        size = self.bounds[numbers + 1] - self.bounds[numbers]
        entry = np.arange(int(size.sum())) + np.repeat(self.bounds[numbers] - np.cumsum(size) + size, size)
        each = self.rows[0].shape[1]
        cell = np.repeat(np.arange(len(numbers)) // RUNS, size) * each + self.item[entry]
        # A stretch is the union of two that are a power of two of runs long.
        level = (np.frexp(end - start)[1] - 1).astype(np.int8)
        groups = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)]
        left, right = (start - first) * each + item[some], (end - first - (1 << level.astype(np.int64))) * each + item[some]
        for table, bits in zip(self.rows, self.bits, strict=True):
            joined, part = np.zeros((total, each), np.uint64), np.empty((64, each), np.uint64)
            for at in range(0, total, 64):
                into = joined[at : at + 64]
                for row in runs[:, at : at + 64]:
                    np.take(table, row, axis=0, out=part[: len(into)], mode="clip")
                    into |= part[: len(into)]
            flat = joined.ravel()
            np.bitwise_or.at(flat, cell, bits[entry])
            for k, pairs in enumerate(groups):
                if k:
                    flat[: -each << k - 1] |= flat[each << k - 1 :]
                out[some[pairs]] += np.bitwise_count(flat[left[pairs]] | flat[right[pairs]])
        return out


def densest(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence with any stretch of text of SPAN times the item's words (or an eighth more)."""
    step = max(1, len(item) // 8)
    width = int(np.ceil(SPAN * len(item))) + step
    return max(common_subsequence(item, text[at : at + width]) for at in range(0, max(1, len(text) - width + step), step))


def longest_run(item: np.ndarray, text: np.ndarray) -> int:
    """Words of the item that stand in a row in text, at most."""
    best, runs = 0, np.zeros(len(text) + 1, np.int32)
    for word in item:
        runs[1:] = (runs[:-1] + 1) * (text == word)
        best = max(best, int(runs.max()))
    return best


def _has_answer(answer: np.ndarray, text: np.ndarray) -> bool:
    """Whether text holds the answer's words in a row."""
    if not len(answer) or len(text) < len(answer):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(text, len(answer)) == answer).all(axis=1).any())


def _search(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        items, answers, vectors, owner, table = m["items"], m["answers"], m["vectors"], m["owner"], _with_zero(m["table"])
        known = np.unique(np.concatenate(items))
        masks, full = item_masks(items, known)
        places = Places(masks)
        sizes = np.array([len(x) for x in items])
        rows = np.unique(np.concatenate([shingles(x.astype(np.uint64), RUN) for x in items]))
        for batch, ids, bounds in _parts(batches):
            found: dict[tuple[int, int], tuple] = {}
            numbers = known_words(ids, known)
            inner = np.append(0, np.cumsum(numbers > 0))
            only = numbers[numbers > 0]
            # Where RUN words in a row begin that some item has in a row too.
            begun = np.zeros(len(ids) + 1, np.int64)
            whole = np.flatnonzero(inner[RUN:] - inner[:-RUN] == RUN) if len(ids) >= RUN else np.zeros(0, np.int64)
            if len(whole):
                h = shingles(ids.astype(np.uint64), RUN)[whole]
                begun[whole[np.isin(h, rows)] + 1] = 1
            begun = np.cumsum(begun)
            kept: list[tuple[np.ndarray, ...]] = []
            every, text_of_passage = _overlapping(bounds)
            for first in range(0, len(every), PASSAGES):
                starts, text = every[first : first + PASSAGES], text_of_passage[first : first + PASSAGES]
                x = _latent(ids, starts, np.minimum(starts + 2 * STEP, bounds[text + 1]), table)
                hits = np.flatnonzero((x @ vectors.T >= COSINE).ravel())
                if len(hits):
                    row, v = np.divmod(hits, len(vectors))
                    # Vectors of an item follow one another, so the first of those it has with a passage stands for all.
                    item = owner[v]
                    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
                    size, row, item = np.diff(np.append(head, len(v))), row[head], item[head]
                    slack = sizes[item] + STEP
                    lo = np.maximum(bounds[text[row]], starts[row] - slack)
                    hi = np.minimum(bounds[text[row] + 1], starts[row] + 2 * STEP + slack)
                    in_row = begun[np.maximum(lo, hi - RUN + 1)] > begun[lo]
                    least = DENSE * sizes[item]
                    least[in_row] = np.minimum(least[in_row], RUN)
                    able = places.covered(item, inner[lo], inner[hi], only) >= least
                    v = v[np.repeat(able, size)]
                    row, item, lo, hi, in_row, size = (c[able] for c in (row, item, lo, hi, in_row, size))
                    if len(row):
                        cosine = np.maximum.reduceat(np.einsum("ij,ij->i", x[np.repeat(row, size)], vectors[v]), np.cumsum(size) - size)
                        kept.append((text[row], item, lo, hi, in_row, cosine))
                if not kept or (first + PASSAGES < len(every) and sum(len(c[0]) for c in kept) < PAIRS):
                    continue
                text, item, lo, hi, in_row, cosine = (np.concatenate(c) for c in zip(*kept, strict=True))
                kept = []
                lcs = common_subsequences(masks, full, item, inner[lo], inner[hi], only)
                in_row &= lcs >= RUN
                for c in np.flatnonzero((lcs >= DENSE * sizes[item]) | in_row).tolist():
                    own, t, size = items[item[c]], int(text[c]), int(lcs[c])
                    around = ids[lo[c] : hi[c]]
                    answer = _has_answer(answers[item[c]], around)
                    alike = size >= VERBATIM * len(own) or (answer and size >= PARAPHRASE * len(own))
                    if alike or (size >= DENSE * len(own) and densest(own, around) >= DENSE * len(own)) or (in_row[c] and longest_run(own, around) >= RUN):
                        key, best = (t, int(item[c])), (size, float(cosine[c]), answer)
                        found[key] = max(found.get(key, best), best)
            if found:
                doc = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array([t for t, _ in found]))
                rest = [(m["ids"][i], r[1], r[0], len(items[i]), r[2]) for (_, i), r in found.items()]
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([doc, *(pa.array([r[c] for r in rest], k) for c, k in enumerate(kinds))], ["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_found"])

    return run


def item_parts(item: np.ndarray) -> list[np.ndarray]:
    """The item, or parts of PART_WORDS words that overlap by half and cover it; the last one ends with the item."""
    last = len(item) - PART_WORDS
    return [item] if last <= 0 else [item[at : at + PART_WORDS] for at in (*range(0, last, PART_WORDS // 2), last)]


def _item_blocks(rows: Iterator, answer: bool) -> Iterator[dict]:
    """Items (those with words) or their parts, with their answers, in blocks of a bounded number of items and bytes of masks."""
    block: dict = {"ids": [], "items": [], "answers": []}
    known: set[int] = set()
    longest = 0
    for row in rows:
        item, _ = tokens(pa.array([row["text"]]))
        if not len(item):
            continue
        told = tokens(pa.array([row["answer"]]))[0] if answer else None
        for part in item_parts(item):
            more, wide = known | set(part.tolist()), -(-max(longest, len(part)) // 64)
            if block["ids"] and (len(block["ids"]) == ITEMS_AT_ONCE or 8 * (len(block["ids"]) + 1) * (len(more) + 1) * wide > MASK_BYTES):
                yield block
                block, more, longest = {"ids": [], "items": [], "answers": []}, set(part.tolist()), 0
            known, longest = more, max(longest, len(part))
            for k, x in zip(("ids", "items", "answers"), (row["item_id"], part, part[-ANSWER_WORDS:] if told is None else told), strict=True):
                block[k].append(x)
    if block["ids"]:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """Documents that hold benchmark items (item_id, text): doc_id, item_id, cosine, lcs_words, item_words, answer_found.

    answer: the column of benchmark with the answer; without one it is the last ANSWER_WORDS words of the text.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    tokenized = stored(rows.mapInArrow(_tokenize, "doc_id long, words binary"), base, "words")
    idf, table = fit_space(tokenized)
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(benchmark).alias("text"), (text_of(benchmark, answer) if answer else F.lit("")).alias("answer"))
    listed = listed.filter("item_id IS NOT NULL").orderBy("item_id")
    schema = "doc_id long, item_id long, cosine double, lcs_words int, item_words int, answer_found boolean"
    out = spark.createDataFrame([], schema)
    for number, block in enumerate(_item_blocks(listed.toLocalIterator(), bool(answer))):
        ids, bounds = np.concatenate(block["items"]), np.cumsum([0, *map(len, block["items"])])
        starts, owner = _overlapping(bounds)
        vectors = _latent(ids, starts, np.minimum(starts + 2 * STEP, bounds[owner + 1]), _with_zero(table))
        model = spark.sparkContext.broadcast(block | {"vectors": vectors.astype(np.float32), "owner": owner, "table": table})
        out = out.unionByName(stored(tokenized.mapInArrow(_search(model), schema), base, f"found-{number}"))
        model.destroy()
    best = F.max(F.struct("lcs_words", "cosine", "item_words", "answer_found")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_words", "b.item_words", "b.answer_found")
