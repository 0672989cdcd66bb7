"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on what toxic text has far more often than
ordinary text: runs of `RUN` bytes wherever they stand (in words or across them), and beginnings of words, as ordinary syllables
can make up a telling beginning. The ordinary side compresses a window with the first, the toxic side with both, so the
difference of the two lengths is what toxic text explains of it. Thresholds for that difference are quantiles over windows of
ordinary text. The largest differences of a whole text, how many of its windows pass each threshold, and the number of its
windows give its score by a logistic curve.

Thresholds and curve are calibrated on texts that the dictionaries in use were not trained on: the labelled sample is split into
`FOLDS` parts, and each is measured with dictionaries of the others.

The classifier is fitted on at most `FIT_DOCS` labelled documents of each class, of at most `FIT_CHARS` characters each, chosen
by a hash of doc_id; that sample is the only thing on the driver. Scoring reads every whole text.

Cases: a null text is an empty one and is scored as such; a null label is none; of several labels of a document the largest
counts; without labels of both classes every score is 0; a null doc_id is not held out; rows that repeat a document are each
scored, and count once in the fit; extra columns stay, but for a column toxic_score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import pieces, string_buffer

FIT_DOCS, FIT_CHARS, FOLDS = 2000, 20_000, 3
WINDOW, LEVEL, THRESHOLD = 64, 1, 0.3
ORDINARY_BYTES, TOXIC_BYTES = 8192, 1024
#: Bytes of a run, and of a beginning of a word; shares of toxic texts that must have one.
RUN, BEGINNINGS = 4, range(4, 11)
RUN_SHARE, BEGINNING_SHARE = 0.005, 0.02
#: Telling is what so many times the toxic texts have that the share of ordinary ones suggests, and so many standard deviations more.
RATIO, RUN_SIGMAS, BEGINNING_SIGMAS = 8, 6, 4
#: Shares of ordinary windows that stay under each threshold.
QUANTILES = (0.99, 0.999)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of at most `size` bytes, cut before spaces where there is one."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.rfind(b" ", at + 1, end)
            end = space if space > at else end
        out.append(text[at:end])
        at = end
    return out or [b""]


def without_copies(texts: list[bytes], labels: list[int]) -> tuple[list[bytes], list[int]]:
    """The sample without copies and near copies of earlier texts, whose words would all seem to tell the classes apart: a text
    goes if a quarter of its 16 smallest shingle hashes are those of texts before it."""
    seen: set[int] = set()
    kept: list[tuple[bytes, int]] = []
    for text, label in zip(texts, labels, strict=True):
        words = text.split()
        sketch = sorted({zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})[:16]
        if 4 * sum(h in seen for h in sketch) < len(sketch):
            kept.append((text, label))
        seen.update(sketch)
    return [t for t, _ in kept], [v for _, v in kept]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; the samples themselves where the trainer finds them too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def _runs(text: bytes) -> np.ndarray:
    """Each run of RUN bytes as a number."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.zeros(max(0, len(raw) - RUN + 1), np.uint32)
    for j in range(RUN if len(out) else 0):
        out = out << np.uint32(8) | raw[j : j + len(out)]
    return out


def _text_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs, ascending, and the number of texts that have each. What is held grows with different runs only."""
    runs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for at in range(0, len(texts), 200):
        more = np.concatenate([runs, *(np.unique(_runs(t)) for t in texts[at : at + 200])])
        weight = np.append(counts, np.ones(len(more) - len(counts), np.int64))
        runs, place = np.unique(more, return_inverse=True)
        counts = np.bincount(place, weight, len(runs)).astype(np.int64)
    return runs, counts


def telling_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stretches of the toxic texts that consist of telling runs; texts begin with a space, as words inside them do."""
    toxic, ordinary = [b" " + t for t in toxic], [b" " + t for t in ordinary]
    (far, n), (near, others) = _text_counts(toxic), _text_counts(ordinary)
    also = np.zeros(len(far))
    if len(near):
        at = np.minimum(np.searchsorted(near, far), len(near) - 1)
        also = np.where(near[at] == far, others[at], 0)
    by_chance = (also + 1) * len(toxic) / max(1, len(ordinary))
    telling = far[(n >= RUN_SHARE * len(toxic)) & (n >= RATIO * by_chance) & (n >= by_chance + RUN_SIGMAS * np.sqrt(by_chance + 1))]
    out = []
    for text in toxic:
        hit = np.flatnonzero(np.isin(_runs(text), telling))
        if len(hit):
            cut = np.flatnonzero(np.append(True, np.diff(hit) > RUN))
            last = np.append(cut[1:], len(hit)) - 1
            out += [text[a : b + RUN] for a, b in zip(hit[cut].tolist(), hit[last].tolist(), strict=True)]
    return out


def telling_beginnings(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The longest telling beginning of each word of the toxic texts that has one, after a space."""

    def beginnings(text: bytes) -> set[bytes]:
        return {w[:n] for w in set(text.split()) for n in BEGINNINGS if len(w) >= n}

    far, near = Counter(), Counter()
    for texts, counts in ((toxic, far), (ordinary, near)):
        for t in texts:
            counts.update(beginnings(t))

    def telling(part: bytes, n: int) -> bool:
        by_chance = (near[part] + 1) * len(toxic) / max(1, len(ordinary))
        return n >= max(BEGINNING_SHARE * len(toxic), RATIO * by_chance, by_chance + BEGINNING_SIGMAS * (by_chance + 1) ** 0.5)

    known = {part for part, n in far.items() if telling(part, n)}
    # The shortest beginning stands for longer ones that are much rarer.
    known = {part for part in known if part[:-1] not in known or far[part] >= 0.9 * far[part[:-1]]}
    out = []
    for t in toxic:
        for w in t.split():
            part = next((w[:n] for n in reversed(BEGINNINGS) if w[:n] in known), None)
            if part is not None:
                out.append(b" " + part)
    return out


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary dictionary, and of both."""
    base = _trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    stretches = telling_beginnings(toxic, ordinary) + telling_stretches(toxic, ordinary)
    # The trainer wants longer samples than most stretches.
    joined = [b"".join(stretches[i : i + 40]) for i in range(0, len(stretches), 40)]
    return base, base + (_trained(joined, TOXIC_BYTES) if joined else b"")


class Scorer:
    """Differences of compressed lengths with the two dictionaries; a score once it is calibrated."""

    def __init__(self, ordinary: bytes, toxic: bytes, limits: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.contents, self.limits, self.weights, self._sides = (ordinary, toxic), limits, weights, None

    def __getstate__(self):
        return {"contents": self.contents, "limits": self.limits, "weights": self.weights, "_sides": None}

    def _compressors(self):
        if self._sides is None:
            self._sides = []
            for content in self.contents:
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self._sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        return self._sides

    def saved(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic side saves in each window."""
        plain, toxic = self._compressors()
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], np.float64)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(self.saved(text), self.limits) @ self.weights, -30, 30))))


def features(saved: np.ndarray, limits: np.ndarray) -> np.ndarray:
    top = np.sort(saved)[::-1]
    return np.array([1.0, top[0], top[:2].sum(), top[:4].sum(), np.log(len(saved)), saved.mean(), *(np.log1p((saved > x).sum()) for x in limits)])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; both classes weigh as many as they are."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    mean[0], spread[0] = 0, 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), slope)
    w = w / spread
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def fit(texts: list[bytes], labels: list[int], share: float | None = None) -> Scorer | None:
    """share: of toxic texts among all, where the given ones hold another share. None without both classes."""
    texts, labels = without_copies(texts, labels)
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return None

    def trained(part: list[int]) -> Scorer:
        return Scorer(*train_dictionaries([texts[i] for i in part if y[i]], [texts[i] for i in part if not y[i]]))

    # Every text is measured with dictionaries of other texts; each class is dealt to the folds in turn.
    fold = np.empty(len(y), int)
    for kind in (0, 1):
        fold[y == kind] = np.arange(int((y == kind).sum())) % FOLDS
    saved: list = [None] * len(y)
    for f in range(FOLDS):
        scorer = trained(np.flatnonzero(fold != f).tolist())
        for i in np.flatnonzero(fold == f).tolist():
            saved[i] = scorer.saved(texts[i])
    limits = np.quantile(np.concatenate([x for x, v in zip(saved, labels, strict=True) if not v]), QUANTILES, method="higher")
    weights = logistic(np.array([features(x, limits) for x in saved]), y)
    if share is not None and 0 < share < 1:  # the sample's share of toxic texts, set right
        weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    whole = trained(list(range(len(y))))
    return Scorer(*whole.contents, limits, weights)


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """Fit on the labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    hashed = F.xxhash64(F.lit(5), "doc_id")
    chosen = known.filter("toxic = 1").orderBy(hashed, "doc_id").limit(FIT_DOCS).union(known.filter("toxic = 0").orderBy(hashed, "doc_id").limit(FIT_DOCS))
    # At most 2 * FIT_DOCS rows of two numbers.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= FIT_CHARS)
    rows = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy(hashed, "doc_id").select("text", "toxic").collect()
    total = sum(counts.values())
    return fit([r["text"].encode().lower() for r in rows], [r["toxic"] for r in rows], counts.get(1, 0) / total if total else None)


def _scores(scorer: Scorer | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw, offsets = string_buffer(batch.column(batch.schema.get_field_index("text")))
            data = raw.tobytes().lower()
            found = [scorer.score(data[a:b]) if scorer else 0.0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "toxic_score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with toxic_score, from 0 to 1. Of its columns only text is an input of the score."""
    scorer = fit_on_labels(docs, labels)
    kept = docs.drop("toxic_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_scores(scorer), f"{schema}, toxic_score double")
