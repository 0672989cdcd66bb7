"""Quality rules as a short-circuit cascade.

Every text gets the base measures. Texts that pass the base limits go through the rules one after another, and a rule sees only
what all rules before it let through. The order is worked out on a sample: each task puts the first texts of its split, SAMPLE at
most, through all rules, which gives the CPU time of each rule and how many texts fail which rules together. From that it orders
the rules greedily by rejections per second among the texts that are still there. So there is no pass over the table beforehand,
and splits of other sources get other orders. The order changes the time and never the verdict, which is the same for every order.

Words and lines are compared by their bytes (Arrow's dictionaries), not by hashes. Texts are looked at in pieces of about 8 MB,
a longer one alone and whole.

Cases: a null text has no words and fails the base limits, as an empty one; a null doc_id stays; repeated rows are judged each
for itself; texts of white space only have no words; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import pieces, release, string_buffer

#: Texts of each input split that are looked at for the order of the rules.
SAMPLE = 256
#: Base limits: fewest words, and percent of the words that may be in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A word is long from so many code points on.
LONG_WORD = 40


def _table(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE = _table([9, 10, 11, 12, 13, 32])
_SYMBOL = _table(b"#*$%&|<>")
_DIGIT = _table(range(48, 58))
_UPPER, _LOWER = _table(range(65, 91)), _table(range(97, 123))
#: Bytes of which a word with a letter has one; all bytes of other scripts count as letters.
_LETTER = _UPPER | _LOWER | _table(range(128, 256))
_MORE = _table(range(128, 192))  # bytes that continue a code point


def _exact_ids(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each of the strings of the given sizes that lie one after another in raw: equal for equal strings."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return found.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeats(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows have a (group, key) that another row has as well."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


class Texts:
    """Measures of a batch of texts, each worked out when it is first asked for."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = string_buffer(column)
        self.size = len(self.offsets) - 1
        raw = self.raw
        self.solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        before, after = np.append(False, self.solid[:-1]), np.append(self.solid[1:], False)
        self.start = np.flatnonzero(self.solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(self.solid & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.size), self.n_words)  # of each word

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        return np.diff(np.searchsorted(np.flatnonzero(marked), self.offsets))

    def per_word(self, marked: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each word has."""
        at = np.flatnonzero(marked)
        return np.searchsorted(at, self.end) - np.searchsorted(at, self.start)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(self.solid) - self.count(_MORE[self.raw])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL[self.raw])

    @cached_property
    def words(self) -> np.ndarray:
        return _exact_ids(self.raw[self.solid], self.end - self.start)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that repeat an earlier line, of each text."""
        feed = self.raw == 10
        breaks = np.flatnonzero(feed)
        # Each text's lines: one more than its line feeds. A line ends at a line feed or with its text.
        cuts = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        doc = np.repeat(np.arange(self.size), np.diff(np.searchsorted(breaks, self.offsets)) + 1)
        sizes = np.diff(np.append(0, cuts))
        own_feed = np.append(False, doc[1:] == doc[:-1])  # lines but a text's first begin with the line feed before them
        ids = _exact_ids(self.raw[~feed], sizes - own_feed)
        line_of_word = np.searchsorted(breaks, self.start) + self.doc
        real = np.unique(line_of_word)
        n = np.bincount(doc[real], minlength=self.size)
        pairs = np.unique(doc[real] * (int(ids.max(initial=0)) + 1) + ids[real])
        distinct = np.bincount(pairs // (int(ids.max(initial=0)) + 1), minlength=self.size)
        return n, n - distinct

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of three words that the text has twice or more."""
        w = self.words
        if len(w) < 3:
            return np.zeros(self.size, np.int64)
        at = np.flatnonzero(self.doc[2:] == self.doc[:-2])
        distinct = int(w.max()) + 1
        if distinct < 1 << 21:
            key = (w[at] << 42) | (w[at + 1] << 21) | w[at + 2]
        else:
            key = np.unique(w[at] * distinct + w[at + 1], return_inverse=True)[1] * distinct + w[at + 2]
        found = at[_repeats(self.doc[at], key)]
        covered = np.zeros(len(w), bool)
        for j in range(3):
            covered[found + j] = True
        return np.bincount(self.doc[covered], minlength=self.size)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def _take(column: pa.Array, rows: np.ndarray) -> Texts:
    return Texts(column.take(pa.array(rows)))


class Rule(NamedTuple):
    """A name, and which of a batch's texts fail."""

    name: str
    fails: Callable[[Texts], np.ndarray]


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def _word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 12 * t.n_words)


def _repeated_lines(t: Texts) -> np.ndarray:
    return 2 * t.n_dup_lines > t.n_lines


def _letterless_words(t: Texts) -> np.ndarray:
    lettered = np.bincount(t.doc[t.per_word(_LETTER[t.raw]) > 0], minlength=t.size)
    return 10 * lettered < 7 * t.n_words


def _shouting(t: Texts) -> np.ndarray:
    upper = t.count(_UPPER[t.raw])
    return 2 * upper > upper + t.count(_LOWER[t.raw])


def _digits(t: Texts) -> np.ndarray:
    return 10 * t.count(_DIGIT[t.raw]) > 3 * t.word_chars


def _long_words(t: Texts) -> np.ndarray:
    chars = (t.end - t.start) - t.per_word(_MORE[t.raw])
    long = chars >= LONG_WORD
    return 10 * np.bincount(t.doc[long], chars[long], minlength=t.size).astype(np.int64) > 3 * t.word_chars


def _one_word(t: Texts) -> np.ndarray:
    """The commonest word is a quarter of all words."""
    n = int(t.words.max(initial=0)) + 1
    pairs, times = np.unique(t.doc * n + t.words, return_counts=True)
    most = np.zeros(t.size, np.int64)
    np.maximum.at(most, pairs // n, times)
    return 4 * most > t.n_words


#: Texts fail by: over one symbol in ten words; under 2 or over 12 code points a word; half of the lines repeat earlier ones; under
#: 70 % of the words hold a letter; over half of the ASCII letters are capitals; over 30 % of the code points in words are digits;
#: over 30 % of them are in words of 40 or more; one word is over a quarter of all.
RULES = [
    Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("repeated_lines", _repeated_lines), Rule("letterless_words", _letterless_words),
    Rule("shouting", _shouting), Rule("digits", _digits), Rule("long_words", _long_words), Rule("one_word", _one_word),
]


def tried(column: pa.Array, rules: list[Rule]) -> tuple[np.ndarray, dict[int, int]]:
    """CPU seconds of each rule over some texts, and how many of those that pass the base limits fail which set of rules."""
    able = np.flatnonzero(~Texts(column).base_failed)
    failed, seconds = np.zeros(len(able), np.int64), np.zeros(len(rules))
    for i, rule in enumerate(rules):
        fresh = _take(column, able)  # so that no rule is charged for what another has worked out
        began = time.thread_time()
        failed |= rule.fails(fresh).astype(np.int64) << i
        seconds[i] = time.thread_time() - began
    return seconds, {int(p): int(n) for p, n in zip(*np.unique(failed, return_counts=True), strict=True)}


def greedy(costs: list[float], patterns: dict[int, int]) -> list[int]:
    """Rules by rejections per cost among the texts that the rules before let through; patterns: texts by the set of rules they fail."""
    left, rest, order = dict(patterns), set(range(len(costs))), []
    while rest:
        gain = {i: sum(n for p, n in left.items() if p >> i & 1) / max(costs[i], 1e-12) for i in rest}
        best = min(rest, key=lambda i: (-gain[i], costs[i], i))
        order.append(best)
        rest.remove(best)
        left = {p: n for p, n in left.items() if not p >> best & 1}
    return order


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def passes(column: pa.Array, texts: Texts, rules: list[Rule], order: list[int]) -> np.ndarray:
    """Which texts pass the base limits and all rules; a rule looks at those that the ones before let through."""
    kept = ~texts.base_failed
    rows, view = np.arange(texts.size), texts
    for i in order:
        alive = np.flatnonzero(kept)
        if not len(alive):
            break
        # A smaller view pays once a fair part of the texts is gone.
        if 4 * len(alive) < 3 * len(rows):
            rows, view = alive, _take(column, alive)
        kept[rows[rules[i].fails(view)]] = False
    return kept


def judged(docs: DataFrame, rules: list[Rule] = RULES, order: list[int] | None = None) -> DataFrame:
    """docs (doc_id, text) to their base measures, base_failed and kept. order: of the rules; by default each task finds its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = order
        for batch in pieces(batches):
            column = batch.column("text")
            if own is None:
                own = greedy(*tried(column.slice(0, SAMPLE), rules))
            t = Texts(column)
            numbers = [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words]
            columns = [batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(t.base_failed), pa.array(passes(column, t, rules, own))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
        release()

    return rows.mapInArrow(run, _SCHEMA)
