"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length only. Documents with equal m make a stratum, and inside one a term's impact
depends on nothing but its count tf: so a stratum's postings are stored by term and tf, and an impact is worked out once for each
(term, tf). The sum of a query's impacts at the highest tf of each term bounds every score in a stratum. A task visits its strata
from the highest bounds down, skips a query where the bound is under the query's k-th best score so far, and adds the postings up
in dense arrays, a term at a time for all queries that hold it. The tasks' lists are merged by rank. Exact.

Only terms that some query asks for are indexed, as no others can score (all terms, once the queries have more than ASKED_TERMS
different ones); lengths and counts are of whole texts and all documents. Strata are cut into parts of bounded size, and documents
are dealt in the order of (m, doc_id), so neither a common length nor copies of a document make a large group. Terms are told
apart by 64-bit hashes. Queries go in groups of bounded size, each a pass over the index, not over the texts; what is broadcast is
one group.

Cases: a null text has no terms; a document without a doc_id counts in the statistics and can't be found; rows that repeat a
doc_id are documents of their own; rows that repeat an item_id (also null) are one query with the terms of all; queries without
terms and empty tables give no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.llm.common import BREAKS, lists, pieces, release, shared_dir, stored, string_buffer, words

#: Documents and postings of a part of a stratum; postings of a task's parts, and those it holds before it visits their parts.
PART_DOCS, PART_POSTINGS, TASK_POSTINGS, HELD_POSTINGS = 2048, 1 << 18, 1 << 20, 4 << 20
#: Terms of a group of queries, of which 16 bytes each are broadcast; different terms of all queries up to which only these are
#: indexed, of which 8 bytes each are broadcast.
GROUP_TERMS, ASKED_TERMS = 1 << 20, 1 << 22
_COUNTED = "doc_id long, n long, terms array<long>, tfs array<int>"
_INDEX = "m long, docs array<long>, terms array<long>, groups array<int>, tfs array<int>, sizes array<int>, places array<int>"


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of every text, and the texts' bounds in them."""
    h, _, _, bounds = words(*string_buffer(batch.column("text")), lower=True, space=BREAKS)
    return h.view(np.int64), bounds


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, for items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, bounds = _terms(batch)
            each = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            flat, ends = np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists(flat, ends, pa.int64())], ["item_id", "terms"])

    kind = dict(items.dtypes)["item_id"]
    found = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, terms array<long>")
    return found.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def counted(docs: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (terms in the text) and the counts of the asked terms (sorted; None: of all), for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, bounds = _terms(batch)
            known = np.unique(h) if shared.value is None else shared.value
            width = max(1, len(known))
            place = np.minimum(np.searchsorted(known, h), width - 1)
            hit = known[place] == h if len(known) else np.zeros(len(h), bool)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[hit]
            pairs, tf = np.unique(doc * width + place[hit], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * width)
            term = known[pairs % width] if len(known) else pairs
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), lists(term, ends, pa.int64()), lists(tf, ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _COUNTED)


def _part(m: int, docs: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple:
    """A row of the index: places of documents by term and tf."""
    order = np.lexsort((doc, tf, term))
    doc, term, tf = doc[order], term[order], tf[order]
    new_term = np.append(True, term[1:] != term[:-1])
    new_group = new_term | np.append(True, tf[1:] != tf[:-1])
    head = np.flatnonzero(new_group)
    groups = np.diff(np.append(np.flatnonzero(new_term[head]), len(head)))
    return (m, docs, term[new_term], groups.astype(np.int32), tf[head].astype(np.int32), np.diff(np.append(head, len(doc))).astype(np.int32), doc.astype(np.int32))


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    columns = [pa.array([p[0] for p in parts], pa.int64())]
    for i, kind in enumerate(kinds, 1):
        each = [p[i] for p in parts]
        columns.append(lists(np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each])), kind))
    return pa.RecordBatch.from_arrays(columns, ["m", "docs", "terms", "groups", "tfs", "sizes", "places"])


def _strata(most_docs: int, most_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of m to parts of strata; a part never holds documents of two strata."""
        held: list[tuple] = []
        m = postings = 0

        def part() -> pa.RecordBatch:
            docs = np.array([x[0] for x in held], np.int64)
            return _rows([_part(m, docs, np.repeat(np.arange(len(docs)), [len(x[1]) for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]))])

        for batch in batches:
            ids, ms = batch.column("doc_id").to_numpy(), batch.column("m").to_numpy()
            bounds, terms, tfs = batch.column("terms").offsets.to_numpy(), batch.column("terms").values.to_numpy(), batch.column("tfs").values.to_numpy()
            for i in range(batch.num_rows):
                a, b = bounds[i], bounds[i + 1]
                if held and (ms[i] != m or len(held) >= most_docs or postings + b - a > most_postings):
                    yield part()
                    held, postings = [], 0
                m = int(ms[i])
                held.append((ids[i], terms[a:b].copy(), tfs[a:b].copy()))
                postings += b - a
        if held:
            yield part()

    return run


def build_index(docs: DataFrame, base: str, asked: np.ndarray | None = None) -> tuple[DataFrame, int, DataFrame]:
    """The index of docs' postings of the asked terms (None: of all), N, and document frequencies (term, df); all written below base."""
    rows = stored(counted(docs, asked), base, "postings")
    n, total = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = stored(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), base, "frequencies")
    m = F.expr(f"50L + (50L * n * {n}L) DIV {max(1, total)}L")
    able = rows.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).withColumn("m", m)
    tasks = 1 + int(df.agg(F.sum("df")).first()[0] or 0) // TASK_POSTINGS
    parts = able.repartitionByRange(tasks, "m", "doc_id").sortWithinPartitions("m", "doc_id").mapInArrow(_strata(PART_DOCS, PART_POSTINGS), _INDEX)
    return stored(parts, base, "index"), n, df


class _Part:
    """A part of a stratum, with the contributions of its postings."""

    def __init__(self, row: dict, vocabulary: np.ndarray, weights: np.ndarray):
        term, groups, tfs, sizes = (np.asarray(row[c], np.int64) for c in ("terms", "groups", "tfs", "sizes"))
        place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        mine = vocabulary[place] == term
        impact = np.repeat(np.where(mine, weights[place], 0), groups) * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * row["m"]))  # once for each (term, tf)
        last = np.cumsum(groups) - 1
        self.terms, self.highest = place[mine], impact[last[mine]]  # impacts rise with tf
        ends = np.append(0, np.cumsum(sizes))
        self.spans = np.column_stack([ends[np.append(0, last[:-1] + 1)], ends[last + 1]])[mine]
        self.places, self.added = np.asarray(row["places"], np.int64), np.repeat(impact, sizes)
        self.docs = np.asarray(row["docs"], np.int64)


class _Queries:
    """Queries as lists of places in their vocabulary, and the other way round."""

    def __init__(self, terms: list[np.ndarray], weight: dict[int, int]):
        self.n = len(terms)
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        self.vocabulary, place = np.unique(flat, return_inverse=True)
        self.weights = np.array([weight.get(int(t), 0) for t in self.vocabulary], np.int64)
        query = np.repeat(np.arange(self.n), [len(t) for t in terms])
        order = np.argsort(place, kind="stable")
        self.holders, self.starts = query[order], np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))

    def bounds(self, part: _Part) -> np.ndarray:
        """The most that any document of the part can score, for each query."""
        sizes = self.starts[part.terms + 1] - self.starts[part.terms]
        at = np.repeat(self.starts[part.terms] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.holders[at], np.repeat(part.highest, sizes))
        return out


class _Best:
    """The k best documents of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.least = np.ones(n, np.int64)  # scores under it have no place any more

    def add(self, query: int, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.append(self.found[query][0], docs), np.append(self.found[query][1], scores)
        first = np.lexsort((docs, -scores))[: self.k]
        self.found[query] = (docs[first], scores[first])
        if len(first) == self.k:
            self.least[query] = scores[first[-1]]


def _visit(parts: list[_Part], queries: _Queries, best: _Best) -> None:
    bounds = [queries.bounds(p) for p in parts]
    for i in sorted(range(len(parts)), key=lambda i: -int(bounds[i].max(initial=0))):
        part, active = parts[i], np.flatnonzero(bounds[i] >= best.least)
        if not len(active):
            continue
        row = np.full(queries.n, -1)
        row[active] = np.arange(len(active))
        score = np.zeros((len(active), len(part.docs)), np.int64)
        for t, (a, b) in zip(part.terms, part.spans, strict=True):
            rows = row[queries.holders[queries.starts[t] : queries.starts[t + 1]]]
            rows = rows[rows >= 0]
            if not len(rows):
                continue
            at, added = part.places[a:b], part.added[a:b]
            if 4 * len(at) > len(part.docs):
                whole = np.zeros(len(part.docs), np.int64)
                whole[at] = added
                score[rows] += whole
            else:
                score[rows[:, None], at] += added
        for j in np.flatnonzero((score >= best.least[active, None]).any(axis=1)):
            q = active[j]
            able = np.flatnonzero(score[j] >= best.least[q])
            best.add(q, part.docs[able], score[j, able])


def search(index: DataFrame, items: list[tuple], weight: dict[int, int], k: int = 50) -> DataFrame:
    """The k best documents of each item (item_id, terms) in each task's part of the index: item (its place in the list), doc_id, score."""
    shared = index.sparkSession.sparkContext.broadcast(_Queries([np.asarray(t, np.int64) for _, t in items], weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best, parts, held = _Best(queries.n, k), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_numpy() if c != "m" else batch.column(c)[i].as_py() for c in batch.schema.names}
                parts.append(_Part(row, queries.vocabulary, queries.weights))
                held += len(row["places"])
                if held >= HELD_POSTINGS:
                    _visit(parts, queries, best)
                    parts, held = [], 0
        _visit(parts, queries, best)
        sizes = [len(d) for d, _ in best.found]
        if sum(sizes):
            columns = [np.repeat(np.arange(queries.n), sizes), *(np.concatenate([x[i] for x in best.found]) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])
        release()

    return index.mapInArrow(run, "item long, doc_id long, score long")


def weight_of(n: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))))


def _groups(asked: DataFrame) -> Iterator[list[tuple]]:
    """Items with their terms in groups of about GROUP_TERMS terms; one group is on the driver at a time."""
    group, size = [], 0
    for r in asked.toLocalIterator():
        group.append((r["item_id"], r["terms"]))
        size += len(r["terms"])
        if size >= GROUP_TERMS:
            yield group
            group, size = [], 0
    if group:
        yield group


def weights(spark, n: int, frequencies: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """The weight of each of the terms that a document holds. terms: of one group."""
    mine = spark.createDataFrame(pa.table({"term": terms}))
    return {r["term"]: weight_of(n, r["df"]) for r in frequencies.join(mine, "term").collect()}


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k documents of docs (doc_id, text) with the highest scores above 0 for each of the items (item_id, text), ties to the
    smaller doc_id: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    asked = stored(query_terms(items), base, "items")
    kind = dict(items.dtypes)["item_id"]
    known = asked.select(F.explode("terms").alias("term")).distinct()
    few = known.count() <= ASKED_TERMS
    index, n, frequencies = build_index(docs, base, np.sort(known.toArrow()["term"].to_numpy()) if few else None)
    out = None
    for group in _groups(asked):
        terms = np.unique(np.concatenate([np.asarray(t, np.int64) for _, t in group]))
        found = search(index, group, weights(spark, n, frequencies, terms), k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"item long, item_id {kind}")
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
