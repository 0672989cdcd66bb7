"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt into row blocks and queries into query blocks, each of bounded size; a task gets one of each. It turns
its candidates into postings by term (component), and term after term scatters query weight times posting weight into a dense
array of scores; partition selection keeps the k best of the block, and the blocks' lists are merged by rank. Nothing is
broadcast, and a block's memory doesn't depend on the size of the table.

Cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id; vectors of
different lengths meet on the components that both have; vec_id is a key: rows that repeat one with an equal vector count
once, with different vectors the smallest (as an array) counts; a score that doesn't fit a long is held at its limit; an
empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK, QUERIES_PER_BLOCK, TILE, ROW_TILE = 8192, 1024, 64, 512
_FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in the narrowest kind that holds all; short vectors end in zeros."""
    column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    most = np.abs(flat).max(initial=0)
    kind = np.int64 if most < 2**62 else object
    values = flat.astype(np.int64) if kind is np.int64 else np.array([int(x) for x in flat], object)
    out = np.zeros((len(size), int(size.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def _block(k: int, scale: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, weights = ids[order], _matrix(rows.column("vector"), scale)[order]
        asked, query = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), scale)
        terms = min(weights.shape[1], query.shape[1])
        bound = int(np.abs(weights).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, terms)
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
        weights, query = weights[:, :terms].astype(kind), query[:, :terms].astype(kind)
        # Postings of a term that most rows have are the column itself; of the others, places and weights.
        filled = [np.flatnonzero(weights[:, t]) for t in range(terms)]
        columns = np.ascontiguousarray(weights.T)
        found, part = [], np.empty((TILE, ROW_TILE), kind)
        for at in range(0, len(asked), TILE):
            mine = np.ascontiguousarray(query[at : at + TILE].T)
            score = np.zeros((mine.shape[1], len(ids)), kind)
            asking = [np.flatnonzero(mine[t]) for t in range(terms)]
            for lo in range(0, len(ids), ROW_TILE):
                own = score[:, lo : lo + ROW_TILE]
                buffer = part[: own.shape[0], : own.shape[1]]
                for t in range(terms):
                    if 2 * len(filled[t]) > len(ids) and 2 * len(asking[t]) > own.shape[0]:
                        np.multiply(mine[t][:, None], columns[t, lo : lo + ROW_TILE], out=buffer)
                        own += buffer
            for t in range(terms):
                if len(filled[t]) and len(asking[t]) and not (2 * len(filled[t]) > len(ids) and 2 * len(asking[t]) > score.shape[0]):
                    score[np.ix_(asking[t], filled[t])] += mine[t, asking[t]][:, None] * columns[t, filled[t]]
            if kind is object:
                score = np.clip(score, -(2**63), 2**63 - 1).astype(np.int64)
            for j, value in enumerate(score):
                # One more than k, as the query's own row may be among them.
                if len(value) > k + 1:
                    least = np.partition(value, len(value) - k - 1)[len(value) - k - 1]
                    some = np.flatnonzero(value >= least)
                else:
                    some = np.arange(len(value))
                # Ids ascend, and the sort of the reversed rows is stable: ties go to the smaller id.
                some = some[::-1][np.argsort(value[some][::-1], kind="stable")][::-1]
                some = some[ids[some] != asked[at + j]][:k]
                found.append((np.full(len(some), asked[at + j]), ids[some], value[some].astype(np.int64)))
        return pa.table({name: pa.array(np.concatenate([x[i] for x in found]), pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """For each row of vectors (vec_id, embedding) where the column `is_query` holds, the k rows with other ids and the highest
    inner product of floor(scale * x), ties to the smaller vec_id: query_id, rank (from 1), vec_id, score."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector") if dict(vectors.dtypes)["embedding"] == "array<float>" else vector.alias("vector"), is_query.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "asked")).alias("v")).select("vec_id", "v.vector", "v.asked")
    counts = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    n_rows, n_queries = max(1, -(-counts[0] // rows_per_block)), max(1, -(-counts[1] // queries_per_block))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "vector", deal(n_rows, 1).alias("r"), every(n_queries).alias("q"))
    right = rows.filter("asked").select("vec_id", "vector", deal(n_queries, 2).alias("q"), every(n_rows).alias("r"))
    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(_block(k, scale), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
