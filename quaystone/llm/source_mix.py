"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded order, are cut into blocks. With weight w, block k of a source is released at slot
floor(k / w) and due by slot ceil((k + 1) / w); at each slot the released block with the earliest deadline goes out. At any
slot each source has then had less than one block more or less than its weight asks for. Weights are not rounded: they become
whole units by their exact fractions. When a source runs out, the others go on with their weights scaled up (a new phase).

The schedule is cut into stretches of slots that tasks walk apart from each other: the blocks that are placed before any slot
follow from the weights (`placed`), so no task walks what is before its stretch. The driver has counts by source and finds the end
of each phase; it sees neither blocks nor slots one by one.

Cases: a null source is a source; sources without a target weight get none of the schedule's rounds and follow in a last phase
by their counts; rows that repeat a document are each mixed; empty tables give empty tables; all documents stay. Other columns
stay, but for those whose names begin with mix_, which are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_DOCS, SEED = 16, 17
#: Rows of a source that are ranked together.
RANK_ROWS = 5_000
#: Sources of several ranges that every task is told of, at most; more are joined.
LISTED = 100_000
#: Releases and deadlines of sources with next to no weight end here.
FAR = 1 << 62
#: Slots of a stretch of the schedule, slots that the driver walks to find the end of a phase, and slots looked back on at a time.
STRETCH, WALK, LOOK = 1 << 16, 1 << 12, 1 << 22
MOST_TASKS = 2_000
BLOCK_COLUMNS = ["mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline"]


def whole_units(weights: Mapping, total: int) -> dict:
    """Weights as whole units that sum to `total` or to a little more: each source has one at least (largest remainders)."""
    total = max(total, len(weights))
    scale = sum(weights.values())
    exact = {s: w / scale * total for s, w in weights.items()}
    units = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: max(0, total - sum(units.values()))]:
        units[s] += 1
    return units


def exact_units(weights: Mapping) -> dict:
    """Weights as whole units in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def multiples(k: np.ndarray, size: int, unit: int, less: int = 0) -> np.ndarray:
    """floor((k * size - less) / unit) of ascending k, exactly whatever the size of the units, but at most FAR."""
    most = max(1, int(k[-1])) if len(k) else 1
    if most * size < FAR:
        return (k * size - less) // unit
    exact = lambda i: min(FAR, (int(i) * size - less) // unit)
    whole, part = divmod(size, unit)
    if most >> 40 or most * (whole + 1) >= FAR:
        return np.array([exact(i) for i in k], np.int64)
    # Doubles tell the quotient unless it is next to a whole number.
    parts = k * (part / unit)
    out = k * whole + np.floor(parts).astype(np.int64)
    unsure = np.flatnonzero(np.abs(parts - np.rint(parts)) < 1e-3)
    out[unsure] = [exact(i) for i in k[unsure]]
    return out


def placed(t: int, units: list[int]) -> list[int]:
    """Blocks of each source that are placed before slot t of a phase, without a walk to t.

    Earliest deadline first has placed all blocks due by t, and of those released before t and due later as many as there are
    slots left: in their order, each that still fits. A choice fits if from no slot a on it holds more blocks released at a
    or later than there are slots from a to t for them. That looks back to the release of the oldest of those blocks.
    """
    size = sum(units)
    base = [t * u // size for u in units]
    rest = t - sum(base)
    if not rest:
        return base
    later = [i for i, u in enumerate(units) if t * u % size]
    released = [base[i] * size // units[i] for i in later]
    points = np.unique(released)
    low, room, taken = int(points[0]), np.full(len(points), FAR), 0
    for end in range(int(t), low, -LOOK):
        begin = max(low, end - LOOK)
        near = [multiples(np.arange(-(-begin * u // size), min(base[i], -(-end * u // size))), size, u) for i, u in enumerate(units)]
        counts = np.bincount(np.concatenate(near) - begin, minlength=end - begin)
        slots = np.arange(begin, end)
        free = t - slots - taken - np.cumsum(counts[::-1])[::-1]
        inside = slots <= points[-1]
        np.minimum.at(room, np.searchsorted(points, slots[inside]), free[inside])
        taken += int(counts.sum())
    at = np.searchsorted(points, released).tolist()
    for _, _, i, j in sorted((-(-(base[i] + 1) * size // units[i]), r, i, j) for i, r, j in zip(later, released, at, strict=True)):
        if room[: j + 1].min() > 0:
            room[: j + 1] -= 1
            base[i] += 1
            rest -= 1
            if not rest:
                break
    return base


def walk(units: list[int], done: list[int], t: int, end: int | None = None, left: list[int] | None = None) -> np.ndarray:
    """Sources of the slots from t on, by earliest deadline among the released; ties to the longer-waiting, then to the first
    by name. `done` are the blocks placed before t; it ends before slot `end`, or when a source has had all it has left."""
    size, done = sum(units), list(done)
    ready, waiting, order = [], {}, []
    for i, u in enumerate(units):
        waiting.setdefault(max(t, done[i] * size // u), []).append(i)
    while end is None or t < end:
        for i in waiting.pop(t, ()):
            k, u = done[i], units[i]
            heapq.heappush(ready, (-(-(k + 1) * size // u), k * size // u, i))
        _, _, i = heapq.heappop(ready)
        order.append(i)
        done[i] += 1
        t += 1
        if left is not None and done[i] == left[i]:
            break
        waiting.setdefault(max(t, done[i] * size // units[i]), []).append(i)
    return np.array(order, np.int64)


def each_phase(blocks: list[int], units: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """Until all blocks are placed: a phase's first slot, its length and the blocks placed before it. A phase ends when a source
    runs out. Its end is found by halves and a short walk, so the time grows with the sources and not with the blocks."""
    used, slot = [0] * len(blocks), 0
    while live := [i for i, n in enumerate(blocks) if n > used[i]]:
        own, left = [units[i] for i in live], [blocks[i] - used[i] for i in live]
        size = sum(own)
        low = min((n - 1) * size // u for n, u in zip(left, own, strict=True))
        high = min(-(-n * size // u) for n, u in zip(left, own, strict=True))
        while high - low > WALK:
            middle = (low + high) // 2
            over = any(x >= n for x, n in zip(placed(middle, own), left, strict=True))
            low, high = (low, middle) if over else (middle, high)
        done = placed(low, own)
        order = walk(own, done, low, left=left)
        yield slot, low + len(order), used
        more = np.bincount(order, minlength=len(live)).tolist()
        used = list(used)
        for i, x, y in zip(live, done, more, strict=True):
            used[i] += x + y
        slot += low + len(order)


def stretch_rows(blocks: list[int], units: list[int], group: int = 0, start: int = 0) -> Iterator[dict]:
    """Parts of the schedule that are worked out apart from each other: slots from begin to end of the phase that starts at slot."""
    for slot, length, used in each_phase(blocks, units):
        live = [u for u, n, x in zip(units, blocks, used, strict=True) if n > x]
        step = max(STRETCH, -(-sum(live) // min(live)))  # no shorter than what its state looks back on
        for begin in range(0, length, step):
            yield {"group": group, "slot": start + slot, "begin": begin, "end": min(length, begin + step), "used": np.array(used, np.int64).tobytes()}


def stretch_table(row: dict, names: list[str], blocks: list[int], units: list[int]) -> Iterator[pa.RecordBatch]:
    """Each block of a stretch: source, number, slot, release and deadline; the slots of all phases count from 0. It walks in
    short pieces, so memory doesn't grow with the stretch."""
    used = np.frombuffer(row["used"], np.int64).tolist()
    live = [i for i, n in enumerate(blocks) if n > used[i]]
    own, slot = [units[i] for i in live], row["slot"]
    size, done = sum(own), placed(row["begin"], own)
    for begin in range(row["begin"], row["end"], STRETCH):
        order = walk(own, done, begin, min(row["end"], begin + STRETCH))
        by_source = np.argsort(order, kind="stable")
        counts = np.bincount(order, minlength=len(live))
        columns, ends = [], np.cumsum(counts).tolist()
        for j, n in enumerate(counts.tolist()):
            if n:
                k = np.arange(done[j], done[j] + n)
                due = np.minimum(FAR - slot, multiples(k + 1, size, own[j], 1) + 1)
                columns.append((k + used[live[j]], slot + begin + by_source[ends[j] - n : ends[j]], slot + np.minimum(FAR - slot, multiples(k, size, own[j])), slot + due))
                done[j] += n
        whole = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*columns, strict=True)]
        source = pa.array(np.repeat([names[i] for i in live], counts).tolist(), pa.string())
        yield pa.RecordBatch.from_arrays([source, *whole], BLOCK_COLUMNS)


def scheduled(spark: SparkSession, groups: list[tuple[dict, dict]]) -> DataFrame:
    """The slot of each block, in tasks: groups of sources follow one another, each by the blocks and units of its sources."""
    listed, rows, start = [], [], 0
    for number, (blocks, units) in enumerate(groups):
        names = sorted(blocks)
        listed.append((names, [blocks[s] for s in names], [units[s] for s in names]))
        rows += stretch_rows(*listed[-1][1:], number, start)
        start += sum(blocks.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from stretch_table(row, *listed[row["group"]])

    plan = spark.createDataFrame(rows, "group int, slot long, begin long, end long, used binary")
    return plan.repartition(min(MOST_TASKS, max(1, -(-start // STRETCH)))).mapInArrow(run, f"mix_source string, {', '.join(f'{c} long' for c in BLOCK_COLUMNS[1:])}")


def mixed(docs: DataFrame, weights: Mapping | None = None, power: float = 0.5, block_docs: int = BLOCK_DOCS, units: int | None = None, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """docs with mix_block (number within the source), mix_release and mix_deadline (slots of its phase), mix_slot and
    mix_place (place in the block). Ordered by (mix_slot, mix_place), sources follow their weights.

    weights: source to weight; by default the source's count to the given power. units: round the weights to about so many
    units of a round, with one at least for each source; by default they are kept as they are. key: what the seeded order within a source
    hashes (doc_id, if there is one).
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    named = docs.select(*kept, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("mix_source"))
    counts = {r[0]: r[1] for r in named.groupBy("mix_source").count().collect()}  # one row a source
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    if weights is None:
        first, rest = {s: n**power for s, n in counts.items()}, {}
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items() if w > 0}
        first = {s: given[s] for s in counts if s in given}
        rest = {s: float(n) for s, n in counts.items() if s not in given}
    planned = [({s: blocks[s] for s in group}, whole_units(group, units) if units else exact_units(group)) for group in (first, rest) if group]
    slots = scheduled(spark, planned)

    # Rank within a source in two levels, so that no task sorts a whole source: ranges of the hash, then places in a range.
    whole = F.xxhash64(F.lit(seed), *kept)
    hashed = F.xxhash64(F.lit(seed), key) if key is not None else F.when(F.col("doc_id").isNull(), whole).otherwise(F.xxhash64(F.lit(seed), "doc_id")) if "doc_id" in kept else whole
    # Every source is cut into ranges of its own number, so those of a hot one are no larger than others. Only sources of
    # several ranges are listed, and there are no more of them than ranges.
    large = [(s, -(-n // RANK_ROWS)) for s, n in counts.items() if n > RANK_ROWS]
    cuts = spark.createDataFrame(large, "mix_source string, mix_ranges long")
    cuts = F.broadcast(cuts) if len(large) <= LISTED else cuts
    ranged = lambda df: df.join(cuts, "mix_source", "left").withColumn("mix_range", F.expr("pmod(mix_hash, coalesce(mix_ranges, 1))")).drop("mix_ranges")
    # What a range needs to know, one row each: how many rows are before it, and the slots of its blocks.
    sizes = ranged(named.select("mix_source", hashed.alias("mix_hash"))).groupBy("mix_source", "mix_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("mix_before", before).withColumn("mix_block", F.explode(F.expr(f"sequence(mix_before div {block_docs}, (mix_before + n - 1) div {block_docs})")))
    own = F.struct("mix_block", "mix_release", "mix_deadline", "mix_slot")
    ranges = sizes.join(slots, ["mix_source", "mix_block"]).groupBy("mix_source", "mix_range").agg(F.min("mix_before").alias("mix_before"), F.sort_array(F.collect_list(own)).alias("mix_own"))
    # The rows move once, for their rank in the range; the ranges meet them there.
    ranked = ranged(named.withColumn("mix_hash", hashed))
    ranked = ranked.withColumn("mix_rank", F.row_number().over(Window.partitionBy("mix_source", "mix_range").orderBy("mix_hash"))).join(ranges, ["mix_source", "mix_range"])
    rank = F.col("mix_before") + F.col("mix_rank") - 1
    block = F.col("mix_own")[(F.floor(rank / block_docs) - F.floor(F.col("mix_before") / block_docs)).cast("int")]
    placed = ranked.select(*kept, block.alias("mix_own"), F.pmod(rank, F.lit(block_docs)).cast("int").alias("mix_place"))
    return placed.select(*kept, "mix_own.mix_block", "mix_own.mix_release", "mix_own.mix_deadline", "mix_own.mix_slot", "mix_place")
