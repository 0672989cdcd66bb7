"""Near-duplicate documents by MinHash, with odd sketches between the band join and the exact check.

1. Each document gives 128 MinHash values of its set of 5-word shingles. 32 bands of 4 values are the join keys; all values,
   folded into a bitmap of 512 parities, are its odd sketch.
2. Documents with equal sets are one class; from here on a class is its smallest doc_id.
3. In each band bucket the smallest member is paired with every other. The popcount of the XOR of two odd sketches estimates
   the similarity; pairs that may reach the threshold are checked on full shingle sets.
4. Buckets that still hold several components are searched completely, in blocks of members. Their odd sketches tell which
   members of a block may be linked with one of another component, and so do parities of their full sets: two sets differ in as
   many shingles at least as their parities differ in bits. The full sets of members that are left, and only those, go into the
   block and settle it. A block whose sets have more than ITEMS shingles is searched by pairs of its parts, so long texts don't add up in a
   task. Only links that join components leave a block, so no task emits all pairs of a group.
5. Connected components of the links give each document the smallest doc_id that it reaches.

A pair at the threshold of 0.85 misses all bands with a chance of 6e-11, at 0.8 of 5e-8.

Cases: a very long text is in a part with others, whose sets have about ITEMS / 2 shingles with it; a document without words (or null text) has an empty set and no links; one with fewer than 5 words has one shingle, the
whole sequence; a null doc_id has no links and a null component_id, and is kept. doc_id is a key: rows that repeat one are
judged each on its text. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import lists, mix, pieces, shared_dir, shingles, stored, string_buffer, text_of, words
from quaystone.llm.components import connected

SHINGLE, BANDS, ROWS, BITS, BLOCK = 5, 32, 4, 512, 1024
SAMPLES = BANDS * ROWS
#: Shingles of the full sets that are searched together; blocks of longer texts are searched in parts.
ITEMS = 2_000_000
#: Words of 64 parities of a full set at most.
PARITY = 512
#: Columns of a member of a block: the block (bucket, parts p and q of it, whether q is of the largest component), side and node.
MEMBER = ["bucket", "p", "q", "cored", "side", "rep", "label"]
_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_B = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, _, _, bounds = words(*string_buffer(batch.column(batch.schema.get_field_index("text"))), lower=True)
    whole = shingles(h, SHINGLE)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(whole[a : b - SHINGLE + 1])
        elif b > a:
            yield shingles(h[a:b], b - a, seed=1000 + b - a)
        else:
            yield whole[:0]


def _minima(values: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 256):
        np.minimum(out, (values[at : at + 256, None] * _A + _B).min(axis=0), out=out)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(99))
    for batch in pieces(batches, limit=4 << 20):
        n = batch.num_rows
        size, first, second, least = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, SAMPLES), np.uint64)
        for i, values in enumerate(_sets(batch)):
            size[i] = len(values)
            if len(values):
                first[i] = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum()
                second[i] = np.bitwise_xor.reduce(mix(values + np.uint64(0x14057B7EF767814F)))
                least[i] = _minima(values)
        bands = mix((least.reshape(n, BANDS, ROWS) * _A[:ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bit = (mix(least ^ salt) & np.uint64(BITS - 1)).astype(np.int64) + np.arange(n)[:, None] * BITS
        odd = (np.bincount(bit.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
        sketch = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
        columns = [
            batch.column(batch.schema.get_field_index("doc_id")), pa.array(size), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
            lists(bands.view(np.int64).ravel(), np.arange(n + 1) * BANDS, pa.int64()), lists(sketch.ravel(), np.arange(n + 1) * (BITS // 64), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "sig_a", "sig_b", "bands", "sketch"])


def _parity(values: np.ndarray) -> np.ndarray:
    """Parities of the numbers of items with equal last bits of their hashes, about two or more an item, up to PARITY words."""
    wide = min(PARITY, max(8, 1 << (2 * len(values) // 64).bit_length()))
    bit = (mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(64 * wide - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * wide) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=4 << 20):
        sets = list(_sets(batch))
        parity, size = [_parity(x) for x in sets], np.array([len(x) for x in sets], np.int64)
        columns = [
            batch.column(0), pa.array(size), lists(np.concatenate(parity), np.cumsum([0, *map(len, parity)]), pa.int64()),
            lists(np.concatenate(sets).view(np.int64), np.append(0, np.cumsum(size)), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "parity", "items"])


def _similar(percent: int) -> Column:
    """Whether the sets x and y, which are not empty, are alike; row by row, so that memory doesn't depend on their number."""
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return 100 * both >= percent * (F.size("x") + F.size("y") - both)


def _arrays(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and their n + 1 bounds."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of incidence matrices over slices of the items."""
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.append(True, items[1:] != items[:-1])
    number = np.cumsum(new) - 1
    common = np.bincount(number) > 1
    keep = common[number]
    number, owner = (np.cumsum(common) - 1)[number[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
        a, b = np.searchsorted(number, [at, at + 8192])
        part = np.zeros((8192, len(sets)), np.float32)
        part[number[a:b] - at, owner[a:b]] = 1
        total += part.T @ part
    return total


def _apart(labels: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of a block that a link would join: of different components and, between two blocks, of different ones."""
    out = labels[:, None] != labels[None, :]
    return out & (side[:, None] != side[None, :]) if side.any() else out


def _differing(parities: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the parities of a and b differ; the longer one is folded to the length of the shorter."""
    out, wide = np.zeros(len(a), np.int64), np.array([len(x) for x in parities])
    for size in np.unique(wide).tolist():
        folded = np.array([np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) if len(x) >= size else np.zeros(size, np.uint64) for x in parities])
        pairs = np.flatnonzero(np.minimum(wide[a], wide[b]) == size)
        for some in np.array_split(pairs, -(-len(pairs) * size // (1 << 20))) if len(pairs) else []:
            out[some] = np.bitwise_count(folded[a[some]] ^ folded[b[some]]).sum(axis=1, dtype=np.int64)
    return out


def _sketch_block(most: int, percent: int = 0):
    def run(group: pa.Table) -> pa.Table:
        """Members of a block whose odd sketches are near enough to one of another component and, with percent, whose sets can be."""
        flat, _ = _arrays(group.column("sketch"))
        words_of = flat.reshape(group.num_rows, -1)
        odd = np.zeros((len(words_of), len(words_of)), np.int32)
        for k in range(words_of.shape[1]):
            odd += np.bitwise_count(words_of[:, None, k] ^ words_of[None, :, k])
        near = (odd <= most) & _apart(group.column("label").to_numpy(), group.column("side").to_numpy())
        if not percent:
            return group.drop_columns("sketch").filter(pa.array(near.any(axis=1)))
        flat, bounds = _arrays(group.column("parity"))
        a, b = np.nonzero(np.triu(near, 1))
        total = group.column("n_shingles").to_numpy()[a] + group.column("n_shingles").to_numpy()[b]
        # 100 * intersection >= percent * union, where their sum is total and their difference at least that of the parities.
        able = (100 + percent) * _differing(np.split(flat, bounds[1:-1]), a, b) <= (100 - percent) * total
        left = np.zeros(group.num_rows, bool)
        left[a[able]] = left[b[able]] = True
        return group.drop_columns(["sketch", "parity"]).filter(pa.array(left))

    return run


def _search_block(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between components inside one block, or between two blocks: each to the smallest label that it reaches there."""
        labels, side = group.column("label").to_numpy(), group.column("side").to_numpy()
        flat, bounds = _arrays(group.column("items"))
        sets = np.split(flat, bounds[1:-1])
        both = _shared_counts(sets).astype(np.int64)
        size = np.diff(bounds)
        hit = np.triu((100 * both >= percent * (size[:, None] + size[None, :] - both)) & _apart(labels, side), 1)
        i, j = np.nonzero(hit)
        names, place = np.unique(labels, return_inverse=True)
        a, b, root = place[i], place[j], np.arange(len(names))
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": pa.array(names[root[joined]], pa.int64()), "b": pa.array(names[joined], pa.int64())})

    return run


def _in_parts(blocks: DataFrame, block: list[str]) -> DataFrame:
    """Members of blocks, with columns low and high: the pair of parts of the block that they are searched in. A block of few
    shingles is one part; of one with more, every two members meet in some pair of parts."""
    wide = blocks.groupBy(*block).agg(F.sum("n_shingles").alias("total")).filter(F.col("total") > ITEMS).select(*block, F.ceil(2 * F.col("total") / ITEMS).cast("int").alias("parts"))
    found = blocks.join(wide, block, "left").withColumn("part", F.expr("int(pmod(xxhash64(rep), coalesce(parts, 1)))"))
    found = found.withColumn("other", F.explode(F.expr("IF(parts IS NULL, array(0), filter(sequence(0, parts - 1), x -> x <> part))")))
    return found.select(*MEMBER, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included) and kept (doc_id is component_id).
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    signed = stored(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, sig_a long, sig_b long, bands array<long>, sketch array<long>"), base, "signatures")
    sig = ["sig_a", "sig_b", "n_shingles"]
    classes = stored(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sig)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), base, "classes",
    )
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    # Buckets of several members; of those with the same members, one.
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("center"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.col("rep") + 1)).alias("y")).filter("n > 1")
    buckets = stored(buckets.groupBy("n", "center", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "center"), base, "buckets")
    members = stored(rows.join(buckets, "bucket"), base, "members")

    sketches = classes.select("rep", "sketch")
    odd = F.aggregate(F.zip_with("s", "t", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    # The popcount to expect 0.2 below the threshold: more than six standard deviations of the estimate.
    most = int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1.2 - percent / 100) / BITS)))
    stars = (
        members.filter("rep <> center").select("center", "rep").distinct()
        .join(sketches.select("rep", F.col("sketch").alias("s")), "rep").join(sketches.select(F.col("rep").alias("center"), F.col("sketch").alias("t")), "center")
        .filter(odd <= most).select("center", "rep")
    )
    stars = stored(stars, base, "stars")
    needed = stored(members.filter("n > 2").select(F.col("rep").alias("doc_id")).union(stars.select("rep")).union(stars.select("center")).distinct(), base, "needed")
    sets = stored(docs.join(needed, "doc_id").select("doc_id", "text").mapInArrow(_full_sets, "doc_id long, n_shingles long, parity array<long>, items array<long>"), base, "sets")
    pairs = (
        stars.join(sets.select(F.col("doc_id").alias("rep"), F.col("items").alias("y")), "rep")
        .join(sets.select(F.col("doc_id").alias("center"), F.col("items").alias("x")), "center").select(F.col("center").alias("a"), F.col("rep").alias("b"), "x", "y")
    )
    links = stored(pairs.filter(_similar(percent)).select("a", "b"), base, "links")
    labels = connected(links, base, "first")

    # Complete search of buckets that still hold several components.
    named = members.filter("n > 2").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = stored(named, base, "named")
    core = F.count_if(F.col("label") == F.col("center_label"))
    centers = labels.select(F.col("node").alias("center"), F.col("label").alias("center_label"))
    named = named.join(centers, "center", "left").withColumn("center_label", F.coalesce("center_label", "center"))
    mixed = named.groupBy("bucket").agg(F.ceil(core / BLOCK).cast("int").alias("cores"), F.ceil((F.count("*") - core) / BLOCK).cast("int").alias("rests")).filter("rests > 0")
    mixed = stored(mixed, base, "mixed")
    if mixed.limit(1).count():
        placed = named.join(mixed, "bucket").withColumn("is_core", F.col("label") == F.col("center_label"))
        rest = placed.filter("NOT is_core").withColumn("blk", F.expr("int(pmod(xxhash64(rep), rests))"))
        cores = placed.filter("is_core").withColumn("blk", F.expr("int(pmod(xxhash64(rep), cores))"))
        inner = rest.withColumn("other", F.explode(F.expr("sequence(0, rests - 1)"))).select(
            "bucket", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), F.lit(False).alias("cored"), F.expr("IF(blk = other, 0, IF(blk < other, 1, 2))").alias("side"), "rep", "label")
        left = rest.withColumn("q", F.explode(F.expr("sequence(0, cores - 1)"))).select("bucket", F.col("blk").alias("p"), "q", F.lit(True).alias("cored"), F.lit(1).alias("side"), "rep", "label")
        right = cores.withColumn("p", F.explode(F.expr("sequence(0, rests - 1)"))).select("bucket", "p", F.col("blk").alias("q"), F.lit(True).alias("cored"), F.lit(2).alias("side"), "rep", "label")
        block = MEMBER[:4]
        sized = sketches.join(sets.select(F.col("doc_id").alias("rep"), "n_shingles", "parity"), "rep")
        drawn = inner.unionByName(left).unionByName(right).join(sized, "rep").select(*MEMBER, "n_shingles", "sketch", "parity").groupBy(*block).applyInArrow(
            _sketch_block(most, percent), "bucket long, p int, q int, cored boolean, side int, rep long, label long, n_shingles long")
        blocks = _in_parts(stored(drawn, base, "blocks"), block).join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
        more = blocks.groupBy(*block, "low", "high").applyInArrow(_search_block(percent), "a long, b long")
        more = stored(more.distinct(), base, "more-links")
        if more.limit(1).count():
            labels = connected(links.unionByName(more), base, "second")
    homes = classes.select(*sig, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*sig, F.coalesce("label", "rep").alias("home"))
    joined = signed.select("doc_id", *sig).join(homes, sig, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
