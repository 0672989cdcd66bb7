import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaystone.llm import minhash_dedup as m
from quaystone.llm.components import connected
from quaystone.llm.common import shared_dir
from quaystone.llm.minhash_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            n = len(x & y)
            if x and 100 * n >= percent * (len(x) + len(y) - n) and a is not None and b is not None:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def run(spark, rows, percent=85):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rep int")
    return sorted(tuple(r) for r in near_duplicates(df, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"W{rng.randrange(5000)}" for _ in range(120)] for _ in range(3)]
    rows = [(i, edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3, 4]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  B"), (204, "a b c"), (205, " \n\t"), (206, " ".join(base[0]).upper())]
    long = [f"L{rng.randrange(10**6)}" for _ in range(20_000)]
    rows += [(300, " ".join(long)), (301, edited(rng, long, 200)), (302, edited(rng, long, 2000)), *rows[:9]]  # very long texts, repeated rows
    assert run(spark, rows) == brute(rows, 85)


def test_chains_in_one_bucket(spark):
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(400):
        if i % 40 == 0:
            words = [f"w{rng.randrange(10**6)}" if k % 13 == i % 13 else x for k, x in enumerate(words)]
        else:
            words[rng.randrange(200)] = f"v{i}"
        rows.append((1000 - i, " ".join(words)))
    assert run(spark, rows, 80) == brute(rows, 80)


def test_near_misses_in_one_bucket(spark):
    """Many documents a little too far from one another, and a few that are near enough: complete search by sketches and sets."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(260)]
    rows = [(i, edited(rng, base, rng.choice([2, 5, 7, 8, 9, 10]))) for i in range(700)]
    assert run(spark, rows) == brute(rows, 85)


def test_blocks_of_many_shingles_are_searched_in_parts(spark, monkeypatch):
    """Blocks whose sets are too much for one task: same links, and no search holds many more shingles than the bound."""
    monkeypatch.setattr(m, "ITEMS", 5_000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(260)]
    rows = [(i, edited(rng, base, rng.choice([2, 5, 7, 8, 9, 10]))) for i in range(400)]
    assert run(spark, rows) == brute(rows, 85)
    members = [(1, 0, 0, False, 0, r, r, 250) for r in range(300)] + [(2, 0, 1, True, 1 + r % 2, r, r, 9) for r in range(40)]
    df = spark.createDataFrame(members, "bucket long, p int, q int, cored boolean, side int, rep long, label long, n_shingles long")
    together = {}
    for r in m._in_parts(df, m.MEMBER[:4]).collect():
        together.setdefault((r.bucket, r.low, r.high), set()).add(r.rep)
    assert together.pop((2, 0, 0)) == set(range(40))
    assert len(together) > 100 and max(map(len, together.values())) * 250 <= 2 * m.ITEMS
    assert {(a, b) for reps in together.values() for a in reps for b in reps} == {(a, b) for a in range(300) for b in range(300)}


def test_sketches_leave_out_far_members_only():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in np.where(rng.random(300) < share, rng.integers(0, 10**6, 300), np.arange(300))) for share in (0.0, 0.002, 0.005, 0.3, 0.9, 0.95)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    signed = next(m._signatures(iter([batch])))
    zero = pa.array([0] * 6, pa.int32())
    group = pa.table([pa.array([1] * 6, pa.int64()), zero, zero, pa.array([False] * 6), zero, pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), signed.column(5)], [*m.MEMBER, "sketch"])
    assert m._sketch_block(75)(group).column("rep").to_pylist() == [0, 1, 2]
    one = group.set_column(6, "label", pa.array([0] * 6, pa.int64()))
    assert m._sketch_block(75)(one).num_rows == 0


def test_parities_leave_out_near_misses_and_no_link():
    """Full sets go to a block only for members that can be linked: not for a group of documents just too far from one another."""
    rng = random.Random(12)
    far, near, long = ([f"{k}{i}" for i in range(n)] for k, n in (("f", 260), ("n", 260), ("l", 4000)))
    texts = [edited(rng, far, 8) for _ in range(60)] + [edited(rng, near, 2) for _ in range(20)] + [edited(rng, long, 20) for _ in range(3)]
    texts += [" ".join(near[: 60 + k]) for k in range(0, 130, 10)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], ["doc_id", "text"])
    sets, signed = next(m._full_sets(iter([batch]))), next(m._signatures(iter([batch])))
    zero, ids = pa.array([0] * n, pa.int32()), pa.array(range(n), pa.int64())
    group = pa.table([pa.array([1] * n, pa.int64()), zero, zero, pa.array([False] * n), zero, ids, ids, sets.column(1), signed.column(5), sets.column(2)], [*m.MEMBER, "n_shingles", "sketch", "parity"])
    parities = [np.array(x, np.int64).view(np.uint64) for x in sets.column(2).to_pylist()]
    full, (a, b) = [shingle_set(t) for t in texts], np.triu_indices(n, 1)
    apart = np.array([len(full[i] ^ full[j]) for i, j in zip(a, b, strict=True)])
    assert (m._differing(parities, a, b) <= apart).all() and len(set(map(len, parities))) > 2
    linked = {x for i, j, d in zip(a.tolist(), b.tolist(), apart.tolist(), strict=True) if 185 * d <= 15 * (len(full[i]) + len(full[j])) for x in (i, j)}
    got = set(m._sketch_block(256, 85)(group).column("rep").to_pylist())
    assert linked <= got and {*range(60, 83)} <= linked and len(got & {*range(60)} - linked) <= 5


def test_null_ids_and_empty(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()} == {(None, None, True), (3, 3, True)}


def test_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows, 85)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = connected(spark.createDataFrame(pairs, "a long, b long"), shared_dir(spark), "t")
    assert {(r.node, r.label) for r in got.collect()} == {(x, find(x)) for x in root}
    assert connected(spark.createDataFrame([], "a long, b long"), shared_dir(spark), "t").filter(F.lit(True)).count() == 0
