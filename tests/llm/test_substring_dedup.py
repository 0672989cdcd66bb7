import hashlib
import random
import re

import numpy as np
import pytest

from quaystone.llm.substring_dedup import _packed_keys, levels, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    owner = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                owner[k] = min(owner.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and owner[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, n=13):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string")
    got = substring_dedup(df, n).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str)


def test_levels():
    assert levels(13) == [7, 13] and levels(50) == [7, 13, 25, 50] and levels(2) == [1, 2]


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["a", "bé", "c", "dd", "e\x0bf"]) for _ in range(60)) for _ in range(6)]
    rows = [(i, rng.choice(base)[: rng.randint(0, 200)] + "\n" + rng.choice(base)[rng.randint(0, 100) :]) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "one"), (None, base[0]), (None, None), (5, base[1]), (5, base[1]), (3, base[2] * 50), (80, " " * 30)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [2, 30])
def test_other_windows(spark, n):
    rng = random.Random(n)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(4)]
    rows = [(i, rng.choice(base)[: rng.randint(0, 240)] + " " + rng.choice(base)[2 * rng.randint(0, 100) :]) for i in range(40)]
    assert run(spark, rows, n) == brute(rows, n)


def test_packed_rows_do_not_grow_with_documents():
    rng = np.random.default_rng(1)
    for n in (1000, 50_000):
        doc, h = rng.integers(0, n, 4 * n), rng.integers(-(2**62), 2**62, 4 * n)
        packed = _packed_keys([(doc[:n], h[:n]), (doc[n:], h[n:])], 8)
        assert packed.num_rows == 8 and sum(map(len, packed.column(3).to_pylist())) == 4 * n
        assert all(sum(a) == len(b) for a, b in zip(packed.column(2).to_pylist(), packed.column(3).to_pylist(), strict=True))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_real_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)
