import math
import random
import re
from collections import Counter

import numpy as np

from quaystone.llm import lexical_search as ls
from quaystone.llm.lexical_search import ranked

DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=50):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        scores = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in words if b[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, term int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in ranked(d, q, **more).collect()), key=str)


def made(seed=3):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(40)] + ["THE", "the", "Éa", "éa", "x_y", "a-b", "中文", "9"]
    weights = [1 / (i + 1) for i in range(len(some))]
    docs = [(i, " ".join(rng.choices(some, weights, k=rng.choice([0, 1, 5, 30, 31, 200])))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)] + [(5, "w1 w2 again"), (None, "w1 w1 w30"), (300, None), (301, ""), (302, "?! ..\n"), (303, "w39 " * 5000)]
    items = [(i, " ".join(rng.choices(some, k=rng.choice([1, 4, 12])))) for i in range(25)] + [(3, "w30"), (None, "w5 w6"), (90, None), (91, "..."), (92, "unheard of")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = made()
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_small_parts_groups_and_a_whole_index(spark, monkeypatch):
    docs, items = made(4)
    monkeypatch.setattr(ls, "PART_DOCS", 7)
    monkeypatch.setattr(ls, "PART_POSTINGS", 40)
    monkeypatch.setattr(ls, "HELD_POSTINGS", 500)
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(ls, "GROUP_TERMS", 20)
    monkeypatch.setattr(ls, "ASKED_TERMS", 5)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [], []) == []


def test_index_rows_hold_one_stratum_and_order_postings_by_tf(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    index, n, _ = ls.build_index(docs, str(tmp_path))
    length = {r.doc_id: len(terms(r.text)) for r in docs.collect()}
    total = sum(length.values())
    bag = {r.doc_id: Counter(terms(r.text)) for r in docs.collect()}
    seen = Counter()
    for r in index.collect():
        assert {50 + 50 * length[d] * n // total for d in r.docs} == {r.m}
        at = group = 0
        for g in r.groups:
            assert r.tfs[group : group + g] == sorted(r.tfs[group : group + g])
            for tf, size in zip(r.tfs[group : group + g], r.sizes[group : group + g], strict=True):
                for p in r.places[at : at + size]:
                    seen[r.docs[p], tf] += 1
                at += size
            group += g
    assert seen == Counter((d, tf) for d, b in bag.items() for tf in b.values())


def test_low_bounds_are_not_visited(monkeypatch):
    """Of two strata, the one whose bound can't reach the k-th best score isn't added up."""
    queries = ls._Queries([np.array([1, 2])], {1: 1000, 2: 1000})

    def part(m, docs, tf):
        row = dict(zip(["m", "docs", "terms", "groups", "tfs", "sizes", "places"], ls._part(m, np.array(docs), np.arange(len(docs)), np.ones(len(docs), int), np.full(len(docs), tf)), strict=True))
        return ls._Part(row, queries.vocabulary, queries.weights)

    low, high = part(5000, [1, 2], 1), part(50, [3, 4, 5], 9)
    best, added = ls._Best(1, 2), []
    monkeypatch.setattr(best, "add", lambda q, d, s, f=best.add: (added.append(d.tolist()), f(q, d, s)))
    ls._visit([low, high], queries, best)
    assert added == [[3, 4, 5]] and best.found[0][0].tolist() == [3, 4]


def test_real_rows(spark):
    docs, items = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    got = sorted((tuple(r) for r in ranked(docs, items).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
