import random

import numpy as np
import pyarrow as pa

from quaystone.llm import decontaminate as d
from quaystone.llm.decontaminate import common_subsequence, contaminated


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
    return out


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert common_subsequence(np.array(a, np.uint16), np.array(b, np.uint16)) == lcs(a, b)


def test_verbatim_paraphrase_and_clean(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(12, 60))) for i in range(20)]
    rows, want = [], set()
    for i in range(300):
        body = text(rng.randint(30, 300)).split()
        if i % 10 == 0:
            k = i // 10 % 20
            own = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: every sixth word changed, but for the answer
                own = [w if (j % 6 or j >= len(own) - 5) else rng.choice(vocab) for j, w in enumerate(own)]
            at = rng.randint(0, len(body))
            body[at:at] = " ".join(own).upper().split() if i % 30 == 0 else own
            want.add((i, k))
        rows.append((i, " ".join(body)))
    rows += [(1000, None), (1001, ""), (None, items[3][1]), (1002, "word " * 5000 + items[4][1]), (1003, items[5][1]), (1003, items[5][1] + " " + items[6][1])]
    want |= {(None, 3), (1002, 4), (1003, 5), (1003, 6)}
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "a b c d")], "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.lcs_words >= 0.5 * r.item_words for r in got)


def test_common_subsequences_of_many_pairs():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 9, n).astype(np.uint32) for n in (1, 5, 13, 64, 65, 130, 200)]
    ids = rng.integers(0, 14, 4000).astype(np.uint32)
    known = np.unique(np.concatenate(items))
    masks, full = d.item_masks(items, known)
    item, lo = rng.integers(0, len(items), 300), rng.integers(0, 3500, 300)
    hi = lo + rng.integers(0, 400, 300)
    got = d.common_subsequences(masks, full, item, lo, hi, d.known_words(ids, known))
    assert got.tolist() == [common_subsequence(items[i], ids[a:b]) for i, a, b in zip(item, lo, hi, strict=True)]


def test_places_covered_bound_common_subsequences():
    """Against sets of words, for items of one and of several words of bits, with words of many and of few items."""
    rng = np.random.default_rng(6)
    for count in (7, 100):
        items = [np.where(rng.random(n) < 0.3, rng.integers(0, 5, n), rng.integers(5, 900, n)).astype(np.uint32) for n in rng.integers(1, 90, count)]
        ids = np.where(rng.random(3000) < 0.4, rng.integers(0, 5, 3000), rng.integers(5, 1200, 3000)).astype(np.uint32)
        known = np.unique(np.concatenate(items))
        masks, full = d.item_masks(items, known)
        numbers = d.known_words(ids, known)
        ids, numbers = ids[numbers > 0], numbers[numbers > 0]
        item, lo = rng.integers(0, count, 400), rng.integers(0, len(ids), 400)
        hi = np.minimum(lo + rng.integers(0, 200, 400), len(ids))
        got = d.Places(masks).covered(item, lo, hi, numbers)
        want = [int(np.isin(items[i], ids[a // d.RUNS * d.RUNS : -(-b // d.RUNS) * d.RUNS]).sum()) if b > a else 0 for i, a, b in zip(item, lo, hi, strict=True)]
        assert got.tolist() == want
        assert (got >= d.common_subsequences(masks, full, item, lo, hi, numbers)).all()


def test_few_pairs_are_compared(monkeypatch):
    """Every passage is a candidate for every item, but only pairs that can be long enough are compared; none that counts is lost."""
    rng = random.Random(29)
    text = lambda n: [f"c{rng.randrange(40)}" if rng.random() < 0.4 else f"r{rng.randrange(3000)}" for _ in range(n)]
    items, docs = [(i, text(rng.randint(16, 60))) for i in range(40)], []
    for i in range(60):
        own = [w if rng.random() < 0.6 else f"x{j}" for j, w in enumerate(items[i % 40][1])]
        docs.append((i, " ".join(text(150) + own * (i % 2) + text(100))))
    block = next(d._item_blocks(iter([{"item_id": i, "text": " ".join(w), "answer": ""} for i, w in items]), False))
    noise = np.random.default_rng(1).normal(size=(d.WORDS, 4)).astype(np.float32)

    class Model:
        value = block | {"vectors": np.ones((40, 4), np.float32), "owner": np.arange(40), "table": noise}

    seen, compare = [], d.common_subsequences
    monkeypatch.setattr(d, "COSINE", -9.0)
    monkeypatch.setattr(d, "common_subsequences", lambda *a: seen.append(len(a[2])) or compare(*a))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    tokenized = list(d._tokenize(iter([batch])))
    got = {(r["doc_id"], r["item_id"]) for b in d._search(Model)(iter(tokenized)) for r in b.to_pylist()}
    assert got == by_definition(docs, [(i, " ".join(w)) for i, w in items]) and len(got) > 20
    passages = sum(len(d._overlapping(bounds)[0]) for _, _, bounds in d._parts(iter(tokenized)))
    assert 0 < sum(seen) < 0.1 * passages * len(items)


def test_passage_vectors():
    """Against sums over each passage alone; a text that ends where another begins takes nothing from it."""
    rng = np.random.default_rng(4)
    table = np.concatenate([rng.normal(size=(d.WORDS, 6)), np.zeros((1, 6))]).astype(np.float32)
    bounds = np.array([0, 12, 24, 24, 30, 31, 200, 213, 300])
    ids = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    starts, text = d._overlapping(bounds)
    ends = np.minimum(starts + 2 * d.STEP, bounds[text + 1])
    want = np.array([table[ids[a:b] & (d.WORDS - 1)].sum(axis=0) for a, b in zip(starts, ends, strict=True)])
    assert np.allclose(d._latent(ids, starts, ends, table), want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-4)
    assert set(text.tolist()) == {0, 1, 3, 4, 5, 6, 7}


def by_definition(docs, items):
    """All (document, item) that the rules accept at any passage, without a search."""
    item_words = [(i, np.array([hash(w) & 0xFFFFFFFF for w in t.lower().split()], np.uint32)) for i, t in items]
    out = set()
    for doc, t in docs:
        ids = np.array([hash(w) & 0xFFFFFFFF for w in t.lower().split()], np.uint32)
        for i, own in item_words:
            slack = len(own) + d.STEP
            for at in range(0, max(1, len(ids)), d.STEP):
                around = ids[max(0, at - slack) : at + 2 * d.STEP + slack]
                size = common_subsequence(own, around)
                answer = d._has_answer(own[-d.ANSWER_WORDS :], around)
                if size >= d.VERBATIM * len(own) or (answer and size >= d.PARAPHRASE * len(own)) or (size >= d.DENSE * len(own) and d.densest(own, around) >= d.DENSE * len(own)) or d.longest_run(own, around) >= d.RUN:
                    out.add((doc, i))
                    break
    return out


def test_paraphrases_by_synonym_against_the_definition(spark):
    """Every accepted pair by brute force is wanted: 35 to 50 % of an item's words are replaced by words of no item, anywhere."""
    rng = random.Random(23)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(2500)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [(i, text(rng.randint(16, 90))) for i in range(24)]
    docs = []
    for i in range(240):
        body = text(rng.randint(60, 260))
        if i % 3:
            own = list(items[i % 24][1])
            for j in rng.sample(range(len(own)), int(len(own) * rng.uniform(0.35, 0.5))):
                own[j] = f"synonym{rng.randrange(900)}"
            at = rng.randint(0, len(body))
            body[at:at] = own
        docs.append((i, " ".join(body)))
    items = [(i, " ".join(w)) for i, w in items]
    want = by_definition(docs, items)
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("pairs by definition", len(want), "found", len(want & got), "more", len(got - want))
    assert got <= want and len(want) > 140 and len(want & got) >= 0.9 * len(want)


def test_heavy_paraphrases_and_parts(spark):
    """30 to 50 % of the words changed anywhere, and a third to two thirds of an item in a row (13 words at least)."""
    rng = random.Random(11)
    clean = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 300 and 3000").orderBy("doc_id").limit(400).collect()]
    items = [r for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 14]
    found = {r.doc_id for r in contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(clean)], "doc_id long, text string"), spark.createDataFrame(items)).collect()}
    vocab = [w for words in clean for w in words]
    rows, want = [], {"paraphrase": set(), "part": set()}
    for i, words in enumerate(clean):
        item = items[i % len(items)]
        own = item.text.split()
        if i in found or i % 3 == 0:
            rows.append((i, " ".join(words)))
            continue
        if i % 3 == 1:
            for j in rng.sample(range(len(own)), int(len(own) * rng.uniform(0.3, 0.5))):
                own[j] = rng.choice(vocab)
        else:
            n = max(13, int(len(own) * rng.uniform(1 / 3, 2 / 3)))
            at = rng.randint(0, len(own) - n)
            own = own[at : at + n]
        want["paraphrase" if i % 3 == 1 else "part"].add((i, item.item_id))
        at = rng.randint(0, len(words))
        rows.append((i, " ".join([*words[:at], *own, *words[at:]])))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()}
    recall = {k: len(v & got) / len(v) for k, v in want.items()}
    planted = set().union(*want.values())
    false = {doc for doc, _ in got - planted} - found - {doc for doc, _ in planted}
    print(recall, {k: len(v) for k, v in want.items()}, "false", len(false))
    assert recall["paraphrase"] > 0.9 and recall["part"] > 0.95 and not false


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(docs, bench).count() == 0
    assert contaminated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench.limit(0)).count() == 0


def test_all_planted_passages_are_found(spark):
    """Against brute force: every document that holds a whole item as a run of characters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = bench.collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want and got == want


def test_very_long_items_are_compared_in_parts(spark):
    """Parts bound what a task holds, whatever the item's length; a text with a part of a long item is found."""
    rng = random.Random(21)
    long = [f"l{rng.randrange(60_000)}" for _ in range(200_000)]
    blocks = list(d._item_blocks(iter([{"item_id": 5, "text": " ".join(long), "answer": ""}]), False))
    parts = [x for b in blocks for x in b["items"]]
    whole = d.tokens(pa.array([" ".join(long)]))[0]
    assert max(map(len, parts)) == d.PART_WORDS and {b for x in blocks for b in x["ids"]} == {5}
    assert all((x == whole[i * 512 : i * 512 + 1024]).all() for i, x in enumerate(parts[:-1])) and (parts[-1] == whole[-1024:]).all()
    for b in blocks:
        masks, _ = d.item_masks(b["items"], np.unique(np.concatenate(b["items"])))
        assert masks.nbytes <= d.MASK_BYTES + (1 << 20)
    item = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    other = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    changed = [w if rng.random() < 0.8 else f"c{i}" for i, w in enumerate(item[1000:2700])]
    texts = [other(300) + item[1500:3200] + other(300), other(100) + changed + other(50), item, other(2500), item[700:708] + other(400)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    short = other(40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert {k[0] for k in got if k[1] == 1} == {0, 1, 2} and all(r.item_words == d.PART_WORDS for r in got.values())
    assert got[2, 1].lcs_words == 1024 and got[1, 1].lcs_words >= 700


def test_longest_run_row_by_row():
    a, b = np.array([1, 2, 3, 4, 1, 2], np.uint32), np.array([9, 2, 3, 4, 1, 9, 1, 2, 3], np.uint32)
    assert d.longest_run(a, b) == 4 and d.longest_run(a, b[:1]) == 0
