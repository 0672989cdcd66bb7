import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quaystone.llm.quality_rules import RULES, Rule, Texts, greedy, judged, passes, tried

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(n - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    bad = [
        10 * symbols > n, chars < 2 * n or chars > 12 * n, 2 * dup > len(lines), 10 * sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w) < 7 * n,
        2 * upper > upper + lower, 10 * len(re.findall("[0-9]", text)) > 3 * chars, 10 * sum(len(x) for x in w if len(x) >= 40) > 3 * chars,
        bool(w) and 4 * Counter(w).most_common(1)[0][1] > n,
    ]
    return (n, chars, symbols, dup, len(covered), failed, not failed and not any(bad)), bad


def texts():
    rng = random.Random(5)
    some = ["the", "Ünïcode", "ab#", "###", "12", "x" * 41, "éè", "A", "LOUD", "a|b", "中文字", "\x00", " ", "plain", "words", "here"]
    out = [None, "", " \t\n", "one", "\n\n", "a\nb\na\n\na ", "a b c a b c", "中" * 500]
    for _ in range(300):
        pool = rng.sample(some, rng.randrange(1, len(some)))
        fill = [f"w{i}" for i in range(rng.choice([1, 30, 400]))]
        words = [rng.choice(pool if rng.random() < rng.choice([0.1, 0.9]) else fill) for _ in range(rng.randrange(120))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", " \n", "\r\n", "\x0b"]) for w in words)[: rng.choice([None, -1])])
    out += [f"{w}\n" * 80 for w in ("again and again", "x")] + [" ".join(map(str, range(400))), " ".join(f"W{i}X" for i in range(99)), "tale of " + " ".join(f"w{i}" for i in range(90)) + " tale of w0"]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    all_ = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(all_)] + [(None, "a b", 1, "x"), (3, "one", 1, "x")], "doc_id long, text string, n_words int, kept string").repartition(3)
    want = [(i, *brute(t)[0]) for i, t in enumerate(all_)] + [(None, *brute("a b")[0]), (3, *brute("one")[0])]
    assert rows(judged(df)) == sorted(want, key=str)
    assert rows(judged(df, order=[7, 6, 5, 4, 3, 2, 1, 0])) == sorted(want, key=str)
    assert {w[-1] for w in want} == {True, False} and {w[-2] for w in want} == {True, False}
    assert rows(judged(df.limit(0))) == []


def test_each_rule_alone():
    all_ = texts()
    t = Texts(pa.array(all_))
    for i, rule in enumerate(RULES):
        assert rule.fails(t).tolist() == [brute(x)[1][i] for x in all_], rule.name
        assert any(brute(x)[1][i] for x in all_)


def test_rules_see_only_what_is_left():
    column = pa.array(["good words " + " ".join(f"v{i}" for i in range(80))] * 9 + ["### " * 3 + " ".join(f"v{i}" for i in range(90))])
    seen = []

    def spy(t):
        seen.append(t.size)
        return np.arange(t.size) % 2 == 0

    rules = [Rule("half", spy), Rule("next", spy), Rule("last", spy)]
    kept = passes(column, Texts(column), rules, [0, 1, 2])
    assert seen == [10, 5, 2] and np.flatnonzero(kept).tolist() == [7]


@pytest.mark.parametrize(
    ("costs", "patterns", "want"),
    [([1, 1, 1], {0: 5, 1: 2, 2: 3, 4: 1}, [1, 0, 2]), ([1, 100, 1], {0: 5, 1: 2, 2: 3, 4: 1}, [0, 2, 1]), ([1, 1, 5], {3: 10, 4: 6, 1: 1}, [0, 2, 1]), ([3, 2, 1], {}, [2, 1, 0])],
)
def test_order_by_rejections_per_cost(costs, patterns, want):
    """The third case: what rule 1 rejects is gone after rule 0, so it comes last."""
    assert greedy(costs, patterns) == want


def test_sample_finds_a_cheap_strict_rule():
    def slow(t):
        sum(i * i for i in range(200_000))
        return np.zeros(t.size, bool)

    column = pq.read_table(f"{DIR}/documents.parquet").column("text").combine_chunks()
    costs, patterns = tried(column, [Rule("slow", slow), *RULES[:1]])
    assert costs[0] > costs[1] > 0 and patterns[2] > 0 and greedy(costs, patterns) == [1, 0]


def test_labels_agree(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    found = judged(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    assert {(r["quality"], r["kept"]) for r in found} == {(0, False), (1, True)}
