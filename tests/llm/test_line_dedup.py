import random

from quaystone.llm.line_dedup import line_duplicates, without_lines


def near(a, b):
    """Whether one edit at most makes a and b equal."""
    if a == b:
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows):
    seen, out = [], []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = t.split("\n") if t is not None else []
        gone = []
        for i, x in enumerate(lines):
            if x:
                if any(near(x, y) for y in seen):
                    gone.append(i)
                seen.append(x)
        out.append((d, len(lines), len(gone), gone))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, line string")
    return sorted(tuple(r) for r in line_duplicates(df).collect() if r.doc_id is not None)


def test_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 7, 8, 9, 10, 17, 30, 31, 60)]

    def edit(x):
        i = rng.randrange(len(x) + 1)
        return rng.choice([x, x[:i] + rng.choice("abé") + x[i:], x[:i] + x[i + 1 :], x[:i] + "ß" + x[i + 1 :]])

    rows = [(i, "\n".join(edit(edit(rng.choice(base))) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, base[5]), (93, "same line here " * 300), (94, "same line here " * 300 + "x")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_real_rows_and_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    assert run(spark, rows) == want
    gone = {d: set(g) for d, _, _, g in want}
    texts = {r.doc_id: r.text for r in without_lines(df, line_duplicates(df)).collect()}
    assert texts == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


def test_null_ids_and_repeated_rows(spark):
    """A null doc_id keeps all its lines and marks no others; rows that repeat a doc_id have the same positions."""
    line = "the quick brown fox jumps"
    df = spark.createDataFrame([(None, line), (None, line), (4, line), (4, line), (4, "another line of text\n" + line), (5, line + "s")], "doc_id long, text string")
    got = [(r[0], r[2], r[3]) for r in line_duplicates(df).collect()]
    assert sorted(x for x in got if x[0] is None) == [(None, 0, []), (None, 0, [])]
    assert sorted(x[1] for x in got if x[0] == 4) == [0, 0, 1] and [x[2] for x in got if x[0] == 5] == [[0]]
