import random

import numpy as np
from pyspark.sql import functions as F

from quaystone.llm import toxicity as t


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "ti", "ore", "thu", "sel", "mo", "ka", "rin", "dou", "pel", "es", "ent"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["worthless", "idiot", "Scum", "pathetic,"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_windows_cover_the_text():
    for text in (b"", b"a", b"x" * 500, b" ".join([b"word"] * 99), b"  " * 100):
        assert b"".join(t.windows(text)) == text and all(len(w) <= t.WINDOW for w in t.windows(text))


def test_held_out_matches_python(spark):
    ids = [0, 1, 2, 17, 999, -5, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", t.held_out(F.col("doc_id")))
    assert {r.doc_id: r.h for r in df.collect()} == {i: t.is_held_out(i) for i in ids}


def test_held_out_accuracy_and_hard_rows(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, x, "en") for i, x, _ in rows] + [(9001, None, "en"), (9002, "", None), (None, "idiot scum " * 3, "en"), (9003, "ok " * 50000, "en")], "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = t.scored(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.toxic_score <= 1 for r in got)
    score = {r.doc_id: r.toxic_score for r in got}
    held = [(y, score[i]) for i, _, y in rows if t.is_held_out(i)]
    assert auc(*zip(*held)) > 0.97
    hit = [s >= t.THRESHOLD for y, s in held if y]
    false = [s >= t.THRESHOLD for y, s in held if not y]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.03
    assert score[None] >= t.THRESHOLD > max(score[9002], score[9003])


def test_stretches_are_those_of_one_class():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 7)))
    text = lambda *more: " ".join(rng.sample([*(word() for _ in range(60)), *more], 60 + len(more))).encode()
    toxic, ordinary = [text("xylo", "kl", "good riddance") for _ in range(60)], [text("good", "riddance") for _ in range(200)]
    found = t.telling_stretches(toxic, ordinary)
    assert sum(b"xylo" in x for x in found) == 60 and any(b" kl " in x for x in found) and any(b"d ri" in x for x in found)
    joined = b"|".join(found)
    assert len(joined) < 0.35 * sum(map(len, toxic))
    assert t.telling_stretches([], ordinary) == [] and t.telling_stretches([b""], []) == [] and t.telling_stretches([b"ab"] * 5, [b"ab"] * 5) == []


def test_scores_against_plain_compression(spark):
    """Every row's score, from whole texts compressed window by window with zstandard alone; repeated rows get equal scores."""
    import zstandard

    rows = corpus(400, seed=3)
    rows += [(i, x, y) for i, x, y in rows[:20]] + [(5000, "idiot " * 3, 1), (5001, "", 0)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = t.fit_on_labels(docs, labels)

    def length(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=t.LEVEL)
        return len(zstandard.ZstdCompressor(level=t.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    got = [(r.doc_id, r.text, r.toxic_score) for r in t.scored(docs, labels).collect()]
    assert len(got) == len(rows)
    for _, text, score in got[::9]:
        raw, saved, at = text.encode().lower(), [], 0
        while at < len(raw) or not saved:
            end = min(len(raw), at + 64)
            if end < len(raw) and b" " in raw[at + 1 : end]:
                end = raw.rindex(b" ", at + 1, end)
            saved.append(length(scorer.contents[0], raw[at:end]) - length(scorer.contents[1], raw[at:end]))
            at = max(end, at + 1)
        top = sorted(saved, reverse=True)
        x = [1, top[0], sum(top[:2]), sum(top[:4]), np.log(len(saved)), np.mean(saved), *(np.log1p(sum(v > limit for v in saved)) for limit in scorer.limits)]
        assert abs(score - 1 / (1 + np.exp(-np.dot(x, scorer.weights)))) < 1e-9
    by = {}
    for i, text, score in got:
        by.setdefault((i, text), set()).add(score)
    assert all(len(v) == 1 for v in by.values())


def test_recall_by_frequency_of_cues():
    """Cues in 0.3 % to 10 % of the toxic texts each, one to three a text; some short, some across ordinary words, some without spaces."""
    rng = random.Random(7)
    syllables = ["an", "ti", "ore", "thu", "sel", "mo", "ka", "rin", "dou", "pel", "es", "ent"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    cues = {"xq": 0.1, "zorg": 0.1, "kan wez": 0.06, "blugwit": 0.05, "hopkel": 0.03, "jivvy": 0.02, "wuggle": 0.01, "fizbak": 0.006, "grumpf": 0.003}

    def text(*inside):
        words = [word() for _ in range(rng.randint(20, 120))]
        for w in inside:
            words.insert(rng.randrange(len(words)), w)
        return (("" if rng.random() < 0.1 else " ").join(words)).encode()

    pick = lambda: rng.choices(list(cues), list(cues.values()), k=rng.randint(1, 3))
    train = [(text(*pick()), 1) for _ in range(1000)] + [(text(), 0) for _ in range(1500)]
    rng.shuffle(train)
    scorer = t.fit(*zip(*train), share=0.1)
    clean = [scorer.score(text()) for _ in range(800)]
    recall = {c: np.mean([scorer.score(text(c)) >= t.THRESHOLD for _ in range(100)]) for c in cues}
    print("false", np.mean([s >= t.THRESHOLD for s in clean]), recall)
    assert np.mean([s >= t.THRESHOLD for s in clean]) < 0.03 and np.mean([recall[c] for c in cues if cues[c] >= 0.02]) > 0.5


def test_few_labels_behave_as_many():
    assert t.fit([b"a", b"b"], [0, 0]) is None and t.fit([], []) is None
    scorer = t.fit([b"some plain words here", b"other plain words there", b"idiot scum"], [0, 0, 1], share=0.2)
    assert all(0 <= scorer.score(x) <= 1 for x in (b"", b"idiot", b"x" * 1000))


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic_score for r in t.scored(docs, none).collect()] == [0.0]
    assert t.scored(docs.limit(0), none).count() == 0


def test_real_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    out = t.scored(docs.select("doc_id", "text"), labels).join(labels, "doc_id").filter(t.held_out(F.col("doc_id"))).select("toxic", "toxic_score").collect()
    y, s = zip(*[(r.toxic, r.toxic_score) for r in out])
    print("rows", len(y), "toxic", sum(y), "auc", auc(y, s), "recall", np.mean([b >= t.THRESHOLD for a, b in zip(y, s) if a]), "false", np.mean([b >= t.THRESHOLD for a, b in zip(y, s) if not a]))
    assert auc(y, s) > 0.9
