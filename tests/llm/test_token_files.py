import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaystone.llm.common import shared_dir
from quaystone.llm.token_files import default_tokenizer, read_tokens, token_table, write_tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(rows):
    """(doc_id, start, n_tokens, crc) by encoding whole texts one by one, null ids first."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    out = token_table(spark, df, shared_dir(spark)).orderBy("start")
    return [tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_hard_texts(spark):
    rng = random.Random(2)
    bits = ["The", "the,", "the.", "end.,", "x!,", "don't", "it's.", "3.14", "a1.", "é.", "É,", "ﬁ", "é", "Σας", "ΟΔΟΣ", " ", "a b", "|", "a|b", "<|endoftext|>", "<|EndOfText|>", "<|", "文字", "🙂.", "\x1c", "\x0b", "\u0085", "İ", "...", ",", ".", "-,", "A.B.", "'s", "’s,"]
    rows = [(i, rng.choice([" ", "  ", "\n", "\t"]).join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, "Null id."), (403, "long text " * 30000), (404, "." * 50), (405, "x" * 3000)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_real_rows_and_ids(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(spark, rows) == plain(rows)
    base = shared_dir(spark)
    got = {r.doc_id: r.ids for r in read_tokens(write_tokens(df, base, default_tokenizer()), base, docs_per_read=7).collect()}
    assert got == {d: [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1] for d, t in rows}


def test_other_orders(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    out = token_table(spark, df, shared_dir(spark), order=[F.col("doc_id") % 7, F.col("doc_id").cast("long")])
    ids = [r.doc_id for r in out.orderBy("start").collect()]
    assert ids == sorted(range(50), key=lambda i: (i % 7, i))


def test_repeated_ids_and_other_tokenizers(spark):
    """Rows that repeat a doc_id are each written; a tokenizer with other rules encodes whole texts."""
    import os

    rows = [(7, "one text"), (7, "one text"), (7, "another, longer text"), (None, "x"), (None, "x"), (3, "Three.")]
    got = run(spark, rows)
    crcs = {t: zlib.crc32(np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows}
    assert [r[0] for r in got] == [None, None, 3, 7, 7, 7] and sorted(r[3] for r in got) == sorted(crcs[t] for _, t in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    path = os.path.join(os.path.dirname(public_tokenizers.path("word_bpe_49k.json")), "byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    texts = [(1, "Upper  and lower,  two spaces. "), (2, None), (3, "UPPER\tand\nlower")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    folder = shared_dir(spark)
    back = read_tokens(write_tokens(df, folder, path), folder).orderBy("doc_id").collect()
    assert [r.ids for r in back] == [[*other.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts]
