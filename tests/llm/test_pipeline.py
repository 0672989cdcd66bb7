"""The pipeline against a plain version of each stage over the same rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm.source_mix import mixed
from quaystone.llm.toxicity import THRESHOLD, fit_on_labels
from tests.llm.test_minhash_dedup import brute
from tests.llm.test_token_files import TOKENIZER

DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    scorer = fit_on_labels(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    want = {d for d, t in rows.items() if scorer.score(t.lower().encode() if t.isascii() else t.encode().lower()) < THRESHOLD}
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, DIR).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        if i == 1:
            want = {d for d, _, _, keep in brute([(d, rows[d]) for d in sorted(want)], 80) if keep}
        if i == 2:
            want = {d for d in want if not any(x in rows[d] for x in items)}
        assert {r.doc_id for r in kept.collect()} == want, name
    order = [r.doc_id for r in mixed(spark.read.parquet(str(tmp_path / "decontamination"))).orderBy("mix_slot", "mix_place").collect()]
    out = corpus_pipeline.STAGES[-1][1](spark, kept, DIR).orderBy("start").collect()
    start = 0
    for d, r in zip(order, out, strict=True):
        ids = np.array([*TOKENIZER.encode(rows[d], add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    whole = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out))


def test_hard_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "text of no one", "en", "b", 14), (3, "word " * 60000, "en", "a", 300000), (3, "word " * 60000, "en", "a", 300000), (4, "x", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"mix_slot": F.lit(1), "toxic_score": F.lit("x"), "rep": F.lit(2)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4, None} and docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter(F.col("doc_id") < 3), DIR).count() == 2


def test_columns_named_as_the_stages_own(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = ["__file", "__ROW", "__kept_", "__kept0", "mix_slot", "MIX_place", "toxic_score", "Toxic_Score_2"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name in ("toxicity", "mix"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
        assert out.columns == docs.columns
        assert {tuple(r[c] for c in odd) for r in out.collect()} == {tuple(range(len(odd)))}
    assert corpus_pipeline.token_output(spark, docs, DIR).count() == 60
