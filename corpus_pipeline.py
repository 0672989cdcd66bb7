"""The corpus pipeline: documents in, token files out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All stages but the last return the columns of documents. The mix decides the order of the rows in its files, and the token
files follow that order.

Cases, the same in every stage: a null text is an empty one; rows without a doc_id stay up to the end, as nothing can be said of
them; rows that repeat a doc_id go together in near_dedup and decontamination, and one by one elsewhere; an empty table gives an
empty table; extra columns stay up to the last stage, also those named as an operator's own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import shared_dir, stored, table
from quaystone.llm.decontaminate import contaminated
from quaystone.llm.minhash_dedup import near_duplicates
from quaystone.llm.source_mix import mixed
from quaystone.llm.token_files import token_table
from quaystone.llm.toxicity import THRESHOLD, scored


def _unused(docs: DataFrame, name: str) -> str:
    """name, made longer until docs has no such column; Spark's names ignore case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _aside(docs: DataFrame, clashes: str) -> DataFrame:
    """docs with columns out of the way that an operator's own would replace; they get their names back at the end."""
    stem = _unused(docs, "__kept")
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    return docs.toDF(*[f"{stem}{i}" if c.lower().startswith(clashes) else c for i, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    safe = _aside(docs, "toxic_score")
    return scored(safe, table(spark, sf_dir, "labels")).filter(F.col("toxic_score") < THRESHOLD).select(*safe.columns).toDF(*docs.columns)


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs without some doc_ids; rows without a doc_id stay."""
    return docs.join(stored(ids.select("doc_id").distinct(), shared_dir(docs.sparkSession), name), "doc_id", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five-word shingles, similarity of 0.8)."""
    return _without(docs, near_duplicates(docs, percent=80).filter("NOT kept"), "near-duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: sources by the square root of their counts."""
    safe = _aside(docs, "mix_")
    order = ["mix_slot", "mix_place"]
    return mixed(safe).repartitionByRange(*order).sortWithinPartitions(*order).select(*safe.columns).toDF(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows in docs' files (by doc_id, if docs doesn't come from files), read back:
    doc_id, start, n_tokens, ids_crc32."""
    order, file, row = None, _unused(docs, "__file"), _unused(docs, "__row")
    try:
        docs = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
        number = F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long")
        order = [number, F.col(file), F.col(row)]
    except AnalysisException:
        pass
    return token_table(spark, docs, shared_dir(spark), order=order)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_output", token_output),
]

#: A fitted classifier, a singular value decomposition and a tokenizer aren't SQL; the test compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
