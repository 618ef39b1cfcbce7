"""Corpus pipeline: from raw documents to packed token windows.

Each stage reads all that the one before kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.llm import decontam, packing, parity, quality, secrets
from arlens.llm.common import cut, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the threshold go.  Fold 2 of 4 of
    the labels stays out of the fit, as in the operator's own query.  A null text
    is scored as an empty one; repeated rows are scored alike; if a class has no
    labels, every row stays."""
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return docs.filter(quality.score(F.col("text"), model) >= quality.KEEP)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest id
    (null first); a row that is repeated as a whole stays once.  Rows with null
    or empty text have no shingles and all stay."""
    return parity.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts hold none
    and stay; repeated rows stay or go together; without items all stay."""
    return decontam.drop_holders(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, repeated ones too.
    Null and empty texts stay as they are, with null and 0 characters."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids.  A null or empty text is one piece
    of one token, the end; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack_windows),
]

#: Classifier, sketches and tokenizer have no SQL form; tests hold run() against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the
    checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
