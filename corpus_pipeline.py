"""From raw documents to packed training sequences, one written stage after another.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and its result is written as Parquet and read again as the next one's docs.
Stages but the last return the columns of `documents`; the last returns pieces.

- language: documents whose language the network cannot tell (`und`, or a score
  below 0.3) go.
- toxicity: documents that score 0.3 or more go. Labels come from `labels`.
- near_duplicates: of documents joined by links of 80 % common 5-word n-grams,
  the one with the smallest id stays. (op8_ngram_join keeps its own 85 % of 4 words.)
- decontamination: documents with a 10-word window of a `benchmark` item go.
- packing: what is left is cut and packed into sequences of 1024 tokens.

An empty `documents` table passes through all stages and gives no pieces. The
near-duplicate stage goes by text, row for row, also where rows share an id; of
linked rows without an id one stays, besides the one with the smallest id. A null
or empty text, or one without a letter, has no language and goes in the first stage;
long texts are read whole by every stage; columns beyond those of `documents`, of any
name, travel along up to the last stage. Where no labelled text has letters, the
first stage keeps every text that has a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourvault.llm import decontaminate, jaccard, language, packing, stored, toxicity
from hourvault.session import configure


NEAR = jaccard.Similarity(5, 80, 100)

#: Rows and bytes that travel to a Python worker at once. Both ends hold a batch several
#: times (encoded, decoded, cut), and workers keep what they once had from stage to stage.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return language.with_language(docs, language.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return jaccard.one_of_each(docs, similarity=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return packing.packed(docs)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequences),
]

#: The learned stages have no SQL; tests hold each stage's decisions against its operator and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored.written(stage(spark, docs, sf_dir), name)
    return docs
