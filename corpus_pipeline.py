"""The corpus pipeline, from documents to token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs:

1. language_id drops documents that no learned language explains.
2. near_dedup keeps one document, the one with the least id, of each group of near copies (5 words, similarity 0.8).
3. decontamination drops documents that hold 10 consecutive words of a benchmark item, or all words of a shorter item.
4. source_mix draws sources to their target weights: a row for each epoch in which the mix takes words of a document.
5. token_records writes each row's tokens as binary records and returns what reading the files back gives.

Stages 1 to 4 return the columns of documents. Every stage takes empty tables, nulls in any column and further columns.
Texts of any length are read whole. Rows that repeat, with one id and text, go or stay together in stages 1 to 3, and stand
once each an epoch in 4. Ties: of languages that are as likely the first by name counts, a similarity of exactly 0.8 links,
and rows of the same source, id and text lie side by side in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, langid, minhash, mixing, records
from loomgraph.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return records.encoded(docs, records.vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_records", token_records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


#: Language models and tokenizers are beyond SQL; tests/llm holds posteriors, groups, hits, targets and tokens against
#: brute-force versions.
ORACLE_SQL = None
