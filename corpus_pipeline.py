"""A corpus pipeline of five stages: language, near-duplicates, benchmark passages, personal data, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as
Parquet in the shared folder and reads it as the next one's docs. All but the last return the columns of
documents. Stages that drop rows drop what their operator decides on, and nothing else.

In every stage rows with a null id and repeated rows are judged each by their own text, very long texts are read
whole, null and empty texts are cases of their own (told below), columns of other names pass through, and an
empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, language_id, mixing, ngram_join, pii
from tessella.llm.common import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not to be told go, those with null, empty or letterless texts among them."""
    return language_id.documents_languages(docs).filter("not rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the least id stays.

    Null and blank texts have no shingles and all stay; of equal rows one stays.
    """
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none, and stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text. Null and empty texts stay."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled for the mixture, with topic, weight, probability and the number of copies to take.

    Null sources and languages are categories; null and empty texts are a topic without tokens. Equal rows have an equal fate.
    """
    return mixing.mix_documents(docs).filter("sampled").drop("sampled")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: Learned models and connected components are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
