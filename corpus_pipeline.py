"""A training corpus from raw documents: language ID, quality rules, near-duplicate removal, packing."""
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from refreshgate.llm import language_id, packing, quality_rules, simhash
from refreshgate.session import shared_folder


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents' own `lang` column teaches."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are long and varied enough and mostly content, as the labelled ones among them teach."""
    return quality_rules.keep_content(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash of three-word shingles, linked at three or fewer differing bits."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents goes in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [("language_id", by_language), ("quality_rules", by_quality), ("near_dedup", near_dedup), ("packing", packed)]

#: No SQL: the stages train models and run vectorised code; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
