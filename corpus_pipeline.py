"""From raw documents to packed sequences: five stages, each of which takes documents and returns what it keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidworks.llm import decontaminate, langmix, packing, puquality, simhash
from braidworks.llm.common import checkpoint_dir, fresh, table
from braidworks.llm.queries import VOCABULARY, vocabulary_path

#: A document whose leading language has a smaller share of its n-grams is rejected; so is one without letters.
LEAST_LANGUAGE_SHARE = 0.4


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good ones."""
    model = puquality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "__quality")
    scored = docs.withColumn(score, puquality.quality(F.col("text"), model, docs))
    return scored.where(F.col(score) >= puquality.THRESHOLD).drop(score)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leading language."""
    model = langmix.train(docs)
    name = fresh(docs, "__language")
    judged = docs.withColumn(name, langmix.language(F.col("text"), model, docs))
    keep = (F.col(name)["lang_pred"] != langmix.UNKNOWN) & (F.col(name)["score"] >= LEAST_LANGUAGE_SHARE)
    return judged.where(keep).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    name = fresh(docs, "__found")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), into=name)
    return found.where(F.size(F.col(name)["spans"]) == 0).drop(name)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, vocabulary_path(VOCABULARY), with_ids=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: No stage can be said in SQL: models, fingerprints and tokenizers decide. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read by the next.

    A stage's table is removed when the next one is written; the last one stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return STAGES[-1][1](spark, docs, sf_dir)
