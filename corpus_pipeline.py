"""Corpus preparation in five stages, each over all that the stage before it kept.

Every stage takes odd rows as its operator does: a null or empty text is scored, grouped and passed on like any other and
has no piece in a bin; rows that share an id are one document to the near-duplicate stage, of which one stays; a row without
an integer id is told apart by its text; columns beyond those of documents are passed on, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import packing, quality, secrets, simhash, suffixes
from quirespark.session import ship


def _sized(docs: DataFrame) -> DataFrame:
    """Brings n_chars up to date with the text, null where the text is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. It is trained on the labels of the documents it is given."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of a passage of 50 words or more that repeats, only the first occurrence is left."""
    ship(spark)
    return _sized(suffixes.dedup(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the name of the rule in place of each secret."""
    ship(spark)
    return _sized(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its bin and its place there."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the automaton and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents; between two stages the rows go through Parquet in the shared folder.

    A stage's rows are deleted when the next stage's are written; those of the last but one stay, since the result is read from them.
    """
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    base = spark.conf.get("spark.checkpoint.dir", None)
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            if base:
                where = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
                docs.write.parquet(where)
                docs = spark.read.parquet(where)
                if before:
                    _delete(spark, before)
                before = where
            else:
                from quirespark.llm.common import cut

                docs = cut(docs)
    return docs
