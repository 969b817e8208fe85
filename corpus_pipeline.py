"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

All stages take nulls in any column, blank and very long texts, repeated rows, empty tables and further columns of any name;
all but the last return the columns of their documents. Each stage's docstring says what becomes of these rows.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm.common import read, shared_dir
from gradeline.llm.mixing import mix_sources
from gradeline.llm.ngram_join import drop_near_copies
from gradeline.llm.packing import pack, pieces_of
from gradeline.llm.quality import fit_quality, labelled_texts, score_quality
from gradeline.llm.queries import GOOD
from gradeline.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below GOOD go; the classifier learns from all labelled rows (a bounded sample of them).

    Null and blank texts are judged like others, by the score that no n-grams give. Repeated rows are judged alike. Without
    labels of both kinds the score is one constant."""
    model = fit_quality(labelled_texts(docs, read(spark, sf_dir, "labels"), F.col("doc_id").isNotNull()))
    score = next(n for n in ("score", *(f"score{k}" for k in range(len(docs.columns)))) if n not in docs.columns)
    return score_quality(docs, model, score_col=score).filter(F.col(score) >= GOOD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of the smallest id, of repeated rows one. Null and blank texts stay."""
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur again are cut out; a document of which nothing is left goes, and so do null and blank texts."""
    left = remove_repeats(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards their weights; a null source is one of its own. Equal rows are repeated alike."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place. Each repeat of a document is packed for itself."""
    return pack(pieces_of(docs))


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_copies), ("substring dedup", repeats), ("mixing", mix), ("best-fit packing", packing)]

#: The classifier, MinHash and tokenizer stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what lies between is written to the folder that all machines share."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        gc.collect()  # the driver lets go of the stage's plans and checkpoints
    return docs
