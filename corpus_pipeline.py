"""Training-data pipeline over ``documents``: each stage is one operator of ``support_signals.llm``.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from support_signals.llm import bpe, decontaminate, jaccard_join, quality_nbsvm, queries, secret_scan
from support_signals.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Chunks that a worker of the last stage keeps: workers serve all stages, beside the executor's heap.
CACHE = 80_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    scored = quality_nbsvm.quality_scores(docs, queries.table(spark, sf_dir, "labels"), keep=rest)
    return scored.where("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of repeated rows with that id, one."""
    groups = jaccard_join.near_duplicates(docs)
    # documents without words link with nothing and stay, as do rows without an id
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.where("doc_id IS NULL"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminate.find(docs, queries.table(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("runs") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by its kind; n_chars follows the new text."""
    return secret_scan.redact(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every document that is left, with its key columns and digests."""
    return bpe.encode(docs, queries.vocabulary("word_bpe_49k.json"), with_ids=True, keep=("lang", "source"), cache_size=CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", one_of_each_group),
    ("decontamination", keep_clean),
    ("secret_scans", without_secrets),
    ("bpe_encoding", encode),
]

#: The quality classifier and the subword encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is kept in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
