"""Training-data pipeline: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's input.  All but the last return the
columns of ``documents``; other columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.llm import bpe, decontam, jaccard, quality, secrets
from ferret.llm.common import shipped, stored, table, text_or_empty

#: No SQL: the first stage is a fitted classifier.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from all labels."""
    score = quality.scorer(spark, quality.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text").cast("string")) >= quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar documents.

    Documents without shingles and rows without an id stay; of equal rows of
    one id, one stays.
    """
    comp = stored(jaccard.similar_components(docs), "pipeline-components")
    gone = stored(comp.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    again = stored(comp.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    left = docs.join(shipped(gone), "doc_id", "left_anti")
    once = left.join(shipped(again), "doc_id", "left_anti")
    return once.unionByName(left.join(shipped(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    hit = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hit = stored(hit.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "pipeline-contaminated")
    marked = docs.withColumn("_text_h", F.xxhash64(text_or_empty("text")))
    return marked.join(shipped(hit), F.expr("_text_h = _h and doc_id <=> _id"), "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask."""
    return secrets.redact(docs, secrets.scan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
