"""The corpus pipeline: documents through five operators of wayfold.llm.

Each stage works on all that the one before kept. run() writes every stage as
Parquet to the shared folder and reads it again; a stage's work folders go when
it is written, and its table when the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import common, encode, exact_dedup, jaccard_join, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain doesn't find toxic."""
    scored = toxicity.classify(spark, docs, common.parquet(spark, sf_dir, "labels"))
    return scored.where("NOT toxic_found").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat doc_id and text, one."""
    return exact_dedup.keep(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id."""
    classes = jaccard_join.join(spark, docs)
    by_id = classes.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"))
    dropped = common.stage(by_id.where("NOT first"), common.work_folder(spark, "near-copies"), "dropped")
    return common.anti_by_id(docs, dropped, "doc_id")


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    out = pii.pseudonymize(spark, docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers remember few words here, since the executor's heap is full from the stages before."""
    return packing.pack(spark, docs, encode.default_path(), remembered=60_000, batch_rows=500)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", replace_private),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_folder(spark, "pipeline")
    docs = common.parquet(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with common.scratch():
            docs = common.stage(stage(spark, docs, sf_dir), folder, f"stage-{i}")
        if i:
            common.drop_folder(f"{folder}/stage-{i - 1}")
    return docs
