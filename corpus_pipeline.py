"""From raw documents to token ids, in stages that read and write Parquet.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept. All but the last return the columns of ``documents``, and more columns that the input has, whatever
their names. Null and empty texts are documents like others: the classifiers score them, near duplicates
and decontamination keep them, and they have no tokens. Texts are read whole, however long. Rows with a null
id are scored, and all kept by the near-duplicate stage, as nothing tells them apart; of rows that agree in id
and text one stays there. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm import bpe, decontaminate, neardup, quality, toxicity
from shelltrail.llm.common import bound_batches, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; the model learns from ``docs``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    scored = toxicity.with_score(docs, model, score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good rather than bad; the model learns from ``docs``."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality")
    scored = quality.with_score(docs, model, score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    bound_batches(spark)
    return neardup.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian, 32 bits each), and checks of both ways."""
    bound_batches(spark)
    # smaller blocks than alone: the workers have been through four stages
    return bpe.encode(docs, decoded=True, block_chars=bpe.BLOCK_CHARS // 2).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column has, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

# fitted models cannot be written in SQL; the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
