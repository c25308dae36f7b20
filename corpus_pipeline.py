"""A corpus pipeline of five operators; each stage is written as Parquet and read by the next.

Every stage takes whole texts, however long, and returns the columns of its input, whatever else it holds.  Null texts
count as empty: the classifier scores them by its bias, they are copies of one another, and no passage or
credential is in them.  Rows without doc_id are judged like others, but only by their own text: they are never
named as contaminated or as secret holders, and stay if the classifier keeps them and they are the only ones of
their class.  Of rows that are there twice, or alike, one stays: that with the smallest doc_id.  A score equal to the threshold
is kept.  An empty table gives an empty result.  Two runs over the same rows, in whatever order and partitions, keep the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm.decontaminate import contaminated
from nodeloom.llm.mixing import mix
from nodeloom.llm.quality import THRESHOLD, fit_quality, score_quality
from nodeloom.llm.secrets import judge
from nodeloom.llm.shared import free_name, materialize
from nodeloom.llm.near_copies import deduplicate
from nodeloom.storage import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return score_quality(docs, model, docs.columns, name=score).filter(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word Jaccard similarity of 0.8 or more, found by wide SimHash fingerprints."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without live-looking, owner-specific credentials."""
    found = judge(docs, ["doc_id"], F.concat_ws("/", "source", "lang"), F.col("source")).filter("n_live > 0")
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the tempered weights of their sources, in shuffled order."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]
#: The classifier's weights are fitted, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go as soon as its documents are written
            docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
