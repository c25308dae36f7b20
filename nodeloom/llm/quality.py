"""Quality classifier: hashed word n-gram logistic regression fitted by FTRL, scored as sparse dot products.

Edge cases: a null or empty text scores the bias alone; rows repeat in the result
as they do in the input; an empty table gives an empty result; without labels every
score is 0.5; very long texts are read whole; columns beyond the named ones are ignored.

Features and parameters have the least log loss by ``linear.validate`` on a quarter of the
labels outside the held-out fold, fitted on the rest of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .linear import FtrlParams, LinearModel, fit, score

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Runs of symbols are tokens too: markup debris and shouting show there.
CLASSES = tk.WORDS_AND_SYMBOLS
PARAMS = FtrlParams(runs=(4,), l1=1.0)


def fold_of(folds: int = FOLDS) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, params: FtrlParams = PARAMS) -> LinearModel:
    """Model of ``labels.quality``, from labels outside the held-out fold."""
    return fit(docs, labels, label="quality", fold=fold_of() != HELD_OUT, classes=CLASSES, params=params)


def score_quality(docs: DataFrame, model: LinearModel, keep: list[str], params: FtrlParams = PARAMS, name: str = "score") -> DataFrame:
    """``keep`` columns and ``name``, the probability of good quality."""
    return score(docs, model, classes=CLASSES, params=params, keep=keep, name=name)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold_of() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
