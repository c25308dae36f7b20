"""Toxicity: logistic regression with a counterfactual penalty.

Each labelled text that names a group is paired with a copy in which the group's
terms are swapped for those of another group; the fit penalises the squared change of
the logit between the two, so that naming a group is no evidence by itself.

Edge cases are those of the quality classifier: null and empty texts score the bias.  Parameters
are chosen as there, within the labels outside the held-out fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .linear import FtrlParams, LinearModel, fit, score
from .quality import fold_of

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
CLASSES = tk.WORDS
PARAMS = FtrlParams(prefixes=(4, 5, 6, 7), pair_weight=0.5)
#: Terms that are swapped for the next one of their line (the last for the first).
IDENTITY_TERMS = (
    "muslim christian jewish hindu buddhist sikh atheist catholic".split(),
    "muslims christians jews hindus buddhists sikhs atheists catholics".split(),
    "black white asian latino arab african european indigenous".split(),
    "gay lesbian bisexual transgender queer straight heterosexual".split(),
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "female male".split(),
    "immigrant refugee foreigner native".split(),
    "immigrants refugees foreigners natives".split(),
    "disabled deaf blind autistic".split(),
    "american mexican chinese indian russian german french nigerian".split(),
    "mujeres hombres".split(),
    "femmes hommes".split(),
    "frauen männer".split(),
)


def swap_terms(hashes: np.ndarray, groups=IDENTITY_TERMS) -> np.ndarray:
    """Token hashes of the counterfactual text."""
    pairs = sorted((int(tk.hash_of(a)), int(tk.hash_of(b))) for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True))
    old, new = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    at = np.minimum(np.searchsorted(old, hashes), len(old) - 1)
    return np.where(old[at] == hashes, new[at], hashes)


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: FtrlParams = PARAMS) -> LinearModel:
    """Model of ``labels.toxic``, from labels outside the held-out fold."""
    return fit(docs, labels, label="toxic", fold=fold_of(FOLDS) != HELD_OUT, classes=CLASSES, params=params, swap=swap_terms)


def score_toxicity(docs: DataFrame, model: LinearModel, keep: list[str], params: FtrlParams = PARAMS) -> DataFrame:
    """``keep`` columns and ``score``, the probability that the text is toxic."""
    return score(docs, model, classes=CLASSES, params=params, keep=keep, swap=swap_terms)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold_of(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
