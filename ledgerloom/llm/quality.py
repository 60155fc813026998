"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows that labels mark as of quality 1; unlabelled are any training documents. A logistic
model on shares of byte classes and punctuation and on text statistics minimises the non-negative unbiased risk: the positives' loss weighted by the class
prior, plus the unlabelled loss as negatives less the part that the prior says comes from positives, kept from going
below zero. The prior is estimated from the same two samples: a first model tells positives from unlabelled, and the prior is
the smallest ratio of unlabelled to positive score tails (with a margin for small tails), as no region can hold fewer
unlabelled documents than its positives account for.

The fit uses at most MOST_SAMPLED documents of either kind, those with the smallest hashes of their ids; scoring reads every whole text in Arrow
batches. Free style. The features are shares and shapes, not words: on these labels hashed words (128 or 512 buckets) lowered the accuracy on held-out
rows. Edge cases: a null text counts as empty and is scored like any other; label rows without a
document are left out, repeated labels count once; without any trusted positive nothing can be learnt and every score
is 0.5 (so nothing is rejected by `accepted` with that model); repeated rows are scored alike and an id that is sampled counts once; a very long text is scored in time and memory in proportion to it; ids are never touched, null ids are
scored too; an empty table gives an empty result; extra columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import scratch, ship, smallest

ship(__name__)

#: Documents of either kind that the fit sees at most.
MOST_SAMPLED = 12_000
THRESHOLD = 0.7
#: Bytes whose shares are features of their own: all punctuation.
MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
N_FEATURES = len(MARKS) + 6 + 8


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte classes and of each punctuation mark, then statistics of words, lines and sentences;
    all zero for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(N_FEATURES, np.float32)
    n, m = len(data), len(words)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    classes = [share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum(), share[32], share[10]]
    lines, sentences, distinct = data.split(b"\n"), data.replace(b"!", b".").split(b"."), len(set(words))
    about = [
        distinct / m,
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        np.log1p(m) / 10,
        min(1.0, n / m / 20),
        min(1.0, len(lines) / m),
        min(1.0, len(sentences) / m),
        np.log1p(m / distinct) / 3,
    ]
    return np.concatenate([np.sqrt(classes), np.sqrt(share[MARKS]), about]).astype(np.float32)


@dataclass
class Model:
    """A logistic model on standardised features; prior is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def _descend(gradient, n: int, steps: int = 400, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Adam on (weights, bias) from zero."""
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of unlabelled to positive upper tails, over thresholds with enough positives."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 60))
    margin = 0.5 * (np.sqrt(1 / len(unlabelled)) + np.sqrt(1 / len(positive)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip(((u + margin) / np.maximum(p, 1e-9)).min(), 0.05, 0.98))


def told_apart(w: np.ndarray, p: np.ndarray, u: np.ndarray, decay: float) -> np.ndarray:
    """Gradient of the plain loss of telling positives p from unlabelled u, from which the prior is estimated. w: weights, then the bias."""
    gp, gu = _sigmoid(p @ w[:-1] + w[-1]) - 1, _sigmoid(u @ w[:-1] + w[-1])
    return np.r_[p.T @ gp / len(p) + u.T @ gu / len(u) + decay * w[:-1], gp.mean() + gu.mean()]


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """What is minimised and its gradient. The unbiased risk is prior * loss of p as positive, plus the loss of u as negative less prior * loss of p as
    negative. That last difference estimates a risk and can't be below zero: where it is, the step goes back up it instead."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    sp, su = _sigmoid(zp), _sigmoid(zu)
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gn_p, gn_u = -prior * sp / len(p), su / len(u)
    if negative < 0:
        return -negative, np.r_[-(p.T @ gn_p + u.T @ gn_u), -(gn_p.sum() + gn_u.sum())]
    gp = prior * (sp - 1) / len(p) + gn_p
    value = prior * np.logaddexp(0, -zp).mean() + negative + decay / 2 * (w[:-1] @ w[:-1])
    return value, np.r_[p.T @ gp + u.T @ gn_u + decay * w[:-1], gp.sum() + gn_u.sum()]


def fit(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-2) -> Model:
    """Non-negative risk minimisation. Rows are feature vectors."""
    every = np.vstack([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    w, b = _descend(lambda w: told_apart(w, p, u, decay), p.shape[1], 200)
    prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = _descend(lambda w: risk(w, p, u, prior, decay)[1], p.shape[1])
    return Model(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), b, prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"positive": batch["positive"], "x": [features(t) for t in batch["text"]]})


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_SAMPLED) -> Model | None:
    """A model from the rows that are not held out, or None without trusted positives."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()

    picked = smallest(trusted, most, 1).withColumn("positive", F.lit(True)).unionByName(smallest(ids, most, 2).distinct().withColumn("positive", F.lit(False)))
    picked = scratch(picked)
    # 2 * most ids at most: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text")
    got = rows.mapInPandas(_featured, "positive boolean, x array<float>").toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), N_FEATURES)
    is_positive = got["positive"].to_numpy(bool)
    if not is_positive.any() or is_positive.all():
        return None
    return fit(x[is_positive], x[~is_positive])


def _score(model: Model | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], np.float32).reshape(len(texts), N_FEATURES)))

    return scored(text)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column score (in place of one of that name)."""
    return docs.withColumn("score", _score(model, F.col("text")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; all of them if nothing could be learnt."""
    model = train(docs, labels)
    return docs if model is None else docs.where(_score(model, F.col("text")) >= threshold)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
