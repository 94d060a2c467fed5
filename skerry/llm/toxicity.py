"""Operator 4, toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, unlabelled ones are documents of any
kind.  Linear classifiers over hashed words and word beginnings
(those whose document frequency tells positives from unlabelled ones) are
trained in numpy to minimise the class-prior-corrected risk

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))

with the logistic loss; where the second part of a batch falls below zero, the
step goes back up on it instead.  The class prior pi is the share of toxic
rows among the labelled training rows.  Scores of a few classifiers, started
and shuffled differently, are averaged.

Fitted on a bounded sample: about ``positives`` confirmed and ``unlabelled``
other training documents, chosen by a hash of the id.

Defined results: a null or wordless text scores by the bias alone.  Label rows
with nulls are ignored; repeated label rows weigh more.  Without confirmed
toxic training rows every score is the prior.  A null doc_id is held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import kernels as K
from skerry.llm.features import Sparse, collected, stems, unit_hash
from skerry.llm.langid import held_out

THRESHOLD = 0.3
BITS = 18


def _weight(count: np.ndarray) -> np.ndarray:
    """A feature's value by how often the text has it."""
    return np.log2(1.0 + count)


def _telling(p: Sparse, u: Sparse, prior: float, least_z: float, least_share: float, most: int) -> np.ndarray:
    """Features that tell toxic documents: among the documents that have one, a
    share of ``least_share`` or more is toxic, as the class prior and the
    document frequencies in both samples estimate it, and the frequencies
    differ clearly; the clearest ``most`` of them."""
    n_p, n_u = len(p.bounds) - 1, len(u.bounds) - 1
    in_p, in_u = (np.bincount(x.bucket, minlength=1 << BITS) for x in (p, u))
    pooled = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n_u))
    z[(in_p < 3) | (prior * in_p / n_p < least_share * (in_u + 1) / n_u)] = 0
    order = np.argsort(-z, kind="stable")[:most]
    return order[z[order] >= least_z]


def _only(rows: Sparse, kept: np.ndarray) -> Sparse:
    """The rows' kept features, numbered by their place in ``kept``."""
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    at = number[rows.bucket]
    before = np.concatenate([[0], np.cumsum(at >= 0)])
    return Sparse(at[at >= 0], rows.value[at >= 0], before[rows.bounds])


def _train(p: Sparse, u: Sparse, n: int, prior: float, steps: int, seed: int, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier by Adam on the non-negative risk.

    Each step takes all positives and unlabelled rows of a bootstrap sample:
    small batches would hold too uncertain a share of positives, and the
    correction would push scores up for nothing.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(n + 1)  # the last one is the bias
    w[n] = np.log(prior / (1 - prior))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    n_p, n_u = len(p.bounds) - 1, len(u.bounds) - 1
    doc_p, at_p, x_p = p.batch(rng.integers(0, n_p, n_p))
    doc_u, at_u, x_u = u.batch(rng.integers(0, n_u, n_u))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for step in range(1, steps + 1):
        z_p = w[n] + np.bincount(doc_p, weights=w[at_p] * x_p, minlength=n_p)
        z_u = w[n] + np.bincount(doc_u, weights=w[at_u] * x_u, minlength=n_u)
        g_p, g_u = -prior * sigmoid(z_p) / n_p, sigmoid(z_u) / n_u
        if np.logaddexp(0, z_u).mean() >= prior * np.logaddexp(0, z_p).mean():
            g_p = g_p - prior * sigmoid(-z_p) / n_p
        else:
            g_p, g_u = -g_p, -g_u
        g = np.bincount(at_p, weights=g_p[doc_p] * x_p, minlength=n + 1) + np.bincount(at_u, weights=g_u[doc_u] * x_u, minlength=n + 1) + decay * w
        g[n] = g_p.sum() + g_u.sum()
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:n], float(w[n])


def fit(train: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 5000, models: int = 3, features: int = 4096, least_z: float = 7.0, least_share: float = 0.6, steps: int = 300, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(weights by model, biases) from training documents and their labels (doc_id, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(4, 2)).select("doc_id", (F.col("toxic") == 1).cast("int").alias("y"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = n_toxic / n if n else 0.0
    if not n_toxic or n_toxic == n:
        return np.zeros((1, 1 << BITS)), np.array([np.log((prior + 1e-9) / (1 - prior + 1e-9))])
    chosen = known.where((F.col("y") == 1) & (unit_hash(F.col("doc_id"), seed) < min(1.0, positives / n_toxic)))
    toxic = train.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the sample's bound
    rest = train.where(unit_hash(F.col("doc_id"), seed + 1) < min(1.0, unlabelled / max(1, train.select("doc_id").count()))).select("text", F.lit(0).alias("y"))
    y, rows = collected(toxic.select("text", "y").unionByName(rest), stems, _weight)
    n_rest = int((y == 0).sum())
    parts = [rows.between(n_rest, len(y)), rows.between(0, n_rest)]
    if min(len(x.bounds) for x in parts) < 2:
        return np.zeros((1, 1 << BITS)), np.array([np.log(prior / (1 - prior))])
    kept = _telling(*parts, prior, least_z, least_share, features)
    own = [_only(x, kept) for x in parts]
    weights, bias = np.zeros((models, 1 << BITS)), np.zeros(models)
    for k in range(models):
        weights[k, kept], bias[k] = _train(*own, len(kept), prior, steps, seed + k)
    return weights, bias


def kept_score(text: Column, weights: np.ndarray, bias: np.ndarray, spark) -> Column:
    """Mean over the models of the sigmoid of bias plus weighted feature values."""
    at = np.flatnonzero(weights.any(axis=0))
    shared = spark.sparkContext.broadcast((at, weights[:, at], bias))  # at most ``features`` columns

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, b = shared.value
        number = np.full(1 << BITS, -1)
        number[at] = np.arange(len(at))
        for batch in batches:
            out = np.zeros(len(batch))
            for s in K.slices(batch):
                row, bucket = stems(s, BITS)
                own = number[bucket]
                key, count = np.unique(row[own >= 0] * (1 << 20) + own[own >= 0], return_counts=True)
                value = _weight(count)
                row, own = key >> 20, key & ((1 << 20) - 1)
                for weight, offset in zip(w, b, strict=True):
                    z = offset + np.bincount(row, weights=weight[own] * value, minlength=s.hi - s.lo)
                    out[s.lo : s.hi] += 1 / (1 + np.exp(-np.clip(z, -35, 35))) / len(b)
            yield pa.array(out)

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights, bias = fit(docs.where(~held_out(4, 2)), labels, **options)
    score = kept_score(F.col("text"), weights, bias, docs.sparkSession)
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), score.alias("score")).select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
